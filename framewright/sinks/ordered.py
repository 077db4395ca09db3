"""K1 to K4: ordered binary sinks. Pieces are range-sorted and come to the writer one partition at a time."""

from __future__ import annotations

import struct
from typing import BinaryIO

from pyspark.sql import DataFrame


def wav_header(channels: int, rate: int, frames: int) -> bytes:
    """K1: 32-bit float WAV; four gigabytes or more can't be written."""
    size = frames * channels * 4
    if size + 50 >= 1 << 32:
        raise ValueError("too long for WAV; write raw samples")
    fmt = struct.pack("<HHIIHHH", 3, channels, rate, rate * channels * 4, channels * 4, 32, 0)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 12 + 8 + size) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", size)


def write_ordered(df: DataFrame, order: str, column: str, out: BinaryIO) -> int:
    """K3, K4: the pieces in order; returns the bytes written. The driver holds a partition of pieces at most."""
    n = 0
    pieces = df.select(order, column).repartitionByRange(order).sortWithinPartitions(order)
    for r in pieces.toLocalIterator():
        n += out.write(r[column])
    return n


def write_wav(df: DataFrame, order: str, column: str, path: str, channels: int, rate: int, frames: int) -> int:
    with open(path, "wb") as f:
        f.write(wav_header(channels, rate, frames))
        return write_ordered(df, order, column, f)


def write_raw(df: DataFrame, order: str, column: str, path: str) -> int:
    """K2: samples alone, of any length."""
    with open(path, "wb") as f:
        return write_ordered(df, order, column, f)
