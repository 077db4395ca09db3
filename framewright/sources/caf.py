"""CAF essence. The header is read once; fixed-width packets split into byte ranges at will."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.schemas import PCM


@dataclass(frozen=True)
class CafInfo:
    sample_rate: float
    format_id: str
    flags: int
    packet_bytes: int
    channels: int
    bits: int
    data_offset: int
    data_bytes: int

    @property
    def frames(self) -> int:
        return self.data_bytes // max(1, self.packet_bytes)

    @property
    def is_float(self) -> bool:
        return bool(self.flags & 1)

    @property
    def is_big_endian(self) -> bool:
        return not self.flags & 2


def caf_info(f: BinaryIO, total: int) -> CafInfo:
    """S3: chunks up to the data; a data chunk of unknown size goes to the end of the file."""
    if f.read(4) != b"caff":
        raise ValueError("no CAF file")
    f.read(4)
    desc = None
    while len(head := f.read(12)) == 12:
        kind, size = head[:4], struct.unpack(">q", head[4:])[0]
        if kind == b"desc":
            raw = f.read(size)
            rate, fid, flags, packet, _, channels, bits = struct.unpack(">d4s5I", raw[:32])
            desc = (rate, fid.decode("utf-8", "replace") if fid.isascii() else "?", flags, packet, channels, bits)
        elif kind == b"data":
            if desc is None:
                raise ValueError("data before its description")
            f.read(4)
            at = f.tell()
            return CafInfo(*desc, at, total - at if size < 0 else size - 4)
        elif size < 0:
            raise ValueError("a chunk of unknown size")
        else:
            f.seek(size, 1)
    raise ValueError("no data")


def s24be(raw: bytes) -> np.ndarray:
    """Signed 24-bit big-endian to float32."""
    b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] << 24 | b[:, 1] << 16 | b[:, 2] << 8) >> 8).astype(np.float32) / np.float32(8388608)


class Range(InputPartition):
    def __init__(self, path: str, first: int, packets: int, info: CafInfo):
        self.path, self.first, self.packets, self.info = path, first, packets, info


class CafReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"].removeprefix("file://"), int(options.get("block", 8192))
        self.per_task = int(options.get("packets_per_task", 1 << 22)) // self.block * self.block or self.block

    def partitions(self):
        import os

        with open(self.path, "rb") as f:
            info = caf_info(f, os.path.getsize(self.path))
        if info.is_float or not info.is_big_endian or info.bits != 24:
            raise ValueError("only 24-bit big-endian integers")
        return [Range(self.path, at, min(self.per_task, info.frames - at), info) for at in range(0, info.frames, self.per_task)]

    def read(self, partition: Range) -> Iterator[tuple]:
        i = partition.info
        with open(partition.path, "rb") as f:
            f.seek(i.data_offset + partition.first * i.packet_bytes)
            for at in range(partition.first, partition.first + partition.packets, self.block):
                n = min(self.block, partition.first + partition.packets - at)
                yield at, i.channels, f.read(n * i.packet_bytes)


class CafSource(DataSource):
    """``spark.read.format("caf_pcm").load(path)``: blocks of packets ``(block_start, channels, pcm)``."""

    @classmethod
    def name(cls) -> str:
        return "caf_pcm"

    def schema(self) -> str:
        return PCM

    def reader(self, schema) -> CafReader:
        return CafReader(self.options)
