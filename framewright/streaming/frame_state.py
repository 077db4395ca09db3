"""ST1, ST3: frames of streams that arrive in pieces. State per stream: the unfinished tail, frames and samples so far."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators.frames import Header, header, scan

OUTPUT = "stream_id string, frame_idx long, offset long, start long, size int, bytes binary"
STATE = "tail binary, offset long, frames long, samples long"


def frames_of(pieces: DataFrame, f: Callable[[Header, int, bytes], bytes | None] | None = None) -> DataFrame:
    """Frames of a stream of ``(stream_id, seq, data)``, as soon as each is whole; ``f`` may rewrite them.

    Pieces of a micro-batch are taken in order of ``seq``. ``start`` is the first sample; only independent frames move on.
    """

    def step(key: tuple, batches, state: GroupState):
        tail, offset, n, samples = state.get if state.exists else (b"", 0, 0, 0)
        got = pd.concat(list(batches)).sort_values("seq")
        rows = []
        data = bytes(tail) + b"".join(map(bytes, got["data"]))
        rest, end = b"", offset + len(data)
        for off, ok, piece in scan(iter([data]), offset):
            if ok:
                h = header(piece)
                new = f(h, n, piece) if f else None
                rows.append((key[0], n, off, samples, h.size, piece if new is None else new))
                n += 1
                samples += h.samples if h.strmtyp == 0 else 0
            elif off + len(piece) == end and (piece[:2] == b"\x0b\x77" or piece == b"\x0b"):
                rest = piece
            elif off + len(piece) == end and piece.endswith(b"\x0b"):
                rest = b"\x0b"
        state.update((rest, end - len(rest), n, samples))
        yield pd.DataFrame(rows, columns=["stream_id", "frame_idx", "offset", "start", "size", "bytes"])

    return pieces.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
