"""Elementary streams in two phases: an index of headers per file, then byte ranges read in parallel."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.operators.frames import header, scan, scanned
from framewright.schemas import FRAME

CHUNK = 4 << 20


def chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while data := f.read(size):
            yield data


def index(path: str, per_task: int = 1000, size: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """(first frame, offset, bytes, frames) of runs of frames; one sequential pass that keeps no frame's bytes."""
    out: list[tuple[int, int, int, int]] = []
    n = 0
    for off, ok, data in scan(chunks(path, max(8, size))):
        if not ok:
            continue
        if n % per_task == 0:
            out.append((n, off, 0, 0))
        first, start, _, count = out[-1]
        out[-1] = (first, start, off + len(data) - start, count + 1)
        n += 1
    return out


class Run(InputPartition):
    def __init__(self, path: str, first: int, offset: int, size: int):
        self.path, self.first, self.offset, self.size = path, first, offset, size


class StreamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task = options["path"].removeprefix("file://"), int(options.get("frames_per_task", 1000))
        self.lo, self.hi = int(options.get("frame_start", 0)), int(options.get("frame_end", 1 << 62))

    def partitions(self):
        return [Run(self.path, first, off, size) for first, off, size, n in index(self.path, self.per_task) if first + n > self.lo and first < self.hi]

    def read(self, p: Run) -> Iterator[tuple]:
        sid, n = os.path.basename(p.path), p.first
        with open(p.path, "rb") as f:
            f.seek(p.offset)
            for off, ok, data in scan(iter([f.read(p.size)]), p.offset):
                if not ok:
                    continue
                if self.lo <= n < self.hi:
                    h = header(data)
                    yield sid, n, off, h.size, h.strmtyp, h.substreamid, h.blocks, h.fscod, h.sample_rate, h.acmod, h.lfe, h.bsid, data
                n += 1


class StreamSource(DataSource):
    """``spark.read.format("frames").option("frame_start", ...).load(path)``: the frames of a file on a shared disk."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Many streams, one row of pieces each, from any store that Spark reads (a file of up to 2 GB)."""
    return scanned(spark.read.format("binaryFile").load(path).selectExpr("path AS stream_id", "content AS data"))
