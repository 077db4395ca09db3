"""Embedding near-duplicates by collision-counting projections.

A table sorts the vectors by the cells of twelve one-dimensional random projections; a vector's query-centred windows
reach over the nearest cell borders, so it looks into eight cells per table. Pairs that meet are
counted over 32 further projections: a collision is a difference within the window, and pairs with at least
PASS collisions are verified by the cosine in double precision. WIDTH, TABLES, WINDOW and PASS are calibrated so
that pairs at cosine 0.9 exactly are found with probability 0.98 or more (tests/llm measures it); nearer pairs
are found almost surely. Copies are one point with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import components, group_sums, spans, table, written

COSINE = 0.9
TABLES, PER_TABLE, WIDTH, REACH = 9, 12, 2.0, 3
COUNTED, WINDOW, PASS = 32, 0.6, 19
SEED = 20_240_601
#: Differences of sketches are in steps of this.
STEP = 1 / 24


def directions(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dims])
    return rng.normal(size=(dims, TABLES * PER_TABLE)), rng.uniform(0, WIDTH, TABLES * PER_TABLE), rng.normal(size=(dims, COUNTED))


def _key(cells: np.ndarray, t: int, dims: int) -> np.ndarray:
    h = np.full(len(cells), (np.uint64(dims) << np.uint64(8)) ^ np.uint64(t))
    for j in range(cells.shape[1]):
        h = (h ^ (cells[:, j].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells that each unit vector looks into, (rows, TABLES * 2**REACH), the first of each 2**REACH its own; and its sketch."""
    a, shift, b = directions(x.shape[1])
    place = (x @ a + shift) / WIDTH
    keys = []
    rows = np.arange(len(x))
    for t in range(TABLES):
        p = place[:, t * PER_TABLE : (t + 1) * PER_TABLE]
        cell = np.floor(p).astype(np.int64)
        f = p - cell
        near = np.argsort(np.minimum(f, 1 - f), axis=1)[:, :REACH]
        step = np.where(f < 0.5, -1, 1)
        for chosen in product((0, 1), repeat=REACH):
            c = cell.copy()
            for k, on in enumerate(chosen):
                if on:
                    c[rows, near[:, k]] += step[rows, near[:, k]]
            keys.append(_key(c, t, x.shape[1]))
    sketch = np.clip(np.rint((x @ b) / STEP), -127, 127).astype(np.int8)
    return np.stack(keys, axis=1), sketch


def usable(vector: str):
    """Whether an array column can link: not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.diff(b.column("v").offsets.to_numpy())
        flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(sizes) - sizes
        ids = b.column("cid").to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            for lo in range(0, len(rows), 2000):
                part = rows[lo : lo + 2000]
                x = flat[first[part][:, None] + np.arange(dims)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                keys, sketch = windows(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                per = keys.shape[1]
                owner = np.repeat(np.arange(len(part)), per)
                home = np.tile(np.arange(per) % 2**REACH == 0, len(part))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COUNTED), len(owner), [None, pa.py_buffer(np.ascontiguousarray(sketch[owner]))])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids[part][owner]), raw.cast(pa.binary()), pa.array(home)], names=["key", "cid", "sketch", "home"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their cell: pairs of (home, visitor) with enough collisions. Only the cell a batch ends in is carried on."""
    reach = round(WINDOW / STEP)

    def pairs(key, cid, sketch, home) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        group = np.repeat(np.arange(len(starts)), size)
        h = np.flatnonzero(home & (size[group] > 1))
        width = np.cumsum(size[group[h]])
        at = 0
        while at < len(h):  # about a million pairs at a time, however large a cell is
            to = max(at + 1, int(np.searchsorted(width, (width[at - 1] if at else 0) + 1_000_000)))
            part = h[at:to]
            own, k = spans(size[group[part]])
            x, y = part[own], starts[group[part]][own] + k
            ok = cid[x] != cid[y]
            x, y = x[ok], y[ok]
            hits = np.zeros(len(x), dtype=np.int16)
            for j in range(COUNTED):
                hits += np.abs(sketch[x, j].astype(np.int16) - sketch[y, j]) <= reach
            ok = hits >= PASS
            a, b = cid[x[ok]], cid[y[ok]]
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            at = to

    held: list[tuple] = []
    for b in batches:
        if not len(b):
            continue
        key = b.column("key").to_numpy(zero_copy_only=False)
        sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.int8).reshape(-1, COUNTED)
        held.append((key, b.column("cid").to_numpy(zero_copy_only=False), sk, b.column("home").to_numpy(zero_copy_only=False)))
        if key[0] == key[-1] and held[0][0][0] == key[-1]:
            continue
        every = [np.concatenate([x[i] for x in held]) for i in range(4)]
        last = int(np.flatnonzero(every[0] != key[-1])[-1]) + 1
        yield from pairs(*(x[:last] for x in every))
        held = [tuple(x[last:] for x in every)]
    if held:
        yield from pairs(*(np.concatenate([x[i] for x in held]) for i in range(4)))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), strict=True):
            if len(x) != len(y):
                keep.append(False)
                continue
            p, q = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
            p, q = p / np.abs(p).max(), q / np.abs(q).max()
            keep.append(bool(p @ q >= COSINE * np.sqrt((p @ p) * (q @ q))))
        yield b.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def linked(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component.
    Vectors of different lengths do not link. A row with a null id links, but gives no component its name.
    Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", "v", F.when(usable("v"), F.xxhash64("v")).alias("cid"))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = written(classes.withColumn("v", F.col("v").cast("array<float>") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("v")), "classes")
    looks = classes.select("cid", "v").mapInArrow(_look, "key long, cid long, sketch binary, home boolean")
    pairs = looks.repartition("key").sortWithinPartitions("key").mapInArrow(_count, "a long, b long").distinct()
    va, vb = (classes.select(F.col("cid").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    links = written(pairs.join(va, "a").join(vb, "b").mapInArrow(_verify, "a long, b long"), "links")
    found = components(links)
    both = links.select(F.col("a").alias("cid"), F.col("b").alias("peer")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("peer")))
    degree = both.join(classes.select(F.col("cid").alias("peer"), "n"), "peer").groupBy("cid").agg(F.sum("n").alias("others"))
    named = classes.drop("v").join(degree, "cid", "left").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    named = written(named.select("cid", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = written(named.join(lowest, "root").select("cid", "n_links", "component_id"), "by-class")
    plain = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("cid is not null").select("vec_id", "cid").join(by_class, "cid").select("vec_id", "n_links", "component_id").unionByName(plain)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
