"""Near copies by the Jaccard similarity of word shingles: min-hash bands find candidates, exact Jaccard decides.

A text's set is the XXH64 of its five-word shingles (of all its words if it has fewer). BANDS fingerprints of ROWS
minima each: sets at similarity s share a fingerprint with probability 1 - (1 - s^ROWS)^BANDS (0.998 at 0.8). Texts with equal sets are one
point. Buckets with the same points are compared once, and each point of a bucket with every other one that is
not yet linked with it; only links that span a bucket's groups are sent. Large buckets are split into blocks by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import components, dropped, filter_of, maybe, one_each, packed, text_key, written
from framewright.llm.simhash import fingerprints, links, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 5
#: A bucket with more points, or more shingles in all, than this is dealt out in blocks.
BLOCK, MOST = 4_000, 1 << 20
_A = np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t or b"", SHINGLE), dtype=np.uint64)) for t in texts]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A point (signed, 0 for no words) and BANDS fingerprints per set; those of an empty set mean nothing."""
    points = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], dtype=np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for band in range(BANDS):
            k = np.full(len(full), band + 1, dtype=np.uint64) * _P
            for a in _A[band * ROWS : (band + 1) * ROWS]:
                k = (k ^ np.minimum.reduceat(flat * a, first)) * _P
                k ^= k >> np.uint64(31)
            keys[full, band] = k
    return points.view(np.int64), keys.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], prints: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 200):
            part = b.slice(lo, 200)
            raws = part.column("raw").to_pylist()
            sets = shingle_sets(raws)
            points, keys = sketches(sets)
            fps = pa.array(fingerprints(raws).view(np.int64)) if prints else pa.nulls(len(raws), pa.int64())
            lists = pa.array([k.tolist() if len(s) else [] for s, k in zip(sets, keys, strict=True)], type=pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h", "g")), pa.array(points), fps, sizes, lists], names=["doc_id", "h", "g", "point", "fp", "size", "keys"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points with their sets; 32 bits of a shingle tell it from a text's others."""
    for b in batches:
        for lo in range(0, len(b), 200):
            sets = shingle_sets(b.column("raw").slice(lo, 200).to_pylist())
            points, _ = sketches(sets)
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array([np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets], type=pa.binary())], names=["point", "members"])


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places at Jaccard SIMILAR or more that connect all that such pairs connect: fewer than the sets."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if n >= SIMILAR * (len(sets[0]) + len(sets[1]) - n) else []
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has = np.zeros(int(code.max()) + 1, dtype=np.int64)
    label, out, left = np.arange(len(sets)), [], len(sets)
    for i in range(len(sets)):
        if left == 1:
            break
        own = code[first[i] : first[i] + size[i]]
        has[own] = 1
        n = np.add.reduceat(has[code], first)
        has[own] = 0
        near = np.flatnonzero((n >= SIMILAR * (size + size[i] - n)) & (label != label[i]))
        names, at = np.unique(label[near], return_index=True)
        out += [(i, int(j)) for j in near[at]]
        left -= len(names)
        label[np.isin(label, names)] = label[i]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their bucket and blocks: the links of each. One is held at a time."""
    key, points, sets = None, [], []

    def held() -> list[tuple[int, int]]:
        return [(points[i], points[j]) for i, j in spanning(sets)] if len(sets) > 1 else []

    for b in batches:
        found = []
        for k, p, m in zip(zip(*(b.column(c).to_pylist() for c in ("key", "i", "j")), strict=True), b.column("point").to_pylist(), b.column("members").to_pylist(), strict=True):
            if k != key:
                found += held()
                key, points, sets = k, [], []
            points.append(p), sets.append(np.frombuffer(m, dtype="<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])
    found = held()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def _by_fingerprint(pairs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect the points ``(point, fp)`` whose fingerprints ``simhash`` links."""
    prints = written(pairs.select("fp").distinct(), "prints")  # each goes to many anchors: not packed
    found = components(links(prints))
    named = pairs.join(found, F.col("fp") == F.col("node"), "left").select("point", F.coalesce("component", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("point").alias("b"))
    edges = written(named.join(least, "group").where("point <> b").select(F.col("point").alias("a"), "b"), "by-print")
    dropped(prints)
    return edges


def _grouped(docs: DataFrame, prints: bool = False) -> DataFrame:
    """``(doc_id, h, g, point, component_id, root)``: ``text_key`` and the group, too. With ``prints`` what ``simhash`` links is linked, too."""
    texts = docs.select(F.col("doc_id").cast("long"), *text_key(), F.col("text").cast("binary").alias("raw"))
    rows = written(texts.mapInArrow(lambda batches: _sketched(batches, prints), "doc_id long, h long, g long, point long, fp long, size long, keys array<long>"), "sketches")
    most = rows.count()
    points = written(packed(rows.groupBy("point").agg(F.min("doc_id").alias("low"), F.min("size").alias("size"), F.min("keys").alias("keys")), most), "points")
    visits = points.select("point", "low", "size", F.explode("keys").alias("key"))
    buckets = visits.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("point")).alias("who")).where("n > 1")
    buckets = buckets.groupBy("n", "size", "who").agg(F.min("key").alias("key"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / MOST)))
    buckets = buckets.select("key", blocks.cast("int").alias("c"))
    met = written(visits.drop("size").join(buckets, "key"), "buckets")
    wanted = met.select("point", "low").distinct()
    lows = wanted.where("low is not null").select(F.col("low").alias("doc_id")).distinct()
    named = maybe(texts.where("doc_id is not null"), filter_of(lows, "doc_id"), "doc_id").where("maybe").join(lows.hint("merge"), "doc_id", "left_semi").select("raw")
    found = named.unionByName(texts.where("doc_id is null").select("raw")).mapInArrow(_members, "point long, members binary")
    found = written(found.groupBy("point").agg(F.min("members").alias("members")), "members")
    # a point of block p meets block q in the group (p, q) of the two, the lower one first
    mine = F.pmod(F.xxhash64("point"), F.col("c")).cast("int")
    dealt = met.select("key", "point", mine.alias("p"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("q"))
    dealt = dealt.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "point")
    edges = dealt.join(found, "point").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked, "a long, b long")
    if prints:
        pairs = written(packed(rows.select("point", "fp").distinct(), most), "pairs")
        more = _by_fingerprint(pairs)
        edges = edges.unionByName(more)
    joined = components(edges)
    if prints:
        dropped(pairs), dropped(more)
    roots = points.join(joined, F.col("point") == F.col("node"), "left").select("point", "low", F.coalesce("component", "point").alias("root"))
    roots = written(packed(roots, most), "roots")
    lowest_ids = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    by_point = written(packed(roots.join(lowest_ids, "root").select("point", "component_id", "root"), most), "by-point")
    for old in (points, met, found, roots):
        dropped(old)
    return rows.join(by_point, "point").select("doc_id", "h", "g", "point", "component_id", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, point, component_id)`` per row of ``docs``: texts that links at SIMILAR connect share a component.

    Texts without words (null ones, too) are one group. Texts are taken whole. Ids, repeated rows, empty tables and other
    columns as in ``simhash.grouped``.
    """
    return _grouped(docs).select("doc_id", "point", "component_id")


def first_of_each(docs: DataFrame, prints: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document per group, as ``one_each`` chooses.

    With ``prints`` texts whose fingerprints ``simhash`` links are in one group, too, and so are those that both kinds of links connect.
    """
    return one_each(docs, _grouped(docs, prints))
