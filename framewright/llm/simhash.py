"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints at 4 or fewer differing bits differ in at most 2 bits in one half. Each half's
anchors are the words of a covering code: Golay [23,12] (perfect, radius 3) + Hamming [7,4] (perfect,
radius 1) + 2 bits as they are, 2^18 anchors. A fingerprint's home is its one anchor within the radii;
it visits every anchor within the radii plus the threshold of 2. So two linked fingerprints meet at the
home of either, and only homes are compared with visitors, anchor by anchor. Copies share a fingerprint and
are one point. An anchor emits links that span its groups, never all pairs of a group; anchors with very many homes
are split into blocks of homes by blocks of visitors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import components, dropped, group_sums, one_each, packed, spans, table, text_key, written

SHINGLE = 4
DISTANCE = 4
HALF = 2  # of DISTANCE falls on one half at most
#: An anchor with more homes than this is dealt out in blocks.
BLOCK = 20_000
#: Anchors with at most this many pairs are compared at one stroke.
SMALL = 4096

# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(raw: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle of a text, repeats included."""
    words = raw.lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(flat, 42)]
    view, hashed = memoryview(flat), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(sizes + 1) - 1
    start = end - sizes
    return [hashed(view[a:b], 42) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """A uint64 per text; bit i is set if it is set in over half of the shingle hashes. No words: 0."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hold: list[tuple[int, list[int]]] = []
    held = 0

    def settle() -> None:
        counts = np.array([len(h) for _, h in hold])
        flat = np.fromiter((x for _, h in hold for x in h), dtype=np.uint64, count=int(counts.sum()))
        ones = np.zeros((len(hold), 64), dtype=np.int64)
        owner = np.repeat(np.arange(len(hold)), counts)
        for lo in range(0, len(flat), 65536):  # bounded, however long a text is
            bits = np.unpackbits(flat[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
            part = owner[lo : lo + 65536]
            ones[part[0] : part[-1] + 1] += group_sums(bits, np.bincount(part - part[0]))
        packed = np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
        out[[i for i, _ in hold]] = packed

    for i, raw in enumerate(texts):
        h = shingle_hashes(raw or b"", k)
        if h:
            hold.append((i, h))
            held += len(h)
        if held > 200_000:
            settle()
            hold, held = [], 0
    if hold:
        settle()
    return out


def fingerprinted(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, h, g, fp)`` per row of ``docs``: ``text_key``, and fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h", "g")), pa.array(fingerprints(part.column("raw").to_pylist(), k).view(np.int64))], names=["doc_id", "h", "g", "fp"])

    return docs.select(F.col("doc_id").cast("long"), *text_key(), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, h long, g long, fp long")


# -- the covering code ----------------------------------------------------------------------------


def _syndrome(v: np.ndarray, poly: int, n: int, r: int) -> np.ndarray:
    """Remainder of the n-bit polynomials v modulo a generator of degree r."""
    v = v.astype(np.int64)
    for i in range(n - 1, r - 1, -1):
        v = np.where((v >> i) & 1, v ^ (poly << (i - r)), v)
    return v


def _cosets(n: int, poly: int, r: int, radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By excess e = 0..HALF over the radius: words of weight <= radius + e in each coset, as (words, first, count) by syndrome."""
    words = np.array([sum(1 << i for i in c) for w in range(radius + HALF + 1) for c in combinations(range(n), w)], dtype=np.int64)
    excess = np.maximum(0, np.bitwise_count(words).astype(int) - radius)
    out = []
    for e in range(HALF + 1):
        part = words[excess == e]
        s = _syndrome(part, poly, n, r)
        part = part[np.argsort(s, kind="stable")]
        count = np.bincount(s, minlength=1 << r)
        out.append((part, np.cumsum(count) - count, count))
    return out


@lru_cache(maxsize=1)
def code():
    golay = _cosets(23, 0b101011100011, 11, 3)
    hamming = _cosets(7, 0b1011, 3, 1)
    plain = [np.array(v, dtype=np.int64) for v in ((0,), (1, 2), (3,))]
    return golay, hamming, plain, _syndrome(np.arange(1 << 23), 0b101011100011, 23, 11).astype(np.int16), _syndrome(np.arange(1 << 7), 0b1011, 7, 3)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, home) for every anchor that each fingerprint visits, of both halves."""
    golay, hamming, plain, sg, sh = code()
    keys, rows, homes = [], [], []
    for half in (0, 1):
        y = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        g, h, p = y & 0x7FFFFF, (y >> 23) & 0x7F, y >> 30
        s, t = sg[g].astype(np.int64), sh[h]
        for eg in range(HALF + 1):
            for eh in range(HALF + 1 - eg):
                for ep in range(HALF + 1 - eg - eh):
                    (gw, gf, gc), (hw, hf, hc), pw = golay[eg], hamming[eh], plain[ep]
                    n = gc[s] * hc[t] * len(pw)
                    row, k = spans(n)
                    a = k // (hc[t][row] * len(pw))
                    rest = k - a * (hc[t][row] * len(pw))
                    b, c = rest // len(pw), rest % len(pw)
                    word = (g[row] ^ gw[gf[s][row] + a]) >> 11, (h[row] ^ hw[hf[t][row] + b]) >> 3, p[row] ^ pw[c]
                    keys.append((half << 18) | (word[0] << 6) | (word[1] << 2) | word[2])
                    rows.append(row)
                    homes.append(np.full(len(row), eg + eh + ep == 0) & _is_home(gw, gf, s, row, a, hw, hf, t, b, 3, 1))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _is_home(gw, gf, s, row, a, hw, hf, t, b, rg, rh) -> np.ndarray:
    return (np.bitwise_count(gw[gf[s][row] + a]) <= rg) & (np.bitwise_count(hw[hf[t][row] + b]) <= rh)


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 5000):
            fps = b.column("fp").slice(lo, 5000).to_numpy(zero_copy_only=False)
            key, row, home = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fps[row]), pa.array(home)], names=["anchor", "fp", "home"])


# -- comparing at the anchors ---------------------------------------------------------------------


def spanning(homes: np.ndarray, visitors: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (home, visitor) at ``most`` or fewer bits that connect all that such links connect: fewer than the points."""
    points = np.unique(np.concatenate([homes, visitors]))
    label = np.arange(len(points))
    a, b = [], []
    for h in np.unique(homes):
        near = np.flatnonzero(np.bitwise_count(points ^ h) <= most)
        names, first = np.unique(label[near], return_index=True)
        if len(names) > 1:
            own = label[np.searchsorted(points, h)]
            for name, at in zip(names, first, strict=True):
                if name != own:
                    a.append(h), b.append(points[near[at]])
            if len(names) > 64:
                low = np.zeros(len(points), dtype=bool)
                low[names] = True
                label[low[label]] = own
            else:
                label[np.isin(label, names)] = own
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their group: links of each group. Only the group that a batch ends in is carried on."""
    held: list[list[np.ndarray]] = []

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[starts, len(key)])
        nh = group_sums(home.astype(np.int64), size)
        small = (nh > 0) & (nh * size <= SMALL)
        group = np.repeat(np.arange(len(starts)), size)
        ra, rb = [], []
        h = np.flatnonzero(home & small[group])
        for lo in range(0, len(h), 20_000):
            part = h[lo : lo + 20_000]
            own, k = spans(size[group[part]])
            x, y = fp[part[own]], fp[starts[group[part]][own] + k]
            hit = (x != y) & (np.bitwise_count(x ^ y) <= DISTANCE)
            ra.append(x[hit]), rb.append(y[hit])
        for g in np.flatnonzero((nh > 0) & ~small):
            at = slice(starts[g], starts[g] + size[g])
            x, y = spanning(fp[at][home[at]], fp[at])
            ra.append(x), rb.append(y)
        x, y = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (ra, rb))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x.view(np.int64), y.view(np.int64))), pa.array(np.minimum(x.view(np.int64), y.view(np.int64)))], names=["a", "b"])

    for b in batches:
        if not len(b):
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        held.append([key, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("home").to_numpy(zero_copy_only=False)])
        if np.all(key[0] == key[-1]) and np.all(held[0][0][0] == key[-1]):
            continue
        key, fp, home = (np.concatenate([x[i] for x in held]) for i in range(3))
        last = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1
        yield links(key[:last], fp[:last], home[:last])
        held = [[key[last:], fp[last:], home[last:]]]
    if held:
        yield links(*(np.concatenate([x[i] for x in held]) for i in range(3)))


def links(points: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct long fingerprints ``fp`` that span all groups linked at DISTANCE bits."""
    visits = points.mapInArrow(_visit, "anchor int, fp long, home boolean")
    # anchors with very many homes, at most one per BLOCK / 2 fingerprints, are split into blocks by blocks
    busy = points.mapInArrow(_homes, "anchor int").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    busy = written(busy.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("c")), "busy")
    cuts = F.coalesce(F.col("c"), F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    dealt = visits.join(busy, "anchor", "left").withColumn("mine", mine) if busy.take(1) else visits.withColumns({"c": F.lit(1), "mine": F.lit(0)})
    dealt = dealt.select("anchor", "fp", "home", "mine", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other")) if busy.take(1) else dealt.withColumn("other", F.lit(0))
    # a row is a home in the blocks (mine, *) and a visitor in the blocks (*, mine)
    as_home = dealt.where("home").select("anchor", F.col("mine").alias("i"), F.col("other").alias("j"), "fp", F.lit(True).alias("home"))
    as_visitor = dealt.select("anchor", F.col("other").alias("i"), F.col("mine").alias("j"), "fp", F.lit(False).alias("home"))
    if not busy.take(1):
        both = dealt.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    else:
        both = as_home.unionByName(as_visitor)
    return both.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_meet, "a long, b long")


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        golay, hamming, _, sg, sh = code()
        for half in (0, 1):
            y = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            g, h, p = y & 0x7FFFFF, (y >> 23) & 0x7F, y >> 30
            g, h = g ^ golay[0][0][golay[0][1][sg[g].astype(np.int64)]], h ^ hamming[0][0][hamming[0][1][sh[h]]]
            yield pa.RecordBatch.from_arrays([pa.array(((half << 18) | ((g >> 11) << 6) | ((h >> 3) << 2) | p).astype(np.int32))], names=["anchor"])


def _grouped(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, h, g, fp, component_id, root)``: ``text_key`` and the group, too."""
    rows = written(fingerprinted(docs, k), "fingerprints")
    most = rows.count()
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")  # each goes to many anchors: not packed
    found = components(links(points.select("fp")))
    named = points.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = written(packed(named, most), "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = written(packed(named.join(lowest, "root").select("fp", "component_id", "root"), most), "by-fp")
    for old in (points, named):
        dropped(old)
    return rows.join(by_fp, "fp").select("doc_id", "h", "g", "fp", "component_id", "root")


def grouped(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; a null id is a row of its own group's members
    but never a component's id unless the whole component has none. Rows that repeat get equal results. Texts are taken whole, however
    long; other columns are ignored; no rows give no rows.
    """
    return _grouped(docs, k).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document per group, as ``one_each`` chooses."""
    return one_each(docs, _grouped(docs, k))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
