"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark; their document frequencies come from the passages of all documents. A
distributed randomised SVD of the TF-IDF rows (the passages of all documents, cut into terms once, and as heavy as these all items) gives the
latent space. Every passage of every document is a query: items with enough cosine are candidates, which are
checked by the longest common subsequence of words and, for looser paraphrases, by whether the item's answer
(its last words) is there. Items of common words, as of a passage that many documents hold, have little or nothing in that
space: they are checked wherever enough of their words, common ones too, are close together. Documents are scanned in place; nothing of them is shuffled but sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import dropped, group_sums, spans, table, written

#: The step between passages, in words, and the words of a passage.
STEP = 32
PASSAGE = 2 * STEP
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: Distinct words of the items of an index at most (items with more are halved until they fit).
MAX_TERMS = 65_536
#: Terms in more than this share of passages have no part in the latent space. Items that keep fewer than LEAST distinct
#: terms, or less than KEPT of theirs, are also searched for word by word.
COMMON, LEAST, KEPT = 0.02, 8, 0.4
COSINE = 0.4
#: Share of an item's terms (of those that fit a passage) that a candidate's passage must have.
SHARED = 0.4
#: Shares of an item's words, in order, that make a copy, and that make a paraphrase if the answer is there, too.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 5
#: Words of a part of an item at most; longer items are cut, and a document that holds a part holds the item.
MOST = 2 * PASSAGE
#: Items that are held against the documents in one pass.
ITEMS = 50_000
#: Cosines that are held at a time.
CELLS = 1 << 22


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case, a sigma being one letter at the end of a word, too."""
    return Words(pa.array([text], type=pa.string())).of(0) if text else []


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: list[str], b: list[str]) -> float:
    """Cosine of the word counts of two texts."""
    x, y = Counter(a), Counter(b)
    return float(sum(n * y[w] for w, n in x.items()) / np.sqrt(float(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))))


class Words:
    """The words of a batch of texts, cut by Arrow: ``first`` has where each text begins in the run of all words (and the end)."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN_]+")
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        self.words = flat.filter(full)
        self.first = np.r_[0, np.cumsum(group_sums(full.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())))]
        self._split: dict[int, list[str]] = {}

    def among(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places and numbers of the words that are terms."""
        code = pc.fill_null(pc.index_in(self.words, terms), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(code >= 0)
        return at, code[at]

    def of(self, text: int) -> list[str]:
        if text not in self._split:
            self._split[text] = self.words.slice(self.first[text], self.first[text + 1] - self.first[text]).to_pylist()
        return self._split[text]


def parts_of(words: list[str]) -> list[list[str]]:
    """An item in even parts of MOST words or fewer: a passage that is much shorter than what it is held against looks like nothing of it."""
    n = max(1, -(-len(words) // MOST))
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


@dataclass
class Index:
    names: pa.Array  # the terms
    vectors: np.ndarray  # term x rank, with idf
    items: np.ndarray  # item part x rank, unit length
    ids: list[int | None]
    item: list[int]  # of each part: the place of its item's id
    last: list[bool]  # whether the part ends in the item's answer
    words: list[list[str]]
    sets: list[frozenset[int]]
    weak: list[int]  # parts that are also searched for word by word

    def passages(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of all texts: which text each passage with terms is of, its first word, its unit vector and its terms."""
        first, (at, term) = words.first, words.among(self.names)
        size = np.diff(first)
        strides = -(-size // STEP)  # a passage is two strides; a text of one stride is a passage
        text, nth = spans(strides)
        edge = np.searchsorted(at, np.r_[first[text] + nth * STEP, first[-1]])
        sums = np.zeros((len(text), self.vectors.shape[1]), dtype=np.float32)
        for a in range(0, len(text), 4096):  # bounded, however long a text is
            cut = edge[a : a + 4097]
            sums[a : a + 4096] = group_sums(self.vectors[term[cut[0] : cut[-1]]], np.diff(cut))
        owner, k = spans(np.where(size > 0, np.maximum(1, strides - 1), 0))
        begin = first[owner] + k * STEP
        stride = (np.cumsum(strides) - strides)[owner] + k
        more = (strides[owner] > k + 1).astype(np.int64)
        lo, hi = edge[stride], edge[stride + 1 + more]
        some = hi > lo
        owner, begin, stride, more, lo, hi = owner[some], begin[some], stride[some], more[some], lo[some], hi[some]
        out = sums[stride]
        out[more > 0] += sums[stride[more > 0] + 1]
        length = np.sqrt(np.einsum("ij,ij->i", out, out))
        ok = np.flatnonzero(length > 1e-6)
        return owner[ok], begin[ok] - first[owner[ok]], out[ok] / length[ok][:, None], [term[lo[i] : hi[i]] for i in ok]

    def matches(self, texts: pa.Array) -> list[list[tuple]]:
        """Per text, one (item id, cosine, overlap, answer, first word, words) for each item that it holds: the best of the item's parts."""
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        for lo in range(0, len(texts), 200):
            words = Words(texts.slice(lo, 200))
            owner, start, vec, terms = self.passages(words)
            best: dict[tuple[int, int], tuple] = {}

            def seen(o: int, i: int, got: tuple, cosine: float, best: dict = best) -> None:
                if best.get((o, self.item[i])) is None or got[0] > best[o, self.item[i]][1]:
                    best[o, self.item[i]] = (cosine, *got)

            step = max(16, min(4096, CELLS // len(self.items)))
            for a in range(0, len(vec), step):
                cos = vec[a : a + step] @ self.items.T
                for r, i in zip(*np.nonzero(cos >= COSINE), strict=True):
                    have = self.sets[i]
                    if len(have.intersection(terms[a + r].tolist())) < SHARED * len(have) * min(1.0, PASSAGE / len(self.words[i])):
                        continue
                    o = int(owner[a + r])
                    got = self.check(words.of(o), int(start[a + r]), self.words[i], self.last[i])
                    if got:
                        seen(o, i, got, float(cos[r, i]))
            for o, i, at in self.dense(words):
                got = self.check(words.of(o), at, self.words[i], self.last[i])
                if got:
                    seen(o, i, got, alike(self.words[i], words.of(o)[got[2] : got[2] + got[3]]))
            for (o, k), x in sorted(best.items()):
                found[lo + o].append((self.ids[k], *x))
        return found

    def dense(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item part, first word) of the places in all texts with enough words of a weak part for ``check``, common ones too."""
        if not self.weak:
            return
        named = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(self.words[i] for i in self.weak)))}
        first, (at, code) = words.first, words.among(pa.array(list(named)))
        for i in self.weak:
            n = len(self.words[i])
            own = np.zeros(len(named), dtype=bool)
            own[[named[w] for w in self.words[i]]] = True
            here = at[own[code]]  # the words of the part, in the run of all words
            need = max(1, int(np.ceil(PARAPHRASE * n - 1e-9)))
            if len(here) < need:
                continue
            a, b = here[: len(here) - need + 1], here[need - 1 :]
            owner = np.searchsorted(first, a, side="right") - 1
            ok = (b - a < n + n // 3 + 2) & (b < first[owner + 1])
            for o, k in np.unique(np.stack([owner[ok], (a - first[owner])[ok] // STEP], axis=1), axis=0).tolist():
                yield o, i, k * STEP

    @staticmethod
    def check(words: list[str], start: int, item: list[str], ends: bool = True) -> tuple | None:
        """(overlap, answer, first word, words) of the best stretch around a passage, if it is a copy or a paraphrase of a part that ``ends`` in the answer."""
        n = len(item)
        stretch = n + n // 3 + 2
        lo, hi = max(0, start - stretch), min(len(words), start + PASSAGE + stretch)
        known = set(item)
        run = np.cumsum([0, *(w in known for w in words[lo:hi])])
        span = min(stretch, hi - lo)
        dense = run[span:] - run[: len(run) - span]
        if dense.max() < PARAPHRASE * n:
            return None
        at = lo + int((dense.argmax() + len(dense) - 1 - dense[::-1].argmax()) // 2)
        part = words[at : at + span]
        overlap = lcs(item, part) / n
        if overlap < PARAPHRASE:
            return None
        end = item[-ANSWER:]
        answer = ends and lcs(end, part) >= 0.8 * len(end)
        return (overlap, answer, at, len(part)) if overlap >= COPY or answer else None


def _coded(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """The passages of all documents, cut once and written: by run of texts the terms and their counts, and how many terms each passage has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(terms), type=pa.string())
        for b in batches:
            for lo in range(0, len(b), 500):
                words = Words(b.column("text").slice(lo, 500))
                first, (at, term) = words.first, words.among(names)
                passages = -(-np.diff(first) // PASSAGE)
                owner = np.searchsorted(first, at, side="right") - 1
                p = (np.cumsum(passages) - passages)[owner] + (at - first[owner]) // PASSAGE
                key, n = np.unique(p * len(terms) + term, return_counts=True)
                size = np.bincount(key // len(terms), minlength=int(passages.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u4").tobytes()], type=pa.binary()) for x in (key % len(terms), n, size)], names=["t", "n", "size"])

    return written(docs.select(F.col("text").cast("string")).mapInArrow(run, "t binary, n binary, size binary"), "coded")


def _uncoded(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for row in zip(*(b.column(c).to_pylist() for c in ("t", "n", "size")), strict=True):
        yield tuple(np.frombuffer(x, dtype="<u4").astype(np.int64) for x in row)


def _frequencies(coded: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each term is, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms + 1, dtype=np.int64)
        for b in batches:
            for t, _, size in _uncoded(b):
                df += np.bincount(t, minlength=len(df))
                df[-1] += len(size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "n"])

    out = np.zeros(terms + 1, dtype=np.int64)
    got = coded.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _weighted(t: np.ndarray, n: np.ndarray, size: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of TF-IDF, of unit length: the places in ``idf`` of their terms, the weights, and the terms of each row. Terms with place -1 are left out."""
    ok = t >= 0
    size = group_sums(ok.astype(np.int64), size)
    t, v = t[ok], n[ok] * idf[t[ok]]
    return t, v / np.repeat(np.sqrt(group_sums(v * v, size)), size), size


def _spread(t: np.ndarray, w: np.ndarray, size: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A Q) of some sparse rows A to ``out``, a bounded number of rows at a time."""
    edge = np.r_[0, np.cumsum(size)]
    for lo in range(0, len(size), 2048):
        at, n = slice(edge[lo], edge[min(lo + 2048, len(size))]), size[lo : lo + 2048]
        if at.start == at.stop:
            continue
        term, weight = t[at], w[at].astype(q.dtype)[:, None]
        row = group_sums(weight * q[term], n)
        order = np.argsort(term, kind="stable")
        names, first = np.unique(term[order], return_index=True)
        out[names] += np.add.reduceat((weight * row[np.repeat(np.arange(len(n)), n)])[order], first, axis=0)


def _space(coded: DataFrame, place: np.ndarray, idf: np.ndarray, own: tuple, weight: float, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF rows of all passages, and of ``own`` rows with a weight: a randomised range finder.

    ``place`` has the place in ``idf`` of each coded term, or -1. Each pass sums A'(A Q) over the partitions; a sum has
    terms x (rank + OVERSAMPLE) numbers whatever the rows.
    """
    size = len(idf)
    width = min(size, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(size, width)))[0]
    cut = 512
    for _ in range(POWER):

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for b in batches:
                for t, n, sizes in _uncoded(b):
                    _spread(*_weighted(place[t], n, sizes, idf), q, out)
            for lo in range(0, size, cut):
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([out[lo : lo + cut].tobytes()], type=pa.binary())], names=["lo", "v"])

        def add(t: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(x) for x in t.column("v").to_pylist())
            return pa.table({"lo": t.column("lo").slice(0, 1), "v": pa.array([v.tobytes()], type=pa.binary())})

        y = np.zeros((size, width))
        _spread(*own, q, y)
        y *= weight
        for r in coded.mapInArrow(run, "lo long, v binary").groupBy("lo").applyInArrow(add, "lo long, v binary").collect():
            y[r["lo"] : r["lo"] + cut] += np.frombuffer(r["v"]).reshape(-1, width)
        q, _, _ = np.linalg.svd(y, full_matrices=False)
    return q[:, : min(rank, width)]


def index(docs: DataFrame, items: list[tuple[int | None, str]]) -> Index | None:
    """The index of some items; None if they have no words."""
    ids, words = [i for i, _ in items], [words_of(t) for _, t in items]
    ids, words = [i for i, w in zip(ids, words, strict=True) if w], [w for w in words if w]
    cut = [(k, j == len(ps) - 1, p) for k, ps in enumerate(map(parts_of, words)) for j, p in enumerate(ps)]
    words = [p for _, _, p in cut]
    named = sorted(set(chain.from_iterable(words)))
    if not named:
        return None
    terms = {w: k for k, w in enumerate(named)}
    coded = _coded(docs, terms)
    df, passages = _frequencies(coded, len(named))
    use = np.flatnonzero(df <= max(2, COMMON * passages))
    if not len(use):
        use = np.arange(len(named))
    idf = np.log((passages + 2) / (df[use] + 1))
    terms = {named[k]: j for j, k in enumerate(use)}
    place = np.full(len(named), -1)
    place[use] = np.arange(len(use))
    counted = [np.unique([terms[w] for w in ws if w in terms], return_counts=True) for ws in words]
    t, n = (np.concatenate([x[i].astype(np.int64) for x in counted]) for i in (0, 1))
    own = _weighted(t, n, np.array([len(t) for t, _ in counted]), idf)
    # the items weigh as much as all passages: a space of passages alone has little of an item that few of them resemble
    basis = _space(coded, place, idf, own, max(1.0, passages / len(words)), RANK)
    dropped(coded)
    vectors = (basis * idf[:, None]).astype(np.float32)
    unit = group_sums(own[1][:, None] * basis[own[0]], own[2])
    unit = (unit / np.maximum(1e-9, np.linalg.norm(unit, axis=1, keepdims=True))).astype(np.float32)
    sets = [frozenset(terms[w] for w in ws if w in terms) for ws in words]
    weak = [k for k, (s, ws) in enumerate(zip(sets, words, strict=True)) if len(s) < min(LEAST, len(set(ws))) or len(s) < KEPT * len(set(ws))]
    return Index(pa.array(list(terms), type=pa.string()), vectors, unit, ids, [k for k, _, _ in cut], [x for _, x, _ in cut], words, sets, weak)


def indices(docs: DataFrame, benchmark: DataFrame) -> list[Index]:
    """Indices of ITEMS items each: a benchmark of any size, so many at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    slices = -(-items.count() // ITEMS)
    out = []
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        out += [index(docs, own) for own in _fitting([(r["item_id"], r["text"]) for r in part.collect()])]
    return [x for x in out if x is not None]


def _fitting(items: list[tuple[int | None, str]]) -> list[list[tuple[int | None, str]]]:
    """The items in runs of MAX_TERMS distinct words or fewer, or of one item."""
    if len(items) < 2 or len(set(chain.from_iterable(words_of(t) for _, t in items))) <= MAX_TERMS:
        return [items]
    half = len(items) // 2
    return _fitting(items[:half]) + _fitting(items[half:])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, cosine, overlap, answer, first_word, n_words)``: one row per document row and item that it holds.

    Null, empty and wordless texts and items match nothing; ids may be null; rows that repeat match alike; words are
    runs of letters and digits in lower case. The cosine is that of the latent space, or of word counts where only the
    words led to the item. Texts are taken whole, however long; of an item of more than MOST words a document that holds one of its
    parts holds the item. Other columns are ignored. No items or no documents, no rows.
    """
    schema = "doc_id long, item_id long, cosine double, overlap double, answer boolean, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for ix in indices(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], ix: Index = ix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, *x) for d, xs in zip(b.column("doc_id").to_pylist(), ix.matches(b.column("text")), strict=True) for x in xs]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=t) for i, t in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "overlap", "answer", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for ix in indices(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], ix: Index = ix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not x for x in ix.matches(b.column("text"))], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
