"""Language identification: one interpolated Kneser-Ney character model per language.

Words are padded on their own, so a model is a distribution over the letters of a word given up to three
letters before. The n-grams of all languages share sorted hash arrays with a column per language: a
lookup of the longest n-gram gives all languages' interpolated probabilities at once; what is missing there
falls back order by order. The language with the lowest cross-entropy per letter is chosen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod, group_sums, table

ORDER = 4
#: Training documents per language, in expectation: rows are kept by hash with probability bound / count.
DOCS_PER_LANG = 1500
#: Languages that share arrays: each n-gram of one of them has a value for all.
GROUP = 16
#: Runs of letters in any script.
LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each letter (and at the end) of each word, and the letters per word."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    pad = " " * (ORDER - 1)
    flat = np.frombuffer((pad + (" " + pad).join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = first[owner] + np.arange(int(sizes.sum())) - (np.cumsum(sizes) - sizes)[owner]
    out = []
    for k in range(1, ORDER + 1):
        h = np.full(len(at), np.uint64(k))
        for j in range(k - 1, -1, -1):
            h = (h * _P) ^ ((flat[at - j] + np.uint64(1)) * _MIX)
        out.append(h)
    return out, sizes


def contexts(words: list[str]) -> list[np.ndarray]:
    """Hashes of the contexts (the n-gram without its last letter) for each order; order 1 has one context."""
    pad = " " * (ORDER - 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    flat = np.frombuffer((pad + (" " + pad).join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = first[owner] + np.arange(int(sizes.sum())) - (np.cumsum(sizes) - sizes)[owner]
    out = [np.zeros(len(at), dtype=np.uint64)]
    for k in range(2, ORDER + 1):
        h = np.full(len(at), np.uint64(100 + k))
        for j in range(k - 1, 0, -1):
            h = (h * _P) ^ ((flat[at - j] + np.uint64(1)) * _MIX)
        out.append(h)
    return out


class Group:
    """Sorted n-gram and context hashes per order with a column of values per language."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.keys: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []  # discounted share of the n-gram
        self.full: np.ndarray | None = None  # interpolated probability of the longest n-grams
        self.ctx: list[np.ndarray] = []
        self.left: list[np.ndarray] = []  # share that goes to the shorter context
        self.letters = 1

    @staticmethod
    def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, (keys[at] == h) if len(keys) else np.zeros(len(h), dtype=bool)

    def probabilities(self, gs: list[np.ndarray], cs: list[np.ndarray]) -> np.ndarray:
        p = np.full((len(gs[0]), len(self.langs)), 1.0 / (self.letters + 1))
        for k in range(ORDER):
            at, hit = self.find(self.ctx[k], cs[k])
            p = p * np.where(hit[:, None], self.left[k][at], 1.0)
            at, hit = self.find(self.keys[k], gs[k])
            p += np.where(hit[:, None], self.kept[k][at], 0.0)
        return p

    def logs(self, gs: list[np.ndarray], cs: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Per word: log2 probability in each language."""
        at, hit = self.find(self.keys[-1], gs[-1])
        p = self.full[at]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            p[miss] = self.probabilities([g[miss] for g in gs], [c[miss] for c in cs])
        return group_sums(np.log2(p), sizes)

class Model:
    """The languages in groups that share arrays, so that memory follows the languages, however many, and not their square."""

    def __init__(self, groups: list[Group]):
        self.groups = groups
        self.langs = [x for g in groups for x in g.langs]
        self.heat = 1.0
        self.limit = np.full(len(self.langs), np.inf)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: log2 probability in each language, and letters."""
        (gs, sizes), cs = grams(words), contexts(words)
        return np.concatenate([g.logs(gs, cs, sizes) for g in self.groups], axis=1), sizes

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per letter in each language (0 without letters), and letters."""
        split = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in split])
        flat = [w for ws in split for w in ws]
        if not flat:
            return np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        logs, sizes = self.words(list(distinct))
        total, letters = group_sums(logs[codes], counts), group_sums(sizes[codes], counts)
        return -total / np.maximum(letters, 1)[:, None], letters

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        bits, letters = self.texts(texts)
        best = bits.argmin(axis=1)
        e = np.exp2(-self.heat * np.sqrt(letters)[:, None] * (bits - bits.min(axis=1, keepdims=True)))
        sure = np.where(letters > 0, 1 / e.sum(axis=1), 0.0)
        low = bits[np.arange(len(texts)), best]
        pred = [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
        return pred, sure, np.where(letters > 0, low, 0.0), (letters == 0) | (low > self.limit[best])


def build(counts: dict[str, Counter], langs: list[str], size: int = GROUP) -> Model:
    """Models from weighted words per language: {language: {word: count}}."""
    letters = max([1, *(len(np.unique(grams(list(counts[x]))[0][0])) for x in langs)])
    return Model([_group(counts, langs[k : k + size], letters) for k in range(0, len(langs), size)])


def _group(counts: dict[str, Counter], langs: list[str], letters: int) -> Group:
    """Kneser-Ney tables of some languages."""
    m = Group(langs)
    m.letters = letters
    per = []
    for lang in langs:
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], dtype=np.float64)
        gs, sizes = grams(words)
        per.append((gs, contexts(words), np.repeat(weight, sizes)))
    m.keys = [np.unique(np.concatenate([g[k] for g, _, _ in per] or [np.zeros(0, np.uint64)])) for k in range(ORDER)]
    m.ctx = [np.unique(np.concatenate([c[k] for _, c, _ in per] or [np.zeros(0, np.uint64)])) for k in range(ORDER)]
    m.kept = [np.zeros((len(k), len(langs))) for k in m.keys]
    m.left = [np.ones((len(k), len(langs))) for k in m.ctx]
    for col, (gs, cs, weight) in enumerate(per):
        tables = []  # per order: n-gram, its context, its suffix, count
        for k in range(ORDER):
            key, first, code = np.unique(gs[k], return_index=True, return_inverse=True)
            tables.append((key, cs[k][first], gs[k - 1][first] if k else key, np.bincount(code, weights=weight)))
        for k in range(ORDER):
            key, ctx, _, n = tables[k]
            if k < ORDER - 1:  # lower orders count the distinct n-grams that end in theirs
                longer = tables[k + 1][2]
                n = np.bincount(np.searchsorted(key, longer), minlength=len(key)).astype(np.float64)
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = float(np.clip(once / max(1.0, once + 2.0 * twice), 0.1, 0.9))
            c, code = np.unique(ctx, return_inverse=True)
            total = np.bincount(code, weights=n)
            m.kept[k][np.searchsorted(m.keys[k], key), col] = np.maximum(n - d, 0) / total[code]
            m.left[k][np.searchsorted(m.ctx[k], c), col] = np.bincount(code, weights=np.minimum(n, d)) / total
    # interpolated probabilities of the longest n-grams: one example of each is enough to know all its suffixes
    if langs:
        allg = [np.concatenate([g[k] for g, _, _ in per]) for k in range(ORDER)]
        allc = [np.concatenate([c[k] for _, c, _ in per]) for k in range(ORDER)]
        _, first = np.unique(allg[-1], return_index=True)
        m.full = m.probabilities([g[first] for g in allg], [c[first] for c in allc])
    return m


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Models from a bounded sample of documents whose crc32(doc_id) mod 4 is not 2 and whose language is known.

    The sample's word counts are added up in Spark, per language; odd documents (by hash) calibrate the
    score's sharpness and each language's rejection limit, the rest make the n-grams. No rows, no languages.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        (crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return build({}, [])
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000))
    shares = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(int(1_000_000 * min(1.0, docs_per_lang / n)))) for lang, n in sizes.items()))
    sample = known.where(place < shares[F.col("lang")]).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(12)), F.lit(8)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text, fold in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                if fold:
                    seen.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted: dict[str, Counter] = {}
    for b in sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, w, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            counted.setdefault(lang, Counter())[w] = n
    model = build(counted, sorted(counted))
    tune = sample.where("fold = 0").select("lang", "text").toPandas()
    tune = tune[tune["lang"].isin(model.langs)]
    if len(tune) and model.langs:
        bits, letters = model.texts(list(tune["text"]))
        truth = np.array([model.langs.index(x) for x in tune["lang"]])
        full = letters > 0
        if full.any():
            gap = (bits - bits.min(axis=1, keepdims=True))[full] * np.sqrt(letters[full])[:, None]
            loss = lambda heat: -np.mean((-heat * gap)[np.arange(len(gap)), truth[full]] * np.log(2) - np.log(np.exp2(-heat * gap).sum(axis=1)))
            model.heat = float(min((0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0), key=loss))
            for k in range(len(model.langs)):
                own = bits[full & (truth == k), k]
                if len(own):
                    model.limit[k] = float(np.quantile(own, 0.995) * 1.05)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits, rejected)`` per row of ``docs``.

    ``und`` (score 0, rejected) for texts that are null or have no letter; ``rejected`` also marks texts whose
    cross-entropy per letter is beyond the calibrated limit of their language. Nothing else is read from a row
    than its whole text, so repeated rows agree; a null id counts as the empty text in ``held_out``; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.slice(lo, 2000)
                pred, sure, bits, odd = model.decide(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, type=pa.string()), pa.array(sure), pa.array(bits), pa.array(odd)], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
