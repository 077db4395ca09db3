"""Quality classifier: histogram gradient-boosted trees over statistics of the document.

The statistics are taken from the whole text in one Arrow pass and written once. The trees are fitted
with numpy on a bounded sample of labelled rows (``max_rows``, by hash of the id) and flattened into
arrays; scoring walks all trees of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod, group_sums, table, written

#: Rows that the trees may be fitted on; scores of all other rows don't depend on how many there are.
MAX_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_len", "upper", "digit", "space", "high", "punct", "symbol", "hash_amp", "pipe", "bang",
    "comma", "stop", "distinct", "repeat_next", "lines", "line_words", "distinct_lines", "short_lines", "upper_words",
    "symbol_words", "long_words", "top_byte", "entropy", "worst_symbol", "worst_upper", "worst_distinct", "worst_pipe",
]

_CLASS = np.zeros((256, 10), dtype=np.float64)
for _k, _chars in enumerate((range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b"#&$%*", b"|", b"!", b",")):
    _CLASS[list(_chars), _k] = 1


def statistics(raw: bytes) -> list[float]:
    """The features of one text; the empty text gives zeros."""
    if not raw:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    n = float(len(raw))
    upper, digit, space, high, punct, symbol, hashes, pipe, bang, comma = (seen @ _CLASS) / n
    words = raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    p = seen[seen > 0] / n
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words)) if words else np.zeros(1, dtype=np.int32)
    # the worst stretch of 40 words, so that junk in a part of a text shows
    worst = [0.0, 0.0, 1.0, 0.0]
    for at in range(0, len(words), 40):
        part = words[at : at + 40]
        if len(part) < 12 and at:
            part = words[-40:]
        b = b" ".join(part)
        k = len(b) or 1
        worst[0] = max(worst[0], (b.count(b"#") + b.count(b"&") + b.count(b"$") + b.count(b"%") + b.count(b"*")) / k)
        worst[1] = max(worst[1], sum(1 for w in part if w.isupper()) / len(part))
        worst[2] = min(worst[2], len(set(part)) / len(part))
        worst[3] = max(worst[3], b.count(b"|") / k)
    return [
        np.log1p(n), np.log1p(len(words)), n / m, upper, digit, space, high, punct, symbol, hashes, pipe, bang, comma,
        raw.count(b".") / n, len(set(words)) / m, sum(map(eq, words, words[1:])) / m, np.log1p(len(lines)), m / len(lines),
        len(set(lines)) / len(lines), sum(1 for x in lines if len(x) < 30) / len(lines), sum(1 for w in words if w.isupper() and len(w) > 1) / m,
        float((seen[35] + seen[36] + seen[37] + seen[38] + seen[42]) / m), float((sizes > 12).mean()), float(p.max()), float(-(p * np.log2(p)).sum()), *worst,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.array([statistics(x or b"") for x in b.column("raw").to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["doc_id", "x"]
        )


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` for every row; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(_measure, "doc_id long, x array<float>")


@dataclass
class Forest:
    """Trees as flat arrays; node i goes left where ``x[feature[i]] <= cut[i]``, a leaf points at itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[lo : lo + 4096] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0) -> Forest:
    """Logistic boosting on binned features; splits by gain from per-node histograms of gradients."""
    n, f = x.shape
    least = min(20.0, max(3.0, n / 100))  # rows of a leaf
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    raw = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        todo = [(np.arange(n), 0, len(feature))]
        feature.append(0), cut.append(0.0), left.append(len(feature) - 1), right.append(len(feature) - 1), value.append(0.0)
        while todo:
            rows, level, me = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                b = binned[rows]
                flat = (b + np.arange(f) * bins).ravel()
                gh = np.bincount(flat, weights=np.repeat(g[rows], f), minlength=f * bins).reshape(f, bins).cumsum(1)
                hh = np.bincount(flat, weights=np.repeat(h[rows], f), minlength=f * bins).reshape(f, bins).cumsum(1)
                nn = np.bincount(flat, minlength=f * bins).reshape(f, bins).cumsum(1)
                gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                gain[(nn < least) | (len(rows) - nn < least)] = -1
                j, k = np.unravel_index(gain.argmax(), gain.shape)
                if k < len(edges[j]) and gain[j, k] > best[0]:
                    best = (gain[j, k], j, k)
            if best[1] < 0:
                value[me] = float(-rate * gs / (hs + l2))
                raw[rows] += value[me]
                continue
            _, j, k = best
            goes = binned[rows, j] <= k
            feature[me], cut[me] = int(j), float(edges[j][k])
            for side, sub in ((left, rows[goes]), (right, rows[~goes])):
                side[me] = len(feature)
                todo.append((sub, level + 1, len(feature)))
                feature.append(0), cut.append(0.0), left.append(len(feature) - 1), right.append(len(feature) - 1), value.append(0.0)
    ints = lambda v: np.array(v or [0], dtype=np.int64)
    return Forest(ints(feature), np.array(cut or [0.0]), ints(left), ints(right), np.array(value or [0.0]), ints(roots), base, depth)


def _marked(labels: DataFrame, max_rows: int) -> DataFrame:
    """``(doc_id, y)``: ``max_rows`` labels at most of documents whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return marked.where(crc_mod("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)


def learn(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    rows = measured.join(_marked(labels, max_rows), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows).select("x", "y").toPandas()
    x = np.stack([np.asarray(v, dtype=np.float32) for v in rows["x"]]).astype(np.float64) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(dtype=np.float64))


def score(measured: DataFrame, forest: Forest) -> DataFrame:
    """``(doc_id, score)`` of every measured row. The trees are a few thousand numbers, bound by ``trees`` and ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forest.score(x))], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs``.

    Null and empty texts are scored on zero features; a null id is kept and belongs to no training row;
    repeated rows each get the same score; without any labelled row every score is 0.5. Texts are taken whole, however long;
    other columns are ignored; no rows give no rows.
    """
    measured = written(features(docs), "features")
    out = score(measured, learn(measured, labels, max_rows))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject. Only texts that the trees are fitted on are measured twice."""
    few = _marked(labels, max_rows).select("doc_id").distinct()  # max_rows ids at most
    fitted = docs.join(F.broadcast(few), docs["doc_id"].cast("long") == few["doc_id"], "left_semi")
    forest = learn(features(fitted), labels, max_rows)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.array([statistics((t or "").encode()) for t in texts], dtype=np.float32).astype(np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(forest.score(x) >= THRESHOLD))

    return docs.select(*names).mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
