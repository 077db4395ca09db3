"""Power, mixes, Gram matrices and regularised least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_square(df: DataFrame, keys: list[str], samples: str, nominal: int = 1536) -> DataFrame:
    """A5: squares summed per key over the nominal length of a frame, however many samples there are."""
    own = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return df.groupBy(*keys).agg((F.sum(own) / nominal).alias("power"))


def gram(df: DataFrame, keys: list[str], d: str, p: str, width: int) -> DataFrame:
    """Sums of p * d_i * d_j; partial sums of width * width columns, no exploded rows before the shuffle."""
    cells = [(i, j) for i in range(width) for j in range(width)]
    sums = df.groupBy(*keys).agg(*(F.sum(F.col(d)[i] * F.col(d)[j] * F.col(p)).alias(f"g{i}_{j}") for i, j in cells))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("g")) for i, j in cells))
    return sums.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.i", "r.j", "r.g")


def solve(d: np.ndarray, p: np.ndarray, clamp: float = 9.5) -> np.ndarray:
    """M9: rows p_k * d_k * inverse(D'PD + lambda I), clamped; lambda follows the trace."""
    a = (d * p[:, None]).T @ d
    lam = np.trace(a) * 1e-3 / d.shape[1] + 1e-12
    return np.clip(np.linalg.solve(a + lam * np.eye(d.shape[1]), (d * p[:, None]).T).T, -clamp, clamp)


def ridge(df: DataFrame, frame: str, obj: str, d: str, p: str) -> DataFrame:
    """M9 per frame: ``(frame, obj, m)``. A frame has few objects, so its rows are gathered as one list."""
    per = df.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(F.col(obj).alias("o"), F.col(d).cast("array<double>").alias("d"), F.col(p).cast("double").alias("p")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, o, m = [], [], []
            for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = solve(np.array([r["d"] for r in rows]), np.array([r["p"] for r in rows]))
                f += [key] * len(rows)
                o += [r["o"] for r in rows]
                m += got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(f, type=pa.int64()), pa.array(o, type=pa.int64()), pa.array(m, type=pa.list_(pa.float64()))], names=["frame_idx", "obj", "m"])

    return per.mapInArrow(run, "frame_idx long, obj long, m array<double>")


def downmix(samples: DataFrame, gains: DataFrame, keys: list[str], gain_db: float = 0.0) -> DataFrame:
    """``(keys..., mix)`` with mix[c] the sum over objects of s * g[c], at a gain in dB. Inner join."""
    both = samples.join(gains, [*keys, "obj"])
    g = float(10 ** (gain_db / 20))
    return both.groupBy(*keys).agg(F.array(*(F.sum(F.col("s") * F.col("gains")[c]) * F.lit(g) for c in range(5))).alias("mix"))
