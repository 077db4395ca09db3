"""The frame grid: starts, bins, offsets, sequence checks and cyclic pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def starts(df: DataFrame, stream: str, order: str, independent: str, samples: str) -> DataFrame:
    """Samples of the independent frames before each frame."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(F.when(F.col(independent), F.col(samples)).otherwise(0)).over(w), F.lit(0)).cast("long"))


def binned(df: DataFrame, t: str, step: int) -> DataFrame:
    """The bin of a regular grid that a time falls in; no join is needed."""
    return df.withColumn("bin", F.floor(F.col(t) / F.lit(step)).cast("long"))


def offsets(df: DataFrame, stream: str, order: str, size: str, gap: int = 0) -> DataFrame:
    """Where each of a chain of records begins."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("at", (F.sum(F.col(size) + gap).over(w) - F.col(size) - gap).cast("long"))


def monotonic(df: DataFrame, stream: str, seq: str, modulus: int) -> DataFrame:
    """Whether each sequence number follows the one before it, modulo ``modulus``."""
    prev = F.lag(seq).over(Window.partitionBy(stream).orderBy(seq))
    ok = F.when(prev.isNull() | (F.pmod(F.col(seq), F.lit(modulus)) == F.pmod(prev + 1, F.lit(modulus))), 1).otherwise(0)
    return df.select(stream, ok.alias("ok")).groupBy(stream).agg(F.min("ok").alias("monotonic"), F.count("*").alias("n"))


#: Rows of a bucket of ``numbered``, on the mean.
BUCKET = 1 << 20


def numbered(df: DataFrame, order: str, name: str, by: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Dense numbers from 0 in the order of a numeric column (of each ``by``), without one task for all.

    Buckets of equal width follow from the least and largest value and the number of rows, so a row's bucket is a function of its
    value alone; its number is that within the bucket plus the rows of those before. Null values come first; ties are
    numbered in any order.
    """
    at = F.col(order).cast("double")
    seen = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).first()
    lo, width = seen["lo"] or 0.0, max(1e-9, ((seen["hi"] or 0.0) - (seen["lo"] or 0.0)) / max(1.0, seen["n"] / bucket))
    part = [] if by is None else ["_s"]
    rows = df.select(F.struct("*").alias("_r"), F.col(order).alias("_o"), F.coalesce(F.floor((at - lo) / width), F.lit(-1)).cast("long").alias("_p"), *([] if by is None else [F.col(by).alias("_s")]))
    counts = rows.groupBy(*part, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*(F.col(c).alias("_t") for c in part), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    local = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*part, "_p").orderBy("_o")) - 1)
    same = F.col("_p") == F.col("_q")
    return local.join(base, same if by is None else same & F.col("_s").eqNullSafe(F.col("_t"))).select("_r.*", (F.col("_b") + F.col("_i")).alias(name))


def cycle_join(left: DataFrame, left_order: str, right: DataFrame, right_order: str, by: str | None = None, how: str = "inner") -> DataFrame:
    """Row i of the left with row i mod n of the right, both in order (of each ``by``, which the right loses). No right rows: no rows, or nulls with ``how="left"``."""
    r = numbered(right, right_order, "_j", by)
    rows = numbered(left, left_order, "_i", by)
    if by is None:
        rows = rows.withColumn("_n", F.lit(right.count()))
    else:
        r = r.withColumnRenamed(by, "_by")
        n = r.groupBy(F.col("_by").alias("_y")).agg(F.count("*").alias("_n"))
        rows = rows.join(n, F.col(by) == F.col("_y"), "left").drop("_y")
    rows = rows.withColumn("_k", F.expr("pmod(_i, nullif(_n, 0))")).drop("_i", "_n")
    same = F.col("_k") == F.col("_j")
    return rows.join(r, same if by is None else same & (F.col(by) == F.col("_by")), how).drop("_k", "_j", "_by")
