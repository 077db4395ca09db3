"""Timelines: forward fill, as-of lookup and interpolation of keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events(df: DataFrame) -> DataFrame:
    """Events without an id go, a missing position is 0, a ``pos`` counts only with three values."""
    return df.where(F.col("id").isNotNull()).withColumns({"sample_pos": F.coalesce("sample_pos", F.lit(0).cast("long")), "pos": F.when(F.size("pos") == 3, F.col("pos"))})


def forward_fill(df: DataFrame, key: str, order: str, defaults: dict[str, object]) -> DataFrame:
    """The latest value of each column in ``defaults`` up to each row, or its default."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(v)) for c, v in defaults.items()})


def keyframes(df: DataFrame, key: str, t: str, value: str, seq: str) -> DataFrame:
    """Each key's ``(t, value)`` in order of time, ties in list order. Lists are as long as a timeline, bounded by one element's events."""
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(t, F.col(seq).alias("_seq"), value))).alias("k"))
    return got.select(key, F.transform("k", lambda x: F.struct(x[t].alias(t), x[value].alias(value))).alias("keys"))


def neighbours(grid: DataFrame, keys: DataFrame, key: str, t: str, value: str, seq: str) -> DataFrame:
    """For each grid row the last keyframe at or before it (ties: the latest in the list) and the first after it.

    Keyframes learn their successor among themselves; then one sort of both sides by key and time carries the latest pair
    forward. A pair without a first half stands before a key's first frame. A keyframe at the time of a grid point comes first.
    """
    own = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    k = keys.select(F.col(key).alias("_id"), F.col(t).alias("_t"), F.col(seq).alias("_seq"), own.alias("_a"))
    order = Window.partitionBy("_id").orderBy("_t", "_seq")
    k = k.withColumns({"_b": F.lead("_a").over(order), "_new": F.lag("_a").over(order).isNull()})
    none = F.lit(None)
    pair = F.struct(F.col("_t").alias("t"), F.lit(0).alias("o"), "_seq", F.col("_a").alias("a"), F.col("_b").alias("b"))
    head = F.struct(none.cast(keys.schema[t].dataType).alias("t"), F.lit(-1).alias("o"), "_seq", F.when(F.lit(False), F.col("_a")).alias("a"), F.col("_a").alias("b"))
    k = k.select("_id", F.explode(F.when(F.col("_new"), F.array(head, pair)).otherwise(F.array(pair))).alias("_k"))
    k = k.select(F.col("_id").alias(key), F.col("_k.t").alias(t), F.col("_k.o").alias("_o"), F.col("_k._seq").alias("_seq"), F.struct("_k.a", "_k.b").alias("_k"))
    both = grid.withColumn("_o", F.lit(1)).unionByName(k, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(t).asc_nulls_first(), "_o", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_k", F.last("_k", ignorenulls=True).over(w)).where("_o = 1")
    return out.select(*grid.columns, F.col("_k.a.t").alias("t0"), F.col("_k.a.v").alias("v0"), F.col("_k.b.t").alias("t1"), F.col("_k.b.v").alias("v1"))


def _between(t: Column, t0: Column, t1: Column, v0: Column, v1: Column) -> Column:
    return v0 + (v1 - v0) * ((t - t0) / (t1 - t0))


def interpolate(grid: DataFrame, keys: DataFrame, key: str, t: str, value: str, seq: str) -> DataFrame:
    """M3: a scalar timeline on the grid; the first value holds before it, the last after."""
    n = neighbours(grid, keys, key, t, value, seq)
    at = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(_between(F.col(t), F.col("t0"), F.col("t1"), F.col("v0"), F.col("v1")))
    return n.select(*grid.columns, at.alias(value))


def interpolate_vector(grid: DataFrame, keys: DataFrame, key: str, t: str, value: str, seq: str, none: list[float] | None = None) -> DataFrame:
    """M2, M3 for array values; ``none`` for keys without keyframes (J3), else such rows go."""
    n = neighbours(grid, keys, key, t, value, seq)
    f = (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    at = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(F.zip_with("v0", "v1", lambda a, b: a + (b - a) * f))
    out = n.select(*grid.columns, at.alias(value))
    if none is None:
        return out.where(F.col(value).isNotNull())
    return out.withColumn(value, F.coalesce(value, F.array(*map(F.lit, none))))


def movers(df: DataFrame, key: str, t: str, many: int) -> DataFrame:
    """Keys with more than one event."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.max(t).alias("last_t")).where("n > 1")
    return out.withColumn("kind", F.when(F.col("n") > many, "moving").otherwise("static"))
