"""Mixing sources to target weights by weighted fair queueing.

Every epoch of a source's documents is shuffled by hash; a copy's virtual finish time is the source's
cumulative words up to and with it, over the source's target. Copies of all sources are ordered by finish time and cut where
the total budget is used up. Running sums are two-level (bucket totals, then within the bucket), so that a
source with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import WORD, table, written

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
BUCKETS = 256


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h)``: words of the whole text, and the place in the shuffle."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)``: shares of all words by weight, none above ``most`` times its source.

    A target is min(most * size, level * weight); the level comes in closed form from the sources in order of
    most * size / weight (one row per source). Sources without words get target 0.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    per = per.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int") + 1).alias("w"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # once sources up to rank i are held at their caps, the others share what is left by weight
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("held"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("held_w"),
        F.sum("w").over(every).alias("all_w"),
        F.sum("source_size").over(every).cast("double").alias("total"),
    )
    per = per.withColumn("level", (F.col("total") - F.col("held")) / (F.col("all_w") - F.col("held_w")))
    # the level is the first one that its own source's cap can bear
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("held_w", "level"))).over(every).getField("level")
    per = per.withColumn("lvl", level)
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("lvl") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` per row of ``docs``.

    ``copies`` is how often the mix has the document, ``taken`` its words. A null source is a source of its own,
    last in order; null and empty texts have size 0 and are never taken; rows that are equal in id and text
    are told apart by nothing and are taken alike in a fixed order. No rows give no rows.
    """
    rows = written(sized(docs), "sizes")
    shares = written(targets(rows, weights, most), "targets")
    # the place in the shuffle is fixed once; an epoch shifts it by the whole source
    spot = F.shiftrightunsigned(F.col("h"), 32)
    rows = rows.withColumn("bucket", F.floor(spot * F.lit(BUCKETS) / F.lit(2.0**32)).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("words").over(run), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within", F.sum("size").over(inside))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k"))).drop("s", "k")
    placed = placed.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = (F.col("start") + F.col("within")).cast("double")
    placed = placed.withColumn("first", first)
    copies = written(
        placed.select("doc_id", "source", "size", "source_size", "target", "h", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"), "first")
        .withColumn("finish", (F.col("first") + F.col("epoch") * F.col("source_size")) / F.col("target"))
        .withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(4.0)) * F.lit(4096)).cast("int")),
        "copies",
    )
    cut = _cut(copies)
    chosen = F.coalesce((F.col("size") > 0) & (F.struct("slot", "finish", "h", "epoch") <= cut), F.lit(False)) if cut is not None else F.lit(False)
    return (
        copies.select("*", chosen.alias("chosen"))
        .groupBy("doc_id", "h", "source", "size", "source_size", "target")
        .agg(F.sum(F.col("chosen").cast("long")).alias("all_copies"), (F.count("*") / F.lit(most)).cast("long").alias("rows"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
        .select("doc_id", "source", "size", "source_size", "target", (F.floor((F.col("all_copies") + F.col("nth") - 1) / F.col("rows"))).cast("long").alias("copies"))
        .select("*", (F.col("copies") * F.col("size")).alias("taken"))
    )


def _cut(copies: DataFrame):
    """The last copy, in the order of (slot, finish, h, epoch), with which the mix is within its budget; None: none is."""
    per = copies.where("size > 0 and target > 0").groupBy("slot").agg(F.sum("size").alias("words"))
    total = copies.where("epoch = 0").agg(F.sum("size")).first()[0] or 0
    run = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    over = per.select("slot", "words", F.sum("words").over(run).alias("upto")).where(F.col("upto") >= F.lit(total)).orderBy("slot").first()
    if over is None:  # all of it fits
        last = copies.where("size > 0 and target > 0").agg(F.max(F.struct("slot", "finish", "h", "epoch")).alias("x")).first()["x"]
        return None if last is None else _row(last)
    left = total - (over["upto"] - over["words"])
    # one slot is a 4096th of a source's target: its running sum, again in two levels
    slot = copies.where((F.col("slot") == over["slot"]) & (F.col("size") > 0) & (F.col("target") > 0))
    upto = slot.select("slot", "finish", "h", "epoch", F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "h", "epoch").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    last = upto.where(F.col("upto") <= F.lit(left)).agg(F.max(F.struct("slot", "finish", "h", "epoch")).alias("x")).first()["x"]
    if last is None:
        return F.struct(F.lit(over["slot"]).alias("slot"), F.lit(-1.0).alias("finish"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("epoch"))
    return _row(last)


def _row(x):
    return F.struct(F.lit(x["slot"]).alias("slot"), F.lit(x["finish"]).alias("finish"), F.lit(x["h"]).cast("long").alias("h"), F.lit(x["epoch"]).alias("epoch"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
