"""Plumbing shared by the training-data operators.

Tables that cut lineage are written below ``spark.checkpoint.dir`` (a folder that all executors
share); nothing is ever kept in an executor's own folder or in the driver's memory.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and \\x09 to \\x0D. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framewright-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: its lineage is cut and survives lost executors.

    ``by`` is a column with few values; the rows of each have a folder that can be dropped on its own.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if by:
        setting = "spark.sql.maxConcurrentOutputFileWriters"  # a writer per value: the rows need no sort
        before = spark.conf.get(setting)
        spark.conf.set(setting, "16")
        try:
            out.partitionBy(by).parquet(path)
        finally:
            spark.conf.set(setting, before)
    else:
        out.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framewright_path = path
    return out


def dropped(df: DataFrame, part: str = "") -> None:
    """Remove a table made by ``written``, or a part ``column=value`` of it, that no later plan reads."""
    path = getattr(df, "_framewright_path", None)
    if path:
        path = f"{path}/{part}" if part else path
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Narrow rows of a partition that is written, at least: a small table needs no file for every shuffle partition.
PER_FILE = 1 << 18


def packed(df: DataFrame, most: int) -> DataFrame:
    """``df``, of ``most`` narrow rows at most, in no more partitions than PER_FILE rows to each need. Nothing is shuffled; large tables stay as they are."""
    return df.coalesce(max(1, -(-most // PER_FILE)))


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text(c: str = "doc_id"):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def crc_mod(c: str, n: int):
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(id_text(c).cast("binary")) % F.lit(n)


#: Slots of 64 bits of a filter of keys: 1 MB, whatever the number of keys.
SLOTS = 1 << 17


def filter_of(keys: DataFrame, *columns: str) -> DataFrame:
    """``(slot, bits)``: a one-hash filter of the keys. It has SLOTS rows at most, so it may be broadcast at any size; full, it lets all rows pass."""
    place = f"xxhash64({', '.join(columns)}, 3)"
    return keys.groupBy(F.expr(f"pmod({place}, {SLOTS})").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftright({place}, 20), 64) as int))")).alias("bits"))


def maybe(rows: DataFrame, bits: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``maybe``: false only for rows whose key is not in the filter."""
    place = f"xxhash64({', '.join(columns)}, 3)"
    marked = rows.join(F.broadcast(bits), F.expr(f"pmod({place}, {SLOTS})") == F.col("slot"), "left")
    return marked.withColumn("maybe", F.expr(f"bits is not null and getbit(bits, cast(pmod(shiftright({place}, 20), 64) as int)) = 1")).drop("slot", "bits")


def text_key(text: str = "text") -> list:
    """128 bits of a text (null is a text of its own)."""
    return [F.xxhash64(F.col(text).cast("binary")).alias("h"), F.xxhash64(F.lit(7), F.col(text).cast("binary")).alias("g")]


def one_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document per group: that with the smallest id, null last.

    ``rows`` has ``(doc_id, h, g, root)`` for each row of ``docs``: its id, ``text_key`` and group. Members that share the smallest id
    are told apart by the hashes of their texts, rows that also share the text by the hash of all their columns; one stays. The
    decision is made on narrow rows; only texts that may go (by a filter of fixed size) are shuffled.
    """
    per = rows.groupBy("doc_id", "h", "g", "root").agg(F.count("*").alias("n"))
    best = per.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")) & (F.col("g") == F.col("best.g"))
    odd = written(per.join(best, "root").select(F.col("doc_id").alias("o"), F.col("h").alias("oh"), F.col("g").alias("og"), "n", kept.alias("stays")).where("not stays or n > 1"), "odd")
    keyed = maybe(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), *text_key()), filter_of(odd, "o", "oh"), "i", "h")
    same = F.col("i").eqNullSafe(F.col("o")) & (F.col("h") == F.col("oh")) & (F.col("g") == F.col("og"))
    held = keyed.where("maybe").join(odd.hint("merge"), same, "left").where("stays is null or stays")
    held = held.groupBy("i", "h", "g").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return keyed.where("not maybe").select("row.*").unionByName(held.select("row.*"))


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged groups of the given sizes: each element's group, and its place in the group."""
    counts = np.asarray(counts, dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(int(counts.sum())) - first[owner]


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows (empty groups give zeros)."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    full = counts > 0
    if full.any():
        first = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, first, axis=0)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected long edges ``(a, b)`` as ``(node, component)``, the smallest node.

    Alternating large-star and small-star rounds; each round is a written table. Minima are partial
    aggregates; tables are written in partitions for their rows; the joins of edges with minima have two plain shuffled sides, so adaptive execution
    splits the rows of a hub. Nodes without an edge have no row. Self loops and null ends are ignored.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark, most = (seen["n"], seen["h"]), 2 * seen["n"]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(packed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), most), "least")
        large = written(packed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), most), "large")
        low = written(packed(large.groupBy("a").agg(F.min("b").alias("m")), most), "low")
        pairs = large.join(low, "a")
        star = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = written(packed(star.distinct(), most), "edges")
        for old in (now, least, large, low):
            dropped(old)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
