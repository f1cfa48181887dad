"""Helpers shared by the training-data operators.

Words are runs of anything but space and U+0009 to U+000D, in every operator.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own that goes when Python ends, on one machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def drop_staged(spark: SparkSession) -> None:
    """Remove all staged tables. Results that were not read yet are lost with them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shelfsight")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and return the table read back: cuts lineage, survives lost executors.

    Shuffle files of the finished write are of no more use, so Spark is asked to remove them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfsight/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chunk_count(rows: int, per_chunk: int = 20_000, least: int = 64) -> int:
    """How many hash chunks keep a chunk of `rows` rows near `per_chunk`."""
    return max(least, -(-rows // per_chunk))


def running_start(df: DataFrame, group: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """`out` = sum of `value` over the rows before this one in its group, ordered by (chunk, *order).

    Two levels, so that a group with most of the rows is never sorted in one task: sums of
    (group, chunk) are added up per group, rows are only ordered inside their chunk. The join
    is on (group, chunk), where no key holds more than a chunk of rows.
    """
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(group, chunk)
        .agg(F.sum(value).alias("_sum"))
        .select(group, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(bases, [group, chunk])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_base")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v: long); root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder; no
    links or components come to the driver, only one count per round.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = staged(edges.where("u <> v").select(*pair).distinct(), label)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = staged(small.select(*pair).distinct(), label)
        parents = now.groupBy("u").agg(F.count("*").alias("n"))
        tangled = parents.where("n > 1").select("u").unionByName(
            now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi")
        )
        if tangled.limit(1).count() == 0:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
