"""Exact dedup: tree-merge of sorted digest runs.

Every input partition is a run: its rows' digests, each with the best identifier seen and a
count. Runs are split by digest into segments, so that no task ever holds a whole run of the
corpus, and within a segment runs are exchanged in rounds of a binomial tree with `fan_in`
children: run r sends to run r // fan_in, which merges the sorted runs and keeps one row a
digest. After the last round a digest has one row, which is sent back down to every run.
A group of copies costs one row a run, however many copies it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import staged, table, text_or_empty

MATCH = ["sha", "n_bytes", "check"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row a document: run, digest (sha256, length, a second hash that verifies it), place in its run's group."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.spark_partition_id().alias("run"),
        F.sha2(text, 256).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def _best(smallest: bool) -> Column:
    """Of rows of one digest: the smallest (or largest) doc_id, nulls last; then the lowest run."""
    known, doc_id = F.col("doc_id").isNotNull(), F.col("doc_id")
    if smallest:
        return F.min(F.struct((~known).alias("unknown"), doc_id.alias("doc_id"), F.col("run")))
    return F.max(F.struct(known.alias("known"), doc_id.alias("doc_id"), (-F.col("run")).alias("run")))


def merge_runs(runs: DataFrame, n_runs: int, *, smallest: bool, fan_in: int = 8) -> DataFrame:
    """Merge (segment, run, digest, best, n) up the tree until each segment has one run."""
    pick = F.min if smallest else F.max
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("segment", "run")
            .sortWithinPartitions("segment", "run", *MATCH)
            .groupBy("segment", "run", *MATCH)
            .agg(pick("best").alias("best"), F.sum("n").alias("n"))
        )
    return runs


def exact_groups(docs: DataFrame, *, keep: str = "smallest", fan_in: int = 8, segments: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for every row of `docs` (text, doc_id; others unused).

    Texts are equal when byte for byte identical; null counts as empty. `keep` is "smallest" or
    "largest" doc_id; a null doc_id loses to any other. Of repeated rows (same doc_id, same
    text) exactly one is kept. An empty table gives an empty result.
    """
    smallest = keep == "smallest"
    rows = staged(digest_runs(docs), "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    order = F.col("doc_id").asc_nulls_last() if smallest else F.col("doc_id").desc_nulls_last()
    level0 = (
        rows.groupBy("run", *MATCH)
        .agg(_best(smallest).alias("best"), F.count("*").alias("n"))
        .withColumn("segment", F.pmod("check", F.lit(max(segments, n_runs))).cast("int"))
    )
    level0 = staged(level0, "runs")
    roots = merge_runs(level0, n_runs, smallest=smallest, fan_in=fan_in).drop("segment", "run")
    # down again: each run's copy of a digest learns the root's answer, and hands it to its own rows
    down = level0.select("run", *MATCH).join(roots, MATCH)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("run", *MATCH).orderBy(order)))
    return ranked.join(down, ["run", *MATCH]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        ((F.col("place") == 1) & (F.col("run") == F.abs(F.col("best.run")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names; keys of rows to be dropped are joined."""
    groups = exact_groups(docs, keep=keep)
    gone = groups.where(~F.col("kept")).select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same"))
    gone = staged(gone, "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(text_or_empty(), 256).alias("sha"))
    others = gone.where(~F.col("same"))
    rows = rows.join(others, rows["id"].eqNullSafe(others["doc_id"]) & (rows["sha"] == others["text_sha256"]), "left_anti")
    if gone.where("same").limit(1).count():  # whole rows repeated: the row that stays has the same key
        first = Window.partitionBy("id", "sha").orderBy(F.lit(1))
        rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("row.*")


def op5_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": OP5_SQL}
