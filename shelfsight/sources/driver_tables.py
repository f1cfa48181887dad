"""Views of the driver's tables in the schemas of the operators, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import FeatureParams

AS_OF = "2001-12-31"
PARAMS = FeatureParams(
    genre_buckets={"STANDARD": "niche", "LARGE": "niche", "ECONOMY": "mainstream", "PROMO": "broad_audience"},
    simple_labels=("Small", "Red"),
    complex_labels=("Ring", "LARGE"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """`frame` in as many partitions as a shuffle has, before work that costs far more than its bytes tell: a small file is one task, and small partitions are merged."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items: reviews are line items, the release is the first order's ship date."""
    key = F.struct("l_orderkey", "l_linenumber", "l_shipdate")
    # by supplier first: different suppliers are then counted without a second copy of every line
    by_supplier = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), "l_suppkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("positive"),
        F.count_if(F.col("l_returnflag") == "R").alias("negative"),
        F.count("*").alias("n_lines"),
        F.min(key).alias("first"),
    )
    lines = by_supplier.groupBy("item_id").agg(
        F.sum("positive").alias("positive"),
        F.sum("negative").alias("negative"),
        F.sum("n_lines").alias("n_lines"),
        F.min("first").alias("first"),
        F.min("l_suppkey").alias("supplier"),
        F.count("l_suppkey").alias("n_suppliers"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("publisher"))
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item_id")
    size, pid = F.col("p_size"), F.col("item_id")
    joined = part.join(lines, "item_id", "left").join(suppliers, "supplier", "left")
    count = F.coalesce("n_lines", F.lit(0))
    return joined.select(
        "item_id",
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("maker"),
        F.substring("p_brand", 7, 10).cast("int").alias("cluster_id"),
        "publisher",
        F.array("p_type").alias("genres"),
        F.col("p_retailprice").alias("price"),
        F.coalesce("positive", F.lit(0)).alias("positive"),
        F.coalesce("negative", F.lit(0)).alias("negative"),
        F.nullif(count, F.lit(0)).cast("long").alias("review_count"),
        F.when(count > 0, F.coalesce("positive", F.lit(0)) / count).alias("positive_share"),
        F.col("first.l_shipdate").alias("released"),
        F.when(size % 7 != 0, size * F.lit(1_000_000_000).cast("long")).alias("size_bytes"),
        F.when(size % 5 != 0, size * F.lit(200_000_000).cast("long")).alias("ram_bytes"),
        (pid % 4 == 0).alias("is_early_access"),
        F.when(pid % 8 == 0, (pid % 400).cast("int")).alias("early_access_days"),
        count.cast("int").alias("achievement_count"),
        F.coalesce("n_suppliers", F.lit(0)).cast("int").alias("addon_count"),
        F.when(pid % 11 != 0, (pid % 3 + 1).cast("int")).alias("platform_count"),
        F.when(size % 3 != 0, size).alias("language_count"),
    )


ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS name, p_brand AS maker, CAST(substr(p_brand, 7) AS INT) AS cluster_id, s_name AS publisher,
    p_type AS genre, p_size, p_retailprice AS price, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
    nullif(coalesce(n_lines, 0), 0) AS review_count, CASE WHEN n_lines > 0 THEN positive / n_lines END AS positive_share,
    released, CASE WHEN p_size % 7 <> 0 THEN p_size * 1000000000::BIGINT END AS size_bytes, CASE WHEN p_size % 5 <> 0 THEN p_size * 200000000::BIGINT END AS ram_bytes,
    p_partkey % 4 = 0 AS is_early_access, CASE WHEN p_partkey % 8 = 0 THEN p_partkey % 400 END AS early_access_days,
    coalesce(n_lines, 0) AS achievement_count, coalesce(n_suppliers, 0) AS addon_count,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 3 + 1 END AS platform_count, CASE WHEN p_size % 3 <> 0 THEN p_size END AS language_count
  FROM part LEFT JOIN (
    SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R') AS positive, count(*) FILTER (l_returnflag = 'R') AS negative, count(*) AS n_lines,
      min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_shipdate)).c AS released, min(l_suppkey) AS supplier, count(DISTINCT l_suppkey) AS n_suppliers
    FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = supplier)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, label, votes: the words of a part's name, type and size, votes by lines and place."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))
    words = F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"), F.concat(F.lit("size"), F.col("p_size").cast("string")), F.concat(F.lit("tier"), (F.col("p_size") % 4).cast("string"))), " ")
    counted = part.withColumnRenamed("p_partkey", "item_id").join(lines, "item_id", "left")  # words are split after it: a small file is one task
    each = counted.select("item_id", "n", F.posexplode(F.array_distinct(words)).alias("at", "label"))
    return each.select("item_id", "label", (F.coalesce("n", F.lit(0)) + 10 - F.col("at") * 3).cast("long").alias("votes"))


LABELS = """words AS (
  SELECT p_partkey AS item_id, string_split(lower(p_name) || ' ' || lower(p_type) || ' size' || p_size || ' tier' || (p_size % 4), ' ') AS w FROM part),
each AS (SELECT item_id, unnest(w) AS label, unnest(range(len(w))) AS pos FROM words),
firsts AS (SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) - 1 AS pos FROM each GROUP BY item_id, label),
labels_ AS (SELECT item_id, label, (coalesce(n, 0) + 10 - pos * 3)::BIGINT AS votes
  FROM firsts LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = item_id)"""


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stage log: the user is the run, the type the stage, the value the status."""
    status = F.when(F.col("value") < 10, "running").when(F.col("value") < 25, "succeeded").otherwise("failed")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), status.alias("status"), "ts", F.col("event_id").alias("seq")
    )


STAGE_LOG = """stage_log AS (SELECT user_id AS run_id, event_type AS stage,
  CASE WHEN value < 10 THEN 'running' WHEN value < 25 THEN 'succeeded' ELSE 'failed' END AS status, ts, event_id AS seq FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "ts", level.alias("level"), F.col("props").alias("message"))
