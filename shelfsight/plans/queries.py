"""Registered queries over the driver's tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..functions import text as T
from ..operators import affinity as A
from ..operators import archetypes as C
from ..operators import features as X
from ..operators import funnel as U
from ..operators import report as R
from ..operators import runs as N
from ..operators import scoring as S
from ..operators import trends as W
from ..operators.select import case_rows, diverse_top
from ..params import AnalysisParams, FeatureParams, FilterParams, canonical
from ..sources import driver_tables as D
from ..sources import tables as B
from ..sources.scratch import scratch_dir, written
from ..streaming import streams as Z
from . import composites as Q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MONTHS = 48
AN = AnalysisParams(min_cluster_size=2)
WINDOW_FROM = f"epoch_us(TIMESTAMP '{D.AS_OF}') - {S.span_micros(MONTHS)}"
WIDTH = S.span_micros(MONTHS // 4)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(frame: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, as the oracle has them."""
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def longs(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- scored items as SQL ----


def _log(name: str, raw: str) -> str:
    if name not in D.PARAMS.bounds:
        return "CAST(NULL AS DOUBLE)"
    low, high = D.PARAMS.bounds[name]
    return f"CASE WHEN {raw} >= 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (log10(({raw})::DOUBLE + 1) - {low!r}::DOUBLE) / ({high!r}::DOUBLE - {low!r}::DOUBLE))) END"


_RAW = {f: f for f in X.FEATURES} | {"early_access_days": "(CASE WHEN is_early_access THEN early_access_days ELSE 0 END)"}
_NORMAL = {f: _log(f, _RAW[f]) for f in X.LOGGED} | {
    "simple_label_score": "1 - simple_label_score", "complex_label_score": "complex_label_score", "platform_count": "(platform_count - 1) / 2.0::DOUBLE",
}
_FILLED = [f for f in X.FEATURES if f != "platform_count"]
_VALUE = {f: f"coalesce(n_{f}, m_{f}, 0.5)" for f in _FILLED} | {"platform_count": "n_platform_count"}
_ABSENT = {f: f"({_RAW[f]} IS NULL" + (f" AND m_{f} IS NOT NULL)" if f in _FILLED else ")") for f in X.FEATURES}
_quoted = lambda names: ", ".join(f"'{n.lower()}'" for n in names)
SCORED = f"""{D.ITEMS}, {D.LABELS},
titles AS (SELECT *, count(*) OVER (PARTITION BY maker) - 1 AS maker_titles,
  CASE genre WHEN 'STANDARD' THEN 'niche' WHEN 'LARGE' THEN 'niche' WHEN 'ECONOMY' THEN 'mainstream' WHEN 'PROMO' THEN 'broad_audience' ELSE 'mainstream' END AS bucket FROM items),
sold AS (SELECT *, review_count * CASE bucket WHEN 'niche' THEN 20.0::DOUBLE WHEN 'mainstream' THEN 30 ELSE 40 END AS sales_low,
  review_count * CASE bucket WHEN 'niche' THEN 27.0::DOUBLE WHEN 'mainstream' THEN 37 ELSE 50 END AS sales_mid,
  review_count * CASE bucket WHEN 'niche' THEN 35.0::DOUBLE WHEN 'mainstream' THEN 45 ELSE 65 END AS sales_high FROM titles),
earned AS (SELECT *, CASE WHEN price <> 0 THEN sales_mid * price END AS revenue_gross, CASE WHEN price <> 0 THEN sales_mid * price * 0.7::DOUBLE END AS revenue_net FROM sold),
shares AS (SELECT item_id, avg((label IN ({_quoted(D.PARAMS.simple_labels)}))::INT) AS simple_label_score, avg((label IN ({_quoted(D.PARAMS.complex_labels)}))::INT) AS complex_label_score FROM labels_ GROUP BY 1),
normal AS (SELECT e.*, simple_label_score, complex_label_score, {", ".join(f"{c} AS n_{f}" for f, c in _NORMAL.items())} FROM earned e LEFT JOIN shares USING (item_id)),
medians AS (SELECT {", ".join(f"median(n_{f}) AS m_{f}" for f in _FILLED)} FROM normal),
scored AS (SELECT normal.*, {", ".join(f"{_VALUE[f]} * {D.PARAMS.weights[f]!r}::DOUBLE AS part_{f}" for f in X.FEATURES)},
  [x FOR x IN [{", ".join(f"CASE WHEN {_ABSENT[f]} THEN '{f}' END" for f in X.FEATURES)}] IF x IS NOT NULL] AS imputed FROM normal, medians),
finished AS (SELECT *, CASE WHEN len(imputed) / 10.0 <= 0.4 AND n_platform_count IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {" + ".join(f"part_{f}" for f in X.FEATURES)})) END AS complexity FROM scored)"""
WITH = f"WITH {SCORED}"
RECENT = f"{SCORED}, recent AS (SELECT * FROM finished WHERE epoch_us(released) >= {WINDOW_FROM})"


def scored(spark, d, labels: DataFrame | None = None) -> DataFrame:
    items = written(D.items(spark, d), "parts")  # counted by maker too, which would read all lines again
    return Q.score_items(X.maker_titles(items, items), D.labels(spark, d) if labels is None else labels, D.PARAMS)


def sold(spark, d) -> DataFrame:
    """Items with their sales, for what needs no complexity."""
    return X.with_sales(D.items(spark, d), D.PARAMS)


# ---- ranking ----

DEMAND = "demand AS (SELECT cluster_id, count(*) AS n_items, median(sales_mid) AS median_sales, median(review_count) AS median_reviews, quantile_cont(sales_mid, 0.25) AS sales_q1, quantile_cont(sales_mid, 0.75) AS sales_q3 FROM recent GROUP BY 1 HAVING count(sales_mid) > 0)"
COMPETITION = "competition AS (SELECT cluster_id, count(*) AS releases, count(*) / (SELECT count(*) FROM recent) AS share FROM recent GROUP BY 1)"
SIMPLICITY = "simplicity AS (SELECT cluster_id, median(complexity) AS median_complexity FROM recent GROUP BY 1 HAVING median(complexity) IS NOT NULL)"
_z = lambda x: f"CASE WHEN stddev_pop({x}) OVER () = 0 THEN 0 ELSE ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () END"
MATRIX = f"""{RECENT}, {DEMAND}, {COMPETITION}, {SIMPLICITY},
zs AS (SELECT *, {_z("median_sales")} AS demand_z, {_z("share")} AS competition_z, {_z("(1 - median_complexity)")} AS simplicity_z
  FROM demand JOIN competition USING (cluster_id) JOIN simplicity USING (cluster_id) WHERE n_items >= 2),
matrix AS (SELECT *, 0.4 * demand_z - 0.3 * competition_z + 0.3 * simplicity_z AS opportunity FROM zs)"""
MATRIX_COLUMNS = ("median_sales", "median_reviews", "sales_q1", "sales_q3", "share", "median_complexity", "demand_z", "competition_z", "simplicity_z", "opportunity")


def recent(spark, d):
    return S.trailing(scored(spark, d), D.AS_OF, MONTHS)


def matrix(spark, d) -> DataFrame:
    return S.opportunity_matrix(recent(spark, d), AN)


@query(f"WITH {MATRIX} SELECT cluster_id, n_items, releases, {', '.join(f'round({c}, 6) AS {c}' for c in MATRIX_COLUMNS)} FROM matrix")
def rank_archetypes(spark, d):
    return r6(matrix(spark, d), *MATRIX_COLUMNS)


@query(f"WITH {RECENT}, {DEMAND} SELECT cluster_id, n_items, round(median_sales, 6) AS median_sales, round(median_reviews, 6) AS median_reviews, round(sales_q1, 6) AS sales_q1, round(sales_q3, 6) AS sales_q3 FROM demand")
def demand(spark, d):
    return r6(S.demand(S.trailing(sold(spark, d), D.AS_OF, MONTHS)), "median_sales", "median_reviews", "sales_q1", "sales_q3")


@query(f"WITH {RECENT}, {COMPETITION} SELECT cluster_id, releases, round(share, 6) AS share FROM competition")
def competition(spark, d):
    return r6(S.competition(S.trailing(sold(spark, d), D.AS_OF, MONTHS)), "share")


@query(f"WITH {RECENT}, {SIMPLICITY} SELECT cluster_id, round(median_complexity, 6) AS median_complexity FROM simplicity")
def simplicity(spark, d):
    return r6(S.simplicity(recent(spark, d)), "median_complexity")


@query(f"WITH {RECENT} SELECT item_id, released FROM recent")
def trailing_window(spark, d):
    return S.trailing(D.items(spark, d), D.AS_OF, MONTHS).select("item_id", "released")


@query(f"{WITH} SELECT item_id, round(complexity, 6) AS complexity FROM finished WHERE complexity <= (SELECT quantile_cont(complexity, 0.4) FROM finished)")
def simple_cut(spark, d):
    return r6(S.simple_cut(scored(spark, d), 0.4).select("item_id", "complexity"), "complexity")


@query(f"{WITH}, c AS (SELECT quantile_cont(complexity, 0.4) AS cut FROM finished) SELECT count(*) FILTER (complexity <= cut) AS simple_size, count(*) FILTER (complexity > cut) AS above, count(*) FILTER (complexity IS NULL) AS unscored FROM finished, c")
def simple_tally(spark, d):
    return S.simple_tally(scored(spark, d), 0.4)


@query(f"{WITH} SELECT item_id, round(complexity, 6) AS complexity FROM finished WHERE complexity <= (SELECT max(complexity) FROM (SELECT complexity FROM finished WHERE complexity IS NOT NULL ORDER BY complexity LIMIT 100))")
def simple_cut_from_size(spark, d):
    return r6(S.simple_from_size(scored(spark, d), 100).select("item_id", "complexity"), "complexity")


_MEDIANS = ("median_complexity", "median_sales_mid", "median_positive_share", "median_price")


@query(f"{WITH} SELECT label, count(DISTINCT item_id) AS n_items, round(median(complexity), 6) AS median_complexity, round(median(sales_mid), 6) AS median_sales_mid, round(median(positive_share), 6) AS median_positive_share, round(median(price), 6) AS median_price FROM labels_ JOIN finished USING (item_id) WHERE votes >= 5 GROUP BY 1")
def label_summary(spark, d):
    return r6(S.label_summary(scored(spark, d), D.labels(spark, d), min_votes=5), *_MEDIANS)


# ---- trends ----

TRENDS = f"""{SCORED}, e AS (SELECT max(epoch_us(released)) AS last FROM finished),
bucketed AS (SELECT cluster_id, CAST(floor((last - epoch_us(released)) / {WIDTH}) AS INT) AS sub_window, last, sales_mid FROM finished, e WHERE released IS NOT NULL),
windows AS (SELECT cluster_id, sub_window, make_timestamp(last - (sub_window + 1) * {WIDTH}) AS starts, make_timestamp(last - sub_window * {WIDTH}) AS ends, count(*) AS n_items, round(median(sales_mid), 6) AS median_sales
  FROM bucketed WHERE sub_window BETWEEN 0 AND 3 GROUP BY cluster_id, sub_window, last HAVING median(sales_mid) IS NOT NULL),
slopes AS (SELECT cluster_id, round(regr_slope(median_sales, sub_window), 6) AS slope, count(median_sales) AS n_points FROM windows GROUP BY 1)"""


def windows(spark, d):
    return r6(W.trend_windows(sold(spark, d), months=MONTHS), "median_sales")


@query(f"WITH {TRENDS} SELECT cluster_id, sub_window, epoch(starts)::BIGINT AS starts, epoch(ends)::BIGINT AS ends, n_items, median_sales FROM windows")
def trend_windows(spark, d):
    return windows(spark, d).withColumns({c: F.floor(F.unix_micros(c) / 1_000_000).cast("long") for c in ("starts", "ends")})


@query(f"WITH {TRENDS} SELECT * FROM slopes")
def trend_slope(spark, d):
    return r6(W.trend_slopes(windows(spark, d)), "slope")


@query(f"WITH {TRENDS} SELECT cluster_id, sub_window, n_items, median_sales, NULL::DOUBLE AS slope, NULL::BIGINT AS n_points FROM windows UNION ALL SELECT cluster_id, NULL, NULL, NULL, slope, n_points FROM slopes")
def trend_union(spark, d):
    found = written(windows(spark, d), "windows")
    return r6(W.trend_rows(found, W.trend_slopes(found)).drop("starts", "ends"), "slope")


BRANDS = tuple(range(1, 26))  # brands of parts are numbered 1 to 25


@query(f"WITH {TRENDS} SELECT epoch(ends)::BIGINT AS ends, {', '.join(f'max(CASE WHEN cluster_id = {k} THEN median_sales END) AS c{k}' for k in BRANDS)} FROM windows GROUP BY ends")
def trend_pivot(spark, d):
    wide = W.trend_pivot(windows(spark, d), list(BRANDS))
    return wide.select(F.floor(F.unix_micros("ends") / 1_000_000).cast("long").alias("ends"), *[F.col(str(k)).alias(f"c{k}") for k in BRANDS])


@query()
def trend_pivot_all(spark, d):
    """A column for every cluster that the windows have; which those are depends on the data, so there is no SQL."""
    wide = W.trend_pivot(windows(spark, d))
    clusters = [c for c in wide.columns if c != "ends"]
    return wide.select(F.floor(F.unix_micros("ends") / 1_000_000).cast("long").alias("ends"), *[F.col(c).alias(f"c{c}") for c in clusters])


# ---- landing and catalog: orders as payloads of customers ----


def order_payloads(spark, d) -> DataFrame:
    orders = D.table(spark, d, "orders")
    body = F.to_json(F.struct(
        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("publisher"), F.col("o_orderkey").cast("string").alias("positive"),
        F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("string")).alias("price"),
    ))
    return orders.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("arrival"), body.alias("payload"))


CATALOG = """catalog AS (SELECT o_custkey AS item_id, o_orderpriority AS name, o_orderstatus AS publisher, o_orderkey AS positive,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE floor(o_totalprice) / 100 END AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""


@query(f"WITH {CATALOG} SELECT item_id, name, publisher, positive, 0::BIGINT AS negative, round(price, 6) AS price FROM catalog")
def catalog_dedup(spark, d):
    return r6(U.build_catalog(order_payloads(spark, d)).select("item_id", "name", "publisher", "positive", "negative", "price"), "price")


@query("SELECT count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders")
def catalog_duplicates(spark, d):
    return U.duplicates(order_payloads(spark, d))


def landed(spark, d) -> DataFrame:
    orders = D.table(spark, d, "orders")
    kinds = F.array(*[F.lit(s) for s in B.ALLOWED_SOURCES])
    body = F.to_json(F.struct((F.col("o_orderstatus") == "F").alias("success")))
    body = F.when(F.col("o_orderkey") % 4 == 2, F.to_json(F.struct((F.col("o_orderkey") % 3).alias("success")))).otherwise(body)
    return orders.select(
        (F.col("o_custkey") % 7).cast("string").alias("run_id"), F.col("o_custkey").alias("item_id"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("source"),
        F.timestamp_seconds("o_orderkey").alias("fetched_at"), F.when(F.col("o_orderkey") % 5 == 0, 500).otherwise(200).alias("http_status"),
        body.alias("payload"), F.sha2(body, 256).alias("payload_sha256"), F.col("o_orderkey").alias("order_key"),
    )


LANDED = "landed AS (SELECT (o_custkey % 7)::VARCHAR AS run_id, o_custkey AS item_id, ['catalog', 'details', 'reviews', 'labels'][o_orderkey % 4 + 1] AS source, o_orderkey AS k, o_orderstatus AS st FROM orders)"


@query(f"WITH {LANDED} SELECT run_id, item_id, source, k AS order_key FROM landed a WHERE NOT EXISTS (FROM landed b WHERE b.k % 3 = 0 AND b.run_id = a.run_id AND b.item_id = a.item_id AND b.source = a.source) QUALIFY row_number() OVER (PARTITION BY run_id, item_id, source ORDER BY k) = 1")
def first_wins_upsert(spark, d):
    rows = landed(spark, d)
    return B.add_payloads(rows.where("order_key % 3 = 0"), rows).select("run_id", "item_id", "source", "order_key")


@query("SELECT c_custkey AS item_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1)")
def resume_keys(spark, d):
    known = landed(spark, d).where("source = 'details'").select("item_id").distinct()
    return B.ids_to_fetch(D.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), known)


@query(f"WITH {LANDED} SELECT run_id, count(*) AS requests FROM (SELECT DISTINCT run_id, item_id, source FROM landed WHERE source <> 'catalog') GROUP BY 1")
def usage_counts(spark, d):
    return N.usage(landed(spark, d))


@query(f"WITH {LANDED}, o AS (SELECT source, CASE source WHEN 'details' THEN st = 'F' WHEN 'reviews' THEN k % 3 = 1 ELSE k % 5 <> 0 END AS ok FROM landed) SELECT source, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM o GROUP BY 1")
def source_outcomes(spark, d):
    return N.source_outcomes(landed(spark, d))


FILTER = FilterParams(min_reviews=50, max_reviews=14_000_000, include_free=False, max_price=4000.0, blocked_publishers=("o",), released_from=None)
COARSE = f"""{CATALOG}, coarse AS (SELECT *, CASE WHEN positive < 50 THEN 'too_few_reviews' WHEN positive > 14000000 THEN 'too_many_reviews' WHEN price = 0 THEN 'free_item'
  WHEN price > 4000 THEN 'too_expensive' WHEN contains(lower(publisher), 'o') THEN 'blocked_publisher' END AS reject_reason FROM catalog),
kept AS (SELECT k.*, c_mktsegment <> 'BUILDING' AS ok, DATE '1995-01-01' + CAST(item_id % 3000 AS INT) AS released FROM coarse k LEFT JOIN customer ON c_custkey = item_id WHERE reject_reason IS NULL),
timed AS (SELECT item_id, CASE WHEN NOT coalesce(ok, false) THEN 'detail_failed' WHEN released < DATE '1996-01-01' THEN 'outside_release_window' WHEN released > DATE '2000-12-31' THEN 'outside_release_window' END AS reject_reason FROM kept)"""


def both_filters(spark, d):
    params = FilterParams(**{**FILTER.__dict__, "released_from": "1996-01-01", "released_to": "2000-12-31"})
    details = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"), (F.col("c_mktsegment") != "BUILDING").alias("success"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("released")
    )
    return Q.funnel(order_payloads(spark, d), details, params)


@query(f"WITH {COARSE} SELECT item_id, reject_reason FROM coarse")
def coarse_filter(spark, d):
    return U.coarse_filter(U.build_catalog(order_payloads(spark, d)), FILTER).select("item_id", "reject_reason")


_KEYLESS = CATALOG.replace("o_custkey AS item_id", "CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS item_id").replace("PARTITION BY o_custkey", "PARTITION BY CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END")


@query(f"WITH {COARSE.replace(CATALOG, _KEYLESS).replace('CASE WHEN positive < 50', 'CASE WHEN item_id IS NULL THEN ' + repr('missing_key') + ' WHEN positive < 50')} SELECT item_id, reject_reason FROM coarse")
def coarse_missing_key(spark, d):
    """Payloads of every tenth customer lack their key: one catalog row, rejected first of all."""
    rows = order_payloads(spark, d).withColumn("item_id", F.when(F.col("item_id") % 10 != 0, F.col("item_id")))
    return U.coarse_filter(U.build_catalog(rows), FILTER).select("item_id", "reject_reason")


@query(f"WITH {COARSE} SELECT item_id, reject_reason FROM timed")
def release_filter(spark, d):
    return both_filters(spark, d)["released"].select("item_id", "reject_reason")


_REASONS = ", ".join(f"'{r}'" for r in (*U.COARSE_REASONS, *U.RELEASE_REASONS))


@query(f"WITH {COARSE}, every AS (SELECT reject_reason FROM coarse UNION ALL SELECT reject_reason FROM timed) SELECT r AS reject_reason, (SELECT count(*) FROM every WHERE reject_reason = r) AS n FROM (SELECT unnest([{_REASONS}]) AS r)")
def funnel_reasons(spark, d):
    return both_filters(spark, d)["tally"]


@query(f"WITH {COARSE} SELECT (SELECT count(*) FROM coarse) AS catalog, (SELECT count(*) FROM kept) AS candidates, count(*) FILTER (reject_reason IS DISTINCT FROM 'detail_failed') AS detail_ok, count(*) FILTER (reject_reason = 'detail_failed') AS detail_failed, count(*) FILTER (reject_reason IS NULL) AS in_window FROM timed")
def funnel_summary(spark, d):
    return both_filters(spark, d)["summary"].drop("criteria")


@query("SELECT 50::BIGINT AS min_reviews, 14000000::BIGINT AS max_reviews, false AS include_free, 4000.0::DOUBLE AS max_price, 'o' AS blocked, '1996-01-01' AS released_from, '2000-12-31' AS released_to, count(DISTINCT o_custkey) AS catalog FROM orders")
def funnel_criteria(spark, d):
    """The criteria that the summary carries."""
    c = "criteria."
    row = both_filters(spark, d)["summary"]
    return row.select(c + "min_reviews", c + "max_reviews", c + "include_free", c + "max_price", F.array_join(c + "blocked_publishers", ",").alias("blocked"), c + "released_from", c + "released_to", "catalog")


@query("""WITH p AS (SELECT o_custkey % 200 AS run_id, year(o_orderdate) AS page, list_sort(list_distinct(list(o_orderkey % 3 + 3 * (year(o_orderdate) % 5)))) AS ids FROM orders GROUP BY 1, 2),
s AS (SELECT *, ids = lag(ids) OVER w OR page >= 2000 AS stop FROM p WINDOW w AS (PARTITION BY run_id ORDER BY page)),
t AS (SELECT *, max(coalesce(stop, false)::INT) OVER (PARTITION BY run_id ORDER BY page) AS stopped FROM s) SELECT run_id, page::BIGINT AS page FROM t WHERE stopped = 0""")
def page_trim(spark, d):
    """Pages of all orders, up to the year 2000; a page repeats the one before only where few orders fall in a year."""
    year = F.year("o_orderdate").cast("long")
    ids = F.col("o_orderkey") % 3 + 3 * (year % 5)
    pages = D.table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("run_id"), year.alias("page")).agg(F.collect_set(ids).alias("ids"))
    return U.pages_to_keep(pages, max_pages=2000).select("run_id", "page")


@query("""WITH p AS (SELECT o_custkey % 200 AS run_id, year(o_orderdate) AS page, list_sort(list_distinct(list(o_orderkey % 3 + 3 * ((year(o_orderdate) + o_custkey % 200) // 3)))) AS ids FROM orders GROUP BY 1, 2),
s AS (SELECT *, ids = lag(ids) OVER w AS stop FROM p WINDOW w AS (PARTITION BY run_id ORDER BY page)),
t AS (SELECT *, max(coalesce(stop, false)::INT) OVER (PARTITION BY run_id ORDER BY page) AS stopped FROM s) SELECT run_id, page::BIGINT AS page FROM t WHERE stopped = 0""")
def page_trim_all(spark, d):
    """Pages of all orders; their ids move on every third year, so that some pages repeat and others do not."""
    run, year = F.col("o_custkey") % 200, F.year("o_orderdate").cast("long")
    ids = F.col("o_orderkey") % 3 + 3 * F.floor((year + run) / 3)
    pages = D.table(spark, d, "orders").groupBy(run.alias("run_id"), year.alias("page")).agg(F.collect_set(ids).alias("ids"))
    return U.pages_to_keep(pages).select("run_id", "page")


@query("SELECT year(o_orderdate)::BIGINT AS page, o_orderkey AS item_id FROM orders WHERE o_orderkey % 2 = 0")
def page_flatten(spark, d):
    """Orders of a customer and year as a page keyed by order id, every second key no number."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("x"), "o_orderkey"))
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.col("o_orderpriority")))))
    pages = D.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("page"), F.col("o_custkey") % 500).agg(body.alias("payload"))
    return U.flatten_pages(pages).select("page", "item_id")


# ---- features from payloads ----


def part_payloads(spark, d):
    part = D.spread(D.table(spark, d, "part").withColumnRenamed("p_partkey", "item_id"), "item_id")
    size, k = F.col("p_size").cast("string"), F.col("item_id").cast("int")
    need = F.concat(F.lit("<li><strong>Memory:</strong> "), size, F.lit(" GB RAM<br></li><li><strong>Storage:</strong> "), size, F.lit(" GB available space</li>"))
    data = F.struct(
        F.when(F.col("item_id") % 10 == 0, "dlc").otherwise("game").alias("type"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.struct(need.alias("minimum")).alias("pc_requirements"), F.array("p_brand").alias("developers"),
        F.struct(F.floor(F.col("p_retailprice") * 100).cast("long").alias("final")).alias("price_overview"),
        F.struct(F.col("p_size").alias("total")).alias("achievements"), F.get(F.array(*map(F.lit, ("English<strong>*</strong>, French,  , German", "English", " , ", "German<strong>*</strong>,Korean"))), k % 4).alias("supported_languages"),
        F.slice(F.array(*map(F.lit, ("x", "y", "z"))), F.lit(1), k % 3).alias("dlc"), F.array(F.struct(F.lit("2").alias("id"), F.col("p_brand").alias("description")), F.struct(F.lit("9").alias("id"), F.lit(None).cast("string").alias("description"))).alias("categories"),
        F.when(k % 7 != 0, F.struct((F.col("p_size") % 4).cast("string").alias("compat_category"))).alias("a_deck_compat"),
        F.create_map(F.lit("windows"), F.lit(True), F.lit("mac"), F.col("item_id") % 2 == 0).alias("platforms"),
        F.array(F.struct(F.lit("1").alias("id"), F.col("p_type").alias("description")), F.struct(F.when(F.col("item_id") % 4 == 0, "70").otherwise("23").alias("id"), F.lit("x").alias("description"))).alias("genres"),
        F.struct(F.get(F.array(*map(F.lit, ("Q2 1999", "5 Jan, 2001", "Mar 7, 2000"))), k % 3).alias("date")).alias("release_date"),
    )
    inner = F.struct((F.col("item_id") % 5 != 0).alias("success"), data.alias("data"))
    details = part.select("item_id", F.to_json(F.create_map(F.col("item_id").cast("string"), inner)).alias("payload"))
    reviews = part.select("item_id", F.to_json(F.struct((F.col("item_id") % 2).alias("success"), F.struct((F.col("p_size") * 2).alias("total_reviews"), F.col("p_size").alias("total_positive")).alias("query_summary"))).alias("payload"))
    catalog = part.select("item_id", F.col("p_name").alias("name"), F.lit("M").alias("maker"), F.lit("P").alias("publisher"), F.col("p_size").cast("long").alias("positive"), F.lit(0).cast("long").alias("negative"), F.lit(None).cast("long").alias("owners_low"), F.lit(None).cast("long").alias("owners_high"))
    return catalog, details, reviews, part.where("item_id % 6 <> 0").select("item_id")


def normal_items(spark, d):
    return X.normalize_items(*part_payloads(spark, d), FeatureParams(software_genres=("PROMO",)))


@query("""SELECT p_partkey AS item_id, p_name AS name, CASE WHEN ok THEN p_brand ELSE 'M' END AS maker, ok AND p_partkey % 10 <> 0 AND p_partkey % 6 <> 0 AND p_type <> 'PROMO' AS in_scope,
 CASE WHEN ok THEN round(floor(p_retailprice * 100) / 100, 6) END AS price, CASE WHEN p_partkey % 2 = 1 THEN p_size * 2 ELSE p_size END::BIGINT AS review_count, CASE WHEN p_partkey % 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS positive_share,
 CASE WHEN ok THEN p_size * 1000000000::BIGINT END AS size_bytes, CASE WHEN ok THEN p_size * 1000000000::BIGINT END AS ram_bytes, CASE WHEN ok THEN p_size END AS achievement_count, CASE WHEN ok THEN [3, 1, NULL, 2][p_partkey % 4 + 1] END AS language_count,
 CASE WHEN ok THEN 1 + (p_partkey % 2 = 0)::INT END AS platform_count, ok AND p_partkey % 4 = 0 AS is_early_access, CASE WHEN ok THEN [DATE '1999-04-01', NULL, DATE '2000-03-07'][p_partkey % 3 + 1] END AS released,
 CASE WHEN p_partkey % 2 = 1 THEN 'reviews' ELSE 'catalog' END AS review_source, CASE WHEN ok THEN p_partkey % 3 END::INT AS addon_count, CASE WHEN ok AND p_partkey % 7 <> 0 THEN (p_size % 4)::VARCHAR END AS handheld,
 coalesce(CASE WHEN ok THEN p_type || '/x' END, '') AS genres, coalesce(CASE WHEN ok THEN p_brand || '/' END, '') AS categories FROM (SELECT *, p_partkey % 5 <> 0 AS ok FROM part)""")
def item_features(spark, d):
    return r6(normal_items(spark, d).select("item_id", "name", "maker", "in_scope", "price", "review_count", "positive_share", "size_bytes", "ram_bytes", "achievement_count", "language_count", "platform_count", "is_early_access", "released", "review_source", "addon_count", "handheld", *[F.coalesce(F.array_join(c, "/"), F.lit("")).alias(c) for c in ("genres", "categories")]), "price", "positive_share")


@query("""WITH p AS (SELECT *, p_partkey % 5 <> 0 AS ok, p_partkey % 10 <> 0 AS game, p_partkey % 6 <> 0 AS listed, p_type = 'PROMO' AS software FROM part)
SELECT count(*) FILTER (ok AND game AND listed AND NOT software) AS kept, count(*) FILTER (ok AND game AND listed AND software) AS software_genre, count(*) FILTER (NOT (ok AND game AND listed)) AS other_type FROM p""")
def drop_reasons(spark, d):
    return X.drop_reasons(normal_items(spark, d))


@query("SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 = 0 THEN 'price,size_bytes,ram_bytes,achievement_count,language_count,platform_count' WHEN p_partkey % 4 = 2 THEN 'language_count' ELSE '' END AS missing FROM part")
def missing_fields(spark, d):
    return normal_items(spark, d).select("item_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT p_partkey AS item_id FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def software_items(spark, d):
    genres = D.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array("p_type").alias("genres"))
    return X.software_ids(genres, ("PROMO", "SMALL"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    parsed = F.from_json("props", "k bigint")
    return D.table(spark, d, "events").groupBy(parsed["k"].alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS item_id, CASE p_partkey % 8 WHEN 0 THEN p_size * 1000000000::BIGINT WHEN 1 THEN p_size * 1048576::BIGINT WHEN 2 THEN p_size * 1500000::BIGINT
 WHEN 4 THEN 7000000000 WHEN 6 THEN p_size * 1000000000::BIGINT WHEN 7 THEN p_size * 1000::BIGINT END::BIGINT AS bytes FROM part""")
def size_text(spark, d):
    """Sizes in eight forms; a sign between number and unit, or a unit that goes on, is no size, and the next line counts."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tenths = F.replace((F.col("p_size") * 3 / 2).cast("decimal(10,1)").cast("string"), F.lit("."), F.lit(","))
    forms = (
        say("<b>OS:</b> 64 GB<br/><b>Hard Drive:</b> ", size, " GB"), say("Storage: ", size, " MiB space"), say("<li>Install size ", tenths, " mb</li>"), say("Memory: 8 GB"),
        say("Storage: ", size, "-GB<br>HDD: 7GB, or more"), say("Storage: ", size, " (GB)\nHard disk: ", size, " gbx"), say("DiskSpace (", size, "\tGB)"), say("storage: v.", size, "KB/s"),
    )
    html = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        html = F.when(k == i, form).otherwise(html)
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), T.storage_bytes(html, F.lit(None).cast("string")).alias("bytes"))


@query("SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 1 THEN p_size * 1000000000::BIGINT WHEN 3 THEN 3000000 WHEN 4 THEN p_size * 1000000::BIGINT END::BIGINT AS bytes FROM part")
def ram_text(spark, d):
    """Memory in six forms: another's, the system's, a name that a number or sign parts from its colon, one behind a sign, and one inside a word."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = (
        say("Video Memory: ", size, " GB"), say("Dedicated Memory: 2 GB\n<strong>Memory:</strong> ", size, " GB RAM"), say("RAM 2: ", size, " GB; Memory-: 1 GB"),
        say("RAM 2: ", size, " GB<br />System RAM : 3 MB"), say("(memory: ", size, "mb)"), say("Program: ", size, " GB<br/>Graphics RAM: 1 GB"),
    )
    html = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        html = F.when(k == i, form).otherwise(html)
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), T.memory_bytes(F.lit(""), html).alias("bytes"))


@query("""SELECT o_orderkey AS item_id, CASE o_orderkey % 8 WHEN 5 THEN make_date(year(o_orderdate), 1, 1) WHEN 6 THEN make_date(year(o_orderdate), 3 * quarter(o_orderdate) - 2, 1) WHEN 7 THEN NULL ELSE o_orderdate::DATE END AS released FROM orders""")
def lenient_dates(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = F.when(k == 7, F.date_format(day, "dd MMM, yyyy")).when(k == 6, F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))).when(k == 5, F.year(day).cast("string"))
    for i, fmt in enumerate(("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")):
        text = text.when(k == i, F.date_format(day, fmt))
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), T.lenient_date(text).alias("released"))


# ---- labels ----


@query(f"WITH {D.LABELS} SELECT item_id, label, votes, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, label) AS rank FROM labels_ WHERE votes >= 3")
def label_rank(spark, d):
    source = D.labels(spark, d).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("labels"))
    return longs(X.extract_labels(source, FeatureParams(min_votes=3)), "rank")


@query(f"WITH {D.LABELS} SELECT item_id, label, votes FROM labels_ QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, label) <= 2")
def label_cap(spark, d):
    return X.rank_labels(D.labels(spark, d), 2).select("item_id", "label", "votes")


@query(f"WITH {D.LABELS} SELECT item_id, label FROM labels_ WHERE label NOT IN (SELECT label FROM labels_ GROUP BY 1 HAVING count(DISTINCT item_id) > 0.15 * (SELECT count(DISTINCT item_id) FROM labels_))")
def generic_labels(spark, d):
    return A.without_generic(D.labels(spark, d), 0.15).select("item_id", "label")


@query(f"WITH {D.LABELS} SELECT item_id, label, votes FROM labels_ WHERE votes >= 12")
def label_scan(spark, d):
    return B.scan_labels(D.labels(spark, d).withColumn("run_id", F.lit("r")), "r", min_votes=12).drop("run_id")


@query(f"WITH {D.LABELS} SELECT item_id, round(avg((label IN ('small', 'red'))::INT), 6) AS share FROM labels_ GROUP BY 1")
def label_share(spark, d):
    return r6(X.label_score(D.labels(spark, d), D.PARAMS.simple_labels, "share"), "share")


SEEN = f"{D.LABELS}, seen AS (SELECT item_id, label, votes FROM labels_ WHERE label NOT IN (SELECT label FROM labels_ GROUP BY 1 HAVING count(DISTINCT item_id) > 0.3 * (SELECT count(DISTINCT item_id) FROM labels_)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, label) <= 20)"
PAIRS = f'''{SEEN}, n AS (SELECT label, count(DISTINCT item_id) AS n FROM seen GROUP BY 1), pairs AS (SELECT x.label AS a, y.label AS b, count(*) AS "both" FROM seen x JOIN seen y ON x.item_id = y.item_id AND x.label < y.label GROUP BY 1, 2), jac AS (SELECT a, b, "both", 1 - "both" / (p.n + q.n - "both") AS distance FROM pairs JOIN n p ON p.label = a JOIN n q ON q.label = b)'''


def seen(spark, d):
    return A.clustering_labels(D.labels(spark, d), min_votes=-100, generic_share=0.3, most=20)


@query(f'''WITH {PAIRS} SELECT a, b, "both", round(distance, 6) AS distance FROM jac''')
def label_jaccard(spark, d):
    return r6(A.jaccard(seen(spark, d)), "distance")


@query(f"WITH {PAIRS} SELECT x.label AS a, y.label AS b, round(CASE WHEN x.label = y.label THEN 0 ELSE coalesce(distance, 1) END, 6) AS distance FROM n x CROSS JOIN n y LEFT JOIN jac j ON j.a = least(x.label, y.label) AND j.b = greatest(x.label, y.label)")
def label_matrix(spark, d):
    return r6(A.jaccard_matrix(seen(spark, d)), "distance")


@query(f"WITH {SEEN}, s AS (SELECT item_id, count(*) AS n FROM seen GROUP BY 1) SELECT label, sum(n)::BIGINT AS popularity FROM seen JOIN s USING (item_id) GROUP BY 1")
def label_popularity(spark, d):
    return A.popularity(seen(spark, d))


# ---- archetypes ----


@query()
def archetype_avg_linkage(spark, d):
    labels = seen(spark, d)
    members, _ = C.linkage(labels.select("label").distinct(), A.jaccard(labels).select("a", "b", "distance"), threshold=0.93)
    return C.numbered(members)


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM jac WHERE distance <= 0.9 UNION SELECT b, a FROM jac WHERE distance <= 0.9),
walk(label, root) AS (SELECT label, label FROM n UNION SELECT e.y, w.root FROM walk w JOIN e ON e.x = w.label) SELECT label, min(root) AS root FROM walk GROUP BY 1""")
def archetype_single_linkage(spark, d):
    labels = seen(spark, d)
    return C.linkage(labels.select("label").distinct(), A.jaccard(labels).select("a", "b", "distance"), method="single", threshold=0.9)[0]


@query()
def threshold_search(spark, d):
    labels = seen(spark, d)
    kinds = A.label_kinds(labels)
    _, merges = C.linkage(A.kind_labels(kinds).select("label").distinct(), A.kinds_jaccard(kinds).select("a", "b", "distance"))
    threshold, source = C.search_threshold(labels, merges, most_share=0.3, kinds=kinds)
    return merges.select("distance", "a", "b", (F.col("distance") <= F.lit(threshold)).alias("within"), F.lit(source).alias("source"))


UPTO = 0.88  # no distance beyond is tried: single linkage makes a chain of the labels, a merge a round


def threshold_sql(most_share: float) -> str:
    """found (threshold, source) over seen, n and jac: partitions of single linkage at every distance up to UPTO, votes at those where clusters merge."""
    return f"""ed AS (SELECT a AS x, b AS y, round(distance, 12) AS d FROM jac UNION ALL SELECT b, a, round(distance, 12) FROM jac), ds AS (SELECT DISTINCT d FROM ed WHERE d <= {UPTO}),
tw(d, label, root) AS (SELECT d, label, label FROM ds, n UNION SELECT w.d, e.y, w.root FROM tw w JOIN ed e ON e.x = w.label AND e.d <= w.d),
parts AS (SELECT d, label, min(root) AS root FROM tw GROUP BY 1, 2),
merged AS (SELECT d FROM (SELECT d, k, lag(k, 1, (SELECT count(*) FROM n)) OVER (ORDER BY d) AS before FROM (SELECT d, count(DISTINCT root) AS k FROM parts GROUP BY 1)) WHERE k < before),
votes AS (SELECT d, item_id, root, count(*) AS c FROM seen JOIN parts USING (label) WHERE d IN (SELECT d FROM merged) GROUP BY 1, 2, 3),
won AS (SELECT d, root FROM votes QUALIFY row_number() OVER (PARTITION BY d, item_id ORDER BY c DESC, root) = 1),
largest AS (SELECT d, max(m) / (SELECT count(DISTINCT item_id) FROM seen) AS share FROM (SELECT d, root, count(*) AS m FROM won GROUP BY 1, 2) GROUP BY 1),
good AS (SELECT max(d) AS d FROM largest WHERE d < coalesce((SELECT min(d) FROM largest WHERE share > {most_share}), 2)),
found AS (SELECT coalesce((SELECT d FROM good), (SELECT min(d) FROM largest)) AS threshold, CASE WHEN (SELECT d FROM good) IS NULL THEN 'smallest' ELSE 'searched' END AS source)"""


@query(f"WITH RECURSIVE {PAIRS}, {threshold_sql(0.3)} SELECT round(threshold, 9) AS threshold, source FROM found")
def threshold_search_single(spark, d):
    labels = seen(spark, d)
    kinds = A.label_kinds(labels)
    _, merges = C.linkage(A.kind_labels(kinds).select("label").distinct(), A.kinds_jaccard(kinds).select("a", "b", "distance"), method="single", threshold=UPTO)
    threshold, source = C.search_threshold(labels, merges, most_share=0.3, kinds=kinds)
    return spark.range(1).select(F.round(F.lit(threshold).cast("double"), 9).alias("threshold"), F.lit(source).alias("source"))


GIVEN = f"{SEEN}, given AS (SELECT DISTINCT label, length(label)::INT AS cluster_id FROM seen), counted AS (SELECT item_id, cluster_id, count(*) AS n FROM seen JOIN given USING (label) GROUP BY 1, 2), placed AS (SELECT item_id, cluster_id FROM counted QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, cluster_id) = 1)"


def given(spark, d):
    labels = seen(spark, d)
    return labels, labels.select("label", F.length("label").alias("cluster_id")).distinct()


@query(f"WITH {GIVEN} SELECT * FROM placed")
def plurality_vote(spark, d):
    return C.vote(*given(spark, d))


@query(f"WITH {GIVEN} SELECT cluster_id, round(avg((item_id IN (SELECT item_id FROM labels_ WHERE label = 'red'))::INT), 6) AS red_share, round(avg((item_id IN (SELECT item_id FROM labels_ WHERE label = 'ring'))::INT), 6) AS ring_share FROM placed GROUP BY 1")
def mode_share(spark, d):
    shares = S.mode_shares(C.vote(*given(spark, d)), D.labels(spark, d), {"red_share": "red", "ring_share": "ring"})
    return r6(shares, "red_share", "ring_share")


@query(f"WITH {GIVEN}, s AS (SELECT item_id, count(*) AS n FROM seen GROUP BY 1), pop AS (SELECT label, sum(n) AS p FROM seen JOIN s USING (item_id) GROUP BY 1) SELECT cluster_id, array_to_string(list(label ORDER BY p DESC, label)[1:3], ' / ') AS name, count(*) AS n_members FROM given JOIN pop USING (label) GROUP BY 1")
def archetype_label(spark, d):
    labels, clusters = given(spark, d)
    return C.cluster_names(clusters, A.popularity(labels)).select("cluster_id", "name", F.size("members").cast("long").alias("n_members"))


RUN = AnalysisParams(generic_share=0.3, distance_threshold=0.85, linkage="single", min_votes=-100, min_cluster_size=2)
#: The steps of an analysis: simple items, their labels, clusters of these, votes, names, shares of modes.
ANALYSIS = f"""{SCORED}, simple AS (SELECT * EXCLUDE (cluster_id) FROM finished WHERE complexity <= (SELECT quantile_cont(complexity, 0.4) FROM finished)),
own AS (SELECT l.* FROM labels_ l SEMI JOIN simple USING (item_id)),
seen AS (SELECT item_id, label, votes FROM own WHERE label NOT IN (SELECT label FROM own GROUP BY 1 HAVING count(DISTINCT item_id) > 0.3 * (SELECT count(DISTINCT item_id) FROM own)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, label) <= 20),
n AS (SELECT label, count(DISTINCT item_id) AS n FROM seen GROUP BY 1), pairs AS (SELECT x.label AS a, y.label AS b, count(*) AS "both" FROM seen x JOIN seen y ON x.item_id = y.item_id AND x.label < y.label GROUP BY 1, 2),
jac AS (SELECT a, b, 1 - "both" / (p.n + q.n - "both") AS distance FROM pairs JOIN n p ON p.label = a JOIN n q ON q.label = b),
e AS (SELECT a AS x, b AS y FROM jac WHERE round(distance, 12) <= {RUN.distance_threshold} UNION SELECT b, a FROM jac WHERE round(distance, 12) <= {RUN.distance_threshold}),
walk(label, root) AS (SELECT label, label FROM n UNION SELECT e.y, w.root FROM walk w JOIN e ON e.x = w.label),
clusters AS (SELECT label, dense_rank() OVER (ORDER BY root)::INT AS cluster_id FROM (SELECT label, min(root) AS root FROM walk GROUP BY 1)),
assigned AS (SELECT item_id, cluster_id FROM (SELECT item_id, cluster_id, count(*) AS n FROM seen JOIN clusters USING (label) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, cluster_id) = 1),
pop AS (SELECT label, sum(m) AS p FROM seen JOIN (SELECT item_id, count(*) AS m FROM seen GROUP BY 1) USING (item_id) GROUP BY 1),
names AS (SELECT cluster_id, array_to_string(list(label ORDER BY p DESC, label)[1:3], ' / ') AS name FROM clusters JOIN pop USING (label) GROUP BY 1),
placed AS (SELECT s.*, a.cluster_id FROM simple s JOIN assigned a USING (item_id)), recent AS (SELECT * FROM placed WHERE epoch_us(released) >= {WINDOW_FROM}), {DEMAND}, {COMPETITION}, {SIMPLICITY},
zs AS (SELECT *, {_z("median_sales")} AS demand_z, {_z("share")} AS competition_z, {_z("(1 - median_complexity)")} AS simplicity_z
  FROM demand JOIN competition USING (cluster_id) JOIN simplicity USING (cluster_id) WHERE n_items >= 2),
matrix AS (SELECT *, 0.4 * demand_z - 0.3 * competition_z + 0.3 * simplicity_z AS opportunity FROM zs),
modes AS (SELECT cluster_id, {", ".join(f"avg((item_id IN (SELECT item_id FROM own WHERE label = '{v}'))::INT) AS {k}" for k, v in S.PLAY_MODES.items())} FROM assigned GROUP BY 1)"""


def analysed(spark, d) -> tuple[DataFrame, DataFrame, dict]:
    """Scored items, their labels, and what the analysis found in them."""
    labels = written(D.labels(spark, d), "labels")  # read by scores, clusters and cases; each reading would count all lines anew
    items = written(scored(spark, d, labels).drop("cluster_id").withColumn("effort_return", F.round("effort_return", 6)), "items")
    return items, labels, Q.analyse(items, labels, D.AS_OF, RUN)


@query(f"WITH RECURSIVE {ANALYSIS} SELECT cluster_id, n_items, releases, name, {', '.join(f'round({c}, 6) AS {c}' for c in (*MATRIX_COLUMNS, *S.PLAY_MODES))} FROM matrix LEFT JOIN names USING (cluster_id) LEFT JOIN modes USING (cluster_id)")
def analysis_run(spark, d):
    """Archetypes of the simple items, ranked, with names and shares of modes."""
    return r6(analysed(spark, d)[2]["matrix"], *MATRIX_COLUMNS, *S.PLAY_MODES)


@query()
def analysis_average(spark, d):
    """The same with average linkage, which has no SQL."""
    params = AnalysisParams(generic_share=0.3, distance_threshold=0.95, min_votes=-100, min_cluster_size=2)
    return Q.analyse(scored(spark, d).drop("cluster_id"), D.labels(spark, d), D.AS_OF, params)["matrix"]


# ---- sales, revenue, complexity ----


@query(f"{WITH} SELECT item_id, bucket, sales_low, sales_mid, sales_high FROM sold")
def bucket_sales(spark, d):
    return X.with_sales(D.items(spark, d), D.PARAMS).select("item_id", "bucket", "sales_low", "sales_mid", "sales_high")


@query(f"{WITH} SELECT item_id, round(revenue_gross, 4) AS revenue_gross, round(revenue_net, 4) AS revenue_net FROM earned")
def revenue_band(spark, d):
    out = X.with_revenue(X.with_sales(D.items(spark, d), D.PARAMS), D.PARAMS)
    return out.select("item_id", F.round("revenue_gross", 4).alias("revenue_gross"), F.round("revenue_net", 4).alias("revenue_net"))


@query(f"{WITH} SELECT item_id, round(revenue_net / (complexity + 0.05), 3) AS effort_return FROM finished")
def effort_return(spark, d):
    return scored(spark, d).select("item_id", F.round("effort_return", 3).alias("effort_return"))


@query("SELECT p_partkey AS item_id, count(*) OVER (PARTITION BY p_brand) - 1 AS maker_titles FROM part")
def maker_other_titles(spark, d):
    part = D.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("maker"))
    return X.maker_titles(part, part).select("item_id", "maker_titles")


@query(f"{WITH} SELECT item_id, round(complexity, 6) AS complexity, {', '.join(f'round(part_{f}, 6) AS {f}' for f in X.FEATURES)} FROM finished")
def complexity(spark, d):
    return scored(spark, d).select("item_id", F.round("complexity", 6).alias("complexity"), *[F.round(f"contributions.{f}", 6).alias(f) for f in X.FEATURES])


@query(f"{WITH} SELECT item_id, array_to_string(imputed, ',') AS imputed FROM finished")
def complexity_imputed(spark, d):
    return scored(spark, d).select("item_id", F.array_join("imputed", ",").alias("imputed"))


_FROZEN = ("size_bytes", "ram_bytes", "achievement_count", "addon_count", "language_count")


@query(f"WITH {D.ITEMS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont(log10({c} + 1), 0.05), 6) AS low, round(quantile_cont(log10({c} + 1), 0.95), 6) AS high, count({c}) AS n FROM items" for c in _FROZEN))
def bounds_freeze(spark, d):
    return r6(X.frozen_bounds(D.items(spark, d).select(*_FROZEN)), "low", "high")


@query(f"{WITH} SELECT count(*) AS n_rows, count(*) FILTER (item_id % 10 = 0) AS out_of_scope, 0::BIGINT AS free, 0::BIGINT AS unknown_price, count(*) FILTER (genre IN ('MEDIUM', 'SMALL')) AS first_genre_unmatched, {', '.join(f'''round(avg(list_contains(imputed, '{f}')::INT), 6) AS imputed_{f}''' for f in X.FEATURES)} FROM finished")
def enrich_report(spark, d):
    items = scored(spark, d).withColumn("in_scope", F.col("item_id") % 10 != 0)
    items = items.withColumn("first_genre_known", F.get("genres", 0).isin(*D.PARAMS.genre_buckets))
    return r6(X.enrichment_report(items), *[f"imputed_{f}" for f in X.FEATURES])


# ---- selection and views ----


def diverse_sql(source: str) -> str:
    """The choice from `source` (item_id, cluster_id, maker, effort_return) row by row: at most 2 a cluster and 1 a maker, then, if that is under 15, 3 a cluster."""

    def walk(name: str, start: str, cap: int) -> str:
        return f"""{name}(r, items, clusters, makers) AS (SELECT 0::BIGINT, {start} UNION ALL
  SELECT x.r, CASE WHEN fits THEN list_append(items, x.item_id) ELSE items END, CASE WHEN fits THEN list_append(clusters, x.cluster_id) ELSE clusters END, CASE WHEN fits THEN list_append(makers, x.maker) ELSE makers END
  FROM (SELECT w.*, o.r AS r1, o.item_id, o.cluster_id, o.maker, len(w.items) < 15 AND len([c FOR c IN w.clusters IF c = o.cluster_id]) < {cap} AND NOT list_contains(w.makers, o.maker) AS fits FROM {name} w JOIN ordered o ON o.r = w.r + 1) AS x(r0, items, clusters, makers, r, item_id, cluster_id, maker, fits))"""

    return f"""ordered AS (SELECT item_id, cluster_id, maker, row_number() OVER (ORDER BY effort_return DESC, item_id) AS r FROM {source} WHERE effort_return IS NOT NULL AND cluster_id IS NOT NULL),
{walk("pass1", "[]::BIGINT[], []::INT[], []::VARCHAR[]", 2)}, first AS (SELECT * FROM pass1 ORDER BY r DESC LIMIT 1),
{walk("pass2", "(SELECT items FROM first), (SELECT clusters FROM first), (SELECT makers FROM first)", 3)},
picked AS (SELECT items, (SELECT len(items) < 15 FROM first) AS relaxed FROM pass2 ORDER BY r DESC LIMIT 1),
chosen AS (SELECT unnest(items)::BIGINT AS item_id, unnest(range(1, len(items) + 1))::INT AS place, relaxed FROM picked)"""


DIVERSE = f"RECURSIVE {SCORED}, returns AS (SELECT *, round(revenue_net / (complexity + 0.05), 6) AS effort_return FROM finished), {diverse_sql('returns')} SELECT * FROM chosen"
_SENTENCE = """concat_ws(', ', 'In ' || archetype || ': ' || review_count || ' reviews' || coalesce(' (' || printf('%.0f', positive_share * 100) || '% positive)', ''), '$' || printf('%.2f', price),
  CASE WHEN size_bytes >= 1000000000 THEN printf('%.1f', size_bytes / 1e9) || 'GB on disk' WHEN size_bytes >= 0 THEN printf('%.0f', size_bytes / 1e6) || 'MB on disk' END,
  CASE WHEN maker_titles = 1 THEN 'one earlier title' ELSE maker_titles || ' earlier titles' END, 'which may point to a small scope.')"""
_CASES = f"""SELECT place, item_id, maker, cluster_id, archetype, price, review_count, effort_return, relaxed, sales_low, sales_mid, sales_high,
  (SELECT array_to_string(list(label ORDER BY k), ' / ') FROM (SELECT label, row_number() OVER (ORDER BY votes DESC, label) AS k FROM labels_ l WHERE l.item_id = c.item_id) WHERE k <= 3) AS top_labels,
  (SELECT array_to_string(list(f ORDER BY v DESC, f)[1:5], ' / ') FROM (SELECT unnest([{", ".join(f"coalesce(part_{f}, 0)" for f in X.FEATURES)}]) AS v, unnest([{", ".join(f"'{f}'" for f in X.FEATURES)}]) AS f)) AS drivers,
  {_SENTENCE} AS rationale, '{{link}}/' || item_id AS link FROM cases c"""


def flat_cases(cases: DataFrame) -> DataFrame:
    """Case rows without lists or structs, as the oracle has them."""
    plain = ("place", "item_id", "maker", "cluster_id", "archetype", "price", "review_count", "effort_return", "relaxed")
    return cases.select(*plain, *[F.col(f"sales.{k}").alias(f"sales_{k}") for k in ("low", "mid", "high")], *[F.array_join(c, " / ").alias(c) for c in ("top_labels", "drivers")], "rationale", "link")


@query(f"WITH {DIVERSE}")
def diverse_topn(spark, d):
    """Returns to six places, so that the order does not hang on the last bit."""
    return diverse_top(scored(spark, d).withColumn("effort_return", F.round("effort_return", 6)))


@query(DIVERSE.replace(" SELECT * FROM chosen", f", cases AS (SELECT *, maker AS archetype FROM chosen JOIN returns USING (item_id)) {_CASES.format(link='item')}").replace("RECURSIVE", "WITH RECURSIVE", 1))
def case_studies(spark, d):
    """The chosen items with bands, labels, drivers, sentence and link."""
    items = written(scored(spark, d).withColumn("effort_return", F.round("effort_return", 6)), "scored")
    picked = written(diverse_top(items), "picked")  # read twice
    names = items.select("cluster_id", "maker").distinct().withColumnRenamed("maker", "name")
    return flat_cases(case_rows(picked, items, names, Q.picked_labels(picked, D.labels(spark, d)), link="item"))


_VIEW = ("demand_z", "competition_z", "simplicity_z", "opportunity", "median_complexity")


@query(f"WITH {MATRIX} SELECT cluster_id, n_items, {', '.join(f'round_even({c}, 2)::DOUBLE AS {c}' for c in _VIEW)}, round_even(median_sales, 0)::DOUBLE AS median_sales FROM matrix WHERE n_items >= 3")
def matrix_view(spark, d):
    return R.matrix_view(matrix(spark, d), min_items=3).select("cluster_id", "n_items", *_VIEW, "median_sales")


@query(f"{WITH}, t AS (SELECT label, count(DISTINCT item_id) AS n_items, round_even(median(complexity), 2)::DOUBLE AS median_complexity, round_even(median(price), 0)::DOUBLE AS median_price FROM labels_ JOIN finished USING (item_id) WHERE votes >= 5 GROUP BY 1) SELECT * FROM t ORDER BY n_items DESC, label LIMIT 20")
def label_table(spark, d):
    view = R.label_view(S.label_summary(scored(spark, d), D.labels(spark, d), min_votes=5), top_n=20)
    return view.select("label", "n_items", "median_complexity", "median_price")


@query(f"WITH {MATRIX} SELECT cluster_id, round(opportunity, 6) AS opportunity FROM matrix ORDER BY opportunity DESC, cluster_id LIMIT 15")
def top_archetypes(spark, d):
    return r6(R.top_rows(matrix(spark, d), "opportunity", 15, "cluster_id").select("cluster_id", "opportunity"), "opportunity")


@query(f"WITH {MATRIX} SELECT (SELECT count(*) FROM finished) AS catalog, cluster_id, round(opportunity, 6) AS opportunity, 'Brand#' || cluster_id AS name FROM matrix ORDER BY matrix.opportunity DESC, cluster_id LIMIT 1")
def headline(spark, d):
    items = written(scored(spark, d), "scored")
    names = items.select("cluster_id", F.col("maker").alias("name")).distinct()
    best = S.opportunity_matrix(S.trailing(items, D.AS_OF, MONTHS), AN)
    return r6(R.headline(best, names, items.agg(F.count("*").alias("catalog"))), "opportunity")


@query(f"WITH {D.ITEMS} SELECT item_id, size_bytes FROM items")
def all_null_columns(spark, d):
    items = D.items(spark, d).select("item_id", "size_bytes", F.lit(None).cast("double").alias("nothing"), F.when(F.col("item_id") < 0, "x").alias("never"))
    return R.without_empty(items)


@query(f"WITH {D.ITEMS} SELECT item_id, concat_ws(', ', 'In ' || maker || ': ' || review_count || ' reviews' || coalesce(' (' || printf('%.0f', positive_share * 100) || '% positive)', ''), '$' || printf('%.2f', price), CASE WHEN size_bytes >= 1000000000 THEN printf('%.1f', size_bytes / 1e9) || 'GB on disk' WHEN size_bytes >= 0 THEN printf('%.0f', size_bytes / 1e6) || 'MB on disk' END, CASE WHEN titles = 1 THEN 'one earlier title' ELSE titles || ' earlier titles' END, 'which may point to a small scope.') AS sentence, 'item/' || item_id AS link FROM (SELECT *, count(*) OVER (PARTITION BY maker) - 1 AS titles FROM items)")
def rationale_text(spark, d):
    """Sentence and link of every item, with its maker's other titles."""
    c = F.col
    found = D.items(spark, d)
    items = X.maker_titles(found, D.table(spark, d, "part").select(F.col("p_brand").alias("maker")))
    return items.select("item_id", T.rationale(c("review_count"), c("positive_share"), c("price"), c("size_bytes"), c("maker_titles"), c("maker")).alias("sentence"), T.item_link("item", c("item_id")).alias("link"))


@query(f"WITH {D.ITEMS} SELECT item_id, concat_ws(', ', 'In ' || maker || ': ' || review_count || ' reviews' || coalesce(' (' || printf('%.0f', positive_share * 100) || '% positive)', ''), '$' || printf('%.2f', price), CASE WHEN size_bytes >= 1000000000 THEN printf('%.1f', size_bytes / 1e9) || 'GB on disk' WHEN size_bytes >= 0 THEN printf('%.0f', size_bytes / 1e6) || 'MB on disk' END, 'which may point to a small scope.') AS sentence FROM items")
def rationale_all(spark, d):
    """All items, those without reviews too."""
    c = F.col
    none = F.lit(None).cast("int")
    return D.items(spark, d).select("item_id", T.rationale(c("review_count"), c("positive_share"), c("price"), c("size_bytes"), none, c("maker")).alias("sentence"))


@query(f"WITH {D.ITEMS} SELECT item_id, left(sha256('{canonical(AN)}' || item_id), 12) AS version FROM items")
def param_version(spark, d):
    return D.items(spark, d).select("item_id", T.text_version(F.concat(F.lit(canonical(AN)), F.col("item_id").cast("string"))).alias("version"))


@query(f"{WITH} SELECT item_id, price FROM finished WHERE price > 900.5 AND maker = 'Brand#3'")
def item_scan(spark, d):
    """Over a stored table of several runs, in the order of prices, with bloom filters for makers."""
    items = D.items(spark, d).select("item_id", "price", "maker", F.explode(F.array(F.lit("r"), F.lit("s"))).alias("run_id"))
    path = fresh(spark, "stored-items")
    B.store_items(items, path, order=["price"], blooms=["maker"])
    stored = B.read_table(spark, path, "item_id long, price double, maker string, run_id string")
    return B.scan_items(stored, "r", columns=["item_id", "price"], where="price > 900.5 and maker = 'Brand#3'")


@query("SELECT l_orderkey, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS x FROM lineitem")
def json_safe(spark, d):
    ratio = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    return r6(B.json_safe(D.table(spark, d, "lineitem").select("l_orderkey", ratio.alias("x"))), "x")


# ---- runs, stages, events ----


def runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("succeeded")
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


@query("SELECT o_orderkey AS run_id, coalesce(n, 0)::BIGINT AS n_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20")
def run_listing(spark, d):
    items = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return N.list_runs(runs(spark, d), items, limit=50, offset=20).select("run_id", "n_items")


@query("SELECT o_orderkey AS run_id, coalesce(n, 0)::BIGINT AS n_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 350")
def run_page(spark, d):
    """The eighth page of the listing, found by rank."""
    items = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return N.runs_page(runs(spark, d), items, 7, limit=50).select("run_id", "n_items")


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def orphan_runs(spark, d):
    live = D.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("run_id")).distinct()
    return N.orphans(runs(spark, d), live).select("run_id")


STATE = f"{D.STAGE_LOG}, state AS (SELECT run_id, stage, arg_max(status, seq) AS status, count(*) FILTER (status = 'running') AS attempt, max(ts) FILTER (status = 'running') AS started_at, arg_max(ts, seq) AS last FROM stage_log GROUP BY 1, 2)"


@query(f"WITH {STATE} SELECT run_id, stage, status, attempt, CASE WHEN status <> 'running' THEN last END AS finished_at FROM state")
def stage_state(spark, d):
    return N.stage_state(D.stage_log(spark, d)).select("run_id", "stage", "status", "attempt", "finished_at")


@query(f"WITH {STATE}, done AS (SELECT run_id, list(stage) FILTER (status = 'succeeded') AS done FROM state GROUP BY 1), m AS (SELECT run_id, [s FOR s IN ['view', 'click', 'purchase'] IF NOT coalesce(list_contains(done, s), false)] AS missing FROM done) SELECT run_id, array_to_string(missing, ',') AS missing, len(missing) > 0 AS is_partial FROM m")
def partial_runs(spark, d):
    found = N.partial_runs(N.stage_state(D.stage_log(spark, d)), ("view", "click", "purchase"))
    return found.withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {STATE}, spans AS (SELECT run_id, min(started_at) AS a, max(CASE WHEN status <> 'running' THEN last END) AS b FROM state GROUP BY 1) SELECT user_id AS run_id, round(epoch(b) - epoch(a), 3) AS seconds FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN spans ON run_id = user_id")
def run_duration(spark, d):
    log = D.stage_log(spark, d)
    ids = log.select("run_id").distinct().select("run_id", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return N.run_seconds(ids, N.stage_state(log)).withColumn("seconds", F.round("seconds", 3))


@query(f"""WITH {STATE}, spans AS (SELECT run_id, min(started_at) AS a, max(CASE WHEN status <> 'running' THEN last END) AS b, list(stage) FILTER (status = 'succeeded') AS done FROM state GROUP BY 1),
m AS (SELECT c_custkey AS run_id, lower(c_mktsegment) AS status, round(epoch(b) - epoch(a), 3) AS seconds, array_to_string([s FOR s IN ['view', 'click', 'purchase'] IF NOT coalesce(list_contains(done, s), false)], ', ') AS missing FROM customer LEFT JOIN spans ON run_id = c_custkey)
SELECT *, missing <> '' AS is_partial, CASE WHEN missing <> '' THEN 'This run is partial. Missing: ' || missing || '. Results are those of the stages that ended.' END AS notice FROM m""")
def run_summaries(spark, d):
    """Duration, missing stages and notice of every run; customers are runs, many without a stage."""
    none = F.lit(None).cast("timestamp")
    runs = D.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lower("c_mktsegment").alias("status"), none.alias("started_at"), none.alias("finished_at"))
    found = N.run_summary(runs, N.stage_state(D.stage_log(spark, d)), ("view", "click", "purchase"))
    return found.withColumn("seconds", F.round("seconds", 3)).withColumn("missing", F.array_join("missing", ", "))


@query("SELECT event_id, user_id AS run_id FROM events WHERE user_id = 7 AND event_id > 500")
def event_tail(spark, d):
    return N.events_after(D.event_log(spark, d), 7, 500).select("event_id", "run_id")


@query("SELECT event_id FROM events WHERE event_type <> 'signup' AND (value IS NULL OR value <= 60)")
def event_validity(spark, d):
    level = F.when(F.col("event_type") == "signup", "shout").otherwise("info")
    log = D.table(spark, d, "events").select("event_id", level.alias("level"), (F.col("value") / 60).alias("progress"))
    return N.valid_events(log).select("event_id")


THROTTLED = """RECURSIVE info AS (SELECT event_id, user_id AS run_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'),
firsts AS (SELECT run_id, t, min(event_id) AS event_id FROM info GROUP BY 1, 2),
kept(run_id, t) AS (SELECT run_id, min(t) FROM firsts GROUP BY 1 UNION ALL SELECT k.run_id, min(f.t) FROM kept k JOIN firsts f ON f.run_id = k.run_id AND f.t >= k.t + 36000000000 GROUP BY 1)
SELECT event_id, user_id AS run_id FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, run_id FROM firsts JOIN kept USING (run_id, t)"""


@query(f"WITH {THROTTLED}")
def info_throttle(spark, d):
    return N.throttle_info(D.event_log(spark, d), gap_seconds=36_000).select("event_id", "run_id")


# ---- composites ----

PAYLOAD_ITEMS = """items AS (SELECT p_partkey AS item_id, p_brand AS maker, p_type AS genre, floor(p_retailprice * 100) / 100 AS price,
  CASE WHEN p_partkey % 2 = 1 THEN p_size * 2 ELSE p_size END::BIGINT AS review_count, p_size * 1000000000::BIGINT AS size_bytes, p_size * 1000000000::BIGINT AS ram_bytes,
  p_partkey % 4 = 0 AS is_early_access, NULL::INT AS early_access_days, p_size AS achievement_count, p_partkey % 3 AS addon_count, 1 + (p_partkey % 2 = 0)::INT AS platform_count, [3, 1, NULL, 2][p_partkey % 4 + 1] AS language_count
  FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 6 <> 0)"""
#: As SCORED, but for the items of the payloads: the catalog has one maker, who has none of them, and labels of negative votes are not extracted.
ENRICHED = (
    SCORED.replace(D.ITEMS, PAYLOAD_ITEMS)
    .replace("count(*) OVER (PARTITION BY maker) - 1 AS maker_titles", "0 AS maker_titles")
    .replace("AS complex_label_score FROM labels_ GROUP BY 1", "AS complex_label_score FROM labels_ WHERE votes >= 0 GROUP BY 1")
)


@query(f"WITH {ENRICHED} SELECT item_id, bucket, round(sales_mid, 6) AS sales_mid, round(revenue_net, 4) AS revenue_net, round(complexity, 6) AS complexity, array_to_string(imputed, ',') AS imputed, round(revenue_net / (complexity + 0.05), 3) AS effort_return FROM finished")
def enrichment_run(spark, d):
    """Payloads to enriched items, all steps in order."""
    catalog, details, reviews, listed = part_payloads(spark, d)
    maps = D.labels(spark, d).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("labels"))
    items, _ = Q.enrich(catalog, details, reviews, maps.join(listed, "item_id", "left_semi"), D.PARAMS)
    places = {"sales_mid": 6, "revenue_net": 4, "complexity": 6, "effort_return": 3}
    return items.select("item_id", "bucket", *[F.round(c, n).alias(c) for c, n in places.items()], F.array_join("imputed", ",").alias("imputed"))


def reported(spark, d) -> dict[str, DataFrame]:
    """All views of a report: the analysis of the items, and the run of user 11 with its stages."""
    items, labels, found = analysed(spark, d)
    log = D.stage_log(spark, d).where("run_id = 11")
    run = log.select("run_id").distinct().select("run_id", F.lit("succeeded").alias("status"), *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "finished_at")])
    return Q.report(found, items, labels, items.agg(F.count("*").alias("catalog")), run=run, stages=N.stage_state(log), stage_order=("view", "click", "purchase"))


CHOSEN = f"{ANALYSIS}, returns AS (SELECT *, round(revenue_net / (complexity + 0.05), 6) AS effort_return FROM placed), {diverse_sql('returns')}, cases AS (SELECT chosen.*, returns.* EXCLUDE (item_id, name), names.name AS archetype FROM chosen JOIN returns USING (item_id) LEFT JOIN names USING (cluster_id))"


@query(f"WITH RECURSIVE {CHOSEN} {_CASES.format(link='')}")
def report_run(spark, d):
    """Analysis and report: the example items."""
    return flat_cases(reported(spark, d)["cases"])


@query(f"""WITH RECURSIVE {CHOSEN}, {D.STAGE_LOG}, state AS (SELECT stage, arg_max(status, seq) AS status, max(ts) FILTER (status = 'running') AS started_at, arg_max(ts, seq) AS last FROM stage_log WHERE run_id = 11 GROUP BY 1),
spans AS (SELECT epoch(max(CASE WHEN status <> 'running' THEN last END)) - epoch(min(started_at)) AS seconds, list(stage) FILTER (status = 'succeeded') AS done FROM state),
told AS (SELECT round(seconds, 3) AS seconds, array_to_string([s FOR s IN ['view', 'click', 'purchase'] IF NOT coalesce(list_contains(done, s), false)], ', ') AS missing FROM spans)
SELECT 11::BIGINT AS run_id, 'succeeded' AS status, seconds, missing, missing <> '' AS is_partial, CASE WHEN missing <> '' THEN 'This run is partial. Missing: ' || missing || '. Results are those of the stages that ended.' END AS notice,
  (SELECT count(*) FROM finished) AS catalog, cluster_id, round(opportunity, 6) AS opportunity, name, (SELECT count(*) FROM matrix) AS n_matrix, (SELECT count(*) FROM chosen) AS n_cases,
  least(100, (SELECT count(DISTINCT label) FROM labels_ SEMI JOIN simple USING (item_id))) AS n_labels
FROM told LEFT JOIN (SELECT * FROM matrix LEFT JOIN names USING (cluster_id) ORDER BY matrix.opportunity DESC, cluster_id LIMIT 1) ON true""")
def report_overview(spark, d):
    """A report's first lines: duration, missing stages and notice of the run, the headline, and how many rows its tables have."""
    found = reported(spark, d)
    sizes = [found[k].agg(F.count("*").alias(f"n_{k}")) for k in ("matrix", "cases", "labels")]
    row = reduce(DataFrame.join, [found["run"], found["headline"], *sizes])  # one row each
    return r6(row, "opportunity").withColumn("seconds", F.round("seconds", 3)).withColumn("missing", F.array_join("missing", ", "))


@query(f"""WITH RECURSIVE {ANALYSIS} SELECT (SELECT count(*) FROM finished) AS candidates, (SELECT count(*) FROM simple) AS simple_size, (SELECT count(DISTINCT cluster_id) FROM assigned) AS clusters,
count(*) FILTER (n_items >= 2) AS scored, count(*) FILTER (n_items < 2) AS below_minimum FROM demand""")
def analysis_counts(spark, d):
    items, _, found = analysed(spark, d)
    return Q.analysis_report(items, found["simple"], found["assignments"], found["demand"], RUN)


@query(f"WITH {GIVEN}, s AS (SELECT cluster_id, count(*) AS n FROM given GROUP BY 1) SELECT count(*) AS clusters, median(n) AS median_members FROM s")
def cluster_stats(spark, d):
    return C.cluster_statistics(given(spark, d)[1])


@query(f"{WITH}, c AS (SELECT quantile_cont(complexity, 0.4) AS cut FROM finished) SELECT count(*) AS candidates, count(*) FILTER (complexity <= cut) AS simple_size FROM finished, c")
def funnel_with_simple_size(spark, d):
    items = scored(spark, d)
    return U.with_simple_size(items.agg(F.count("*").alias("candidates")), S.simple_tally(items, 0.4))


# ---- streams over the event table ----


def event_stream(spark, d):
    schema = D.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)  # a stream reads folders


@query("SELECT event_id, user_id AS run_id FROM events WHERE event_id > 500")
def event_tail_stream(spark, d):
    """Events newer than the last id seen."""
    tail = Z.tail_events(spark, f"{d}/events.parquet", since=500, schema="event_id bigint, user_id bigint", ids=50_000)
    return Z.settled(tail.select("event_id", F.col("user_id").alias("run_id")), "tail")


@query(f"WITH {THROTTLED}")
def info_throttle_stream(spark, d):
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    log = event_stream(spark, d).select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), level.alias("level"))
    return Z.settled(Z.throttled(Z.with_end(log, spark), gap_seconds=36_000), "throttle").select("event_id", "run_id")


@query(f"WITH {STATE} SELECT run_id, stage, status, attempt FROM state")
def stage_state_stream(spark, d):
    status = F.when(F.col("value") < 10, "running").when(F.col("value") < 25, "succeeded").otherwise("failed")
    log = event_stream(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), status.alias("status"), "ts", F.col("event_id").alias("seq"))
    return Z.settled(Z.stage_states(log).select("run_id", "stage", "status", "attempt"), "states", mode="complete")


# ---- scans and sinks: written to the scratch folder and read back ----


def fresh(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/shelfsight/{name}-{uuid.uuid4().hex}"


def stored_payloads(spark, d) -> str:
    path = fresh(spark, "payloads")
    rows = landed(spark, d).drop("order_key")
    B.append_payloads(spark, path, rows.where("http_status = 500"))
    B.append_payloads(spark, path, rows)
    return path


STORED = f"""{LANDED}, body AS (SELECT *, CASE WHEN k % 4 = 2 THEN '{{"success":' || (k % 3) || '}}' ELSE '{{"success":' || (st = 'F') || '}}' END AS payload FROM landed),
stored AS (SELECT *, sha256(payload) AS payload_sha256 FROM body QUALIFY row_number() OVER (PARTITION BY run_id, item_id, source ORDER BY k % 5 <> 0, k) = 1)"""


@query(f"WITH {STORED} SELECT item_id, payload, payload_sha256 FROM stored WHERE run_id = '3' AND source = 'details'")
def payload_scan(spark, d):
    """Two appends, the first wins; a run and source read back with the hashes that landing made."""
    return B.scan_payloads(spark, stored_payloads(spark, d), "3", "details").select("item_id", "payload", "payload_sha256")


@query(f"WITH {STORED} SELECT source, count(*) AS n FROM stored WHERE run_id = '5' GROUP BY 1")
def bundle_scan(spark, d):
    parts = B.bundle(spark, stored_payloads(spark, d), "5")
    both = [frame.agg(F.lit(source).alias("source"), F.count("*").alias("n")) for source, frame in parts.items()]
    return reduce(DataFrame.unionByName, both)


@query(f"WITH {STORED} SELECT DISTINCT item_id FROM stored WHERE run_id = '2' AND source = 'reviews'")
def fetched_ids(spark, d):
    return B.fetched_ids(spark, stored_payloads(spark, d), "2", "reviews")


@query(f"WITH {D.ITEMS} SELECT item_id, price, CASE WHEN item_id % 7 = 0 THEN NULL ELSE positive_share END AS positive_share FROM items")
def replace_items(spark, d):
    """A run's items written twice: the second write replaces the first, NaN becomes null."""
    path = fresh(spark, "items")
    items = D.items(spark, d).select("item_id", "price", F.when(F.col("item_id") % 7 == 0, float("nan")).otherwise(F.col("positive_share")).alias("positive_share"))
    for frame in (items.withColumn("price", F.lit(0.0)), items):
        B.replace_run(frame, path, "r", keys=["item_id"], required=["price"])
    return B.scan_items(B.read_table(spark, path, "run_id string, item_id long, price double, positive_share double"), "r", columns=["item_id", "price", "positive_share"])


@query(f"WITH {D.LABELS} SELECT item_id, label, votes FROM labels_ WHERE votes >= 6")
def replace_labels(spark, d):
    path = fresh(spark, "item-labels")
    B.replace_run(D.labels(spark, d), path, "r", keys=["item_id", "label"])
    return B.scan_labels(B.read_table(spark, path, "run_id string, item_id long, label string, votes long"), "r", min_votes=6).drop("run_id")


@query(f"WITH {GIVEN} SELECT cluster_id, count(*) AS n_items, NULL::DOUBLE AS opportunity FROM placed GROUP BY 1")
def result_store(spark, d):
    """A result written twice and read back typed, with a column that was never written."""
    path = fresh(spark, "results")
    frame = C.vote(*given(spark, d)).groupBy("cluster_id").agg(F.count("*").alias("n_items"))
    for version in ("a", "b"):
        B.write_result(frame, path, "r", "demand", version)
    back = B.read_result(spark, path, "r", "demand", "cluster_id int, n_items long, version string").where("version = 'b'").drop("version")
    absent = B.read_result(spark, path, "r", "matrix", "cluster_id int, n_items long, opportunity double")
    return R.typed(back, absent)


@query("SELECT (user_id % 5)::VARCHAR AS run_id, count(*) AS n FROM events WHERE user_id % 5 <> 2 GROUP BY 1")
def run_delete(spark, d):
    """Events appended to their runs; one run is deleted from every table."""
    path = fresh(spark, "events")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    events = D.table(spark, d, "events").select("event_id", (F.col("user_id") % 5).cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), level.alias("level"), F.col("props").alias("message"), F.lit(None).cast("double").alias("progress"))
    B.append_events(path, events)
    B.delete_run(spark, [path], "2")
    return B.read_table(spark, path, B.EVENT).groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"WITH {STATE} SELECT stage, status, list_position(['view', 'click', 'purchase', 'signup', 'error'], stage)::INT AS place FROM state WHERE run_id = 11")
def stage_scan(spark, d):
    """A run's stages, in their order."""
    order = ("view", "click", "purchase", "signup", "error")
    stages = N.in_stage_order(N.stage_state(D.stage_log(spark, d)).where("run_id = 11"), order)
    return stages.select("stage", "status", F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage")).cast("int").alias("place"))


@query("SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'succeeded' END AS status FROM orders WHERE o_orderkey = 33")
def run_lookup(spark, d):
    return B.find_run(runs(spark, d), 33).select("run_id", "status")


@query(f"WITH {LANDED} SELECT run_id, source, count(DISTINCT item_id) AS n FROM landed GROUP BY 1, 2")
def landing_stream(spark, d):
    """Payloads as JSON files, landed by a stream in two starts; the second finds nothing new."""
    inbox, path, seen = (fresh(spark, x) for x in ("inbox", "landed", "checkpoint"))
    landed(spark, d).drop("order_key").write.json(inbox)
    for _ in range(2):
        Z.land_payloads(spark, inbox, path, seen).awaitTermination()
    return B.read_table(spark, path, B.PAYLOAD).groupBy("run_id", "source").agg(F.count("*").alias("n"))


_BOUNDS = " UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont(log10({c} + 1), 0.05) AS low, quantile_cont(log10({c} + 1), 0.95) AS high, count({c}) AS n FROM finished WHERE {c} >= 0" for c in X.LOGGED)


@query(f"WITH RECURSIVE {ANALYSIS}, {threshold_sql(0.3)} SELECT feature, round(low, 6) AS low, round(high, 6) AS high, n, round(threshold, 9) AS threshold, source FROM ({_BOUNDS}), found")
def bounds_and_threshold(spark, d):
    """What a freeze finds: bounds of the log features, and the searched distance threshold."""
    params = AnalysisParams(generic_share=0.3, min_votes=-100, max_cluster_share=0.3, linkage="single")
    bounds, threshold, source = Q.freeze(scored(spark, d), D.labels(spark, d), params, upto=UPTO)
    return r6(bounds, "low", "high").withColumn("threshold", F.round(F.lit(threshold).cast("double"), 9)).withColumn("source", F.lit(source))
