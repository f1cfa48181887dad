"""Queries that take whole tables where the SQL of their namesakes takes a part."""

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfsight.functions import text as T
from shelfsight.operators import trends
from shelfsight.plans import queries as market

SF = "/root/testdata/sf0.001"


def test_pivot_has_every_cluster(spark):
    rows = [(k, w, 100 - w, float(10 * k + w)) for k in range(1, 31) for w in range(4) if (k + w) % 5]
    windows = spark.createDataFrame(rows, "cluster_id int, sub_window int, ends int, median_sales double")
    wide = {r.ends: r.asDict() for r in trends.trend_pivot(windows).collect()}
    assert set(wide) == {97, 98, 99, 100} and all(set(r) == {"ends", *map(str, range(1, 31))} for r in wide.values())
    given = {(e, k): m for k, _, e, m in rows}
    assert all(wide[e][str(k)] == given.get((e, k)) for e in wide for k in range(1, 31))


def test_pivot_query_loses_no_window(spark):
    wide = market.trend_pivot_all(spark, SF).collect()
    windows = market.trend_windows(spark, SF).collect()
    got = {(r.ends, c): v for r in wide for c, v in r.asDict().items() if c != "ends" and v is not None}
    assert got == {(r.ends, f"c{r.cluster_id}"): r.median_sales for r in windows if r.median_sales is not None}
    assert len({c for _, c in got}) > 3


@pytest.mark.parametrize("name", ["page_trim_all", "rationale_all"])
def test_whole_table_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("orders", "part", "lineitem", "supplier"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ours = market.QUERIES[name](spark, SF)
    cursor = c.execute(market.ORACLES[name])
    rows = cursor.fetchall()
    assert ours.columns == [x[0] for x in cursor.description] and sorted(map(tuple, ours.collect())) == sorted(rows)
    if name == "rationale_all":
        assert len(rows) == c.execute("select count(*) from part").fetchone()[0]
    else:
        pages = c.execute("select count(*) from (select distinct o_custkey % 200, year(o_orderdate) from orders)").fetchone()[0]
        assert 0 < len(rows) < pages


def test_rationale_rounds_ties_to_even(spark):
    shares = [k / 8 for k in range(9)] + [0.005, 0.995, 1 / 3]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "i int, share double")
    none = F.lit(None).cast("double")
    found = rows.select("i", T.rationale(F.lit(8), F.col("share"), none, none, none.cast("int"), F.lit("x")).alias("s")).collect()
    assert all(f"({shares[r.i] * 100:.0f}% positive)" in r.s for r in found)
