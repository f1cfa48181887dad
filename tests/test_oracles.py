"""Registered queries against their oracle SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from shelfsight.plans import queries as market

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "rank_archetypes simple_cut label_summary trend_windows trend_slope catalog_dedup first_wins_upsert resume_keys funnel_reasons page_trim page_flatten item_features"
    " size_text ram_text lenient_dates label_rank generic_labels label_jaccard plurality_vote complexity complexity_imputed bounds_freeze matrix_view"
    " stage_state partial_runs run_duration event_tail_stream param_version enrichment_run diverse_topn info_throttle drop_reasons run_summaries"
    " payload_scan bundle_scan replace_items result_store run_delete landing_stream trend_pivot rationale_text funnel_criteria coarse_missing_key missing_fields"
    " demand simplicity info_throttle_stream case_studies analysis_run analysis_counts report_run report_overview threshold_search_single bounds_and_threshold"
).split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def table(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, oracle, name):
    ours = market.QUERIES[name](spark, SF)
    cursor = oracle.execute(market.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(ours.columns)
    assert table(list(ours.columns), ours.collect()) == table(columns, cursor.fetchall())


def test_entry_needs_no_corpus_operators():
    assert not any(n.startswith("op") and n[2].isdigit() for n in market.QUERIES) and set(market.ORACLES) <= set(market.QUERIES)
