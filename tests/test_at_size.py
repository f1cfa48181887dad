"""Plans of the composites that grew with one task, or by repeated work, on larger tables."""

import pytest

from shelfsight.operators import features
from shelfsight.plans import composites
from shelfsight.plans import queries as market
from shelfsight.sources import driver_tables as D
from shelfsight.sources.scratch import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of what composites and features write, by label."""
    seen = {}

    def noted(df, label):
        seen.setdefault(label, []).append(plan(df))
        return written(df, label)

    for module in (composites, features):
        monkeypatch.setattr(module, "written", noted)
    return seen


def test_enrichment_parses_a_payload_once(spark, plans):
    market.enrichment_run(spark, SF)
    parsed = {label: sum(p.count("parseJson") for p in ps) for label, ps in plans.items()}
    assert sum(parsed.values()) == 2  # details and reviews


def test_payloads_are_spread_before_they_are_parsed(spark):
    catalog, details, reviews, listed = (x.coalesce(1) for x in market.part_payloads(spark, SF))
    found = plan(features.normalize_items(catalog, details, reviews, listed, D.PARAMS))
    above = [line for line in found[: found.rindex("RepartitionByExpression")].split("\n") if "parseJson" in line]
    assert found.count("RepartitionByExpression") >= 2 and above


def test_words_of_labels_are_unfolded_after_their_lines_are_joined(spark):
    found = plan(D.labels(spark, SF))
    assert found.index("Generate posexplode") < found.index("Join LeftOuter")


def test_analysis_reads_all_lines_for_labels_once_and_for_items_once(spark, plans, monkeypatch):
    monkeypatch.setattr(market, "written", composites.written)
    items, labels, found = market.analysed(spark, SF)
    lines = {label: sum(p.count("l_partkey") > 0 for p in ps) for label, ps in plans.items()}
    assert {k for k, n in lines.items() if n} == {"labels", "parts"} and lines["labels"] == lines["parts"] == 1
    assert not any("l_partkey" in plan(x) for x in (labels, items, *found.values()))


def test_only_labels_of_picked_items_are_ranked(spark):
    found = plan(market.case_studies(spark, SF))
    assert found.index("Window") < found.index("Join LeftSemi")
