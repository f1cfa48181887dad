"""Each stage is held against what it must do to the documents it gets."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfsight.llm import registry
from shelfsight.llm.base import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "stage").cache())
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_filters_only_drop(stages):
    for before, after in zip(stages[:4], stages[1:4]):
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_exact_and_near(stages):
    assert stages[2].select("text").distinct().count() == stages[2].count() == stages[1].select("text").distinct().count()
    prints = registry.simhash.near_groups(stages[3])
    assert prints.where("component_id <> doc_id").count() == 0


def test_mixing_repeats_documents(stages):
    times = stages[4].groupBy("doc_id").count()
    taken = registry.mixing.mix(stages[3])["documents"].select("doc_id", F.round(F.col("taken") / F.greatest("size", F.lit(1))).alias("times")).where("times > 0")
    assert {tuple(r) for r in times.collect()} == {(r.doc_id, int(r.times)) for r in taken.collect()}


def test_packing_holds_every_token(stages):
    ids = registry.packing.encoder(registry.packing.token_file())
    expected = sum(len(ids(r.text)) // 4 + 1 for r in stages[4].select("text").collect())
    assert stages[5].agg(F.sum("length")).first()[0] == expected


@pytest.mark.parametrize("name", ["edge", "clashing", "empty"])
def test_stages_take_edge_cases(request, spark, name):
    """Nulls, repeated rows, clashing columns and no rows at all, through every stage."""
    docs = request.getfixturevalue(name)
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = staged(stage(spark, before, SF), "edge")
        assert after.columns == docs.columns
        if k < 3:
            assert after.exceptAll(before).count() == 0
        before = after
    texts = [r.text or "" for r in before.select("text").collect()]
    assert (not docs.count() and not texts) or (texts and all(t.split() for t in texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    by_row = {}
    for p in pieces:
        by_row.setdefault(p.row_id, []).append(p)
    assert len(by_row) == len(texts) and all(sum(p.length for p in ps) == ps[0].doc_tokens for ps in by_row.values())


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == stages[5].agg(F.sum("length")).first()[0]


def test_registry():
    names = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert names == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())
