"""Hand-computed cases and brute-force comparisons for the market-gap operators."""

import datetime
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.functions import payloads as P
from shelfsight.functions import text as T
from shelfsight.operators import affinity, archetypes, features, funnel, quantiles, report, runs, scoring, trends
from shelfsight.operators.select import diverse_top
from shelfsight.plans import composites
from shelfsight.params import AnalysisParams, FeatureParams, FilterParams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<strong>Storage:</strong> 50 GB available space<br>", 50_000_000_000),
        ("Hard Drive: 1,5 MB", 1_500_000),
        ("Disk space 2 GiB", 2 * 1024**3),
        ("Storage: none<br>Install size: 700 kb", 700_000),
        ("Memory: 8 GB", None),
        ("Storage: 0 GB\nHDD 3 tb", 3 * 10**12),
        ("", None),
        (None, None),
        ("<li>Hard Disk Space: ~1.5GB, or 2 GB", 1_500_000_000),
        ("HARDDISK : 16gb/32gb", 16 * 10**9),
        ("DirectX 11 (Storage)\t3\u00a0 x 40 GB.", 40 * 10**9),
        ("Storage: 4 gbit<BR />Install   size: 5 MiB", 5 * 1024**2),
        ("Storage: 8-GB", None),
        ("Storage: 10 (GB)\nStorage: 12\tGB", 12 * 10**9),
        ("Storage: (4 GB)", 4 * 10**9),
        ("Storage: 5 GB-6 GB", 5 * 10**9),
        ("Storage: 7 GB_x", None),
        ("AvailableSpace 1.2.5 kb", 2_500),
        ("Storage: 8<i> GB</i><br clear=all>HDD 9 GB", 8 * 10**9),
    ],
)
def test_storage(spark, html, expected):
    none = F.lit(None).cast("string")
    assert one(spark, T.storage_bytes(F.lit(html).cast("string"), none)) == expected
    assert one(spark, T.storage_bytes(none, F.lit(html).cast("string"))) == expected


@pytest.mark.parametrize(
    "html, expected",
    [("<b>Memory:</b> 8 GB RAM", 8 * 10**9), ("Video Memory: 2 GB", None), ("System RAM: 512 MB", 512 * 10**6), ("Dedicated Memory: 1 GB<br>RAM: 4 GB", 4 * 10**9),
        ("Video Memory: 2 GB, Memory: 6 GB", 6 * 10**9), ("program: 4 GB", None), ("Graphics: 2 GB Memory", None), ("DDR4-RAM : 8gb", 8 * 10**9), ("Storage: 9 GB", None),
        ("RAM 2: 4 GB", None), ("RAM-: 4 GB", None), ("(memory : 4 GB", 4 * 10**9), ("Program: 4 GB", None), ("Video System Memory: 4 GB", 4 * 10**9), ("2RAM: 4 GB", 4 * 10**9), ("Memory: 8-GB<br>RAM: 3 GB", 3 * 10**9)],
)
def test_memory(spark, html, expected):
    assert one(spark, T.memory_bytes(F.lit(None).cast("string"), F.lit(html))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2020-01-15", (2020, 1, 15)), ("Jan 5, 2020", (2020, 1, 5)), ("January 15, 2020", (2020, 1, 15)), ("15 Jan 2020", (2020, 1, 15)),
        ("15 January 2020", (2020, 1, 15)), ("2020", (2020, 1, 1)), ("Q3 2021", (2021, 7, 1)), ("May 3, 2019", (2019, 5, 3)),
        ("01 Jan, 2023", None), ("Coming soon", None), ("", None), (None, None), ("Q5 2020", None), ("2020-13-01", None), ("1900", None),
        ("2020-01-15 maybe later", None),
    ],
)
def test_dates(spark, text, expected):
    found = one(spark, T.lenient_date(F.lit(text).cast("string")))
    assert found == (datetime.date(*expected) if expected else None)


def test_catalog(spark):
    rows = [
        (1, 10, {"name": "a", "positive": 5, "negative": 1, "price": "999", "publisher": "P"}),
        (2, 10, {"name": "b", "positive": 7, "price": "oops"}),
        (3, 11, {"name": "c", "price": None, "publisher": 5, "tags": []}),
    ]
    frame = spark.createDataFrame([(a, i, json.dumps(p)) for a, i, p in rows], "arrival long, item_id long, payload string")
    found = {r.item_id: r for r in funnel.build_catalog(frame).collect()}
    assert found[10].name == "b" and found[10].positive == 7 and found[10].price == 0.0 and found[11].labels is None
    assert funnel.duplicates(frame).first()[0] == 1


def test_first_failing_reason(spark):
    rows = [(None, 100, 5.0, None), (1, 24, 5.0, "Acme"), (2, 25, 5.0, "Acme"), (3, 25, 0.0, "x"), (4, 30, 99.0, "x"), (5, 30, 5.0, "Old ACME Labs"), (6, None, 5.0, None)]
    frame = spark.createDataFrame([(i, n, 0, p, b) for i, n, p, b in rows], "item_id long, positive long, negative long, price double, publisher string")
    params = FilterParams(include_free=False, max_price=50.0, blocked_publishers=("acme l",))
    found = funnel.coarse_filter(frame, params)
    assert [r.reject_reason for r in found.collect()] == ["missing_key", "too_few_reviews", None, "free_item", "too_expensive", "blocked_publisher", "too_few_reviews"]
    tally = {r.reject_reason: r.n for r in funnel.tally(found, funnel.COARSE_REASONS).collect()}
    assert tally == {"missing_key": 1, "too_few_reviews": 2, "too_many_reviews": 0, "free_item": 1, "too_expensive": 1, "blocked_publisher": 1}
    assert funnel.tally(found.limit(0), funnel.COARSE_REASONS).agg(F.sum("n")).first()[0] == 0


def test_release_window(spark):
    day = datetime.date
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "item_id long")
    details = spark.createDataFrame([(1, True, day(2020, 1, 1)), (2, True, day(2019, 12, 31)), (3, True, None), (4, False, day(2021, 1, 1))], "item_id long, success boolean, released date")
    found = {r.item_id: r.reject_reason for r in funnel.release_filter(items, details, FilterParams()).collect()}
    assert found == {1: None, 2: "outside_release_window", 3: "release_date_unknown", 4: "detail_failed", 5: "detail_failed"}


def test_funnel_is_one_pass(spark):
    """Tally and summary of the funnel agree with the filters one by one, and read the payloads once."""
    payload = lambda n, price="500": json.dumps({"positive": n, "price": price})
    rows = [(k, i, payload(n, p)) for k, (i, n, p) in enumerate([(None, 90, "1"), (1, 3, "1"), (2, 90, "0"), (3, 90, "1"), (4, 90, "1"), (5, 90, "1"), (6, 90, "1"), (7, 90, "1"), (3, 80, "2")])]
    day = datetime.date
    details = [(1, True, day(2020, 1, 1)), (3, True, day(2020, 1, 1)), (4, False, None), (5, True, None), (6, True, day(2010, 1, 1))]
    landed = spark.createDataFrame(rows, "arrival long, item_id long, payload string")
    known = spark.createDataFrame(details, "item_id long, success boolean, released date")
    params = FilterParams(min_reviews=10, include_free=False, released_from="2015-01-01", released_to="2022-01-01")
    found = composites.funnel(landed, known, params)
    one_by_one = {r.reject_reason: r.n for name, reasons in (("coarse", funnel.COARSE_REASONS), ("released", funnel.RELEASE_REASONS)) for r in funnel.tally(found[name], reasons).collect()}
    assert {r.reject_reason: r.n for r in found["tally"].collect()} == one_by_one
    assert one_by_one["detail_failed"] == 2 and one_by_one["release_date_unknown"] == 1 and one_by_one["outside_release_window"] == 1 and one_by_one["missing_key"] == 1
    assert tuple(found["summary"].drop("criteria").first()) == (8, 5, 3, 2, 1)
    for name in ("tally", "summary"):
        assert found[name]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # payloads and details, once each
    none = composites.funnel(landed.limit(0), known, params)
    assert tuple(none["summary"].drop("criteria").first()) == (0, 0, 0, 0, 0) and none["tally"].agg(F.sum("n")).first()[0] == 0


def test_pages_stop(spark):
    rows = [("a", 0, [1, 2]), ("a", 1, [3]), ("a", 2, [3]), ("a", 3, [9]), ("b", 0, [1]), ("b", 1, []), ("b", 2, [4]), ("c", 0, [2, 1]), ("c", 1, [5]), ("c", 2, [6])]
    pages = spark.createDataFrame(rows, "run_id string, page int, ids array<bigint>")
    kept = {(r.run_id, r.page) for r in funnel.pages_to_keep(pages, max_pages=2).collect()}
    assert kept == {("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)}


def test_payload_is_parsed_once(spark):
    """Wrapped, bare, foreign, broken, listed and null payloads; fields of another kind are null and the others stay."""
    body = {"success": True, "data": {"name": "x", "pc_requirements": [], "dlc": [1, 2], "price_overview": {"final": "no"}, "platforms": {"windows": True}, "a_deck_compat": {"compat_category": 3}}}
    texts = [json.dumps({"1": body}), json.dumps(body), json.dumps({"9": body}), "{broken", "[1]", None, json.dumps({"7": None}), json.dumps({"8": {"success": "maybe", "data": 4}})]
    frame = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "item_id long, payload string")
    inner = frame.select("item_id", P.inner_object(F.col("payload"), F.col("item_id")).alias("v"))
    out = inner.select("item_id", P.typed(F.col("v"), P.DETAIL).alias("d"), P.handheld_category(F.col("v"), "deck_compat").alias("h"))
    found = {r.item_id: r for r in out.collect()}
    for k in (1, 2):
        d = found[k].d
        assert d.success and d.data.name == "x" and d.data.pc_requirements is None and d.data.dlc == ["1", "2"] and d.data.price_overview.final is None and d.data.platforms == {"windows": True}
        assert found[k].h == "3"
    assert all((found[k].d is None or (found[k].d.success is None and found[k].d.data is None)) and found[k].h is None for k in (3, 4, 5, 6, 7, 8))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_normalized_items(spark):
    catalog = spark.createDataFrame([(1, "cat", "M", "P", 3, 1, None, None), (2, "two", "M", "P", 0, 0, None, None)], "item_id long, name string, maker string, publisher string, positive long, negative long, owners_low long, owners_high long")
    data = {
        "type": "game", "name": "", "developers": [""], "publishers": [], "price_overview": {"final": 1234}, "pc_requirements": [],
        "achievements": {"total": 0}, "supported_languages": "English<strong>*</strong>, French", "platforms": {"windows": True, "mac": False},
        "genres": [{"id": "70", "description": "Early Access"}], "release_date": {"date": "Q2 2020"}, "dlc": [1, 2], "some_deck_compat": {"compat_category": "3"},
    }
    details = spark.createDataFrame([(1, json.dumps({"1": {"success": True, "data": data}})), (2, json.dumps({"2": {"success": False}}))], "item_id long, payload string")
    reviews = spark.createDataFrame([(1, json.dumps({"success": 1, "query_summary": {"total_reviews": 8, "total_positive": 6}}))], "item_id long, payload string")
    labelled = spark.createDataFrame([(1,), (2,)], "item_id long")
    a, b = features.normalize_items(catalog, details, reviews, labelled, FeatureParams()).orderBy("item_id").collect()
    assert (a.name, a.maker, a.publisher, a.price, a.review_count, a.positive_share) == ("cat", "", "P", 12.34, 8, 0.75)
    assert (a.achievement_count, a.language_count, a.platform_count, a.addon_count, a.is_early_access, a.in_scope) == (0, 2, 1, 2, True, True)
    assert a.released == datetime.date(2020, 4, 1) and "size_bytes" in a.missing and (a.handheld, b.handheld) == ("3", None)
    assert b.review_count is None and b.price is None and not b.in_scope and b.addon_count is None


def test_bucket_sales_and_revenue(spark):
    rows = [(1, ["Nope", "Strategy", "Action"], 10, 2.0), (2, [], 10, 0.0), (3, None, None, 5.0)]
    items = spark.createDataFrame(rows, "item_id long, genres array<string>, review_count long, price double")
    a, b, c = features.with_revenue(features.with_sales(items, FeatureParams()), FeatureParams()).orderBy("item_id").collect()
    assert (a.bucket, a.sales_low, a.sales_mid, a.sales_high, a.revenue_gross) == ("niche", 200, 270, 350, 540) and a.revenue_net == pytest.approx(378)
    assert b.bucket == "mainstream" and b.revenue_gross is None and c.sales_mid is None and c.revenue_net is None
    with pytest.raises(Exception, match="no sales band"):
        features.with_sales(items, FeatureParams(default_bucket="unheard")).collect()


def complexity_frame(spark, rows):
    names = "item_id long, size_bytes long, ram_bytes long, is_early_access boolean, early_access_days int, maker_titles long, achievement_count int, addon_count int, platform_count int, language_count int"
    return spark.createDataFrame(rows, names)


def test_complexity(spark):
    labels = spark.createDataFrame([(1, "Casual"), (1, "Other"), (2, "physics"), (3, "x")], "item_id long, label string")
    rows = [
        (1, 10**10, 8 * 10**9, False, None, 1, 20, 2, 1, 5),
        (2, None, 8 * 10**9, False, None, 1, 20, 2, 3, 5),
        (3, 10**10, 8 * 10**9, False, None, 1, 20, 2, None, 5),
        (4, None, None, True, None, 1, None, 2, 1, None),
    ]
    found = {r.item_id: r for r in features.complexity(complexity_frame(spark, rows), labels, FeatureParams()).collect()}
    p = FeatureParams()
    import math

    log = lambda x, f: min(1, max(0, (math.log10(x + 1) - p.bounds[f][0]) / (p.bounds[f][1] - p.bounds[f][0])))
    parts = {"size_bytes": log(10**10, "size_bytes"), "ram_bytes": log(8 * 10**9, "ram_bytes"), "early_access_days": 0.5, "maker_titles": log(1, "maker_titles"),
             "simple_label_score": 0.5, "complex_label_score": 0.0, "achievement_count": log(20, "achievement_count"), "addon_count": log(2, "addon_count"), "platform_count": 0.0, "language_count": log(5, "language_count")}
    assert found[1].complexity == pytest.approx(sum(p.weights[f] * v for f, v in parts.items()))
    assert found[2].imputed == ["size_bytes"] and found[2].contributions.size_bytes == pytest.approx(p.weights["size_bytes"] * parts["size_bytes"])
    assert found[3].complexity is None and found[3].imputed == ["platform_count"]
    assert found[4].complexity is None and len(found[4].imputed) == 6


def test_labels_rank_and_generic(spark):
    source = spark.createDataFrame([(1, {"b": 5, "a": 5, "c": 9}), (2, None)], "item_id long, labels map<string,bigint>")
    assert [tuple(r) for r in features.extract_labels(source, FeatureParams(max_labels=2)).orderBy("rank").collect()] == [(1, "c", 9, 1), (1, "a", 5, 2)]
    labels = spark.createDataFrame([(i, "all", 1) for i in range(4)] + [(0, "half", 1), (1, "half", 1)], "item_id long, label string, votes long")
    assert {r.label for r in affinity.without_generic(labels, 0.5).collect()} == {"half"}
    assert {r.label for r in affinity.without_generic(labels, 1.0).collect()} == {"all", "half"}


def test_maker_titles(spark):
    items = spark.createDataFrame([(1, "A"), (2, "A"), (3, ""), (4, None), (5, "a"), (6, "")], "item_id long, maker string")
    assert [r.maker_titles for r in features.maker_titles(items, items).orderBy("item_id").collect()] == [1, 1, 0, 0, 0, 0]


def random_labels(rng, items=25, names=9):
    return sorted({(i, f"l{rng.randrange(names)}") for i in range(items) for _ in range(rng.randrange(1, 5))})


def distances_by_hand(rows):
    by = defaultdict(set)
    for i, n in rows:
        by[n].add(i)
    return {(a, b): 1 - len(by[a] & by[b]) / len(by[a] | by[b]) for a in by for b in by if a < b}, sorted(by)


def partition_by_hand(distance, names, method, threshold):
    """Merge the nearest pair, ties by name, until none is within the threshold."""
    d = lambda a, b: distance[min(a, b), max(a, b)]
    clusters = {n: {n} for n in names}
    held = {(a, b): d(a, b) for a in names for b in names if a < b}
    while held:
        (a, b), least = min(held.items(), key=lambda kv: (round(kv[1], 12), kv[0]))
        if round(least, 12) > threshold:
            break
        for c in clusters:
            if c in (a, b):
                continue
            x, y = held[min(a, c), max(a, c)], held[min(b, c), max(b, c)]
            if method == "single":
                z = min(x, y)
            elif method == "complete":
                z = max(x, y)
            elif method == "weighted":
                z = (x + y) / 2
            else:
                z = (x * len(clusters[a]) + y * len(clusters[b])) / (len(clusters[a]) + len(clusters[b]))
            held[min(a, c), max(a, c)] = z
        clusters[a] |= clusters.pop(b)
        held = {k: v for k, v in held.items() if b not in k}
    return {frozenset(c) for c in clusters.values()}


@pytest.mark.parametrize("method", ["average", "single", "complete", "weighted"])
def test_linkage_against_brute_force(spark, method):
    rng = random.Random(method)
    rows = random_labels(rng)
    distance, names = distances_by_hand(rows)
    labels = spark.createDataFrame(rows, "item_id long, label string")
    edges = affinity.jaccard(labels).select("a", "b", "distance")
    assert {(r.a, r.b): pytest.approx(r.distance) for r in edges.collect()} == {k: v for k, v in distance.items() if v < 1}
    for threshold in (0.85, 1.0):
        members, _ = archetypes.linkage(labels.select("label").distinct(), edges, method=method, threshold=threshold)
        found = defaultdict(set)
        for r in members.collect():
            found[r.root].add(r.label)
        assert {frozenset(v) for v in found.values()} == partition_by_hand(distance, names, method, threshold)
        assert all(min(v) == k for k, v in found.items())


def test_vote_names_and_search(spark):
    rows = [(i, n, 1) for i in range(5) for n in ("a", "b")] + [(i, n, 1) for i in range(5, 10) for n in ("c", "d")]
    labels = spark.createDataFrame(rows, "item_id long, label string, votes long")
    found = archetypes.cluster_labels(labels, labels, AnalysisParams(generic_share=1.0, distance_threshold=None, max_cluster_share=0.6))
    assert found.threshold == 0.0 and found.source == "searched"
    assert {(r.item_id, r.cluster_id) for r in found.assignments.collect()} == {(i, 1 + (i > 4)) for i in range(10)}
    assert [r.name for r in found.names.orderBy("cluster_id").collect()] == ["a / b", "c / d"]
    one_cluster = archetypes.cluster_labels(labels, labels, AnalysisParams(generic_share=1.0, distance_threshold=None, max_cluster_share=1.0))
    assert one_cluster.threshold == 1.0 and one_cluster.assignments.select("cluster_id").distinct().count() == 1
    tight = archetypes.cluster_labels(labels, labels, AnalysisParams(generic_share=1.0, distance_threshold=None, max_cluster_share=0.1))
    assert tight.source == "smallest"


def threshold_by_hand(rows, merges, most_share):
    """Every distance in turn: merge, let items vote, stop at the first whose largest cluster holds too many."""
    items = sorted({i for i, _ in rows})
    last = None
    distances = sorted({d for d, *_ in merges})
    for d in distances:
        root = {label: label for _, label in rows}
        for _, a, b in sorted(m for m in merges if m[0] <= d):
            ends = sorted({root[a], root[b]})
            root = {x: ends[0] if r in ends else r for x, r in root.items()}
        sizes = Counter()
        for i in items:
            votes = Counter(root[x] for j, x in rows if j == i)
            sizes[min(votes, key=lambda r: (-votes[r], r))] += 1
        if max(sizes.values()) / len(items) > most_share:
            return (last, "searched") if last is not None else (distances[0], "smallest")
        last = d
    return last, "searched"


@pytest.mark.parametrize("method, batch", [("average", 24), ("single", 3), ("complete", 2)])
def test_threshold_search_by_brute_force(spark, method, batch):
    rng = random.Random(len(method))
    rows = sorted({(i, f"t{(i % 3) * 4 + rng.randrange(6):02}") for i in range(60) for _ in range(4)})
    labels = spark.createDataFrame(rows, "item_id long, label string").withColumn("votes", F.lit(1))
    _, merges = archetypes.linkage(labels.select("label").distinct(), affinity.jaccard(labels).select("a", "b", "distance"), method=method)
    steps = [tuple(r) for r in merges.select("distance", "a", "b").collect()]
    assert len({d for d, *_ in steps}) > 6
    for most_share in (0.02, 0.3, 0.5, 0.7, 1.0):
        assert archetypes.search_threshold(labels, merges, most_share=most_share, batch=batch) == threshold_by_hand(rows, steps, most_share)
    assert archetypes.search_threshold(labels, merges.limit(0), most_share=0.5) == (None, "none")


def test_clusters_of_nothing_and_of_one(spark):
    labels = spark.createDataFrame([(1, "a", 1)], "item_id long, label string, votes long")
    single = archetypes.cluster_labels(labels, labels, AnalysisParams(generic_share=1.0))
    assert single.threshold is None and [tuple(r) for r in single.assignments.collect()] == [(1, 0)]
    none = archetypes.cluster_labels(labels.limit(0), labels.limit(0), AnalysisParams())
    assert none.assignments.count() == 0 and none.assignments.columns == ["item_id", "cluster_id"]


def test_opportunities(spark):
    demand = spark.createDataFrame([(1, 9, 100.0), (2, 9, 200.0), (3, 9, 300.0), (4, 1, 999.0)], "cluster_id int, n_items long, median_sales double")
    shares = spark.createDataFrame([(1, 0.2), (2, 0.2), (3, 0.2), (4, 0.4)], "cluster_id int, share double")
    simple = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.8), (4, 0.1)], "cluster_id int, median_complexity double")
    rows = scoring.opportunities(demand, shares, simple, AnalysisParams()).collect()
    assert [r.cluster_id for r in rows] == [3, 2, 1] and all(r.competition_z == 0.0 for r in rows)
    z = 1.5**0.5
    assert rows[0].opportunity == pytest.approx(0.4 * z - 0.3 * z)


def test_simple_cut_is_inclusive(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.2, 0.2, 0.4, 0.5, None])], "item_id long, complexity double")
    assert {r.item_id for r in scoring.simple_cut(items, 0.4).collect()} == {0, 1, 2}
    assert {r.item_id for r in scoring.simple_from_size(items, 2).collect()} == {0, 1, 2}


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_against_numpy(spark, seed):
    """Exact, over ties, nulls and hot values, for several columns at once."""
    rng = np.random.default_rng(seed)
    rows = [(float(a) if a > 2 else None, float(b), None) for a, b in zip(rng.integers(0, 9, 501), rng.normal(size=501))]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    shares = [0.0, 0.05, 0.4, 0.5, 0.95, 1.0]
    found = quantiles.quantile_row(frame.repartition(5), {k: F.col(k) for k in "abc"}, shares).first()
    assert found["c"] == [None] * 6
    for i, k in enumerate("ab"):
        assert found[k] == pytest.approx(np.quantile([r[i] for r in rows if r[i] is not None], shares).tolist())
    ordered = sorted(r[0] for r in rows if r[0] is not None)
    assert [quantiles.smallest(frame, F.col("a"), n).first()[0] for n in (1, 77, 10_000)] == [ordered[0], ordered[76], ordered[-1]]
    assert quantiles.quantile_row(frame.limit(0), {"a": F.col("a")}, [0.5]).first()["a"] == [None]


def test_frozen_bounds(spark):
    schema = "size_bytes long, ram_bytes long, addon_count int"
    items = spark.createDataFrame([(10**6 * (i + 1), None, i % 5) for i in range(40)], schema)
    found = {r.feature: (r.low, r.high, r.n) for r in features.frozen_bounds(items).collect()}
    logs = np.log10(np.arange(1, 41) * 10**6 + 1)
    assert set(found) == {"size_bytes", "addon_count"} and found["size_bytes"] == pytest.approx((*np.quantile(logs, [0.05, 0.95]), 40))
    for bad in (items.limit(29), items.withColumn("addon_count", F.lit(3))):
        with pytest.raises(Exception, match="too few rows|no span"):
            features.frozen_bounds(bad).collect()


def test_drop_reasons(spark):
    rows = [(True, "game", True, True), (False, "game", True, True), (False, "dlc", True, True), (False, None, False, False), (False, "game", True, False)]
    frame = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "in_scope boolean, item_type string, is_software boolean, is_listed boolean")
    assert tuple(features.drop_reasons(frame).first()) == (1, 1, 3)
    assert tuple(features.drop_reasons(frame.limit(0)).first()) == (0, 0, 0)


def test_run_summary(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    listed = spark.createDataFrame([("a", "succeeded", t(0), t(9)), ("b", "running", None, None), ("c", "pending", None, None)], "run_id string, status string, started_at timestamp, finished_at timestamp")
    rows = [("a", s, "succeeded", t(1), t(2)) for s in ("acquisition", "enrichment", "analysis")] + [("b", "acquisition", "succeeded", t(1), t(4)), ("b", "enrichment", "failed", t(4), t(6))]
    stages = spark.createDataFrame(rows, "run_id string, stage string, status string, started_at timestamp, finished_at timestamp")
    found = {r.run_id: r for r in runs.run_summary(listed, stages).collect()}
    assert (found["a"].seconds, found["a"].missing, found["a"].is_partial, found["a"].notice) == (9.0, [], False, None)
    assert (found["b"].seconds, found["b"].missing) == (5.0, ["enrichment", "analysis"]) and "enrichment, analysis" in found["b"].notice
    assert found["c"].missing == ["acquisition", "enrichment", "analysis"] and found["c"].seconds is None


def test_empty_inputs_keep_their_columns(spark):
    """Every result of an analysis of nothing has its columns and no rows."""
    items = spark.createDataFrame(
        [], "item_id long, cluster_id int, maker string, released date, price double, review_count long, positive_share double, size_bytes long, ram_bytes long, is_early_access boolean,"
        " early_access_days int, maker_titles long, achievement_count int, addon_count int, language_count int, platform_count int, genres array<string>",
    )
    labels = spark.createDataFrame([], "item_id long, label string, votes long")
    scored = composites.score_items(items, labels, FeatureParams())
    assert {"complexity", "imputed", "effort_return"} <= set(scored.columns) and scored.count() == 0
    metrics = scoring.archetype_metrics(scored)
    for frame, columns in (
        (scoring.demand(scored), ["cluster_id", "n_items", "median_sales", "median_reviews", "sales_q1", "sales_q3"]), (scoring.competition(scored), ["cluster_id", "releases", "share"]),
        (scoring.simplicity(scored), ["cluster_id", "median_complexity"]), (scoring.simple_cut(scored, 0.4), scored.columns), (scoring.opportunity_matrix(scored, AnalysisParams()), None),
        (trends.trend_windows(scored, months=12), ["cluster_id", "sub_window", "starts", "ends", "n_items", "median_sales"]), (scoring.label_summary(scored, labels), None), (diverse_top(scored), ["item_id", "place", "relaxed"]),
    ):
        assert frame.count() == 0 and (columns is None or frame.columns == columns)
    assert metrics.count() == 0


def test_trends(spark):
    day = lambda k: datetime.datetime(2020, 1, 1) - datetime.timedelta(days=k)
    rows = [(1, day(0), 10.0), (1, day(91), 20.0), (1, day(92), 30.0), (1, day(4 * 91.32), 99.0), (2, day(10), None), (2, day(100), 5.0)]
    items = spark.createDataFrame(rows, "cluster_id int, released timestamp, sales_mid double")
    windows = trends.trend_windows(items, months=12)
    found = {(r.cluster_id, r.sub_window): (r.n_items, r.median_sales) for r in windows.collect()}
    assert found == {(1, 0): (2, 15.0), (1, 1): (1, 30.0), (2, 1): (1, 5.0)}
    slopes = {r.cluster_id: (r.slope, r.n_points) for r in trends.trend_slopes(windows).collect()}
    assert slopes == {1: (15.0, 2), 2: (None, 1)}
    with pytest.raises(ValueError):
        trends.trend_windows(items, months=10)


def pick_by_hand(rows, top_n, per_cluster, per_maker):
    order = sorted((r for r in rows if r[3] is not None and r[1] is not None), key=lambda r: (-r[3], r[0]))

    def walk(picked, cap):
        for r in order:
            if len(picked) < top_n and r not in picked and sum(p[1] == r[1] for p in picked) < cap and sum(p[2] == r[2] for p in picked) < per_maker:
                picked = [*picked, r]
        return picked

    first = walk([], per_cluster)
    return [r[0] for r in (walk(first, per_cluster + 1) if len(first) < top_n else first)], len(first) < top_n


@pytest.mark.parametrize("seed", range(6))
def test_diverse_top(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, float(rng.randrange(20))])) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, cluster_id int, maker string, effort_return double")
    options = {"top_n": rng.randrange(1, 9), "per_cluster": rng.randrange(1, 3), "per_maker": rng.randrange(1, 4)}
    expected, relaxed = pick_by_hand(rows, **options)
    found = diverse_top(items, **options).orderBy("place").collect()
    assert [r.item_id for r in found] == expected and all(r.relaxed == relaxed for r in found)


def test_views(spark):
    frame = spark.createDataFrame([(1, 5, 0.125), (2, 5, 0.135), (3, 5, None)], "cluster_id int, n_items long, opportunity double")
    assert [(r.cluster_id, r.opportunity) for r in report.matrix_view(frame).collect()] == [(2, 0.14), (1, 0.12), (3, None)]
    with pytest.raises(ValueError):
        report.matrix_view(frame, sort_by="nope")
    assert report.without_empty(frame.withColumn("gone", F.lit(None))).columns == frame.columns
    assert report.typed(None, frame.limit(0)).columns == frame.columns
    assert report.renamed(frame, {"n_items": "N"}).columns == ["N", "cluster_id", "opportunity"]


def throttle_by_hand(rows, gap):
    last, out = {}, set()
    for event, run, ts, level in sorted(rows, key=lambda r: (r[2], r[0])):
        if level != "info" or run not in last or ts - last[run] >= gap:
            out.add(event)
            if level == "info":
                last[run] = ts
    return out


def test_throttle(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(120) / 4, rng.choice(["info", "info", "error"])) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, run_id long, at double, level string").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    assert {r.event_id for r in runs.throttle_info(events.drop("at"), gap_seconds=2).collect()} == throttle_by_hand(rows, 2)


def test_throttle_has_no_fold_of_a_burst(spark):
    """One run with nearly all rows, never a gap apart, ties, a run without an id, events without a time."""
    rng = random.Random(3)
    rows = [(i, 7 if i % 10 else None, rng.randrange(4000) / 8, "error" if i % 13 == 0 else "info") for i in range(3000)]
    rows += [(5000, 8, 1.0, "info"), (5001, 9, 1.0, "error")]
    frame = spark.createDataFrame(rows + [(6000, 7, None, "info"), (6001, 7, None, "info")], "event_id long, run_id long, at double, level string")
    events = frame.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    for gap, most in ((0.125, 0), (2, 300), (61, 5), (1000, 0), (2, runs.FOLD_ROWS)):
        found = runs.throttle_info(events, gap_seconds=gap, fold_rows=most)
        assert sorted(r.event_id for r in found.collect()) == sorted(throttle_by_hand(rows, gap) | {6000, 6001})
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_stages(spark):
    log = [("r", "acquisition", "running", 1), ("r", "acquisition", "failed", 2), ("r", "acquisition", "running", 3), ("r", "enrichment", "succeeded", 4)]
    frame = spark.createDataFrame([(*r[:3], datetime.datetime(2020, 1, 1, 0, 0, r[3]), r[3]) for r in log], "run_id string, stage string, status string, ts timestamp, seq long")
    state = {r.stage: r for r in runs.stage_state(frame).collect()}
    assert (state["acquisition"].status, state["acquisition"].attempt, state["acquisition"].finished_at) == ("running", 2, None)
    assert runs.partial_runs(runs.stage_state(frame)).first().missing == ["acquisition", "analysis"]
    assert [r.stage for r in runs.in_stage_order(runs.stage_state(frame)).collect()] == ["acquisition", "enrichment"]


def test_params():
    with pytest.raises(ValueError):
        FeatureParams(weights={"a": 0.5})
    with pytest.raises(ValueError):
        FeatureParams(sales_per_review={"x": (3, 2, 1)})
    with pytest.raises(ValueError):
        AnalysisParams(linkage="ward")
    with pytest.raises(ValueError):
        AnalysisParams(demand=0.9)
    assert sum(FeatureParams().with_weights(size_bytes=0.5).weights.values()) == pytest.approx(1)


def test_scalars(spark):
    assert one(spark, P.whole_count(F.lit("-1"))) is None and one(spark, P.whole_count(F.lit("0"))) == 0
    assert one(spark, P.finite(F.lit(float("nan")))) is None and one(spark, P.finite(F.lit(2.0))) == 2.0
    sentence = one(spark, T.rationale(F.lit(1200), F.lit(0.9), F.lit(0.0), F.lit(5e8), F.lit(1), F.lit("x / y")))
    assert sentence == "In x / y: 1200 reviews (90% positive), free, 500MB on disk, one earlier title, which may point to a small scope."
    bare = one(spark, T.rationale(F.lit(3), F.lit(None).cast("double"), F.lit(2.5), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit("x")))
    assert bare == "In x: 3 reviews, $2.50, which may point to a small scope."
    assert Counter(one(spark, P.missing_names(a=F.lit(None), b=F.lit(1)))) == Counter(["a"])


def test_threshold_search_works_on_kinds_of_items(spark):
    """Copies of items add to the counts of their kind, not to the rows that vote."""
    rows = [(i, n) for i in range(200) for n in (("a", "b", "c") if i % 4 else ("c", "d", "e"))]
    labels = spark.createDataFrame(rows + rows[:3] + [(500, "z")], "item_id long, label string")
    kinds = affinity.label_kinds(labels)
    assert {("".join(r.labels), r.n_items) for r in kinds.collect()} == {("abc", 150), ("cde", 50), ("z", 1)}
    found = {(r.a, r.b): (r.both, r.distance) for r in affinity.kinds_jaccard(kinds).collect()}
    assert found == {("a", "b"): (150, 0.0), ("a", "c"): (150, 0.25), ("b", "c"): (150, 0.25), ("c", "d"): (50, 0.75), ("c", "e"): (50, 0.75), ("d", "e"): (50, 0.0)}
    _, merges = archetypes.linkage(labels.select("label").distinct(), affinity.jaccard(labels).select("a", "b", "distance"), method="single")
    steps = [tuple(r) for r in merges.select("distance", "a", "b").collect()]
    for most_share in (0.1, 0.75):
        assert archetypes.search_threshold(labels.distinct(), merges, most_share=most_share, kinds=kinds) == threshold_by_hand(sorted({*rows, (500, "z")}), steps, most_share)
