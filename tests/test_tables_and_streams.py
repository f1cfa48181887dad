"""Sinks, scans and streams on folders of their own."""

import datetime
import itertools
import json
import random
import time
import types

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfsight.operators.runs import list_runs, runs_after, runs_page, throttle_info
from shelfsight.sources import tables as B
from shelfsight.streaming import streams, throttle

T0 = datetime.datetime(2020, 1, 1)


def payload(run, item, source, second, body="{}"):
    return (run, item, source, T0 + datetime.timedelta(seconds=second), 200, body, "x")


def test_first_payload_wins(spark, tmp_path):
    path = f"file://{tmp_path}/payloads"
    B.append_payloads(spark, path, spark.createDataFrame([payload("r", 1, "details", 5, "b"), payload("r", 1, "details", 1, "a"), payload("r", 2, "reviews", 1)], B.PAYLOAD))
    B.append_payloads(spark, path, spark.createDataFrame([payload("r", 1, "details", 0, "c"), payload("r", 3, "details", 0), payload("r", 9, "unheard", 0)], B.PAYLOAD))
    found = B.scan_payloads(spark, path, "r", "details").collect()
    assert [(r.item_id, r.payload) for r in found] == [(1, "a"), (3, "{}")]
    assert B.fetched_ids(spark, path, "r", "reviews").count() == 1 and set(B.bundle(spark, path, "r")) == set(B.ALLOWED_SOURCES)
    with pytest.raises(ValueError):
        B.scan_payloads(spark, path, "r", "unheard")
    plan = B.scan_payloads(spark, path, "r", "details")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "run_id" in plan


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    """However many keys are stored, only what arrives is dealt out."""
    path = f"file://{tmp_path}/payloads"
    B.append_payloads(spark, path, spark.createDataFrame([payload("r", i, "details", i) for i in range(300)], B.PAYLOAD))
    arriving = spark.createDataFrame([payload("r", i, "details", i) for i in range(290, 310)], B.PAYLOAD)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = B.fresh_payloads(spark, path, arriving)
        assert sorted(r.item_id for r in fresh.collect()) == list(range(300, 310))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount" in plan


def test_two_writers_and_a_broken_batch(spark, tmp_path):
    """A key that is stored twice is read once: the first that was fetched."""
    path = f"file://{tmp_path}/payloads"
    batches = [spark.createDataFrame([payload("r", 1, "details", s, b), payload("r", k, "details", 0)], B.PAYLOAD) for k, (s, b) in enumerate(((5, "b"), (1, "a")), 2)]
    fresh = [B.fresh_payloads(spark, path, b).collect() for b in batches]  # both look before either writes
    for rows in fresh:
        spark.createDataFrame(rows, spark.createDataFrame([], B.PAYLOAD).schema).write.mode("append").partitionBy("run_id", "source").parquet(path)
    B.append_payloads(spark, path, batches[0])  # its keys were never written: the batch comes again
    assert [(r.item_id, r.payload) for r in B.scan_payloads(spark, path, "r", "details").collect()] == [(1, "a"), (2, "{}"), (3, "{}")]
    spark.sql(f"DROP TABLE {B._key_table(path)}")  # as in a new session: the files stay
    assert B.fresh_payloads(spark, path, batches[0]).count() == 0


def test_replace_several_runs(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    kind = "run_id string, item_id long, x double"
    read = lambda: {(r.run_id, r.item_id, r.x) for r in B.read_table(spark, path, kind).collect()}
    B.replace_runs(spark.createDataFrame([(r, i, 0.0) for r in "abc" for i in (1, 2)], kind), path, keys=["item_id"])
    B.replace_runs(spark.createDataFrame([("a", 1, 5.0), ("c", 7, float("nan"))], kind), path, keys=["item_id"], required=["x"])
    assert read() == {("a", 1, 5.0), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 7, None)}
    for wrong in ([("a", 1, 1.0), ("a", 1, 2.0)], [(None, 1, 1.0)]):
        with pytest.raises(ValueError):
            B.replace_runs(spark.createDataFrame(wrong, kind), path, keys=["item_id"])
    other = f"file://{tmp_path}/labels"
    B.replace_runs(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], kind), other, keys=["item_id"])
    B.delete_run(spark, [path, other], "a")
    assert {r for r, *_ in read()} == {"b", "c"} and {r.run_id for r in B.read_table(spark, other, kind).collect()} == {"b"}


def test_scans_of_a_stored_table_skip(spark, tmp_path):
    """Run, range and value reach the files: one folder is listed, row groups are skipped, and two columns are read."""
    path = f"file://{tmp_path}/items"
    kind = "run_id string, item_id long, x double, maker string, other string"
    B.store_items(spark.createDataFrame([(r, i, i / 10, f"m{i % 50}", "o") for r in "ab" for i in range(2000)], kind), path, order=["x"], blooms=["maker"])
    found = B.scan_items(B.read_table(spark, path, kind), "a", columns=["item_id"], where="x >= 199 and maker = 'm7'")
    assert [r.item_id for r in found.collect()] == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,199.0)" in plan and "EqualTo(maker,m7)" in plan and "PartitionFilters: [isnotnull(run_id" in plan
    assert "ReadSchema: struct<item_id:bigint,x:double,maker:string>" in plan
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "items" / "run_id=a").glob("*.parquet"))
    spans = sorted((pq.ParquetFile(f).metadata.row_group(0).column(1).statistics.min, pq.ParquetFile(f).metadata.row_group(0).column(1).statistics.max) for f in files)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # no two files overlap
    B.store_items(spark.createDataFrame([("a", 1, 1.0, "m", "o")], kind), path)
    assert B.read_table(spark, path, kind).groupBy("run_id").count().where("run_id = 'b'").first()["count"] == 2000


def test_pages_are_those_of_the_offset_form(spark):
    rows = [(i, None if i % 9 == 0 else datetime.date(2020, 1, 1 + i % 5)) for i in range(47)]
    runs = spark.createDataFrame(rows, "run_id long, started_at date")
    items = spark.createDataFrame([(i,) for i in range(47) for _ in range(i % 4)], "run_id long")
    last = None
    for page in range(7):
        expected = [tuple(r) for r in list_runs(runs, items, limit=10, offset=10 * page).collect()]
        assert [tuple(r) for r in runs_page(runs, items, page, limit=10).collect()] == expected
        if last:
            assert [tuple(r) for r in runs_after(runs, items, last[1], last[0], limit=10).collect()] == expected
        last = expected[-1] if expected else last
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime.date(1, 1, 1)).toordinal(), -r[0]))
    assert [r.run_id for r in list_runs(runs, items, limit=47).collect()] == [i for i, _ in order]
    assert runs_page(runs.limit(0), items, 2).count() == 0


def test_replace_run(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    rows = spark.createDataFrame([("r", 1, 1.0), ("r", 2, float("nan"))], "run_id string, item_id long, x double")
    B.replace_run(rows, path, "r", keys=["item_id"], required=["item_id", "x"])
    B.replace_run(rows.limit(1), path, "s", keys=["item_id"])
    read = lambda: spark.read.schema("run_id string, item_id long, x double").parquet(path)
    assert {(r.run_id, r.item_id, r.x) for r in read().collect()} == {("r", 1, 1.0), ("r", 2, None), ("s", 1, 1.0)}
    B.replace_run(rows.limit(0), path, "r", keys=["item_id"])
    assert {r.run_id for r in read().collect()} == {"s"}
    with pytest.raises(ValueError):
        B.replace_run(rows.union(rows), path, "r", keys=["item_id"])
    with pytest.raises(ValueError):
        B.replace_run(rows, path, "r", keys=["item_id"], required=["y"])
    B.delete_run(spark, [path], "s")
    assert read().count() == 0
    with pytest.raises(ValueError):
        B.scan_items(rows, "r", columns=["nope"])
    assert B.scan_items(rows, "r", columns=["item_id"], where="x < 2").collect() == [(1,)]


def test_results(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    frame = spark.createDataFrame([(1, 0.5)], "cluster_id int, x double")
    B.write_result(frame, path, "r", "matrix", "v1")
    assert B.read_result(spark, path, "r", "matrix", "cluster_id int, x double").collect() == [(1, 0.5)]
    assert B.read_result(spark, path, "other", "matrix", "cluster_id int, x double").count() == 0
    with pytest.raises(ValueError):
        B.write_result(frame.withColumn("x", F.lit(float("inf"))), path, "r", "matrix", "v1")
    with pytest.raises(ValueError):
        B.write_result(frame, path, "r", "unheard", "v1")
    assert json.loads(B.to_json_rows(frame.withColumn("x", F.lit(float("nan")))).first().json) == {"cluster_id": 1}


def test_labels_with_null_votes(spark):
    labels = spark.createDataFrame([("r", 1, "a", None), ("r", 1, "b", 3)], "run_id string, item_id long, label string, votes long")
    assert B.scan_labels(labels, "r").count() == 2 and B.scan_labels(labels, "r", min_votes=1).count() == 1


def test_landing_stream(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    path, checkpoint = f"file://{tmp_path}/landed", f"file://{tmp_path}/checkpoint"
    row = lambda item, body: json.dumps({"run_id": "r", "item_id": item, "source": "details", "fetched_at": "2020-01-01T00:00:00Z", "http_status": 200, "payload": body, "payload_sha256": body})
    for k, bodies in enumerate((((1, "a"), (2, "b")), ((1, "z"), (3, "c")))):
        (inbox / f"{k}.json").write_text("\n".join(row(*b) for b in bodies))
        streams.land_payloads(spark, f"file://{inbox}", path, checkpoint).awaitTermination()
    assert {(r.item_id, r.payload) for r in B.scan_payloads(spark, path, "r", "details").collect()} == {(1, "a"), (2, "b"), (3, "c")}


def drained(spark, stream, checkpoint, path):
    """What a stream gives with a checkpoint of its own; another call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def put_events(spark, path, ids, mode="append"):
    rows = [(i, "r", T0 + datetime.timedelta(seconds=i), "s", "shout" if i == 4 else "info", "m", None) for i in ids]
    spark.createDataFrame(rows, B.EVENT).coalesce(1).write.mode(mode).parquet(path)


def test_tail_starts_from_an_id_and_goes_on(spark, tmp_path):
    """Ids, not files, are the offset: rows of a file that was read before and came again are not given twice."""
    path, out, seen = (f"file://{tmp_path}/{n}" for n in ("events", "out", "seen"))
    put_events(spark, path, range(1, 8))
    tail = lambda: streams.tail_events(spark, path, since=2, ids=3).select("event_id")
    assert sorted(r[0] for r in drained(spark, tail(), seen, out).collect()) == [3, 5, 6, 7]  # 4 is of no known level
    assert sorted(r[0] for r in drained(spark, tail(), seen, out).collect()) == [3, 5, 6, 7]
    put_events(spark, path, [7, 8, 9, 12])
    put_events(spark, path, [10])
    assert sorted(r[0] for r in drained(spark, tail(), seen, out).collect()) == [3, 5, 6, 7, 8, 9, 10, 12]
    batch = spark.read.format("event_tail").schema(B.EVENT).option("path", path).option("since", 8).load()
    assert sorted(r.event_id for r in batch.collect()) == [9, 10, 12]


def throttle_rows():
    rng = random.Random(3)
    rows, t = [], {"hot": 0.0, "b": 5.0, "c": 9.0}
    for i in range(600):
        run = rng.choice(("hot",) * 8 + ("b", "c"))
        t[run] += rng.choice((0.0, 0.1, 0.7, 3.0, 40.0))
        rows.append((i, run, T0 + datetime.timedelta(seconds=t[run]), rng.choice(("info",) * 9 + ("error",)), f"m{i}"))
    rows += [(900, None, T0, "info", "no run"), (901, "b", None, "info", "no time"), (902, "b", None, "error", None), (903, "b", T0, None, None)]
    return rows


KIND = "event_id long, run_id string, ts timestamp, level string, message string"


def test_throttled_stream_is_the_batch_one(spark, tmp_path):
    """Files out of order within the lateness, batch by batch and over a restart, with one run that has most events."""
    rows = throttle_rows()
    expected = sorted(r.event_id for r in throttle_info(spark.createDataFrame(rows, KIND), gap_seconds=2.0).collect())
    rng = random.Random(4)
    late = [r for r in rows if r[2] is not None]
    order = sorted(late, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 500))) + [r for r in rows if r[2] is None]
    path, out, seen = (f"file://{tmp_path}/{n}" for n in ("events", "out", "seen"))
    step = len(order) // 4
    files = [order[:step], order[step : 2 * step], order[2 * step : 3 * step], order[3 * step :], [(None, None, datetime.datetime(9999, 1, 1), "end", None)]]
    for rows_of in files[:2], files[2:]:
        for part in rows_of:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)  # files are read in the order of their times
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
        found = drained(spark, streams.throttled(source, gap_seconds=2.0), seen, out)
    assert sorted(r.event_id for r in found.collect()) == expected
    assert found.columns == ["event_id", "run_id", "ts", "level", "message"]


def test_stage_stream(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    schema = "run_id string, stage string, status string, ts timestamp, seq long"
    spark.createDataFrame([("r", "a", "running", T0, 1), ("r", "a", "succeeded", T0, 2)], schema).write.parquet(path)
    states = streams.stage_states(spark.readStream.schema(schema).parquet(path))
    states.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.status, r.attempt) for r in spark.table("states").collect()] == [("succeeded", 1)]


def test_events_are_checked_before_they_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    kind = "event_id long, run_id string, ts timestamp, stage string, level string, message string, progress double"
    good = spark.createDataFrame([(1, "a", None, "s", "info", "m", None), (2, "b", None, "s", "error", "m", 1.0)], kind)
    B.append_events(path, good)
    for level, progress in (("shout", None), ("info", 1.5), (None, None)):
        with pytest.raises(ValueError):
            B.append_events(path, good.unionByName(spark.createDataFrame([(3, "a", None, "s", level, "m", progress)], kind)))
    assert sorted(r.event_id for r in B.read_table(spark, path, B.EVENT).collect()) == [1, 2]


def test_landing_makes_the_hash(spark, tmp_path):
    import hashlib

    path = f"file://{tmp_path}/payloads"
    B.append_payloads(spark, path, spark.createDataFrame([payload("r", 1, "details", 1, "{}")], B.PAYLOAD).withColumn("payload_sha256", F.lit(None).cast("string")))
    assert B.read_table(spark, path, B.PAYLOAD).first().payload_sha256 == hashlib.sha256(b"{}").hexdigest()
    B.append_payloads(spark, path, spark.createDataFrame([], B.PAYLOAD))


def test_no_scratch_folder_off_one_machine(spark, monkeypatch):
    from shelfsight.sources import scratch

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        scratch.scratch_dir(Elsewhere)


class CountedState:
    """A run's state as the throttle sees it, in memory, with the number of calls to the store."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = {}, {}, set(), 0

    def getValueState(self, name, _):
        return self._counted(exists=lambda: name in self.value, get=lambda: self.value.get(name), update=lambda v: self.value.update({name: v}), clear=lambda: self.value.pop(name, None))

    def getMapState(self, name, *_):
        m = self.map
        return self._counted(containsKey=lambda k: k in m, getValue=lambda k: m[k], updateValue=lambda k, v: m.update({k: v}), removeKey=lambda k: m.pop(k))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def _counted(self, **methods):
        def counted(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return call

        return types.SimpleNamespace(**{k: counted(f) for k, f in methods.items()})


@pytest.mark.parametrize("page, held, most_calls", [(2, 5, None), (1, 1, None), (1000, 10_000, 60)])
def test_throttle_state_takes_calls_by_pages_not_by_events(spark, page, held, most_calls):
    """Batches out of order in random sizes, the watermark behind the newest by the lateness; many events cost few calls."""
    rng = random.Random(page)
    names = ["event_id", "run_id", "ts", "level", "message", "at"]
    schema = StructType([StructField(n, LongType()) for n in names])
    rows = [Row(*names)(i, 1, None, "info" if i % 10 else "error", f"m{i}", rng.choice((0, 3)) + 700_000 * rng.randrange(0, 900)) for i in range(600)]
    gap, late, state = 2_000_000, 60_000_000, CountedState()
    keeper = throttle.Throttle(schema, gap, 3_750_000, page, held)
    keeper.init(state)
    order = sorted(rows, key=lambda r: r.at + rng.uniform(0, 0.9 * late))
    found, newest, sizes, passed = [], 0, itertools.cycle((7, 1, 300, 40)), 0
    while order or state.timers:
        n = next(sizes)
        batch, order = order[:n], order[n:]
        passed = max(passed, (newest - late) // 1000 if newest else 0) if batch else 10**15
        newest = max([newest, *[r.at for r in batch]])
        times = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
        found += keeper.handleInputRows((1,), iter(batch), times)
        for t in sorted(x for x in state.timers if x <= passed):
            found += keeper.handleExpiredTimer((1,), times, types.SimpleNamespace(getExpiryTimeInMs=lambda: t))
            state.timers.discard(t)
    first, last, kept = {}, None, {r.event_id for r in rows if r.level == "error"}
    for r in rows:
        if r.level == "info":
            first[r.at] = min(first.get(r.at, r.event_id), r.event_id)
    for at in sorted(first):
        if last is None or at >= last + gap:
            last = at
            kept.add(first[at])
    assert sorted(r.event_id for r in found) == sorted(kept) and not state.value and not state.map
    assert all(r == rows[r.event_id] for r in found)
    assert most_calls is None or state.calls <= most_calls
