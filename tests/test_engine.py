"""Operators on hand-made fixtures, properties against plain Python, the store, streams and the record log."""

import json
import math
import pathlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickframe import session
from tickframe.engine import Engine
from tickframe.functions import labels as L
from tickframe.functions import timeutil as T
from tickframe.metrics import Registry
from tickframe.operators import aggregate as A
from tickframe.operators import points as P
from tickframe.operators import series as S
from tickframe.plans import catalog
from tickframe.sources import requests, wal
from tickframe.streaming import ingest as stream_ingest
from tickframe.streaming.late import judge, judged, late_rule

s = T.SECOND
POINTS = "series_id long, ts_ns long, value double, seq long"


def points(spark, rows):
    return spark.createDataFrame([(1, t, float(v), k) for k, (t, v) in enumerate(rows)], POINTS)


def result(df):
    return [(r.ts, r.value, r["count"]) for r in df.orderBy("ts").collect()]


X2 = [(0, 4), (30 * s, 8), (59 * s, 0), (60 * s, 5), (120 * s, 10), (180 * s, 99)]


@pytest.mark.parametrize("agg,want", [("avg", [4, 5, 10]), ("sum", [12, 5, 10]), ("min", [0, 5, 10]), ("max", [8, 5, 10]), ("count", [3, 1, 1]), ("delta", [4, 1, 5]), ("nonsense", [4, 5, 10])])
@pytest.mark.parametrize("step", [60 * s, 0, None, "1m", -5])
def test_range_aggregates(spark, agg, want, step):
    got = result(A.query_range(points(spark, X2), [1], 0, 180 * s, agg, step))
    assert [(t, v) for t, v, _ in got] == list(zip((0, 60 * s, 120 * s), want)) and [c for *_, c in got] == [3, 1, 1]


def test_range_edges(spark):
    p = points(spark, X2)
    assert result(A.query_range(p, [1], 30 * s, 60 * s, "sum")) == [(0, 8, 2)]
    assert result(A.query_range(p, [1], 60 * s, 60 * s)) == []
    assert result(A.query_range(p.where(F.col("ts_ns") != 60 * s), [1], 0, 180 * s, "delta")) == [(0, 4, 3), (120 * s, 6, 1)]
    with pytest.raises(ValueError):
        A.query_range(p, [1], 2, 1)
    with pytest.raises(ValueError):
        A.aggregate(p, "nonsense", strict=True)


def test_downsample_keeps_the_boundary_point(spark):
    t0 = 1_767_225_600 * s
    got = A.downsample(points(spark, [(t0, 1), (t0 + 30 * s, 2), (t0 + 60 * s, 3)]), "60s").orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.value) for r in got] == [(t0, 1.5), (t0 + 60 * s, 3.0)]


def test_requery_of_downsampled(spark):
    d = A.downsample(points(spark, [(0, 1), (10 * s, 2), (20 * s, 3), (60 * s, 10)]), 60 * s)
    assert result(A.aggregate(d, "avg", 120 * s)) == [(0, 6, 2)] and result(A.aggregate(d, "sum", 120 * s)) == [(0, 12, 2)]
    assert result(A.reaggregate(d, "avg", 120 * s)) == [(0, 4, 4)] and result(A.reaggregate(d, "sum", 120 * s)) == [(0, 16, 4)]


def test_negative_times(spark):
    rows = [(-90, -60), (-60, -60), (-59, 0), (-1, 0), (0, 0), (59, 0), (60, 60)]
    df = spark.createDataFrame([(a * s, b * s) for a, b in rows], "ts long, want long")
    assert df.where(T.bucket(F.col("ts"), 60 * s) != F.col("want")).count() == 0


@pytest.mark.parametrize("text,want", [("", {}), ("host=a,b,=c,x=1=2,", {"host": "a", "x": "1=2"}), ("a=1,b=3,a=2", {"a": "2", "b": "3"}), ("k=", {"k": ""})])
def test_parse_labels(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(L.parsed(F.col("t")).alias("m")).first().m == want


@pytest.mark.parametrize("name,good", [("cpu.usage", True), ("a-b_9", True), ("x" * 128, True), ("", False), ("a b", False), ("x" * 129, False), ("é", False), ("a\n", False), (None, False)])
def test_names(spark, name, good):
    assert spark.createDataFrame([(name,)], "n string").select(L.valid_name(F.col("n")).alias("g")).first().g is good


@pytest.mark.parametrize("key,good", [("host.id_1", True), ("host-id", False), ("", False), ("k" * 65, False)])
def test_label_keys(spark, key, good):
    assert spark.createDataFrame([({key: "v"},)], "m map<string,string>").select(L.valid_labels(F.col("m")).alias("g")).first().g is good


def test_registering(spark):
    rows = [("cpu", {"b": "2", "a": "1"}, 0), ("cpu", {"a": "1", "b": "2"}, 1), ("mem", {}, 2), ("cpu", {"a": "1\x00b=2"}, 3)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, seq long")
    dim = S.register(df, S.empty(spark))
    assert {(r.series_id, r.name) for r in dim.collect()} == {(1, "cpu"), (2, "mem"), (3, "cpu")}
    assert {(r.seq, r.series_id) for r in S.with_ids(df, dim).collect()} == {(0, 1), (1, 1), (2, 2), (3, 3)}
    assert S.register(df, dim).count() == 0
    assert S.lookup(dim, "cpu", {"a": "1", "b": "2"}).first().series_id == 1 and S.lookup(dim, "cpu", {"a": " 1", "b": "2"}).isEmpty()
    assert S.names_of(spark.createDataFrame([(999,)], "series_id long"), dim).first().name == ""


X8 = [(100, True), (130, True), (95, False), (250, True), (199, False), (200, True), (140, False), (260, True)]


def test_late_rule(spark):
    got = P.floors(points(spark, [(t, 0) for t, _ in X8]), 100, 100, chunks=3).select("seq", P.on_time().alias("ok"), "floor").orderBy("seq").collect()
    assert [r.ok for r in got] == [ok for _, ok in X8]
    low = P.floors(points(spark, [(50, 0), (120, 0), (99, 0)]), 100, 100).orderBy("seq").collect()
    assert [r.floor for r in low] == [100, 100, 100]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-500, 1500), min_size=1, max_size=40), st.integers(1, 200))
def test_late_rule_of_a_batch(times, cut):
    floor, want = 100, []
    for t in times:
        want.append(t >= floor)
        if t >= floor:
            floor = max(floor, t - t % 100 if t >= 0 else -((-t) - (-t) % 100))
    frame = pd.DataFrame({"series_id": 0, "ts_ns": times, "value": 0.0, "seq": range(len(times))})
    a, f = judged(frame[:cut], 100, 100)
    b, _ = judged(frame[cut:], 100, f)
    assert [*a["accepted"], *b["accepted"]] == want


def test_late_rule_of_a_stream_equals_the_batch(spark):
    folder = session.work_dir(spark, "test-late")
    rows = points(spark, [(t, 0) for t, _ in X8])
    for k in range(4):
        rows.where(f"seq div 2 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = late_rule(stream, 100, 100).writeStream.format("memory").queryName("late_test").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.seq, r.accepted) for r in spark.table("late_test").collect()} == {(k, ok) for k, (_, ok) in enumerate(X8)}


def test_late_rule_of_micro_batches_run_again(spark):
    """The last micro-batch, run again after a failure before its commit, leaves the same rows and floor."""
    folder = session.work_dir(spark, "test-judge")
    rows = points(spark, [(t, 0) for t, _ in X8])
    for k in range(4):
        rows.where(f"seq div 2 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for again in (False, True):
        if again:
            path = pathlib.Path(f"{folder}/c/commits".removeprefix("file://"))
            (path / "3").unlink(), (path / ".3.crc").unlink(missing_ok=True)
        judge(stream, f"{folder}/out", f"{folder}/c", 100, 100).awaitTermination()
        assert sorted((r.seq, r.accepted) for r in spark.read.parquet(f"{folder}/out").collect()) == [(k, ok) for k, (_, ok) in enumerate(X8)]
        assert [spark.read.parquet(f"{folder}/c/floors/{b}").first().floor for b in range(4)] == [100, 200, 200, 200]


def test_late_query_cuts_micro_batches_in_ranges(spark, sf, monkeypatch):
    seen, floors = [], P.floors
    monkeypatch.setattr(P, "floors", lambda points, *more: seen.append(points.count()) or floors(points, *more))
    total = catalog.QUERIES["late_accept_stream"](spark, sf).count()
    assert len(seen) == 4 and sum(seen) == total and max(seen) < total / 2


def test_last_write_wins(spark):
    p = points(spark, [(s, 10), (s, 11)])
    assert [r.value for r in P.last_write_wins(p).collect()] == [11]
    assert result(A.aggregate(p, "sum")) == [(0, 21, 2)]


def test_many(spark):
    dim = spark.createDataFrame([(2, "mem", {})], S.SCHEMA)
    got = A.query_many(spark.createDataFrame([(2, 5, 1.0, 0)], POINTS), dim, [2, 9, 2], 0, 10).collect()
    assert [(r.series_id, r.name, len(r.results)) for r in got] == [(2, "mem", 1), (9, "", 0), (2, "mem", 1)]


def test_nan(spark):
    p = points(spark, [(0, math.nan), (1, 3), (2, 1)])
    q = points(spark, [(0, 3), (1, math.nan), (2, 1)])
    assert math.isnan(A.aggregate(p, "min", nan="first_sticky").first().value) and A.aggregate(q, "min", nan="first_sticky").first().value == 1
    assert A.aggregate(p, "min").first().value == 1 and math.isnan(A.aggregate(p, "max").first().value)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-300, 300), st.integers(-50, 50)), min_size=1, max_size=30), st.integers(1, 90))
def test_buckets_against_plain_python(spark, rows, step):
    want = {}
    for t, v in rows:
        want.setdefault(int(math.fmod(t, step)) and t - int(math.fmod(t, step)) or (t if t % step == 0 else 0), []).append(v)
    got = {r.ts: (r.value, r["count"]) for r in A.aggregate(points(spark, rows), "sum", step).collect()}
    assert got == {k: (sum(v), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("lo,hi", [(-250, -210), (-1, 1), (3600, 7200), (3599, 7201), (0, 1), (-7000, 9000)])
def test_pruning_loses_nothing(spark, lo, hi):
    rows = [(t, 0) for t in range(-9000, 9000, 7)]
    p = points(spark, rows).withColumn("shard_start", T.bucket(F.col("ts_ns"), 3600))
    assert A.in_range(p, lo, hi, 3600).count() == sum(lo <= t < hi for t, _ in rows)
    if (lo, hi) == (3600, 7200):
        assert {r.shard_start for r in p.where(T.overlaps(F.col("shard_start"), 3600, lo, hi)).select("shard_start").distinct().collect()} == {3600}


def write_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, labels map<string,string>, ts_ns long, value double, seq long")


def test_engine(spark):
    e = Engine(spark, session.work_dir(spark, "test-engine"), window=100, downsample=10, max_age=250)
    bad = e.ingest(write_rows(spark, [("cpu", {"h": " a\t"}, 5, 1.0, 0), ("cpu", {"h": "a"}, 7, 3.0, 1), ("cpu", {"h": "a"}, 105, 5.0, 2), ("b d", {}, 1, 1.0, 3), ("cpu", {"h-": "a"}, 1, 1.0, 4)]))
    assert sorted(r.reason for r in bad.collect()) == ["bad label", "bad name"]
    assert result(e.query_range("cpu", {"h": "a"}, 0, 1000, "sum", 100)) == [(0, 4, 2), (100, 5, 1)]
    with pytest.raises(KeyError):
        e.query_range("cpu", {"h": " a\t"}, 0, 1000)
    e.ingest(write_rows(spark, [("cpu", {"h": "a"}, 7, 9.0, 10), ("mem", {}, 350, 2.0, 11)]))
    assert result(e.query_range("cpu", {"h": "a"}, 0, 1000, "sum", 100)) == [(0, 10, 2), (100, 5, 1)]
    plan = e.store.read("raw", 0, 100)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard_start" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts_ns,0)" in plan
    before = e.store.version()
    e.compact()
    assert sorted((r.ts_ns, r.value) for r in e.store.read("downsampled").collect()) == [(0, 5.0), (100, 5.0)]
    assert e.store.read("raw").count() == 1 and e.store.read("raw", version=before).count() == 5
    assert e.compact() == e.store.version()
    assert [r.state for r in e.shards().orderBy("shard_start").collect()] == ["sealed", "sealed", "active"]
    out = e.sweep(355)
    assert out == {"scanned": 3, "removed": 2}  # at the cutoff 105 - 0: blocks up to it go
    assert e.store.reclaim() > 0 and e.store.read("raw").count() == 1
    assert e.stats().first().series == 2 and e.self_check(400)
    assert e.metrics.values()["series_registered"] == 3


def test_engine_late_and_failfast(spark):
    e = Engine(spark, session.work_dir(spark, "test-late-engine"), window=100, late=True)
    bad = e.ingest(write_rows(spark, [("m", {}, t, 1.0, k) for k, t in enumerate((100, 250, 199, 200))]))
    assert [(r.seq, r.reason) for r in bad.collect()] == [(2, "late")]
    bad = e.ingest(write_rows(spark, [("m", {}, 150, 1.0, 9), ("m", {}, 300, 1.0, 10)]))
    assert [r.seq for r in bad.collect()] == [9]
    with pytest.raises(ValueError):
        e.write("b d", {}, 1, 1.0)
    assert json.loads(e.json(spark.createDataFrame([(math.nan,)], "v double")).first().json) == {"v": "NaN"}


def test_requests(spark):
    rows = [("cpu", "h=a", "12", "1.5", 0), ("cpu", "", " 12 ", "1", 1), ("cpu", None, "9" * 19, "-Inf", 2), ("cpu", "", "1", "1.5d", 3), ("cpu", "", "+7", "NaN", 4), ("cpu", "", "1", ".5e3", 5)]
    got = requests.validated(requests.single(spark.createDataFrame(rows, "name string, labels string, ts string, value string, seq long"))).orderBy("seq").collect()
    assert [r.reason for r in got] == [None, "bad ts", "bad ts", "bad value", None, None] and got[5].value == 500 and got[0].labels == {"h": "a"}
    bodies = [(0, '[{"name":"a","labels":{"k":"v"},"ts":1767225600123456789,"value":2.5},{"name":"a b","ts":1,"value":1}]'), (1, "no json"), (2, "[]")]
    good, bad = requests.accept(requests.bulk(spark.createDataFrame(bodies, "seq long, body string")))
    assert [(r.name, r.ts_ns) for r in good.collect()] == [("a", 1767225600123456789)] and bad.count() == 3


def test_log_codec_and_replay(spark, tmp_path):
    assert wal.crc32c(pd.Series(list(b"123456789")).to_numpy("uint8")[None, :])[0] == 0xE3069283
    data = wal.encoded([10, 11, 12], [1, 1, 2], [5, -6, 7], [1.5, math.nan, -0.0])
    assert len(data) == 3 * wal.RECORD
    broken = bytearray(data + b"torn")
    broken[wal.RECORD + 3] ^= 1
    (tmp_path / "wal-000001.seg").write_bytes(bytes(broken))
    (tmp_path / "wal-000002.seg").write_bytes(wal.encoded([13], [2], [8], [4.0]))
    (tmp_path / "other.txt").write_text("x")
    got = wal.replay(spark, str(tmp_path), 11)
    assert {(r.segment, r.seq, r.ts_ns) for r in got.collect()} == {("wal-000001.seg", 12, 7), ("wal-000002.seg", 13, 8)}
    assert tuple(wal.info(wal.replay(spark, str(tmp_path))).first()) == (2, 14, 3 * 37)
    left = wal.segments(wal.truncated(wal.replay(spark, str(tmp_path)), 12), 5).collect()
    assert [(r.segment, wal.decoded(bytes(r.content))["seq"].tolist()) for r in left] == [("wal-000002.seg", [13])]


def test_stream_into_the_store(spark):
    folder = session.work_dir(spark, "test-stream")
    rows = write_rows(spark, [("m", {"k": str(k % 3)}, k * 10, float(k), k) for k in range(60)])
    rows.repartition(3).write.parquet(f"{folder}/in")
    e = Engine(spark, f"{folder}/store", window=100)
    stream_ingest.ingest(stream_ingest.files(spark, f"{folder}/in", 1), e, f"{folder}/c").awaitTermination()
    assert e.stats().first().points == 60 and e.stats().first().series == 3
    assert result(e.query_range("m", {"k": "0"}, 0, 1000, "count", 1000)) == [(0, 20, 20)]
    q = stream_ingest.windowed(stream_ingest.files(spark, f"{folder}/in"), "100 microseconds", "0 seconds").writeStream.format("memory").queryName("windowed_test").outputMode("complete").option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed_test").first()["count"] == 60


def test_registry(spark):
    m = Registry()
    m.count("b", 2), m.count("b"), m.gauge("a", 7), m.add("a", -2)
    assert [r.line for r in m.lines(spark).collect()] == ["a 5", "b 3"]
    with pytest.raises(ValueError):
        m.gauge("b", 1)


@pytest.mark.parametrize("text,ns", [("1m", 60 * s), ("1h30m", 5400 * s), ("250ms", 250_000_000), (5, 5)])
def test_durations(text, ns):
    assert T.duration_ns(text) == ns


def test_bad_duration():
    with pytest.raises(ValueError):
        T.duration_ns("1 m")


def test_ranks_and_floors_over_many_ranges(spark):
    import random

    from tickframe.operators.ranges import numbered

    rng = random.Random(3)
    rows = [(rng.choice([rng.randrange(1 << 60), 5, 7]), str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, name string")
    for at_least in (1 << 16, 20, 1):
        got = [(r.n, r.seq, r.name) for r in numbered(df, "n", "seq", "name", at_least=at_least).orderBy("n").collect()]
        assert got == [(i + 1, *r) for i, r in enumerate(sorted(rows))]
    assert numbered(df.limit(0), "n", "seq").count() == 0


def test_dedup_none_keeps_all_writes(spark, tmp_path):
    from tickframe.engine import Engine

    kept = {}
    for dedup in ("last", "none"):
        e = Engine(spark, f"file://{tmp_path}/{dedup}", dedup=dedup)
        for seq, value in ((0, 10.0), (1, 11.0)):
            e.write("m", {"a": "b"}, 1_000_000_000, value, seq)
        kept[dedup] = [(r.value, r["count"]) for r in e.query_range("m", {"a": "b"}, 0, 2_000_000_000, "sum", "1s").collect()]
    assert kept == {"last": [(11.0, 1)], "none": [(21.0, 2)]}


def test_compaction_keeps_the_boundary_point(spark, tmp_path):
    from tickframe.sources.store import COARSE
    from tickframe.engine import Engine

    s = 1_000_000_000
    t0 = 1767225600 * s
    e = Engine(spark, f"file://{tmp_path}/edge", window="1h", downsample="1m")
    rows = [("m", {}, t0, 1.0, 0), ("m", {}, t0 + 30 * s, 2.0, 1), ("m", {}, t0 + 60 * s, 3.0, 2), ("m", {}, t0 + 7200 * s, 4.0, 3)]
    e.ingest(spark.createDataFrame(rows, "name string, labels map<string,string>, ts_ns long, value double, seq long"))
    e.compact()
    got = {(r.ts_ns, r.value) for r in e.store.read(COARSE).collect()}
    assert {(t0, 1.5), (t0 + 60 * s, 3.0)} <= got
