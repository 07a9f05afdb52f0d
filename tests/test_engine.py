import pandas as pd
import pytest
from pyspark.sql import functions as F

from bucketlane.engine import Engine
from bucketlane.functions import hashing
from bucketlane.operators import placement
from bucketlane.sources.model import BucketError, Config
from bucketlane.streaming import state


@pytest.fixture()
def engine(spark):
    shards = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "rs_id string, weight double")
    e = Engine(spark, Config(bucket_count=30), placement.bootstrap(shards, 30), shards)
    t = spark.range(100).select("id", hashing.bucket_id_strcrc32("id", bucket_count=30).alias("bucket_id"))
    e.close()
    assert e.register("t", t) and not e.register("plain", spark.range(3)) and e.sharded_tables() == ["t"]
    return e


def test_calls(engine):
    b = engine.bucket_id_strcrc32(7)
    assert engine.callro(b, lambda t: sorted(r.id for r in t["t"].collect())).count(7) == 1
    engine.function("count", lambda t, k: t["t"].count() + k)
    assert engine.callrw(b, "count", 5) == engine.call(b, {"mode": "read", "balance": True}, "count", 5) == engine.call_async(b, "read", "count", 5).result()
    assert {r.space for r in engine.collect(b).collect()} == {"t"}
    with pytest.raises(BucketError) as e:
        engine.callrw(31, "count", 5)
    assert e.value.name == "BUCKET_ID_IS_OUT_OF_RANGE"
    with pytest.raises(BucketError):
        engine.call(b, "both", "count", 1)
    engine.buckets = engine.buckets.withColumn("status", F.when(F.col("id") == b, "sending").otherwise(F.col("status")))
    with pytest.raises(BucketError) as e:
        engine.callrw(b, "count", 5)
    assert e.value.name == "TRANSFER_IS_IN_PROGRESS" and BucketError.from_json(e.value.to_json()).name == e.value.name


def test_guard(engine):
    engine.disable()
    with pytest.raises(BucketError):
        engine.route(1)
    assert engine.info().count() == 3
    engine.enable()
    assert engine.route(1) == "a" and engine.route(30) == "b"


def test_map_reduce(engine):
    got = {r.rs_id: r.n for r in engine.map_callrw("t", F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == 100
    one = engine.map_callrw("t", F.count(F.lit(1)).alias("n"), bucket_ids=[1, 1, 2]).collect()
    assert [(r.rs_id, r.n) for r in one] == [("a", got["a"])]

    def fn(rs, frames, args):
        n = sum(len(f) for f in frames)
        yield pd.DataFrame({"rs_id": [rs], "n": [n], "args": [str(sorted(dict(args or []).items()))]})

    split = {r.rs_id: r.args for r in engine.map_apply("t", fn, "rs_id string, n long, args string", {1: "x", 30: "y"}).collect()}
    assert split == {"a": "[(1, 'x')]", "b": "[(30, 'y')]"}


def test_rebalance_and_collect(engine, spark):
    shards = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "rs_id string, weight double")
    moves = engine.rebalance(shards)
    assert moves.count() == 5
    live = {r.rs_id: r["count"] for r in engine.buckets.where("status = 'active'").groupBy("rs_id").count().collect()}
    assert live == {"a": 15, "b": 15}
    heard = []
    engine.on_bucket_event(lambda kind, ids: heard.append((kind, len(ids))))
    engine.buckets = engine.buckets.withColumn("status", F.when(F.col("status") == "sent", "garbage").otherwise(F.col("status")))
    assert engine.collect_garbage().count() == 5 and heard == [("bucket_data_gc_txn", 5)]
    assert engine.recovery_point("x").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = e.select((F.col("user_id") % 7).alias("replica_id"), "event_id", (F.col("event_type") != "error").alias("ok"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.adaptive_timeouts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), streaming=True)
    q = stream.writeStream.format("memory").queryName("timeouts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in state.adaptive_timeouts(rows).collect()}
    assert {tuple(r) for r in spark.sql("select * from timeouts").collect()} == want


def test_folds():
    s, out = {}, []
    for i, ok in enumerate([0, 0, 0, 1, 0, 0] + [1] * 10):
        out.append(state.timeout_step(s, {"replica_id": 1, "event_id": i, "ok": bool(ok)})[0]["timeout"])
    assert out[:6] == [0.5, 1, 2, 2, 2, 4] and out[-2:] == [4, 0.5]
    s, step = {}, state.ratelimit_step(30)
    assert [step(s, {"key": "k", "event_id": t, "now": t})[0]["passes"] for t in (0, 29, 30, 59, 61)] == [True, False, True, False, True]
    s, step = {}, state.sched_step(2, 1)
    log = [step(s, {"shard": 1, "event_id": i, "op": op}) for i, op in enumerate(["ref", "move", "ref", "ref", "end_ref", "end_ref", "end_move"])]
    assert [[x["event_id"] for x in l] for l in log] == [[0], [], [2], [], [], [1], [3]]
    s, n = {}, 0
    said = []
    for now, op, rid in ((0, "add", 1), (1, "add", 1), (2, "use", 1), (99, "use", 2), (99, "kill", 0), (99, "add", 3), (100, "del", 1)):
        n += 1
        r = state.deadline_step(s, {"sid": 1, "event_id": n, "now": now, "op": op, "rid": rid, "timeout": 10})[0]
        said.append((r["held"], r["error"]))
    assert said == [(1, None), (1, "STORAGE_REF_ADD"), (1, None), (1, "STORAGE_REF_USE"), (1, None), (1, "STORAGE_REF_ADD"), (0, None)]
    s, step = {}, state.redirect_step(60)
    ask = lambda t, d=None: step(s, {"bucket_id": 1, "event_id": t, "now": t, "dst": d})
    ask(10, "x")
    assert ask(100)[0]["dst"] == "x" and ask(121)[0]["dst"] is None


def test_changes(engine, spark):
    engine.pin(1)
    with pytest.raises(BucketError) as e:
        engine.send(1, "b")
    assert e.value.name == "BUCKET_IS_PINNED"
    engine.pin(1, False)
    engine.send(1, "b")
    assert engine.route(1) == "b" and engine.version == 3
    with pytest.raises(BucketError):
        engine.send(1, "b")
    with pytest.raises(BucketError):
        engine.send(1, "zzz")
    with pytest.raises(BucketError):
        engine._set(engine.buckets.limit(0))
    engine._set(engine.buckets.withColumn("status", F.when(F.col("id") == 2, "readonly").otherwise(F.col("status"))))
    assert [(r.id, r.new_status) for r in engine.recover().collect()] == [(2, "active")]
    assert engine.service("buckets_count") == 31 and engine.service("sharded_tables") == ["t"]
    engine.rebalancer_enabled = False
    with pytest.raises(BucketError):
        engine.rebalance(engine.replicasets)


def test_master_triggers(engine, spark):
    schema = "replica_id string, rs_id string, is_master boolean"
    heard = []
    engine.on_master("enable", lambda n: heard.append(("on", n)))
    engine.on_master("disable", lambda n: heard.append(("off", n)))
    engine.reconfigure(engine.config, replicas=spark.createDataFrame([("x", "a", True), ("y", "a", False)], schema))
    engine.reconfigure(engine.config, replicas=spark.createDataFrame([("x", "a", False), ("y", "a", True)], schema))
    assert heard == [("on", "x"), ("off", "x"), ("on", "y")]


def test_guards_and_reports(spark):
    from bucketlane.functions import status
    from bucketlane.operators import lifecycle, topology

    schema = "id long, status string, destination string, opts map<string,bigint>, rs_id string"
    old = spark.createDataFrame([(1, "active", None, {"generation": 1}, "a"), (2, "active", None, {"generation": 1}, "a")], schema)
    now = old.withColumn("status", F.when(F.col("id") == 2, "readonly").otherwise(F.col("status")))
    assert [r.id for r in lifecycle.guarded(old, now, old).collect()] == [1]
    refs = spark.createDataFrame([(1, 0), (2, 0)], "id long, rw long")
    assert {r.id: r.ok for r in placement.sendable(old.select("id"), now, refs).collect()} == {1: False, 2: True}
    log = spark.createDataFrame([(1, 1, "start"), (1, 2, "start"), (2, 1, "start"), (2, 2, "end"), (3, 1, "end")], "id long, seq long, op string")
    moving, bad = lifecycle.transfers(log)
    assert [r.id for r in moving.collect()] == [1] and sorted((r.id, r.seq) for r in bad.collect()) == [(1, 2), (3, 1)]
    e = spark.createDataFrame([("WRONG_BUCKET", "own.f", False), ("ACCESS_DENIED", "own.f", False), ("ACCESS_DENIED", "user", True)], "name string, f string, t boolean")
    got = e.select(status.can_retry(F.col("name"), F.col("t")).alias("r"), status.can_backoff(F.col("name"), F.col("f"), "own.").alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (True, False)]
    reps = spark.createDataFrame([("x", "a", True), ("y", "a", False)], "replica_id string, rs_id string, is_master boolean")
    info = topology.storage_info(now, reps, spark.createDataFrame([("x", 0.0, True), ("y", 12.0, True)], "replica_id string, lag double, connected boolean"))
    row = info.first()
    assert row.colour == 3 and [a.name for a in row.alerts] == ["OUT_OF_SYNC"] and topology.recovery_alerts(info).count() == 0
    alone = topology.storage_info(now, reps.where("false"))
    assert [r.message.split(":")[0] for r in topology.recovery_alerts(alone).collect()] == ["MISSING_MASTER"]
    calls = spark.createDataFrame([(0.0, 1.0, True), (1.0, 4.0, False)], "started double, ended double, ok boolean")
    assert tuple(topology.load_report(calls).first()) == (2, 1, 2.0, 0.5)
    new = spark.createDataFrame([("x", "u"), ("y", "v")], "replica_id string, uri string")
    held = spark.createDataFrame([("x", "u", 3, 1, 4.0), ("y", "old", 9, 9, 9.0)], "replica_id string, uri string, fails long, oks long, timeout double")
    assert {r.replica_id: (r.fails, r.timeout) for r in topology.rebind(new, held).collect()} == {"x": (3, 4.0), "y": (0, 0.5)}
