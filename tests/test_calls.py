"""Calls, replicas, transfers and stateful folds against plain Python."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from bucketlane.engine import Engine
from bucketlane.functions import hashing
from bucketlane.operators import balance, calls, lifecycle, mapreduce, placement, topology
from bucketlane.sources.model import BucketError, Config
from bucketlane.streaming import state

BUCKETS = "id long, status string, destination string, opts map<string,bigint>, rs_id string"


@pytest.fixture()
def engine(spark):
    rows = [(1, "active", None, None, "a"), (2, "sent", "b", None, "a"), (2, "active", None, {"generation": 2}, "b"), (3, "sending", "b", None, "a"), (3, "receiving", "a", None, "b"), (4, "garbage", None, None, "a")]
    replicas = [("a1", "a", "1", True), ("a2", "a", "1", False), ("a3", "a", "2", False), ("b1", "b", "1", True)]
    e = Engine(
        spark, Config(bucket_count=5, zone="1"), spark.createDataFrame(rows, BUCKETS), spark.createDataFrame([("a", 1.0), ("b", 1.0)], "rs_id string, weight double"),
        spark.createDataFrame(replicas, "replica_id string, rs_id string, zone string, is_master boolean"), name="calls",
    )
    e.register("t", spark.createDataFrame([(i, i % 5 + 1) for i in range(20)], "id long, bucket_id long"))
    yield e
    e.close()


def test_calls_follow_buckets(engine):
    n = lambda t: t["t"].count()
    assert engine.callrw(1, n) == 4 and engine.served == ("a", "a1")
    engine.routes[2] = "a"  # an old route
    assert engine.callrw(2, n) == 4 and engine.served == ("b", "b1") and engine.routes[2] == "b"
    assert engine.callro(3, n) == 4 and engine.served[0] == "a"
    for bucket, call, name in ((3, engine.callrw, "TRANSFER_IS_IN_PROGRESS"), (4, engine.callro, "WRONG_BUCKET"), (5, engine.callro, "WRONG_BUCKET"), (6, engine.callro, "BUCKET_ID_IS_OUT_OF_RANGE")):
        with pytest.raises(BucketError) as e:
            call(bucket, n)
        assert e.value.name == name
    with pytest.raises(BucketError) as e:
        engine.callro(1, "nothing")
    assert e.value.name == "NO_SUCH_PROC"


def test_replica_choice(engine):
    who = lambda call: (call(1, lambda t: 0), engine.served[1])[1]
    assert [who(engine.callro) for _ in range(2)] == ["a1", "a1"] and who(engine.callre) == "a2"
    assert [who(engine.callbro) for _ in range(4)] == ["a1", "a2", "a3", "a1"] and [who(engine.callbre) for _ in range(3)] == ["a2", "a3", "a2"]
    engine.call(1, {"mode": "read", "prefer_replica": True}, lambda t: 0)
    assert engine.served == ("a", "a2")
    engine.reconfigure(engine.config, replicas=engine.replicas.withColumn("is_master", F.lit(False)))
    with pytest.raises(BucketError) as e:
        engine.callrw(1, lambda t: 0)
    assert e.value.name == "MISSING_MASTER"


def test_time_limit_and_references(engine):
    with pytest.raises(BucketError) as e:
        engine.callro(1, lambda t: time.sleep(5), timeout=0.3)
    assert e.value.name == "TIMEOUT"

    def during(t):
        assert engine.refs[1, "write"] == 1
        with pytest.raises(BucketError) as e:
            engine.send(1, "b")
        return e.value.name

    assert engine.callrw(1, during) == "BUCKET_IS_LOCKED" and engine.refs[1, "write"] == 0


def test_receive_and_commits(engine, spark):
    heard, commits = [], []
    engine.on_bucket_event(lambda *e: heard.append(e))
    engine.on_commit(lambda *e: commits.append(e))
    rows = {"t": spark.createDataFrame([(100, 5), (101, 5)], "id long, bucket_id long")}
    engine.receive(5, "elsewhere", "b", rows, {"t": ["id"]}, is_last=False)
    assert engine.buckets.where("id = 5").first().status == "receiving"
    with pytest.raises(BucketError) as e:
        engine.receive(5, "elsewhere", "b", rows, {"t": ["id"]})
    assert e.value.name == "BUCKET_RECV_DATA_ERROR"
    engine.receive(5, "elsewhere", "b", {}, {})
    assert engine.callrw(5, lambda t: t["t"].count()) == 6 and engine.buckets.where("id = 5").first().destination is None
    assert [h[0] for h in heard] == ["bucket_data_recv_txn"] * 2 and commits == [(1, True), (2, True)]
    with pytest.raises(BucketError) as e:
        engine.receive(1, "elsewhere", "a", rows, {"t": ["id"]})
    assert e.value.name == "BUCKET_ALREADY_EXISTS"
    engine.config.rebalancer_max_receiving = 1
    with pytest.raises(BucketError) as e:
        engine.receive(1, "elsewhere", "b", rows, {"t": ["id"]})  # bucket 3 is coming to b
    assert e.value.name == "TOO_MANY_RECEIVING"
    with pytest.raises(BucketError):
        engine._set(engine.buckets.limit(0))
    assert commits[-1] == (3, False) and engine.version == 2


def test_waves(spark):
    shards = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "rs_id string, weight double")
    e = Engine(spark, Config(bucket_count=25, rebalancer_max_receiving=10), placement.bootstrap(shards, 25), shards, name=None)
    moves = e.rebalance(spark.createDataFrame([("a", 0.0), ("b", 1.0)], "rs_id string, weight double"))
    assert moves.count() == 25 and e.version == 3 and e.buckets.where("status = 'active' and rs_id = 'b'").count() == 25
    assert balance.handoffs(moves).agg(F.sum("prepared")).first()[0] == 25


def test_two_engines_of_a_name(spark, engine):
    with pytest.raises(BucketError) as e:
        Engine(spark, Config(bucket_count=5), engine.buckets, name="calls")
    assert e.value.name == "ROUTER_ALREADY_EXISTS" and Engine.instances["calls"] is engine


def test_many_changes(engine):
    for i in range(12):
        engine.pin(1, i % 2 == 0)
    assert engine.version == 12 and engine.buckets.where("id = 1").first().status == "active"


def test_numbers_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 50)) for i in range(3000)] + [(5000, None, None)]
    got = calls.numbered(spark.createDataFrame(rows, "id long, k string, at long"), ["k"], ["at", "id"]).where("k is not null").collect()
    by = {}
    for i, k, at in rows[:-1]:
        by.setdefault(k, []).append((at, i))
    want = {i: n + 1 for v in by.values() for n, (_, i) in enumerate(sorted(v))}
    assert {r.id: r.n for r in got} == want
    assert calls.numbered(spark.createDataFrame([], "id long, k string, at long"), ["k"], ["at"]).count() == 0


def test_null_keys_are_one_group(spark):
    rows = [(None, i, "ref", "read", "active") for i in range(3)] + [(1, 10, "ref", "write", "active"), (1, 11, "ref", "write", "active")]
    got = state.ref_counters(spark.createDataFrame(rows, "bucket_id long, event_id long, op string, mode string, status string")).orderBy("event_id").collect()
    assert [(r.ro, r.rw) for r in got] == [(1, 0), (2, 0), (3, 0), (0, 1), (0, 2)]


def test_bits_of_doubles(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 0.1, -0.1, 1.5, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 2.0**52 + 0.5, 1 - 2**-53, 1 + 2**-52, 2.0**-1022 * 1.5]
    values += [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", hashing.double_bits(F.col("v")).alias("b"), hashing.bucket_id_mpcrc32("v", schema=spark.createDataFrame([], "v double").schema).alias("id")).collect()
    for r in got:
        v = values[r.i]
        assert struct.pack(">q", r.b) == struct.pack(">d", v), v
        if v not in (float("inf"), float("-inf")):
            assert r.id == hashing.literal_bucket_id(v, packed=True), v


def test_parts_of_a_shard(spark):
    buckets = spark.createDataFrame([(i, "active", None, None, "a" if i < 9 else "b") for i in range(1, 11)], BUCKETS)
    data = spark.createDataFrame([(i, i % 10 + 1) for i in range(500)], "id long, bucket_id long")

    def count(rs, frames, _):
        import pandas as pd

        yield pd.DataFrame({"rs_id": [rs], "n": [sum(len(f) for f in frames)]})

    got = mapreduce.apply(data, buckets, 10, count, "rs_id string, n long", parts=7, merge=lambda f: f.groupby("rs_id", as_index=False).sum())
    assert {r.rs_id: r.n for r in got.collect()} == {"a": 400, "b": 100}
    with pytest.raises(ValueError):
        mapreduce.apply(data, buckets, 10, count, "rs_id string, n long", parts=2)


def test_recovery_and_services():
    assert topology.services({}, False, True) == {"discovery": True, "failover": True, "master_search": True, "recovery": False, "gc": False, "master_sync": False, "rebalancer": True, "rebalancer_applier": False}
    assert Config.problem({}) is None and Config.problem({"bucket_count": -1})


def test_streams_of_stateful_operators(spark):
    """Each operator gives over a replayed stream what it gives over a batch."""
    rng = random.Random(4)
    ops = [(i % 3, i, float(i * 7), rng.choice(["add", "use", "del", "kill"]), rng.randint(0, 3), 50.0) for i in range(120)]
    df = spark.createDataFrame(ops, "sid long, event_id long, now double, op string, rid long, timeout double")
    key = lambda rows: sorted(map(str, rows))
    assert key(state.replayed(df, "event_id", state.ref_deadlines).collect()) == key(state.ref_deadlines(df).collect())
    turns = spark.createDataFrame([(i % 2, i, rng.choice(["ref", "move", "end_ref", "end_move"])) for i in range(120)], "shard long, event_id long, op string")
    one, two = state.schedule(turns, 3, 1), state.replayed(turns, "event_id", state.schedule, triggers=4, ref_quota=3, move_quota=1)
    assert key(one.collect()) == key(two.collect())


def test_events_and_raw_rows(spark):
    b = spark.createDataFrame([(1, "garbage", None, None, "a"), (2, "active", None, None, "a")], BUCKETS)
    after = spark.createDataFrame([(2, "active", None, None, "a"), (3, "receiving", "x", None, "a"), (4, "active", None, None, "a")], BUCKETS)
    assert sorted((r.event, r.id, r.spaces) for r in lifecycle.events(b, after, ["u", "t"]).collect()) == [("bucket_data_gc_txn", 1, "t,u"), ("bucket_data_recv_txn", 3, "t,u")]
    raw = spark.createDataFrame([("t", '{"id": 1, "x": "a"}'), ("t", "{"), ("t", None)], "space string, row string")
    assert [(r.id, r.error) for r in lifecycle.decode(raw, "id long, x string").collect()] == [(1, None), (None, "BUCKET_RECV_DATA_ERROR"), (None, "BUCKET_RECV_DATA_ERROR")]


def test_background_and_reload(engine, spark):
    seen = []
    engine.function("work", lambda data: seen.append(("old", data)) or 0.01)
    thread = engine.background("work", 7)
    while len(seen) < 3:
        time.sleep(0.01)

    def broken(data):
        raise RuntimeError("on purpose")

    engine.function("work", broken)
    while thread.failures < 2:
        thread.wakeup()
        time.sleep(0.01)
    engine.routes[1] = "a"
    new = engine.reload(_functions={"work": lambda data: seen.append(("new", data)) or 0.01})
    while ("new", 7) not in seen:
        thread.wakeup()
        time.sleep(0.01)
    assert thread.stop(5) and new.routes == {1: "a"} and Engine.instances["calls"] is new and new.callro(1, lambda t: t["t"].count()) == 4
    with pytest.raises(BucketError) as e:
        engine.callro(1, lambda t: 0)
    assert e.value.name == "OBJECT_IS_OUTDATED"


def test_replica_calls_and_disabled_shards(engine):
    assert engine.replica_call("a2", lambda t: t["t"].count()) == 8 and engine.master_call("b", lambda t: t["t"].count()) == 4
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            engine.replica_call("a2", lambda t: 1 / 0)
    assert engine.fails["a2"] == 2
    with pytest.raises(BucketError) as e:
        engine.replica_call("a2", lambda t: time.sleep(1), timeout=0.05)
    assert e.value.name == "TIMEOUT" and engine.fails["a2"] == 3
    engine.replica_call("a2", lambda t: 0)
    assert engine.fails["a2"] == 0
    engine.storage_disable("a")
    for call in (lambda: engine.callro(1, lambda t: 0), lambda: engine.replica_call("a1", lambda t: 0)):
        with pytest.raises(BucketError) as e:
            call()
        assert e.value.name == "STORAGE_IS_DISABLED"
    assert engine.callro(2, lambda t: 1) == 1
    engine.storage_enable("a")
    assert engine.callro(1, lambda t: 1) == 1


@pytest.mark.parametrize("options, ok", [
    ({"failover_sequential_fail_count": 0}, False), ({"failover_interval": 0}, False), ({"connection_outdate_delay": 0}, True), ({"connection_outdate_delay": -1}, False), ({"box_cfg_mode": "manual"}, True),
    ({"schema_management_mode": "manual"}, False), ({"identification_mode": "name"}, False), ({"connection_fetch_schema": 1}, False), ({"collect_lua_garbage": True}, True), ({"zone": True}, False),
    ({"sharding": {"a": {"rebalancer": False, "replicas": {"a1": {"uri": "x", "rebalancer": True}}}}}, False), ({"sharding": {"a": {"replicas": {"a1": {"uri": "x", "uuid": "12345678-1234-1234-1234-123456789abc"}}}}}, False),
    ({"identification_mode": "name_as_key", "sharding": {"a": {"replicas": {"a1": {"uri": "x", "uuid": "12345678-1234-1234-1234-123456789abc"}}}}}, True),
])
def test_options(options, ok):
    assert (Config.problem(options) is None) == ok
