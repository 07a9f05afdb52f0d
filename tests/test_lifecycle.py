import pytest
from pyspark.sql import functions as F

from bucketlane.functions import scalars, status
from bucketlane.operators import lifecycle as L
from bucketlane.operators import placement as P
from bucketlane.sources.model import BucketError, Config, downgrade, topology_errors, upgrade

SCHEMA = "id long, status string, destination string, opts map<string,bigint>, rs_id string"


def buckets(spark, *rows):
    return spark.createDataFrame([(i, s, d, {"generation": g} if g else None, r) for i, s, d, g, r in rows], SCHEMA)


def test_all_changes(spark):
    states = [None, *status.STATUSES]
    pairs = [(a, b) for a in states for b in states]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ok", status.is_edge(F.col("a"), F.col("b")))
    got = {(r.a, r.b) for r in df.where("ok").collect()}
    assert got == {(a, a) for a in states} | {(a, b) for a, bs in status.EDGES.items() for b in bs}
    assert len(got) - len(states) == 13


def test_change_errors(spark):
    rows = [("active", "readonly", 1, 1, 0, 2, None), ("readonly", "sending", 1, 2, 0, 0, None), ("readonly", "sending", 1, 1, 0, 0, "generation must grow by one"), ("readonly", "sending", 1, 2, 0, 1, "bucket has rw references"), ("sending", "sent", 2, 3, 0, 0, "generation must stay"), ("sent", "garbage", 2, 2, 1, 0, "bucket has references"), ("active", "active", 2, 0, 0, 0, "generation was dropped"), (None, "receiving", None, 1, 1, 0, "new bucket has references"), ("active", "sent", 1, 1, 0, 0, "prohibited: active to sent")]
    df = spark.createDataFrame(rows, "o string, n string, og long, ng long, ro long, rw long, want string")
    got = df.withColumn("e", status.change_error(*(F.col(c) for c in ("o", "n", "og", "ng", "ro", "rw")))).collect()
    assert all(r.e == r.want for r in got), [r for r in got if r.e != r.want]


@pytest.mark.parametrize("local, lg, remote, rg, want", [("readonly", 1, None, None, "active"), ("sending", 1, "active", 2, "garbage"), ("sending", 2, "active", 1, "active"), ("sending", 2, "active", 2, "sent"), ("receiving", 2, "sending", 2, "garbage"), ("receiving", 2, "sent", 2, "active"), ("sending", 2, None, None, "active"), ("sending", 2, "receiving", 2, "sending")])
def test_recovery(spark, local, lg, remote, rg, want):
    rows = [(1, local, None if local == "readonly" else "b", lg, "a")] + ([(1, remote, "a", rg, "b")] if remote else [])
    got = L.recover(buckets(spark, *rows)).where("rs_id = 'a'").first()
    assert got.new_status == want


def test_recovery_asks_others_and_waits_for_the_unreachable(spark):
    b = buckets(spark, (1, "sending", "b", 1, "a"), (1, "active", None, 2, "c"))
    assert L.recover(b).where("rs_id = 'a'").first().new_status == "garbage"
    down = spark.createDataFrame([("b",)], "rs_id string")
    assert L.recover(b, down).where("rs_id = 'a'").first().new_status == "sending"


def test_send_and_sweep(spark):
    b = buckets(spark, (1, "active", None, 1, "a"), (2, "pinned", None, 1, "a"), (3, "garbage", "b", 1, "a"))
    moves = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id long, rs_id string, dst string")
    done = {(r.id, r.rs_id): (r.status, (r.opts or {}).get("generation")) for r in L.end_send(L.begin_send(b, moves)).collect()}
    assert done == {(1, "a"): ("sent", 2), (1, "b"): ("active", 2), (2, "a"): ("pinned", 1), (3, "a"): ("garbage", 1)}
    with pytest.raises(BucketError):
        L.begin_send(b, moves.withColumn("dst", F.lit("a")))
    data = spark.createDataFrame([(10, 1), (11, 3)], "k long, bucket_id long")
    kept, left, told = L.sweep({"t": data}, b)
    assert [r.k for r in kept["t"].collect()] == [10] and left.count() == 2 and tuple(told.first()) == (3, "b")


def test_receive_refuses_duplicates(spark):
    data = spark.createDataFrame([(1, 1)], "k long, bucket_id long")
    assert L.receive(data, spark.createDataFrame([(2, 1)], data.schema), ["k"]).count() == 2
    with pytest.raises(BucketError):
        L.receive(data, spark.createDataFrame([(1, 9)], data.schema), ["k"])


def test_pages_visit_before_they_filter(spark):
    b = buckets(spark, *[(i, "sent" if i <= 3 else "active", None, 1, "a") for i in range(1, 8)])
    assert P.discovery_page(b, 1, 3).collect() == []
    assert [(r.id, r.next_from) for r in P.discovery_page(b, 3, 3).collect()] == [(4, 6), (5, 6)]
    assert [r.next_from for r in P.discovery_page(b, 6, 3).collect()] == [None, None]


def test_bootstrap_once(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "rs_id string, weight double")
    b = P.bootstrap(s, 9)
    assert {r.rs_id: r["count"] for r in b.groupBy("rs_id").count().collect()} == {"a": 3, "b": 6} and P.coverage(b, 9) == 9
    with pytest.raises(BucketError):
        P.bootstrap(s, 9, b)
    assert P.bootstrap(s, 9, b, True) is b
    with pytest.raises(BucketError):
        P.coverage(b, 10)
    with pytest.raises(BucketError):
        P.force_drop(b, b.select("id").limit(1))
    assert P.force_create(spark, 5, 3, "z").count() == 3


def test_schema_versions(spark):
    old = spark.createDataFrame([(1, "active", None, "a")], "id long, status string, destination string, rs_id string")
    new = upgrade(old)
    assert new.columns == ["id", "status", "destination", "opts", "rs_id"] and downgrade(new, "0.1.16.0").columns == ["id", "status", "destination", "rs_id"]


def test_config():
    c, rest = Config.from_dict({"bucket_count": 10, "listen": 3301})
    assert rest == {"listen": 3301} and c.check().bucket_count == 10
    for bad in ({"bucket_count": 0}, {"rebalancer_max_sending": 16}, {"weights": {1: {1: 5}}}, {"weights": {1: {2: -1}}}, {"discovery_mode": "x"}, {"sharding": {"a": {"weight": 0}}}, {"sharding": {"a": {"replicas": {"x": {"uri": "u", "master": True}, "y": {"uri": "u"}}}}}):
        with pytest.raises(ValueError):
            Config(**bad).check()
    with pytest.raises(ValueError):
        Config(bucket_count=11).check(c)


def test_topology_errors(spark):
    sets = spark.createDataFrame([("a", 1.0), ("a", -1.0)], "rs_id string, weight double")
    reps = spark.createDataFrame([("x", "a", "u", True), ("x", "a", "v", True), ("y", "z", "u", False)], "replica_id string, rs_id string, uri string, is_master boolean")
    assert {r.error for r in topology_errors(sets, reps).collect()} == {"duplicate replica", "duplicate uri", "several masters", "duplicate replicaset", "bad weight", "unknown replicaset"}


def test_vclock_gaps(spark):
    df = spark.createDataFrame([({1: 1, 3: 9}, {1: 1, 3: 1}, 0), ({1: 2}, {1: 1, 2: 5}, 1), ({1: 1, 2: 2}, {1: 2, 2: 1}, None), ({}, {1: 4}, 0), ({1: 0}, {1: 1}, -1)], "a map<int,bigint>, b map<int,bigint>, want int")
    got = df.withColumn("g", scalars.vclock_compare(F.col("a"), F.col("b"))).collect()
    assert all(r.g == r.want for r in got), got


def test_versions(spark):
    ordered = ["2.9.9", "2.10.0-entrypoint", "2.10.0-alpha1", "2.10.0-beta1", "2.10.0-beta2", "2.10.0-beta2-85-gabc", "2.10.0-rc1", "2.10.0", "2.10.0-3-gabc", "2.10.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string")
    assert [r.v for r in df.orderBy(scalars.version_parse(F.col("v"))).collect()] == ordered
