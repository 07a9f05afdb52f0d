import random

import pytest
from pyspark.sql import functions as F

from bucketlane.operators import balance as B
from bucketlane.sources.model import BucketError


def shards(spark, rows):
    return spark.createDataFrame([(r[0], int(r[1]), float(r[2]), int(r[3]) if len(r) > 3 else 0) for r in rows], "rs_id string, bucket_count long, weight double, pinned long")


def plan(spark, rows, total):
    m = B.disbalance(B.etalon(shards(spark, rows), total))
    ways = {(r.src, r.dst): r["count"] for r in B.routes(m).collect()}
    return {r.rs_id: r.etalon for r in m.collect()}, ways, B.max_disbalance(m).first()


# Published planner cases.
def test_new_shards(spark):
    e, ways, worst = plan(spark, [("u1", 100, 50), ("u2", 0, 20), ("u3", 0, 30)], 100)
    assert e == {"u1": 50, "u2": 20, "u3": 30} and ways == {("u1", "u2"): 20, ("u1", "u3"): 30}
    assert worst.max_disbalance == 100 and worst.max_disbalance_id == "u1"


def test_zero_weight(spark):
    e, ways, worst = plan(spark, [("u1", 2, 1), ("u2", 2, 1), ("u3", 3, 0)], 7)
    assert sorted(e.values()) == [0, 3, 4] and sum(ways.values()) == 3 and worst.max_disbalance == float("inf") and worst.max_disbalance_id == "u3"


def test_fractions(spark):
    e, ways, worst = plan(spark, [("u1", 100, 1000), ("u2", 100, 2000), ("u3", 100, 500)], 300)
    assert e == {"u1": 85, "u2": 172, "u3": 43} and ways == {("u1", "u2"): 15, ("u3", "u2"): 57} and round(worst.max_disbalance, 3) == 132.558


def test_balanced(spark):
    e, ways, worst = plan(spark, [(f"u{i}", 100, 1) for i in range(3)], 300)
    assert set(e.values()) == {100} and not ways and worst.max_disbalance_id is None


def test_eight_equal(spark):
    counts = [13] * 5 + [12] * 2 + [11]
    e, _, _ = plan(spark, [(f"u{i}", c, 1) for i, c in enumerate(counts)], 100)
    assert sorted(e.values()) == [12] * 4 + [13] * 4


def test_pins(spark):
    e, _, worst = plan(spark, [("u1", 30, 0, 25), ("u2", 25, 1, 25), ("u3", 25, 1, 25), ("u4", 20, 0)], 100)
    assert e["u1"] == 25 and sorted([e["u2"], e["u3"]]) == [37, 38] and e["u4"] == 0 and worst.max_disbalance_id == "u4"
    e, _, _ = plan(spark, [("u1", 33, 1, 30), ("u2", 33, 1, 25), ("u3", 34, 1, 24), ("u4", 0, 1)], 100)
    assert e == {"u1": 30, "u2": 25, "u3": 24, "u4": 21}


def test_large_cluster(spark):
    e, ways, _ = plan(spark, [("u1", 10000, 1), ("u2", 10000, 1), ("u3", 10000, 1), ("u4", 0, 1)], 30000)
    assert set(e.values()) == {7500} and ways == {(f"u{i}", "u4"): 2500 for i in (1, 2, 3)}


def test_unpinned_window_equals_loop(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(f"u{i}", 0, rng.choice([0, 1, 2, 3.5, 7])) for i in range(rng.randint(2, 6))]
        if sum(r[2] for r in rows) == 0:
            continue
        n = rng.randint(1, 200)
        s = shards(spark, rows)
        a = {r.rs_id: r.etalon for r in B.etalon(s, n).collect()}
        b = {r.rs_id: r.etalon for r in B.etalon_unpinned(s, n).collect()}
        assert a == b and sum(a.values()) == n


def test_dispenser_and_waves(spark):
    ways = spark.createDataFrame([("s", "a", 3), ("s", "b", 1), ("s", "c", 2)], "src string, dst string, count long")
    got = [r.dst for r in B.dispense(ways).orderBy("seq").collect()]
    assert got == ["a", "b", "c", "a", "c", "a"]
    left = B.without(ways, spark.createDataFrame([("s", "a")], "src string, dst string"))
    assert [r.dst for r in B.dispense(left).orderBy("seq").collect()] == ["b", "c", "c"]
    # 250 buckets arrive in waves of 100, 100 and 50
    big = B.waves(B.dispense(spark.createDataFrame([("s", "a", 250)], "src string, dst string, count long")), 1, 100)
    assert {r.wave: r["count"] for r in big.groupBy("wave").count().collect()} == {1: 100, 2: 100, 3: 50}


def test_pick_prefers_unreferenced(spark):
    b = spark.createDataFrame([(i, "active", "r") for i in range(1, 6)] + [(9, "pinned", "r")], "id long, status string, rs_id string")
    refs = spark.createDataFrame([(1, 2), (2, 0)], "id long, rw long")
    moving = spark.createDataFrame([(3,)], "id long")
    got = B.pick(b, spark.createDataFrame([("r", 4)], "rs_id string, count long"), refs, moving).orderBy("pos").collect()
    assert [r.id for r in got] == [2, 4, 5, 1]


def test_states_refuse_transfer_and_gaps(spark):
    s = spark.createDataFrame([("r", 1.0, True), ("q", 1.0, False)], "rs_id string, weight double, lock boolean")
    b = spark.createDataFrame([(1, "active", "r"), (2, "active", "q"), (3, "sent", "q")], "id long, status string, rs_id string")
    assert [(r.rs_id, r.bucket_count) for r in B.states(b, s, 2).collect()] == [("q", 1)]
    with pytest.raises(BucketError, match="(?i)bootstrapped"):
        B.states(b, s, 3)
    with pytest.raises(BucketError):
        B.states(b.withColumn("status", F.lit("sending")), s, 3)


def test_election(spark):
    sets = spark.createDataFrame([("a", None, None), ("b", None, "auto")], "rs_id string, rebalancer boolean, master_mode string")
    reps = [("r2", "a", True, None), ("r1", "a", False, None), ("r0", "b", False, None)]
    schema = "replica_id string, rs_id string, is_master boolean, rebalancer boolean"
    assert tuple(B.elect(sets, spark.createDataFrame(reps, schema)).first()) == ("a", "r2")
    reps[1] = ("r1", "a", False, True)
    assert tuple(B.elect(sets, spark.createDataFrame(reps, schema)).first()) == ("a", "r1")
    reps[0], reps[1] = ("r2", "a", False, None), ("r1", "a", False, None)
    assert tuple(B.elect(sets, spark.createDataFrame(reps, schema)).first()) == ("b", None)
