"""Rebalancing: ideal balance, disbalance, routes, bucket picks and the move plan.

Shards are few and the planner's tables have a row for each, so the loop over pinned shards runs on the driver; what has
a row for each bucket (picks, plans) is windows over the bucket table, partitioned by shard. Where the order of shards
matters it is ascending ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketlane.functions import status as S
from bucketlane.sources.model import DISBALANCE_THRESHOLD, MAX_RECEIVING, BucketError


def _etalon_step(shards: DataFrame, left: Column, weight_sum: Column) -> DataFrame:
    """One round: shares rounded up, and one bucket less for as many fractional shards as the sum is above `left`."""
    share = F.col("weight") * (left / weight_sum)
    up = F.ceil(share)
    cut = (share != F.floor(share)) & (up > 0)
    all_, by = Window.partitionBy(), Window.partitionBy(cut.cast("int")).orderBy("rs_id")
    rest = F.sum(up).over(all_) - left
    return shards.withColumn("etalon", (up - F.when(cut & (F.row_number().over(by) <= rest), 1).otherwise(0)).cast("long"))


def etalon(shards: DataFrame, bucket_count: int) -> DataFrame:
    """shards (rs_id, weight[, pinned]) plus `etalon`. Shards with more pinned buckets than their share keep just these,
    and the others share what is left; this takes at most as many rounds as there are shards."""
    if "pinned" not in shards.columns:
        shards = shards.withColumn("pinned", F.lit(0))
    rows = shards.select("rs_id", F.col("weight").cast("double").alias("weight"), F.coalesce("pinned", F.lit(0)).cast("long").alias("pinned")).orderBy("rs_id").collect()  # a row for each shard
    spark, fixed, left = shards.sparkSession, {}, bucket_count
    for _ in range(len(rows) + 1):
        live = [r for r in rows if r.rs_id not in fixed]
        weight = sum(r.weight for r in live)
        if not live:
            break
        if weight <= 0:
            raise ValueError("the weights of the shards that can take part are 0")
        per = left / weight
        share = {r.rs_id: r.weight * per for r in live}
        plan = {k: -int(-v // 1) for k, v in share.items()}
        rest = sum(plan.values()) - left
        for k, v in share.items():
            if rest > 0 and plan[k] > 0 and v != int(v):
                plan[k] -= 1
                rest -= 1
        if rest:
            raise ArithmeticError("shares don't add up")
        over = [r for r in live if plan[r.rs_id] < r.pinned]
        if not over:
            fixed |= plan
            break
        for r in over:
            fixed[r.rs_id] = r.pinned
            left -= r.pinned
    told = spark.createDataFrame([(k, int(v)) for k, v in fixed.items()], "rs_id string, etalon long")
    return shards.join(F.broadcast(told), "rs_id")


def etalon_unpinned(shards: DataFrame, bucket_count: int) -> DataFrame:
    """The first round of `etalon` alone as a plan, for shards without pins."""
    total = F.sum("weight").over(Window.partitionBy())
    return _etalon_step(shards.withColumn("__w", total), F.lit(bucket_count), F.col("__w")).drop("__w")


def disbalance(shards: DataFrame) -> DataFrame:
    """shards (rs_id, etalon, bucket_count) plus needed and disbalance in percent; infinite where buckets should all go."""
    needed = F.col("etalon") - F.col("bucket_count")
    by = F.when(F.col("etalon") != 0, F.abs(needed) / F.col("etalon") * 100).when(F.col("bucket_count") != 0, F.lit(float("inf"))).otherwise(0.0)
    return shards.withColumn("needed", needed).withColumn("disbalance", by.cast("double"))


def max_disbalance(measured: DataFrame) -> DataFrame:
    """One row: the greatest disbalance and the first shard, by id, that has it (null if all are balanced)."""
    order = Window.orderBy(F.col("disbalance").desc(), "rs_id")
    first = measured.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select(F.col("disbalance").alias("max_disbalance"), F.when(F.col("disbalance") > 0, F.col("rs_id")).alias("max_disbalance_id"))


def routes(measured: DataFrame) -> DataFrame:
    """(src, dst, count): needs take from the pool of surpluses in order of ids. Both sides are laid on one line by running
    sums; overlapping pieces are the routes."""
    run = Window.orderBy("rs_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pool = measured.where("needed < 0").select(F.col("rs_id").alias("src"), F.sum(-F.col("needed")).over(run).alias("s_hi"), (-F.col("needed")).alias("s_n"))
    need = measured.where("needed > 0").select(F.col("rs_id").alias("dst"), F.sum("needed").over(run).alias("d_hi"), F.col("needed").alias("d_n"))
    s_lo, d_lo = F.col("s_hi") - F.col("s_n"), F.col("d_hi") - F.col("d_n")
    both = pool.join(F.broadcast(need), (s_lo < F.col("d_hi")) & (d_lo < F.col("s_hi")))  # a row for each shard on either side
    return both.select("src", "dst", (F.least("s_hi", "d_hi") - F.greatest(s_lo, d_lo)).alias("count"))


def pick(buckets: DataFrame, wanted: DataFrame, refs: DataFrame | None = None, moving: DataFrame | None = None) -> DataFrame:
    """(rs_id, id, pos): for each shard of `wanted` (rs_id, count), its first active buckets that don't move already; those
    without rw references come first."""
    rows = buckets.where(F.col("status") == S.ACTIVE)
    rows = rows.join(refs.select("id", "rw"), "id", "left") if refs is not None else rows.withColumn("rw", F.lit(0))
    if moving is not None:
        rows = rows.join(moving.select("id"), "id", "left_anti")
    busy = (F.coalesce("rw", F.lit(0)) > 0).cast("int")
    pos = F.row_number().over(Window.partitionBy("rs_id").orderBy(busy, "id"))
    return rows.join(F.broadcast(wanted), "rs_id").withColumn("pos", pos).where("pos <= count").select("rs_id", "id", "pos")


def dispense(plan: DataFrame) -> DataFrame:
    """(src, seq, dst) of routes (src, dst, count): a shard serves its destinations in turn until each has its count."""
    turns = plan.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("count")))) if plan is not None else plan
    order = Window.partitionBy("src").orderBy("turn", "dst")
    return turns.withColumn("seq", F.row_number().over(order)).select("src", "seq", "dst")


def waves(moves: DataFrame, workers: int = 1, max_receiving: int = MAX_RECEIVING) -> DataFrame:
    """moves (src, seq, dst, ...) plus the batch of its source's workers and the wave of its destination's quota."""
    arrive = Window.partitionBy("dst").orderBy("seq", "src")
    return moves.withColumn("batch", F.ceil(F.col("seq") / F.lit(workers))).withColumn("wave", F.ceil(F.row_number().over(arrive) / F.lit(max_receiving)))


def corrected(plan: DataFrame, log: DataFrame) -> DataFrame:
    """(src, dst, left, sent, throttled, finished) of routes (src, dst, count) after a log (src, dst, event): `pop` takes a
    bucket off a route, `put` gives one back, `sent` tells that one has arrived, `skip` drops the route's rest and `throttle`
    warns of a busy destination. A route is finished once all its buckets have arrived."""
    n = lambda e: F.count_if(F.col("event") == e)
    told = log.groupBy("src", "dst").agg((n("pop") - n("put")).alias("taken"), n("sent").alias("sent"), (n("throttle") > 0).alias("throttled"), (n("skip") > 0).alias("skipped"))
    rows = plan.join(told, ["src", "dst"], "left").fillna(0, ["taken", "sent"]).fillna(False, ["throttled", "skipped"])
    left = F.when(F.col("skipped"), F.lit(0)).otherwise(F.greatest(F.col("count") - F.col("taken"), F.lit(0)))
    return rows.select("src", "dst", left.cast("long").alias("left"), "sent", "throttled", (F.col("sent") >= F.col("count")).alias("finished"))


def locked(lock: Column) -> Column:
    """Whether a shard takes no part in rebalancing."""
    return F.coalesce(lock.cast("boolean"), F.lit(False))


def first_of(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows: a heap in each task, then one of their heads."""
    return rows.orderBy(*order).limit(k)


def handoffs(moves: DataFrame) -> DataFrame:
    """(src, batch, prepared, first, last): what the worker that prepares a batch of moves (src, batch, bucket_id) hands on."""
    return moves.groupBy("src", "batch").agg(F.count(F.lit(1)).alias("prepared"), F.min("bucket_id").alias("first"), F.max("bucket_id").alias("last"))


def without(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """Routes without the destinations that failed; dispense them anew."""
    return plan.join(failed.select("src", "dst"), ["src", "dst"], "left_anti")


def quota(used: Column, change: Column, most: int = MAX_RECEIVING) -> Column:
    """What is left of a shard's receiving quota after a change, null if it is refused."""
    left = F.lit(most) - used + change
    return F.when(left >= 0, F.least(left, F.lit(most)))


def states(buckets: DataFrame, shards: DataFrame, bucket_count: int | None = None) -> DataFrame:
    """Shards with active and pinned buckets counted; locked shards are counted but not returned. Raises if a shard has
    buckets in transfer or garbage, or if the counts don't add up to bucket_count."""
    counts = buckets.groupBy("rs_id").agg(
        F.count_if(S.is_writable(F.col("status"))).alias("bucket_count"), F.count_if(F.col("status") == S.PINNED).alias("pinned"),
        F.count_if(F.col("status").isin(S.SENDING, S.RECEIVING, S.GARBAGE, S.READONLY)).alias("busy"),
    )
    if bucket_count is not None:
        told = counts.agg(F.sum("busy"), F.sum("bucket_count")).first()
        if told[0]:
            raise BucketError("REBALANCER_INVALID_STATE")
        if told[1] != bucket_count:
            raise BucketError("NOT_BOOTSTRAPPED", known=told[1], total=bucket_count)
    out = shards.join(counts.select("rs_id", "bucket_count", "pinned"), "rs_id", "left").fillna(0, ["bucket_count", "pinned"])
    return out.where(~locked(F.col("lock"))) if "lock" in shards.columns else out


def plan(buckets: DataFrame, shards: DataFrame, threshold: float = DISBALANCE_THRESHOLD, workers: int = 1, max_receiving: int = MAX_RECEIVING, bucket_count: int | None = None) -> DataFrame:
    """The moves (bucket_id, src, dst, seq, batch, wave) of one rebalancing; none if no shard is off by more than
    `threshold` percent."""
    here = buckets.sparkSession.createDataFrame
    now = states(buckets, shards, bucket_count)
    now = here(now.collect(), now.schema)  # a row for each shard: counted once, and then a local table
    total = sum(r.bucket_count for r in now.collect())
    measured = disbalance(etalon(now, int(total)))
    told = measured.collect()
    measured = here(told, measured.schema)
    ways = routes(measured)
    if max((r.disbalance for r in told), default=0) <= threshold:
        ways = ways.limit(0)
    turns = dispense(ways)
    wanted = ways.groupBy("src").agg(F.sum("count").alias("count")).withColumnRenamed("src", "rs_id")
    ready = pick(buckets, wanted)
    last = F.max("pos").over(Window.partitionBy("rs_id"))
    # workers take prepared buckets from the end
    ready = ready.withColumn("seq", last - F.col("pos") + 1).select(F.col("rs_id").alias("src"), "seq", F.col("id").alias("bucket_id"))
    return waves(turns.join(ready, ["src", "seq"]), workers, max_receiving).select("bucket_id", "src", "dst", "seq", "batch", "wave")


def elect(replicasets: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row (rs_id, replica_id): who rebalances. An explicit flag wins; else the least master id of shards that don't
    find their masters themselves; else the least shard that does. Those with the flag set to false can't be."""
    base = replicas.join(replicasets.select("rs_id", F.col("rebalancer").alias("rs_flag"), "master_mode"), "rs_id")
    named = F.when(F.coalesce(F.col("rebalancer"), F.lit(False)), 0).when(F.coalesce(F.col("rs_flag"), F.lit(False)) & F.col("is_master"), 0)
    rank = named.when(F.col("is_master"), 1).when(F.col("master_mode") == "auto", 2)
    fit = base.where(F.coalesce("rebalancer", F.lit(True)) & F.coalesce("rs_flag", F.lit(True))).withColumn("rank", rank).where("rank is not null")
    order = Window.orderBy("rank", F.when(F.col("rank") == 2, F.col("rs_id")).otherwise(F.col("replica_id")))
    return fit.withColumn("n", F.row_number().over(order)).where("n = 1").select("rs_id", F.when(F.col("rank") < 2, F.col("replica_id")).alias("replica_id"))
