"""Calls as tables: requests go to the shard that the router knows, follow buckets that moved, and get a replica.

What becomes of a request depends on its bucket and mode alone, so hops are taken once for each bucket and mode, and requests
of any number are only joined with the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketlane.functions import status as S
from bucketlane.operators import placement

#: Shards that a call tries before its error is final.
HOPS = 4


def outcomes(cache: DataFrame, buckets: DataFrame, bucket_count: int, masters: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """(bucket_id, mode, rs_id, hops, error) for each bucket and mode. cache: the router's routes (bucket_id, rs_id), which may
    be old or missing; a missing one is discovered. masters (rs_id, is_master, found): whether who is taken for the master is
    it, and whether the real one can be found.

    WRONG_BUCKET and TRANSFER_IS_IN_PROGRESS lead to the bucket's destination, or else to where discovery finds it;
    NON_MASTER to the same shard once more, if its master can be found. Other errors, and any without a way on, are final."""
    spark = buckets.sparkSession
    ids = spark.range(1, bucket_count + 1).withColumnRenamed("id", "bucket_id")
    real = placement.route_map(buckets).withColumnRenamed("rs_id", "real")
    known = cache.select("bucket_id", F.col("rs_id").alias("cached"))
    base = ids.join(known, "bucket_id", "left").join(real, "bucket_id", "left").withColumn("rs_id", F.coalesce("cached", "real"))
    told = masters if masters is not None else buckets.select("rs_id").distinct().withColumn("is_master", F.lit(True)).withColumn("found", F.lit(True))
    here = buckets.select(F.col("id").alias("bucket_id"), F.col("rs_id"), F.col("status"), F.col("destination"))
    rows = base.select("bucket_id", F.explode(F.array(F.lit("read"), F.lit("write"))).alias("mode"), "real", "rs_id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("done"), F.lit(False).alias("renewed"))
    for hop in range(hops):
        at = rows.join(here, ["bucket_id", "rs_id"], "left").join(F.broadcast(told), "rs_id", "left")  # a row a shard
        code = S.access(F.col("mode"), F.col("status"), F.coalesce("is_master", F.lit(False)) | F.col("renewed"), F.col("destination"))["code"]
        code = F.when(F.col("rs_id").isNull(), "NO_ROUTE_TO_BUCKET").otherwise(code)
        on = F.when(F.col("code").isin("WRONG_BUCKET", "TRANSFER_IS_IN_PROGRESS"), F.coalesce("destination", "real"))
        again = (F.col("code") == "NON_MASTER") & F.coalesce("found", F.lit(False)) & ~F.col("renewed")
        moves = ~F.col("done") & F.coalesce(again | (on != F.col("rs_id")), F.lit(False)) & F.lit(hop + 1 < hops)
        at = at.withColumn("code", code).withColumn("moves", moves).withColumn("again", F.coalesce(again, F.lit(False))).withColumn("on", on)
        rows = at.select(
            "bucket_id", "mode", "real", F.when(F.col("moves") & ~F.col("again"), F.col("on")).otherwise(F.col("rs_id")).alias("rs_id"),
            (F.col("hops") + F.col("moves").cast("int")).alias("hops"), F.when(F.col("done") | F.col("moves"), F.col("error")).otherwise(F.col("code")).alias("error"),
            (F.col("done") | ~F.col("moves")).alias("done"), ((F.col("renewed") | F.col("again")) & F.col("moves") | F.col("renewed")).alias("renewed"),
        )
    return rows.select("bucket_id", "mode", "rs_id", "hops", "error")


def serve(requests: DataFrame, cache: DataFrame, buckets: DataFrame, bucket_count: int, masters: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """requests (bucket_id, mode, ...) plus rs_id, hops and error, null where the call got through."""
    out = requests.join(placement.small(outcomes(cache, buckets, bucket_count, masters, hops), 2 * bucket_count), ["bucket_id", "mode"], "left")
    error = F.when((F.col("bucket_id") < 1) | (F.col("bucket_id") > bucket_count), "BUCKET_ID_IS_OUT_OF_RANGE").when(~F.col("mode").isin("read", "write"), "UNKNOWN_MODE")
    return out.withColumn("error", error.otherwise(F.col("error")))


def candidates(prioritized: DataFrame, healthy: Column) -> DataFrame:
    """(rs_id, kind, replicas, balanced): for each kind of call, the replicas of a shard that may serve it, in order of
    priority. Reads go to healthy ones, or to the nearest where none is; callre and callbre to masters only where no other
    healthy one is."""
    rows = prioritized.withColumn("up", F.coalesce(healthy, F.lit(False)))
    pick = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("priority", "replica_id")))), lambda s: s["replica_id"])
    # a shard has few replicas
    got = rows.groupBy("rs_id").agg(pick(F.lit(True)).alias("all"), pick(F.col("up")).alias("live"), pick(F.col("up") & ~F.col("is_master")).alias("others"), pick(F.col("is_master")).alias("masters"))
    first = lambda a: F.slice(a, 1, 1)
    live = F.when(F.size("live") > 0, F.col("live")).otherwise(first("all"))
    others = F.when(F.size("others") > 0, F.col("others")).otherwise(live)
    kinds = [("callrw", first("masters"), False), ("callro", first(live), False), ("callbro", live, True), ("callre", first(others), False), ("callbre", others, True)]
    return got.select("rs_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("replicas"), F.lit(b).alias("balanced")) for k, c, b in kinds))))


def numbered(df: DataFrame, by: list[str], order: list[str], blocks: int = 64) -> DataFrame:
    """df plus n, the row number within `by` in this order. A group may hold most rows: it's cut into blocks by the first
    column of the order, which has to be a number or a time, and blocks are numbered on their own; counts of blocks, of which
    there are at most `blocks` for each group, are added up."""
    at = F.col(order[0])
    cuts = df.agg(F.percentile_approx(at, [i / blocks for i in range(1, blocks)], 1000).alias("c")).first().c or []
    block = F.lit(0)
    for cut in sorted(set(cuts)):
        block = block + (at > F.lit(cut)).cast("int")
    rows = df.withColumn("__block", F.coalesce(block, F.lit(-1)))
    sizes = rows.groupBy(*by, "__block").count()
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(*order))
    return rows.withColumn("__n", own).join(sizes, [*by, "__block"]).withColumn("n", F.col("__n") + F.col("__before")).drop("__n", "__before", "__block")


def pick_replica(requests: DataFrame, prioritized: DataFrame, order: list[str], healthy: Column) -> DataFrame:
    """requests (rs_id, kind, ...) plus replica_id. Balanced kinds take turns: request n of a shard and kind goes to replica
    (n - 1) mod their number; others always go to the first one."""
    may = F.broadcast(candidates(prioritized, healthy))  # five rows a shard
    out = numbered(requests, ["rs_id", "kind"], order).join(may, ["rs_id", "kind"], "left")
    turn = F.when(F.col("balanced"), (F.col("n") - 1) % F.size("replicas") + 1).otherwise(1).cast("int")
    return out.withColumn("replica_id", F.try_element_at("replicas", turn)).drop("replicas", "balanced", "n")
