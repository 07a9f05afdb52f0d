"""Map-reduce over shards: all of them, or those that own given buckets, with arguments split by shard.

The snapshot is one bucket table for the whole query, so nothing moves between the check and the map. Native maps are
aggregations by shard, which Spark combines before the shuffle; a Python function sees one shard at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketlane.operators import placement


def located(data: DataFrame, buckets: DataFrame, bucket_count: int, bucket: str = "bucket_id") -> DataFrame:
    """data plus the shard of each row's bucket. Each bucket has one readable copy, so rows never count twice."""
    routes = placement.route_map(buckets).withColumnRenamed("bucket_id", bucket)
    return data.join(placement.small(routes, bucket_count), bucket)


def aggregate(data: DataFrame, buckets: DataFrame, bucket_count: int, *aggs: Column, bucket_ids: DataFrame | None = None, bucket: str = "bucket_id", whole: bool = True) -> DataFrame:
    """(rs_id, aggregates): a native map. With bucket_ids (a column of this name), shards that own one of these take part,
    with all their rows; without, all shards do, after a check that all buckets are there."""
    if bucket_ids is None:
        if whole:
            placement.coverage(buckets.where("status not in ('sent', 'garbage', 'receiving')"), bucket_count)
        return located(data, buckets, bucket_count, bucket).groupBy("rs_id").agg(*aggs)
    routes = placement.route_map(buckets).withColumnRenamed("bucket_id", bucket)
    shards = bucket_ids.select(bucket).distinct().join(routes, bucket).select("rs_id").distinct()
    mine = routes.join(F.broadcast(shards), "rs_id", "left_semi")  # a row a shard
    return data.join(placement.small(mine, bucket_count), bucket).groupBy("rs_id").agg(*aggs)


def split_args(args: DataFrame, buckets: DataFrame, size: int | None = None) -> DataFrame:
    """(rs_id, args): of (bucket_id, args) rows, each shard's map of its buckets' arguments. With `size` it comes in rows
    (rs_id, chunk, args) of buckets from chunk * size + 1 on."""
    rows = args.join(placement.route_map(buckets), "bucket_id")
    by = ["rs_id"] if size is None else ["rs_id", F.floor((F.col("bucket_id") - 1) / F.lit(size)).alias("chunk")]
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket_id", "args")))).alias("args"))


def apply(data: DataFrame, buckets: DataFrame, bucket_count: int, fn: Callable, schema: str, args: DataFrame | None = None, bucket: str = "bucket_id", parts: int = 1, merge: Callable | None = None) -> DataFrame:
    """A Python map: fn(rs_id, batches, args) yields pandas frames of `schema`, after seeing a shard's rows as a stream of
    pandas frames, so a shard needn't fit in memory. args: (rs_id, args) rows; shards without one get None, and are left
    out if args is given. Empty results vanish. Shards are dealt to tasks by id; with `parts`, as many tasks get rows of a
    shard, and merge(frame) makes a shard's results, a frame with rs_id, into one."""
    rows = located(data, buckets, bucket_count, bucket)
    if args is not None:
        rows = rows.join(F.broadcast(args) if bucket_count <= placement.MOST_ROUTES else args, "rs_id")  # a row a shard, an entry a bucket
    if parts > 1 and merge is None:
        raise ValueError("results of parts need a merge")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*data.columns), F.lit(parts)))
    ordered = rows.repartition("rs_id", "__part").sortWithinPartitions("rs_id", "__part")

    def run(frames):
        from itertools import groupby

        def pieces():
            for f in frames:
                for key, part in f.groupby(["rs_id", "__part"], sort=False):
                    yield key, part.drop(columns="__part")

        for (rs, _), parts in groupby(pieces(), key=lambda x: x[0]):
            first = next(parts)[1]
            own = first["args"].iloc[0] if "args" in first.columns else None

            def stream(first=first, parts=parts):
                yield first
                for _, p in parts:
                    yield p

            for out in fn(rs, stream(), own):
                if len(out):
                    yield out

    done = ordered.mapInPandas(run, schema)
    return done if merge is None else done.groupBy("rs_id").applyInPandas(merge, schema)  # a row or so for each part


def referenced(ids: DataFrame, cache: DataFrame, buckets: DataFrame) -> DataFrame:
    """(rs_id, made, moved): for shards that the router (cache: bucket_id, rs_id) asks to hold references for bucket ids. The
    moved ones (that can't be written there now) are told back; a reference is made unless all have moved."""
    asked = ids.select("bucket_id").distinct().join(cache.select("bucket_id", "rs_id"), "bucket_id")
    there = buckets.where(F.col("status").isin("active", "pinned")).select(F.col("id").alias("bucket_id"), "rs_id", F.lit(True).alias("there"))
    rows = asked.join(there, ["bucket_id", "rs_id"], "left").withColumn("gone", F.col("there").isNull())
    # of one call's bucket ids
    return rows.groupBy("rs_id").agg((~F.bool_and("gone")).alias("made"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("bucket_id")))).alias("moved"))


def on_replicas(data: DataFrame, replicas: DataFrame, *aggs: Column, without: str | None = None, masters_only: bool = False) -> DataFrame:
    """(replica_id, aggregates) for data (rs_id, ...): the same call on all replicas, or on masters, but one."""
    rows = replicas.where("is_master") if masters_only else replicas
    rows = rows if without is None else rows.where(F.col("replica_id") != without)
    per_shard = data.groupBy("rs_id").agg(*aggs)
    return rows.select("replica_id", "rs_id").join(per_shard, "rs_id", "left").drop("rs_id")
