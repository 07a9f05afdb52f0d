"""Where buckets are: bootstrap, route maps, scans and access checks over the bucket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketlane.functions import status as S
from bucketlane.operators import balance
from bucketlane.sources.model import BUCKETS, CHUNK, BucketError, generation

#: A route map of more rows than this is joined by shuffle and not broadcast (24 bytes a row and the shard's name).
MOST_ROUTES = 1_000_000


def ranges(shards: DataFrame, bucket_count: int) -> DataFrame:
    """(rs_id, etalon, first, last): contiguous id ranges by ideal balance, in order of shard ids."""
    run = F.sum("etalon").over(Window.orderBy("rs_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = balance.etalon(shards, bucket_count)
    return out.select("rs_id", "etalon", (run - F.col("etalon") + 1).alias("first"), run.alias("last"))


def force_create(spark: SparkSession, first: int, count: int, rs_id: str, existing: DataFrame | None = None) -> DataFrame:
    """Active buckets first to first + count - 1; raises BUCKET_ALREADY_EXISTS if a shard has one of them."""
    if existing is not None and (taken := existing.where(F.col("id").between(first, first + count - 1)).agg(F.min("id")).first()[0]) is not None:
        raise BucketError("BUCKET_ALREADY_EXISTS", bucket_id=taken)
    rows = spark.range(first, first + count).select("id", F.lit(S.ACTIVE).alias("status"), F.lit(None).cast("string").alias("destination"), F.lit(None).cast("map<string,bigint>").alias("opts"), F.lit(rs_id).alias("rs_id"))
    return rows.select(*BUCKETS.fieldNames())


def bootstrap(shards: DataFrame, bucket_count: int, existing: DataFrame | None = None, if_not_bootstrapped: bool = False) -> DataFrame:
    """The bucket table of a new cluster. Raises NON_EMPTY where buckets exist, or returns them if that is asked for."""
    if existing is not None and existing.limit(1).count():
        if if_not_bootstrapped:
            return existing
        raise BucketError("NON_EMPTY")
    spans = ranges(shards, bucket_count).where("etalon > 0")
    rows = spans.select("rs_id", F.explode(F.sequence("first", "last")).alias("id"))
    return rows.select("id", F.lit(S.ACTIVE).alias("status"), F.lit(None).cast("string").alias("destination"), F.lit(None).cast("map<string,bigint>").alias("opts"), "rs_id")


def force_drop(buckets: DataFrame, ids: DataFrame) -> DataFrame:
    """buckets without these ids; only garbage can be dropped."""
    bad = buckets.join(ids, "id", "left_semi").where(F.col("status") != S.GARBAGE)
    if bad.limit(1).count():
        raise BucketError("BUCKET_IS_NOT_GARBAGE")
    return buckets.join(ids, "id", "left_anti")


def route_map(buckets: DataFrame) -> DataFrame:
    """(bucket_id, rs_id) of buckets that can be read; if two shards have one, that of the newest generation."""
    live = buckets.where(S.is_readable(F.col("status")))
    best = F.max_by("rs_id", F.struct(S.is_writable(F.col("status")), generation(), "rs_id"))
    return live.groupBy(F.col("id").alias("bucket_id")).agg(best.alias("rs_id"))


def small(routes: DataFrame, bucket_count: int) -> DataFrame:
    """A broadcast hint for the route map where its number of buckets is small enough."""
    return F.broadcast(routes) if bucket_count <= MOST_ROUTES else routes


def resolve(rows: DataFrame, routes: DataFrame, bucket_count: int, reachable: DataFrame | None = None) -> DataFrame:
    """rows (bucket_id, ...) plus rs_id and error: null, BUCKET_ID_IS_OUT_OF_RANGE, NO_ROUTE_TO_BUCKET, or
    UNREACHABLE_REPLICASET where `reachable` (rs_id) is given and lacks the shard."""
    out = rows.join(small(routes, bucket_count), "bucket_id", "left")
    error = F.when((F.col("bucket_id") < 1) | (F.col("bucket_id") > bucket_count), "BUCKET_ID_IS_OUT_OF_RANGE").when(F.col("rs_id").isNull(), "NO_ROUTE_TO_BUCKET")
    if reachable is not None:
        out = out.join(F.broadcast(reachable.select("rs_id", F.lit(True).alias("__up"))), "rs_id", "left")
        error = error.when(F.col("__up").isNull(), "UNREACHABLE_REPLICASET")
    return out.withColumn("error", error).drop("__up")


def group(ids: DataFrame, routes: DataFrame, size: int | None = None) -> DataFrame:
    """(rs_id, bucket_ids): distinct ids by shard, ascending. A shard's list has no more items than it has buckets; with `size`
    it comes in rows (rs_id, chunk, bucket_ids) of ids from chunk * size + 1 on, of at most `size` items each."""
    rows = ids.select("bucket_id").distinct().join(routes, "bucket_id")
    by = ["rs_id"] if size is None else ["rs_id", F.floor((F.col("bucket_id") - 1) / F.lit(size)).alias("chunk")]
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("bucket_id")).alias("bucket_ids"))


def discovery_page(buckets: DataFrame, start: int = 1, limit: int = CHUNK) -> DataFrame:
    """(id, next_from): the first `limit` rows from `start` are visited and the writable ones returned. next_from is the
    id after the last visited one if the limit was reached, else null; a page without buckets is empty."""
    seen = buckets.where(F.col("id") >= start).orderBy("id").limit(limit)
    told = seen.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    following = F.when(F.col("n") == limit, F.col("last") + 1)
    return seen.where(S.is_writable(F.col("status"))).crossJoin(F.broadcast(told)).select("id", following.alias("next_from"))  # told has one row


def discovery(buckets: DataFrame) -> DataFrame:
    """(status, id) of all writable buckets, active ones first."""
    return buckets.where(S.is_writable(F.col("status"))).select("status", "id").orderBy("status", "id")


def buckets_info(buckets: DataFrame, refs: DataFrame | None = None, bucket_id: int | None = None) -> DataFrame:
    """Rows of the bucket table with generation and reference counters; counters of 0 are null."""
    rows = buckets if bucket_id is None else buckets.where(F.col("id") == bucket_id)
    if refs is not None:
        rows = rows.join(refs.select("id", "ro", "rw"), "id", "left")
    else:
        rows = rows.withColumn("ro", F.lit(0)).withColumn("rw", F.lit(0))
    counted = lambda c: F.when(F.col(c) != 0, F.col(c))
    return rows.select("id", "rs_id", "status", "destination", generation().alias("generation"), counted("ro").alias("ref_ro"), counted("rw").alias("ref_rw"), (~S.is_writable(F.col("status"))).alias("rw_lock"), (~S.is_readable(F.col("status"))).alias("ro_lock"))


def routes_page(spark: SparkSession, routes: DataFrame, bucket_count: int, offset: int = 0, limit: int = CHUNK, masters: DataFrame | None = None) -> DataFrame:
    """(bucket_id, rs_id, status) of ids offset + 1 to offset + limit: unknown without a route; else by `masters` (rs_id,
    rw, ro): available_rw, available_ro or unreachable."""
    ids = spark.range(max(1, offset + 1), min(offset + limit, bucket_count) + 1).withColumnRenamed("id", "bucket_id")
    out = ids.join(small(routes, bucket_count), "bucket_id", "left")
    state = F.when(F.col("rs_id").isNull(), "unknown")
    if masters is None:
        return out.select("bucket_id", "rs_id", state.otherwise("available_rw").alias("status"))
    out = out.join(F.broadcast(masters), "rs_id", "left")
    return out.select("bucket_id", "rs_id", state.when(F.col("rw"), "available_rw").when(F.col("ro"), "available_ro").otherwise("unreachable").alias("status"))


def check_access(requests: DataFrame, buckets: DataFrame, bucket_count: int, masters: DataFrame | None = None) -> DataFrame:
    """requests (bucket_id, mode, ...) plus rs_id, status and error (code, reason, destination), null where allowed.
    Requests go to the newest copy of their bucket; masters (rs_id, is_master) tells where writes are possible."""
    newest = buckets.groupBy(F.col("id").alias("bucket_id")).agg(F.max_by(F.struct("rs_id", "status", "destination"), F.struct(S.is_writable(F.col("status")), generation(), "rs_id")).alias("b"))
    out = requests.join(small(newest, bucket_count), "bucket_id", "left").withColumn("rs_id", F.col("b.rs_id"))
    if masters is not None:
        out = out.join(F.broadcast(masters.select("rs_id", "is_master")), "rs_id", "left")
    else:
        out = out.withColumn("is_master", F.lit(True))
    error = S.access(F.col("mode"), F.col("b.status"), F.coalesce("is_master", F.lit(False)), F.col("b.destination"))
    return out.withColumn("status", F.col("b.status")).withColumn("error", error).drop("b", "is_master")


def moved(ids: DataFrame, buckets: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(id, dst, status) of those ids that are missing, sent or garbage; dst from the row or else from `redirects`."""
    out = ids.select("id").distinct().join(buckets.select("id", "status", "destination"), "id", "left").where("status is null or status in ('sent', 'garbage')")
    if redirects is None:
        return out.select("id", F.col("destination").alias("dst"), "status")
    return out.join(redirects.select(F.col("bucket_id").alias("id"), F.col("dst").alias("__to")), "id", "left").select("id", F.coalesce("destination", "__to").alias("dst"), "status")


def not_collectable(ids: DataFrame, buckets: DataFrame, refs: DataFrame, moving: DataFrame) -> DataFrame:
    """Ids that can't be collected as garbage yet: in transfer, of another status than garbage or sent, or read."""
    rows = ids.select("id").distinct().join(buckets.select("id", "status"), "id", "left").join(refs.select("id", "ro"), "id", "left").join(moving.select("id", F.lit(True).alias("__m")), "id", "left")
    return rows.where(F.col("__m").isNotNull() | (F.col("status").isNotNull() & ~F.col("status").isin(S.GARBAGE, S.SENT)) | (F.coalesce("ro", F.lit(0)) > 0)).select("id")


def sendable(ids: DataFrame, buckets: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, ok): whether a bucket can be sent now: it is readonly and nobody writes to it."""
    rows = ids.select("id").distinct().join(buckets.select("id", "status"), "id", "left").join(refs.select("id", "rw"), "id", "left")
    return rows.select("id", F.coalesce((F.col("status") == S.READONLY) & (F.coalesce("rw", F.lit(0)) == 0), F.lit(False)).alias("ok"))


def has(data: DataFrame, column: str, key) -> bool:
    """Whether any row has this key; it stops at the first."""
    return data.where(F.col(column) == key).limit(1).count() > 0


def counts(buckets: DataFrame) -> DataFrame:
    """(rs_id, buckets, writable): how many rows each shard has, and how many of them can be written."""
    return buckets.groupBy("rs_id").agg(F.count(F.lit(1)).alias("buckets"), F.count_if(S.is_writable(F.col("status"))).alias("writable"))


def union_of(shards: dict[str, DataFrame]) -> DataFrame:
    """The rows of all shards' tables, by name; the columns of any."""
    tables = [shards[k] for k in sorted(shards)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def all_writable(buckets: DataFrame) -> DataFrame:
    """(rs_id, all_rw): whether each bucket of a shard can be written."""
    return buckets.groupBy("rs_id").agg(F.bool_and(S.is_writable(F.col("status"))).alias("all_rw"))


def coverage(buckets: DataFrame, bucket_count: int) -> int:
    """Raises UNKNOWN_BUCKETS unless the shards' buckets add up to bucket_count."""
    known = buckets.agg(F.count(F.lit(1))).first()[0]
    if known != bucket_count:
        raise BucketError("UNKNOWN_BUCKETS", not_discovered_cnt=bucket_count - known)
    return known


def inconsistent(data: DataFrame, buckets: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """Rows of data whose bucket doesn't exist."""
    return data.join(buckets.select(F.col("id").alias(bucket)).distinct(), bucket, "left_anti")


def route_changes(log: DataFrame, order: list[str]) -> DataFrame:
    """(rs_id, delta, ...order) of a log (bucket_id, rs_id, ...) that sets routes, or resets them (null rs_id): one less for
    the shard before, one more for the new one; nothing if they agree."""
    before = F.lag("rs_id").over(Window.partitionBy("bucket_id").orderBy(*order))
    rows = log.withColumn("__b", before).where(~F.col("__b").eqNullSafe(F.col("rs_id")))
    minus = rows.where("__b is not null").select(F.col("__b").alias("rs_id"), F.lit(-1).alias("delta"), *order)
    return minus.unionByName(rows.where("rs_id is not null").select("rs_id", F.lit(1).alias("delta"), *order))


def route_counts(changes: DataFrame) -> DataFrame:
    """(rs_id, known) from route changes (rs_id, delta, ...): signed sums."""
    return changes.groupBy("rs_id").agg(F.sum("delta").alias("known"))


def bucket_stat(ids: DataFrame, buckets: DataFrame, moving: DataFrame) -> DataFrame:
    """(id, status, destination, generation, is_transfering, error) of each id: its row, whether it's in flight (moving: id),
    and why it can't be read."""
    rows = ids.select("id").distinct().join(buckets.withColumn("generation", generation()), "id", "left").join(moving.select("id", F.lit(True).alias("__m")).distinct(), "id", "left")
    error = S.access(F.lit("read"), F.col("status"), F.lit(True), F.col("destination"))["code"]
    return rows.select("id", "status", "destination", "generation", F.coalesce("__m", F.lit(False)).alias("is_transfering"), error.alias("error"))


def exist(keys: DataFrame, data: DataFrame, column: str) -> DataFrame:
    """keys (one column of this name) plus `found`: whether data has any row with it."""
    return keys.join(data.select(column, F.lit(True).alias("found")).distinct(), column, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def discovered(buckets: DataFrame, bucket_count: int, limit: int = CHUNK) -> DataFrame:
    """(bucket_id, rs_id) as pages of `limit` ids tell them to a router, one after the other."""
    pages = [buckets.where(F.col("id").between(first, first + limit - 1)) for first in range(1, bucket_count + 1, limit)]
    out = None
    for page in pages:  # bounded by the number of pages
        rows = page.where(S.is_writable(F.col("status"))).select(F.col("id").alias("bucket_id"), "rs_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def severity(flag: Column, level: int) -> Column:
    return F.when(flag, F.lit(level)).otherwise(F.lit(0))
