"""Bucket lifecycle: changes of the bucket table as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketlane.functions import status as S
from bucketlane.operators import calls
from bucketlane.sources.model import CHUNK, BucketError, generation


def _opts(gen: Column) -> Column:
    return F.map_from_arrays(F.array(F.lit("generation")), F.array(gen.cast("long")))


def begin_send(buckets: DataFrame, moves: DataFrame) -> DataFrame:
    """Buckets of moves (id, rs_id, dst) become sending, with a destination and the next generation, and a receiving row
    appears at the destination. Only active and readonly ones can be sent."""
    m = moves.select("id", "rs_id", F.col("dst").alias("__dst"))
    if moves.where("rs_id = dst").limit(1).count():
        raise BucketError("MOVE_TO_SELF")
    hit = F.col("__dst").isNotNull() & F.col("status").isin(S.ACTIVE, S.READONLY)
    rows = buckets.join(m, ["id", "rs_id"], "left")
    sent = rows.select(
        "id", F.when(hit, S.SENDING).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("__dst")).otherwise(F.col("destination")).alias("destination"),
        F.when(hit, _opts(generation() + 1)).otherwise(F.col("opts")).alias("opts"), "rs_id",
    )
    got = rows.where(hit).select("id", F.lit(S.RECEIVING).alias("status"), F.col("rs_id").alias("destination"), _opts(generation() + 1).alias("opts"), F.col("__dst").alias("rs_id"))
    return sent.unionByName(got)


def end_send(buckets: DataFrame) -> DataFrame:
    """Each pair of a sending and a receiving row of one generation ends as sent and active."""
    rows = buckets.withColumn("__g", generation())
    by = Window.partitionBy("id", "__g")
    both = (F.max((F.col("status") == S.SENDING).cast("int")).over(by) == 1) & (F.max((F.col("status") == S.RECEIVING).cast("int")).over(by) == 1)
    new = F.when(both & (F.col("status") == S.SENDING), S.SENT).when(both & (F.col("status") == S.RECEIVING), S.ACTIVE).otherwise(F.col("status"))
    rows = rows.withColumn("__new", new).withColumn("destination", F.when(F.col("__new") != S.ACTIVE, F.col("destination")))
    return rows.select("id", F.col("__new").alias("status"), "destination", "opts", "rs_id")


def receive(data: DataFrame, chunk: DataFrame, key: list[str]) -> DataFrame:
    """data with the rows of a chunk; raises BUCKET_RECV_DATA_ERROR if a key exists already or twice in the chunk."""
    again = chunk.groupBy(*key).count().where("count > 1").select(*key).unionByName(chunk.join(data, key, "left_semi").select(*key))
    if again.limit(1).count():
        raise BucketError("BUCKET_RECV_DATA_ERROR")
    return data.unionByName(chunk)


def decode(raw: DataFrame, schema: str, column: str = "row") -> DataFrame:
    """raw (space, row as JSON) as typed columns of `schema` plus `error`, null where the row has this form. Nothing raises, so
    one bad row doesn't lose the rest of a chunk."""
    got = raw.withColumn("__r", F.from_json(column, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    names = [f for f in got.schema["__r"].dataType.fieldNames() if f != "__bad"]
    bad = F.col("__r").isNull() | F.col("__r.__bad").isNotNull()
    return got.select("space", *(F.col(f"__r.{n}").alias(n) for n in names), F.when(bad, "BUCKET_RECV_DATA_ERROR").alias("error"))


def receivable(buckets: DataFrame, incoming: DataFrame, max_receiving: int) -> DataFrame:
    """incoming (id, source, rs_id, seq) plus error: BUCKET_ALREADY_EXISTS where the shard has the bucket, and
    TOO_MANY_RECEIVING beyond its quota, those that receive already included; null where the first chunk is taken."""
    there = buckets.select("id", "rs_id", F.lit(True).alias("__there"))
    busy = buckets.where(F.col("status") == S.RECEIVING).groupBy("rs_id").agg(F.count(F.lit(1)).alias("__busy"))
    rows = incoming.join(there, ["id", "rs_id"], "left").join(F.broadcast(busy), "rs_id", "left")  # a row a shard
    new = F.sum(F.col("__there").isNull().cast("int")).over(Window.partitionBy("rs_id").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__n", new + F.coalesce("__busy", F.lit(0)))
    error = F.when(F.col("__there"), "BUCKET_ALREADY_EXISTS").when(F.col("__n") > max_receiving, "TOO_MANY_RECEIVING")
    return rows.withColumn("error", error).drop("__there", "__busy", "__n")


def begin_receive(buckets: DataFrame, incoming: DataFrame, max_receiving: int) -> DataFrame:
    """buckets with a receiving row for each bucket that can be taken."""
    taken = receivable(buckets, incoming, max_receiving).where("error is null")
    return buckets.unionByName(taken.select("id", F.lit(S.RECEIVING).alias("status"), F.col("source").alias("destination"), F.lit(None).cast("map<string,bigint>").alias("opts"), "rs_id"))


def receive_bucket(buckets: DataFrame, data: dict[str, DataFrame], rows: dict[str, DataFrame], keys: dict[str, list[str]], bucket_id: int, source: str, rs_id: str, max_receiving: int, is_last: bool = True, size: int = CHUNK) -> tuple[DataFrame, dict[str, DataFrame], list[tuple[str, int, list[str]]]]:
    """(buckets, data, events) after a shard received rows of one bucket, by table. The first rows make a receiving row, within
    the quota; all rows are checked before any is added, in chunks of `size` as events tell; the last ones make it active."""
    mine = (F.col("id") == bucket_id) & (F.col("rs_id") == rs_id)
    now = buckets.where(mine).select("status").first()
    if now is None:
        first = buckets.sparkSession.createDataFrame([(bucket_id, source, rs_id, 1)], "id long, source string, rs_id string, seq long")
        error = receivable(buckets, first, max_receiving).first().error
        if error:
            raise BucketError(error, bucket_id=bucket_id)
        buckets = begin_receive(buckets, first, max_receiving)
    elif now.status != S.RECEIVING:
        raise BucketError("BUCKET_ALREADY_EXISTS", bucket_id=bucket_id)
    out = dict(data)
    for name, chunk in rows.items():
        try:
            out[name] = receive(data[name], chunk, keys[name])
        except BucketError:
            raise BucketError("BUCKET_RECV_DATA_ERROR", bucket_id=bucket_id, space=name, tuple="", reason="a key exists already") from None
    count = max([chunk.count() for chunk in rows.values()], default=0)
    events = [("bucket_data_recv_txn", bucket_id, sorted(rows))] * max(1, -(-count // size))
    if is_last:
        status = F.when(mine, S.ACTIVE).otherwise(F.col("status"))
        buckets = buckets.withColumn("destination", F.when(~mine, F.col("destination"))).withColumn("status", status).select(*buckets.columns)
    return buckets, out, events


def events(before: DataFrame, after: DataFrame, spaces: list[str]) -> DataFrame:
    """(event, id, rs_id, spaces): what subscribers hear of a change of the bucket table: data of new receiving rows comes, data
    of garbage rows that are gone goes."""
    was, now = before.select("id", "rs_id", F.col("status").alias("old")), after.select("id", "rs_id", F.col("status").alias("new"))
    both = was.join(now, ["id", "rs_id"], "full")
    event = F.when(F.col("old").isNull() & (F.col("new") == S.RECEIVING), "bucket_data_recv_txn").when((F.col("old") == S.GARBAGE) & F.col("new").isNull(), "bucket_data_gc_txn")
    return both.withColumn("event", event).where("event is not null").select("event", "id", "rs_id", F.lit(",".join(sorted(spaces))).alias("spaces"))


def dml(buckets: DataFrame, log: DataFrame, writers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buckets, refused) after a log (seq, rs_id, op, id, status) of raw operations: insert, replace, update and delete, the
    last one of a bucket counts. Shards that can't write (writers: rs_id, error) refuse theirs: (seq, error)."""
    rows = log.join(F.broadcast(writers.select("rs_id", F.col("error").alias("__e"))), "rs_id", "left")  # a row a shard
    refused = rows.where("__e is not null").select("seq", F.col("__e").alias("error"))
    last = rows.where("__e is null").groupBy("id", "rs_id").agg(F.max_by(F.struct("op", "status"), "seq").alias("__l"))
    both = buckets.join(last, ["id", "rs_id"], "full").where("__l is null or __l.op != 'delete'").where("status is not null or __l.op != 'update'")
    status = F.when(F.col("__l").isNotNull(), F.col("__l.status")).otherwise(F.col("status"))
    return both.withColumn("status", status).select(*buckets.columns), refused


def versions(log: DataFrame, order: list[str]) -> DataFrame:
    """log (bucket_id, status, ...) plus `version` of the bucket table after each change: one more for each row that changes
    its bucket's status. Running counts are added up from blocks, as in calls.numbered."""
    before = F.lag("status").over(Window.partitionBy("bucket_id").orderBy(*order))
    rows = log.withColumn("changed", ~before.eqNullSafe(F.col("status")))
    n = calls.numbered(rows.where("changed").withColumn("__all", F.lit(0)), ["__all"], order).select(*order, F.col("n").alias("version"))
    return rows.join(n, order, "left").withColumn("version", F.when(F.col("changed"), F.col("version")))


def locks(buckets: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, rs_id, status, ro, rw, ro_lock, rw_lock): counters of references as a commit of the bucket rows leaves them: a
    status that can't be read or written locks its side, and garbage forgets counters."""
    rows = buckets.join(refs.select("id", "ro", "rw"), "id", "left").fillna(0, ["ro", "rw"])
    kept = lambda c: F.when(F.col("status") == S.GARBAGE, F.lit(0)).otherwise(F.col(c)).alias(c)
    return rows.select("id", "rs_id", "status", kept("ro"), kept("rw"), (~S.is_readable(F.col("status"))).alias("ro_lock"), (~S.is_writable(F.col("status"))).alias("rw_lock"))


def pin(buckets: DataFrame, ids: DataFrame, pinned: bool = True) -> DataFrame:
    """active becomes pinned, or the other way round; others stay."""
    old, new = (S.ACTIVE, S.PINNED) if pinned else (S.PINNED, S.ACTIVE)
    rows = buckets.join(F.broadcast(ids.select("id", F.lit(True).alias("__p"))) if ids.isLocal() else ids.select("id", F.lit(True).alias("__p")), "id", "left")
    return rows.withColumn("status", F.when(F.col("__p") & (F.col("status") == old), new).otherwise(F.col("status"))).drop("__p").select(*buckets.columns)


def ref_counters(log: DataFrame, order: list[str]) -> DataFrame:
    """log (bucket_id, mode, delta, ...) plus the running counters ro and rw after each row. Exact while no request is
    refused; streaming.state.ref_counters keeps locks as well."""
    run = Window.partitionBy("bucket_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda m: F.sum(F.when(F.col("mode") == m, F.col("delta")).otherwise(0)).over(run)
    return log.withColumn("ro", of("read")).withColumn("rw", of("write"))


def violations(log: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a status log (bucket_id, status, ...) that the state machine forbids, with the status before."""
    before = F.lag("status").over(Window.partitionBy("bucket_id").orderBy(*order))
    return log.withColumn("old_status", before).where(~S.is_edge(F.col("old_status"), F.col("status")))


def checked(log: DataFrame, order: list[str]) -> DataFrame:
    """log (bucket_id, status, generation, ro, rw) plus `error`: why the change is refused, null if it isn't."""
    w = Window.partitionBy("bucket_id").orderBy(*order)
    return log.withColumn("error", S.change_error(F.lag("status").over(w), F.col("status"), F.lag("generation").over(w), F.col("generation"), F.col("ro"), F.col("rw")))


def current(log: DataFrame, order: list[str]) -> DataFrame:
    """The newest row of each bucket of a change log; deleted ones (null status) vanish."""
    last = F.max_by(F.struct(*[c for c in log.columns if c != "bucket_id"]), F.struct(*order))
    return log.groupBy("bucket_id").agg(last.alias("b")).select("bucket_id", "b.*").where("status is not null")


def recover(buckets: DataFrame, unreachable: DataFrame | None = None, moving: DataFrame | None = None) -> DataFrame:
    """buckets plus new_status. A row in transfer is held against the row of its destination shard, or, if there is none,
    against the newest row of all other shards (ties: the greatest shard id)."""
    rows = buckets.withColumn("gen", generation())
    # a bucket has a row on few shards: at most a handful of candidates for each
    other = rows.select(F.col("id"), F.struct(F.col("gen"), F.col("rs_id"), F.col("status")).alias("o"))
    local = rows.where(S.is_in_transfer(F.col("status")))
    pairs = local.join(other, "id", "left").where("o.rs_id != rs_id or o is null")
    found = pairs.groupBy("id", "rs_id").agg(F.max(F.when(F.col("o.rs_id") == F.col("destination"), F.col("o"))).alias("peer"), F.max("o").alias("any"))
    out = rows.join(found, ["id", "rs_id"], "left").withColumn("r", F.coalesce("peer", "any"))
    up = F.lit(True)
    if unreachable is not None:
        out = out.join(F.broadcast(unreachable.select(F.col("rs_id").alias("destination"), F.lit(True).alias("__down"))), "destination", "left")
        up = F.col("__down").isNull()
    if moving is not None:
        out = out.join(moving.select("id", F.lit(True).alias("__moving")), "id", "left")
        up = up & F.col("__moving").isNull()
    new = S.recovered(F.col("status"), F.col("gen"), F.col("r.status"), F.col("r.gen"), up)
    return out.select("id", "rs_id", "status", "destination", F.col("gen").alias("generation"), new.alias("new_status"))


def promote_sent(buckets: DataFrame, not_ok: DataFrame) -> DataFrame:
    """sent buckets that no replica objects to (not_ok: id) become garbage."""
    rows = buckets.join(not_ok.select("id").distinct().withColumn("__no", F.lit(True)), "id", "left")
    return rows.withColumn("status", F.when((F.col("status") == S.SENT) & F.col("__no").isNull(), S.GARBAGE).otherwise(F.col("status"))).select(*buckets.columns)


def sweep(data: dict[str, DataFrame], buckets: DataFrame, bucket: str = "bucket_id", shard: str | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(data, buckets, redirects) without garbage buckets. With `shard`, rows of data tell their shard by that column, and
    copies on other shards stay; redirects (bucket_id, dst) are where the buckets went."""
    gone = buckets.where(F.col("status") == S.GARBAGE)
    keys = gone.select(F.col("id").alias(bucket), *([F.col("rs_id").alias(shard)] if shard else [])).distinct()
    on = [bucket, shard] if shard else [bucket]
    kept = {name: df.join(keys, on, "left_anti") for name, df in data.items()}
    redirects = gone.where("destination is not null").select(F.col("id").alias("bucket_id"), F.col("destination").alias("dst"))
    return kept, buckets.where(F.col("status") != S.GARBAGE), redirects


def expire(redirects: DataFrame, old: DataFrame) -> DataFrame:
    """redirects without those that the snapshot of the last round has with the same destination."""
    return redirects.exceptAll(old)


def guarded(before: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed rows (id, rs_id, ...) whose bucket has had no other status or generation since `before` was read; the
    rest must be decided anew."""
    key = lambda df, p: df.select("id", "rs_id", F.col("status").alias(f"__{p}s"), generation().alias(f"__{p}g"))
    same = key(before, "b").join(key(now, "n"), ["id", "rs_id"]).where("__bs = __ns and __bg = __ng").select("id", "rs_id")
    return changed.join(same, ["id", "rs_id"], "left_semi")


def replace(buckets: DataFrame, new: DataFrame) -> DataFrame:
    """new as the next bucket table; a table that had rows is never emptied at once."""
    if buckets.limit(1).count() and not new.limit(1).count():
        raise BucketError("BUCKET_INVALID_UPDATE", reason="truncation is prohibited")
    return new


def transfers(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a log (id, seq, op: start or end): the ids in transfer, and the rows that start one twice or end none."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    wrong = F.col("op").eqNullSafe(F.coalesce("before", F.lit("end")))
    bad = log.withColumn("before", before).where(wrong).drop("before")
    last = log.groupBy("id").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'start'").select("id"), bad


def service_status(log: DataFrame) -> DataFrame:
    """(service, iteration, status, error, status_idx) of a log (service, iteration, seq, status, error): the first error of
    an iteration stands, and statuses are counted."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq")))
    rows = log.groupBy("service", "iteration").agg(first.alias("error"), F.max_by("status", "seq").alias("last"), F.count("status").alias("n"))
    done = F.sum("n").over(Window.partitionBy("service").orderBy("iteration"))
    return rows.select("service", "iteration", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("last")).alias("status"), "error", done.alias("status_idx"))


def chunks(data: DataFrame, key: list[str], size: int = CHUNK, bucket: str = "bucket_id") -> DataFrame:
    """data plus the number of the chunk that a row travels in."""
    n = F.row_number().over(Window.partitionBy(bucket).orderBy(*key))
    return data.withColumn("chunk", F.ceil(n / F.lit(size)))
