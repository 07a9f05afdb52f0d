"""Queries of single rules, calls and transfers, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bucketlane import engine
from bucketlane.functions import hashing, scalars, status
from bucketlane.operators import balance, calls, lifecycle, mapreduce, placement, topology
from bucketlane.plans.catalog import _log, _priorities, _refs, query
from bucketlane.sources import demo, model
from bucketlane.sources.demo import COUNT, crc_sql
from bucketlane.streaming import background

_RW, _RO = "('active', 'pinned')", "('active', 'pinned', 'sending', 'readonly')"


# -- statuses and guards -----------------------------------------------------
@query("SELECT id, status NOT IN ('active', 'pinned', 'readonly') AS has_destination, status IN ('sending', 'receiving', 'readonly') AS in_transfer FROM buckets")
def status_predicates(spark, d) -> DataFrame:
    s = F.col("status")
    return demo.buckets(spark, d).select("id", status.has_destination(s).alias("has_destination"), status.is_in_transfer(s).alias("in_transfer"))


@query("SELECT id, status = 'readonly' AND id % 13 <> 0 AS ok FROM buckets")
def sendable_buckets(spark, d) -> DataFrame:
    refs, _ = _refs(spark, d)
    return placement.sendable(demo.buckets(spark, d).select("id"), demo.buckets(spark, d), refs)


@query("SELECT id, rs_id FROM buckets WHERE id % 5 = 0 AND id % 7 <> 0 AND (id % 11 <> 0 OR status = 'readonly')")
def generation_guard(spark, d) -> DataFrame:
    b = demo.buckets(spark, d)
    newer = F.map_from_arrays(F.array(F.lit("generation")), F.array(model.generation() + 1))
    now = b.withColumn("opts", F.when(F.col("id") % 7 == 0, newer).otherwise(F.col("opts"))).withColumn("status", F.when(F.col("id") % 11 == 0, "readonly").otherwise(F.col("status")))
    return lifecycle.guarded(b, now, b.where("id % 5 = 0").select("id", "rs_id"))


_ERROR_OF = "CASE event_type WHEN 'view' THEN 'WRONG_BUCKET' WHEN 'click' THEN 'ACCESS_DENIED' WHEN 'error' THEN 'TIMEOUT' WHEN 'signup' THEN 'TRANSFER_IS_IN_PROGRESS' ELSE 'STORAGE_IS_DISABLED' END"


def _errors(spark, d) -> DataFrame:
    t = F.col("event_type")
    name = F.when(t == "view", "WRONG_BUCKET").when(t == "click", "ACCESS_DENIED").when(t == "error", "TIMEOUT").when(t == "signup", "TRANSFER_IS_IN_PROGRESS").otherwise("STORAGE_IS_DISABLED")
    return demo.table(spark, d, "events").select("event_id", "user_id", name.alias("name"))


@query(f"SELECT event_id, name IN ('WRONG_BUCKET', 'TRANSFER_IS_IN_PROGRESS', 'TIMEOUT') AS retry, name IN ('ACCESS_DENIED', 'STORAGE_IS_DISABLED') AND user_id % 2 = 0 AS backoff FROM (SELECT event_id, user_id, {_ERROR_OF} AS name FROM events)")
def retry_classes(spark, d) -> DataFrame:
    fn = F.when(F.col("user_id") % 2 == 0, "own.storage_call").otherwise("user_function")
    name = F.col("name")
    return _errors(spark, d).select("event_id", status.can_retry(name, name == "TIMEOUT").alias("retry"), status.can_backoff(name, fn, "own.").alias("backoff"))


_CODES = "(VALUES " + ", ".join(f"('{k}', {c}, '{m.replace(chr(39), chr(39) * 2)}')" for k, (c, m) in sorted(model.ERRORS.items())) + ") AS t(name, code, text)"


@query(f"SELECT event_id, name, code, replace(replace(replace(text, '{{bucket_id}}', CAST(user_id AS VARCHAR)), '{{reason}}', 'why'), '{{destination}}', '') AS message FROM (SELECT event_id, user_id, {_ERROR_OF} AS name FROM events) JOIN {_CODES} USING (name)")
def error_messages(spark, d) -> DataFrame:
    rows = _errors(spark, d)
    return rows.join(F.broadcast(model.error_table(spark)), "name").select("event_id", "name", "code", model.message("text", bucket_id=F.col("user_id").cast("string"), reason=F.lit("why")).alias("message"))


@query(f"""SELECT i AS id, status, destination, coalesce(gen, -1) AS generation, i % 29 = 0 AND i <= {COUNT} AS is_transfering,
  CASE WHEN status IS NULL OR status NOT IN {_RO} THEN 'WRONG_BUCKET' END AS error FROM (SELECT unnest(range(1, {COUNT + 51})) AS i) LEFT JOIN buckets ON id = i""")
def bucket_stats(spark, d) -> DataFrame:
    _, moving = _refs(spark, d)
    return placement.bucket_stat(spark.range(1, COUNT + 51), demo.buckets(spark, d), moving).fillna(-1, ["generation"])


@query("SELECT i AS bucket_id, i IN (SELECT bucket_id FROM cust) AS found FROM (SELECT unnest(range(1, 3101)) AS i)")
def buckets_with_data(spark, d) -> DataFrame:
    return placement.exist(spark.range(1, 3101).withColumnRenamed("id", "bucket_id"), demo.customers(spark, d), "bucket_id")


@query(f"SELECT id, rs_id, CASE WHEN status = 'garbage' THEN 0 WHEN id % 11 = 0 THEN 1 ELSE 0 END AS ro, CASE WHEN status = 'garbage' THEN 0 WHEN id % 13 = 0 THEN 1 ELSE 0 END AS rw, status NOT IN {_RO} AS ro_lock, status NOT IN {_RW} AS rw_lock FROM buckets")
def commit_locks(spark, d) -> DataFrame:
    refs, _ = _refs(spark, d)
    return lifecycle.locks(demo.buckets(spark, d), refs).drop("status")


_CHECKED = "SELECT *, event_id % 3 AS gen, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS ro, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS rw FROM changes"
_EDGE_LIST = ", ".join(f"('{a}', '{b}')" for a, bs in status.EDGES.items() if a for b in bs if b)


@query(f"""SELECT event_id, CASE WHEN NOT (CASE WHEN old IS NULL THEN status = 'receiving' ELSE old = status OR (old, status) IN ({_EDGE_LIST}) END) THEN 'prohibited: ' || coalesce(old, 'nil') || ' to ' || status
  WHEN old IS NULL AND ro + rw > 0 THEN 'new bucket has references' WHEN status IN ('sending', 'sent') AND rw > 0 THEN 'bucket has rw references' WHEN status IN ('garbage', 'receiving') AND ro + rw > 0 THEN 'bucket has references'
  WHEN old IS NOT NULL AND old_gen > 0 AND gen = 0 THEN 'generation was dropped' WHEN status = 'sending' AND old <> 'sending' AND gen <> old_gen + 1 THEN 'generation must grow by one'
  WHEN old IS NOT NULL AND status IN ('sent', 'garbage') AND gen <> old_gen THEN 'generation must stay' END AS error
  FROM (SELECT *, lag(status) OVER w AS old, coalesce(lag(gen) OVER w, 0) AS old_gen FROM ({_CHECKED}) WINDOW w AS (PARTITION BY bucket_id ORDER BY ts, event_id))""")
def fsm_checked(spark, d) -> DataFrame:
    e = F.col("event_id")
    log = demo.changes(spark, d).select("*", (e % 3).alias("generation"), F.when(e % 11 == 0, 1).otherwise(0).alias("ro"), F.when(e % 13 == 0, 1).otherwise(0).alias("rw"))
    return lifecycle.checked(log, ["ts", "event_id"]).select("event_id", "error")


@query("SELECT event_id, CASE WHEN changed THEN count(*) FILTER (changed) OVER (ORDER BY ts, event_id) ELSE -1 END AS version FROM (SELECT *, lag(status) OVER (PARTITION BY bucket_id ORDER BY ts, event_id) IS DISTINCT FROM status AS changed FROM changes)")
def table_versions(spark, d) -> DataFrame:
    return lifecycle.versions(demo.changes(spark, d), ["ts", "event_id"]).select("event_id", F.coalesce("version", F.lit(-1)).alias("version"))


# -- maps, addresses, versions, schemas ---------------------------------------
@query("SELECT o_orderkey, o_custkey % 2 = 0 AS is_numeric, CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE 'a' END || ',b,c' AS keys FROM orders")
def table_helpers(spark, d) -> DataFrame:
    first = F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("a")
    keys = scalars.extended(F.map_keys(F.create_map(first, F.lit(1))), F.array(F.lit("b"), F.lit("c")))
    return demo.table(spark, d, "orders").select("o_orderkey", scalars.is_numeric_table(keys).alias("is_numeric"), F.array_join(keys, ",").alias("keys"))


@query("SELECT replica_id, nk % 2 = 0 AS same_uri, nk % 3 = 0 AS same FROM replicas")
def equal_addresses(spark, d) -> DataFrame:
    r, nk = demo.replicas(spark, d), F.col("nk")
    other = F.concat("uri", F.when(nk % 2 == 0, "?transport=ssl").otherwise("1"))
    deep = lambda n: F.struct(F.struct(F.array(n, F.lit(None).cast("int"))), F.lit("x"))
    return r.select("replica_id", scalars.uri_equal(F.concat("uri", F.lit("?a=b")), other).alias("same_uri"), scalars.deep_equal(deep(nk % 3), deep(F.lit(0))).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_size < 16 THEN -1 WHEN p_size > 16 THEN 1 WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END AS cmp FROM part")
def schema_versions(spark, d) -> DataFrame:
    v = scalars.schema_version(F.concat(F.lit("0.1."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 2).cast("string")))
    base = scalars.schema_version(F.lit("0.1.16.0"))
    return demo.table(spark, d, "part").select("p_partkey", F.when(v < base, -1).when(v > base, 1).otherwise(0).alias("cmp"))


@query("SELECT id, status, destination, CAST(0 AS BIGINT) AS generation, CAST(NULL AS VARCHAR) AS rs_id FROM buckets")
def schema_upgrade(spark, d) -> DataFrame:
    old = model.downgrade(demo.buckets(spark, d), "0.1.15.0").drop("rs_id")
    return model.upgrade(old).select("id", "status", "destination", model.generation().alias("generation"), "rs_id")


@query("SELECT event_id, 'a:' || (user_id % 3) || ',b:2' AS copied FROM events")
def map_copies(spark, d) -> DataFrame:
    m = scalars.copied(F.create_map(F.lit("a"), F.col("user_id") % 3, F.lit("b"), F.lit(2).cast("bigint")))
    return demo.table(spark, d, "events").select("event_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("copied"))


@query(f"SELECT p_partkey, {crc_sql('p_partkey')} AS bucket_id, {COUNT} AS bucket_count FROM part")
def bucket_id_alias(spark, d) -> DataFrame:
    return demo.table(spark, d, "part").select("p_partkey", hashing.bucket_id("p_partkey").alias("bucket_id"), F.lit(model.Config().bucket_count).alias("bucket_count"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '/' || c_nationkey AS key FROM cust")
def key_parts(spark, d) -> DataFrame:
    return demo.customers(spark, d).select("c_custkey", F.concat_ws("/", *hashing.key_parts(["c_custkey", "c_nationkey"])).alias("key"))


@query(f"SELECT o_orderkey, {hashing.oracle_crc('b')} % {COUNT} + 1 AS bucket_id FROM (SELECT o_orderkey, unhex('CB') || unhex(CASE WHEN o_orderkey % 2 = 0 THEN 'BF' ELSE '3F' END || 'E' || printf('%013X', CAST((2 * (0.5 + (o_orderkey % 4096) / 8192.0 + 1.0 / 1048576) - 1) * 4503599627370496 AS BIGINT))) AS b FROM orders)")
def bucket_id_fractional(spark, d) -> DataFrame:
    t = demo.table(spark, d, "orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, -1.0).otherwise(1.0)
    t = t.withColumn("key", sign * (F.lit(0.5) + (F.col("o_orderkey") % 4096) / F.lit(8192.0) + F.lit(1.0 / 1048576)))
    return t.select("o_orderkey", hashing.bucket_id_mpcrc32("key", schema=t.schema).alias("bucket_id"))


# -- scans, sinks, sources -----------------------------------------------------
@query("SELECT i AS id, 'active' AS status, 'new' AS rs_id FROM (SELECT unnest(range(3001, 5001)) AS i)")
def range_create(spark, d) -> DataFrame:
    return placement.force_create(spark, COUNT + 1, 2000, "new", demo.buckets(spark, d)).select("id", "status", "rs_id")


@query("SELECT id, status FROM buckets WHERE NOT (status = 'garbage' AND id % 2 = 0)")
def manual_drop(spark, d) -> DataFrame:
    b = demo.buckets(spark, d)
    return placement.force_drop(b, b.where("status = 'garbage' and id % 2 = 0").select("id")).select("id", "status")


@query("SELECT c_custkey, bucket_id FROM cust")
def receive_rows(spark, d) -> DataFrame:
    c = demo.customers(spark, d).select("c_custkey", "bucket_id")
    return lifecycle.receive(c.where("bucket_id % 10 != 3"), c.where("bucket_id % 10 = 3"), ["c_custkey"])


_COMING = "SELECT id, nxt AS rs_id, b.rs_id AS source, id AS seq FROM buckets b JOIN follow f ON f.rs_id = b.rs_id WHERE id % 97 = 4 OR id % 10 = 6"


def _coming(spark, d) -> DataFrame:
    names, order = demo.shards(spark, d).select("rs_id"), Window.orderBy("rs_id")
    follow = names.select("rs_id", F.coalesce(F.lead("rs_id").over(order), F.first("rs_id").over(order)).alias("next"))
    rows = demo.buckets(spark, d).where("id % 97 = 4 or id % 10 = 6").join(F.broadcast(follow), "rs_id")
    return rows.select("id", F.col("rs_id").alias("source"), F.col("next").alias("rs_id"), F.col("id").alias("seq"))


_QUOTA = f"""SELECT c.id, c.rs_id, CASE WHEN m.id IS NOT NULL THEN 'BUCKET_ALREADY_EXISTS' WHEN sum(CASE WHEN m.id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.rs_id ORDER BY c.seq, c.id ROWS UNBOUNDED PRECEDING) + coalesce(k, 0) > 60 THEN 'TOO_MANY_RECEIVING' END AS error, source
  FROM ({_COMING}) c LEFT JOIN moved m ON m.id = c.id AND m.rs_id = c.rs_id LEFT JOIN (SELECT rs_id, count(*) AS k FROM moved WHERE status = 'receiving' GROUP BY rs_id) u ON u.rs_id = c.rs_id"""


@query(f"SELECT id, rs_id, error FROM ({_QUOTA})")
def receive_quota(spark, d) -> DataFrame:
    return lifecycle.receivable(demo.moved(spark, d), _coming(spark, d), 60).select("id", "rs_id", "error")


@query(f"SELECT id, rs_id, status, destination FROM moved UNION ALL SELECT id, rs_id, 'receiving', source FROM ({_QUOTA}) WHERE error IS NULL")
def receive_begin(spark, d) -> DataFrame:
    return lifecycle.begin_receive(demo.moved(spark, d), _coming(spark, d), 60).select("id", "rs_id", "status", "destination")


@query("SELECT 'customer' AS space, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey ELSE -1 END AS c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN 'BUCKET_RECV_DATA_ERROR' END AS error FROM customer")
def raw_rows(spark, d) -> DataFrame:
    c = demo.table(spark, d, "customer")
    row = F.when(F.col("c_custkey") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("c_custkey", "c_name")))
    return lifecycle.decode(c.select(F.lit("customer").alias("space"), row.alias("row")), "c_custkey long, c_name string").fillna(-1, ["c_custkey"])


@query("SELECT id, rs_id, 'bucket_data_gc_txn' AS event FROM buckets WHERE status = 'garbage' UNION ALL SELECT id, destination, 'bucket_data_recv_txn' FROM buckets WHERE status = 'sending'")
def bucket_events(spark, d) -> DataFrame:
    b = demo.buckets(spark, d)
    after = b.where("status != 'garbage'").unionByName(demo.moved(spark, d).where("status = 'receiving'").join(b.where("status = 'sending'").select("id"), "id", "left_semi").select(*b.columns))
    return lifecycle.events(b, after, ["orders", "customer"]).select("id", "rs_id", "event")


@query("SELECT unnest(['customer', 'orders']) AS name")
def sharded_tables(spark, d) -> DataFrame:
    tables = {"customer": demo.customers(spark, d), "orders": demo.orders(spark, d), "nation": demo.table(spark, d, "nation"), "texts": demo.customers(spark, d).withColumn("bucket_id", F.col("c_name"))}
    return spark.createDataFrame([(n,) for n in engine.sharded(tables, "bucket_id")], "name string")


@query("SELECT rs_id, 'p1' AS label, count(*) AS buckets FROM buckets GROUP BY rs_id")
def recovery_points(spark, d) -> DataFrame:
    return engine.recovery_points(demo.buckets(spark, d), "p1").select("rs_id", "label", "buckets")


@query(f"SELECT rs_id, count(*) AS buckets, count(*) FILTER (status IN {_RW}) AS writable FROM buckets GROUP BY rs_id")
def bucket_counts(spark, d) -> DataFrame:
    return placement.counts(demo.buckets(spark, d))


@query("SELECT id AS bucket_id, rs_id FROM buckets WHERE status IN ('active', 'pinned')")
def discovery_loop(spark, d) -> DataFrame:
    return placement.discovered(demo.buckets(spark, d), COUNT, 700)


@query("SELECT r_name AS rs_id, CAST(r_regionkey + 1 AS DOUBLE) AS weight, r_regionkey = 2 AS lock FROM region")
def route_all(spark, d) -> DataFrame:
    s = demo.shards(spark, d).withColumn("lock", F.col("weight") == 3)
    return placement.union_of({r.rs_id: s.where(F.col("rs_id") == r.rs_id) for r in s.select("rs_id").collect()})  # a row a shard


# -- reports -------------------------------------------------------------------
@query("SELECT replica_id, CASE WHEN nk % 4 = 0 THEN 'missing' WHEN nk % 4 = 1 THEN 'unreachable' ELSE 'available' END AS status FROM replicas")
def instance_status(spark, d) -> DataFrame:
    nk = F.col("nk")
    return demo.replicas(spark, d).select("replica_id", topology.instance_info(nk % 4 != 0, nk % 4 != 1).alias("status"))


@query("SELECT f.rs_id, count(*) AS bucket_count, CAST(0 AS BIGINT) AS pinned FROM fresh f WHERE f.rs_id <> (SELECT min(rs_id) FROM shards) GROUP BY f.rs_id")
def cluster_states(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    locked = s.withColumn("lock", F.col("rs_id") == F.min("rs_id").over(Window.partitionBy()))
    return balance.states(demo.fresh(spark, d), locked, COUNT).select("rs_id", "bucket_count", "pinned")


@query("SELECT rs_id, rs_id = (SELECT min(rs_id) FROM shards) AS locked FROM shards")
def shard_locks(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    return s.select("rs_id", balance.locked(F.when(F.col("rs_id") == F.min("rs_id").over(Window.partitionBy()), True)).alias("locked"))


@query("SELECT count(*) AS ops, count(*) FILTER (event_type = 'error') AS errors, CAST(round(avg(user_id % 16) / 8 * 1000) AS BIGINT) AS mean_ms, CAST(round(count(*) / (max(event_id + user_id % 16 / 8.0) - min(event_id)) * 1000) AS BIGINT) AS per_1000_s FROM events")
def load_report(spark, d) -> DataFrame:
    log = demo.table(spark, d, "events").select(F.col("event_id").cast("double").alias("started"), (F.col("event_id") + F.col("user_id") % 16 / F.lit(8.0)).alias("ended"), (F.col("event_type") != "error").alias("ok"))
    return topology.load_report(log).select("ops", "errors", F.round(F.col("mean_latency") * 1000).cast("long").alias("mean_ms"), F.round(F.col("ops_per_s") * 1000).cast("long").alias("per_1000_s"))


_BEHIND = "(a.nk % 5 > b.nk % 5 OR a.nk % 3 > b.nk % 3)"


@query(f"SELECT a.rs_id, bool_and(NOT {_BEHIND}) AS synced FROM replicas a JOIN replicas b ON a.rs_id = b.rs_id AND NOT b.is_master WHERE a.is_master GROUP BY a.rs_id")
def cluster_synced(spark, d) -> DataFrame:
    c = demo.clocks(spark, d)
    return topology.synced(c.where("is_master").select("rs_id", "vclock"), c.where("not is_master").select("rs_id", "vclock"))


@query("""SELECT a.rs_id, a.replica_id, CASE WHEN NOT a.is_master THEN 'NON_MASTER' WHEN bool_or(b.nk % 5 > a.nk % 5 OR b.nk % 3 > a.nk % 3) THEN 'MASTER_NOT_SYNCED' END AS error
  FROM replicas a JOIN replicas b ON a.rs_id = b.rs_id AND a.replica_id <> b.replica_id GROUP BY a.rs_id, a.replica_id, a.is_master""")
def master_checkpoint(spark, d) -> DataFrame:
    return _writers(spark, d)


def _writers(spark, d) -> DataFrame:
    c = demo.clocks(spark, d)
    peers = c.join(c.select("rs_id", F.col("replica_id").alias("p"), F.col("vclock").alias("peer")), "rs_id").where("p != replica_id").select("replica_id", "vclock", "peer")  # a handful a shard
    return topology.may_write(c, peers)


_DML = "SELECT event_id AS seq, user_id * 23 % 3000 + 1 AS id, CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'readonly' END AS status FROM events"


@query(f"""SELECT id, rs_id, status FROM (SELECT coalesce(f.id, l.id) AS id, coalesce(f.rs_id, l.rs_id) AS rs_id, coalesce(l.status, f.status) AS status, f.id IS NOT NULL AS old, l.op FROM (SELECT id, rs_id, 'active' AS status FROM fresh) f
  FULL JOIN (SELECT * FROM (SELECT x.*, f.rs_id, row_number() OVER (PARTITION BY x.id ORDER BY seq DESC) AS n FROM ({_DML}) x JOIN fresh f ON f.id = x.id WHERE f.rs_id <> (SELECT min(rs_id) FROM shards)) WHERE n = 1) l ON l.id = f.id AND l.rs_id = f.rs_id) WHERE op IS DISTINCT FROM 'delete' AND (old OR op <> 'update')""")
def raw_operations(spark, d) -> DataFrame:
    return _dml(spark, d)[0].select("id", "rs_id", "status")


@query(f"SELECT seq, 'NON_MASTER' AS error FROM ({_DML}) x JOIN fresh f ON f.id = x.id WHERE f.rs_id = (SELECT min(rs_id) FROM shards)")
def raw_operations_refused(spark, d) -> DataFrame:
    return _dml(spark, d)[1]


def _dml(spark, d) -> tuple[DataFrame, DataFrame]:
    b, t = demo.fresh(spark, d), F.col("event_type")
    op = F.when(t == "view", "insert").when(t == "click", "replace").when(t == "error", "delete").otherwise("update")
    log = demo.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 23 % 3000 + 1).alias("id"), op.alias("op"), F.when(F.col("event_id") % 2 == 0, "active").otherwise("readonly").alias("status"))
    s = demo.shards(spark, d)
    writers = s.select("rs_id", F.when(F.col("rs_id") == F.min("rs_id").over(Window.partitionBy()), "NON_MASTER").alias("error"))
    return lifecycle.dml(b, log.join(F.broadcast(b.select("id", "rs_id")), "id"), writers)  # COUNT rows


@query("""SELECT rs_id, name FROM (SELECT rs_id, unnest(CASE WHEN masters = 0 THEN ['MISSING_MASTER'] ELSE [] END || CASE WHEN copies > 0 AND up = 0 THEN ['UNREACHABLE_REPLICASET'] ELSE [] END || CASE WHEN up > 0 AND up < copies THEN ['UNREACHABLE_REPLICA'] ELSE [] END
  || CASE WHEN lag >= 10 THEN ['OUT_OF_SYNC'] ELSE [] END || CASE WHEN lag >= 1 AND lag < 10 THEN ['HIGH_REPLICATION_LAG'] ELSE [] END || CASE WHEN copies = 0 THEN ['LOW_REDUNDANCY'] ELSE [] END) AS name
  FROM (SELECT rs_id, count(*) FILTER (is_master AND nk <> 0) AS masters, max(CASE WHEN NOT is_master OR nk = 0 THEN nk / 2.0 END) AS lag, count(*) FILTER (nk % 4 <> 1 AND (NOT is_master OR nk = 0)) AS up, count(*) FILTER (NOT is_master OR nk = 0) AS copies FROM replicas GROUP BY rs_id))""")
def storage_alerts(spark, d) -> DataFrame:
    return _storage_info(spark, d).select("rs_id", F.explode("alerts.name").alias("name"))


def _storage_info(spark, d) -> DataFrame:
    r = demo.replicas(spark, d).withColumn("is_master", F.col("is_master") & (F.col("nk") != 0))
    return topology.storage_info(demo.buckets(spark, d), r, r.select("replica_id", (F.col("nk") / 2.0).alias("lag"), (F.col("nk") % 4 != 1).alias("connected")))


@query("SELECT rs_id, 'MISSING_MASTER: Master is not configured' AS message FROM replicas WHERE nk = 0")
def recovery_point_alerts(spark, d) -> DataFrame:
    return topology.recovery_alerts(_storage_info(spark, d).select("rs_id", F.filter("alerts", lambda a: a["name"] != "UNREACHABLE_REPLICASET").alias("alerts")))


@query(f"""SELECT rs_id, CASE n WHEN 2 THEN 'UNREACHABLE_MASTER' WHEN 3 THEN 'UNREACHABLE_REPLICASET' END AS name FROM (SELECT rs_id, row_number() OVER (ORDER BY rs_id) AS n FROM shards) WHERE n IN (2, 3)
  UNION ALL SELECT NULL, 'UNKNOWN_BUCKETS' WHERE (SELECT count(*) FROM routes) < {COUNT}""")
def router_alerts(spark, d) -> DataFrame:
    n = F.row_number().over(Window.orderBy("rs_id"))
    up = demo.shards(spark, d).select("rs_id", (~n.isin(2, 3)).alias("master_up"), (n != 3).alias("replica_up"))
    return topology.router_alerts(topology.router_info(placement.route_map(demo.buckets(spark, d)), up, COUNT), COUNT).select("rs_id", "name")


@query("""SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 3 WHEN user_id % 5 = 0 THEN 3 WHEN user_id % 7 = 0 THEN 3 WHEN value > 30 THEN 3 WHEN event_type = 'click' THEN 3 WHEN event_type = 'error' THEN 1 ELSE 0 END AS health FROM events""")
def health_of_all_kinds(spark, d) -> DataFrame:
    u, t = F.col("user_id"), F.col("event_type")
    lag = F.when((t != "error") | (F.col("value") > 30), F.col("value"))
    colour = topology.health(F.when(u % 5 == 0, 1.5).otherwise(0.2), F.when(u % 7 == 0, 3).otherwise(0), F.when(u % 17 == 0, 1).otherwise(100), lag, F.when(t == "click", 31.0).when(t != "error", 0.5))
    return demo.table(spark, d, "events").select("event_id", colour.alias("health"))


_ROUTE_LOG = "SELECT event_id, user_id % 50 AS bucket_id, CASE WHEN event_type <> 'error' THEN 'rs' || (event_id % 3) END AS rs_id FROM events"


@query(f"SELECT rs_id, count(*) AS known FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY event_id DESC) AS n FROM ({_ROUTE_LOG})) WHERE n = 1 AND rs_id IS NOT NULL GROUP BY rs_id")
def route_cache_counts(spark, d) -> DataFrame:
    rs = F.when(F.col("event_type") != "error", F.concat(F.lit("rs"), (F.col("event_id") % 3).cast("string")))
    log = demo.table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("bucket_id"), rs.alias("rs_id"))
    return placement.route_counts(placement.route_changes(log, ["event_id"])).where("known != 0")


@query("""SELECT service, iteration, CASE WHEN max(event_id) FILTER (event_type = 'error') IS NOT NULL THEN 'error' ELSE arg_max(event_type, event_id) END AS status, arg_min('e' || event_id, event_id) FILTER (event_type = 'error') AS error,
  CAST(sum(count(*)) OVER (PARTITION BY service ORDER BY iteration) AS BIGINT) AS status_idx FROM (SELECT event_id, event_type, user_id % 3 AS service, event_id // 50 AS iteration FROM events) GROUP BY service, iteration""")
def service_status(spark, d) -> DataFrame:
    e = F.col("event_id")
    log = demo.table(spark, d, "events").select((F.col("user_id") % 3).alias("service"), F.floor(e / 50).alias("iteration"), e.alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), e.cast("string"))).alias("error"))
    return lifecycle.service_status(log)


# -- topology and configuration -------------------------------------------------
@query("SELECT replica_id, kind FROM (SELECT replica_id, 'disable' AS kind FROM replicas WHERE is_master AND nk < 3 UNION ALL SELECT replica_id, 'enable' FROM (SELECT *, row_number() OVER (PARTITION BY rs_id ORDER BY nk) AS n FROM replicas) WHERE n = 2 AND rs_id IN (SELECT rs_id FROM replicas WHERE is_master AND nk < 3))")
def master_triggers(spark, d) -> DataFrame:
    old = demo.replicas(spark, d)
    w = Window.partitionBy("rs_id")
    n = F.row_number().over(w.orderBy("nk"))
    new = old.withColumn("n", n).withColumn("is_master", F.when(F.min("nk").over(w) < 3, F.col("n") == 2).otherwise(F.col("is_master")))
    return topology.master_changes(old, new)


@query("SELECT replica_id, rs_id, CASE WHEN rs_id = (SELECT max(rs_id) FROM shards) THEN 'auto' WHEN is_master THEN 'master' ELSE 'replica' END AS role, rs_id <> (SELECT max(rs_id) FROM shards) AND NOT is_master AS read_only, rs_id = (SELECT min(rs_id) FROM shards) AS locked, rs_id <> (SELECT max(rs_id) FROM shards) AND is_master AS collects_garbage FROM replicas")
def storage_configuration(spark, d) -> DataFrame:
    s, whole = demo.shards(spark, d), Window.partitionBy()
    sets = s.select("rs_id", F.when(F.col("rs_id") == F.min("rs_id").over(whole), True).alias("lock"), F.when(F.col("rs_id") == F.max("rs_id").over(whole), "auto").alias("master_mode"))
    return topology.storages(sets, demo.replicas(spark, d)).drop("recovers")


@query("SELECT 'several masters' AS error, rs_id AS subject FROM replicas GROUP BY rs_id HAVING count(*) FILTER (is_master OR nk % 7 = 3) > 1 UNION ALL SELECT 'bad weight', rs_id FROM shards WHERE weight = 2 UNION ALL SELECT 'duplicate uri', 'same' WHERE (SELECT count(*) FROM replicas WHERE nk % 11 = 5) > 1")
def topology_problems(spark, d) -> DataFrame:
    r = demo.replicas(spark, d).withColumn("is_master", F.col("is_master") | (F.col("nk") % 7 == 3)).withColumn("uri", F.when(F.col("nk") % 11 == 5, "same").otherwise(F.col("uri")))
    return model.topology_errors(demo.shards(spark, d).withColumn("weight", F.when(F.col("weight") == 2, -1.0).otherwise(F.col("weight"))), r)


@query("""SELECT unnest(['bucket_count', 'discovery_mode', 'failover_ping_timeout', 'rebalancer_max_sending', 'shard_index', 'sync_timeout']) AS option, unnest(['bucket_count must be a positive number', 'unknown discovery or rebalancer mode', 'failover_ping_timeout must be a positive number', 'rebalancer_max_sending must not exceed 15', 'shard_index must be a name', 'sync_timeout must be a non-negative number']) AS error""")
def config_errors(spark, d) -> DataFrame:
    wrong = {"bucket_count": 0, "discovery_mode": "sometimes", "failover_ping_timeout": 0, "rebalancer_max_sending": 16, "shard_index": "", "sync_timeout": -1}
    return spark.createDataFrame([(k, model.Config.problem({k: v})) for k, v in wrong.items()], "option string, error string")


@query("SELECT unnest(['bucket_count', 'listen', 'memory', 'zone']) AS option, unnest([true, false, false, true]) AS own")
def config_split(spark, d) -> DataFrame:
    own, rest = model.Config.from_dict({"bucket_count": 10, "zone": "a", "listen": 3301, "memory": 1})
    names = [(n, True) for n in ("bucket_count", "zone") if getattr(own, n) is not None] + [(n, False) for n in rest]
    return spark.createDataFrame(names, "option string, own boolean")


@query("SELECT replica_id, uri, CASE WHEN nk % 3 = 0 THEN nk ELSE 0 END AS fails, CAST(CASE WHEN nk % 3 = 0 THEN 2.0 ELSE 0.5 END AS DOUBLE) AS timeout FROM replicas")
def topology_rebind(spark, d) -> DataFrame:
    r = demo.replicas(spark, d).select("replica_id", "uri", "nk")
    old = r.select("replica_id", F.when(F.col("nk") % 3 == 0, F.col("uri")).otherwise("elsewhere").alias("uri"), F.col("nk").alias("fails"), F.lit(1).alias("oks"), F.lit(2.0).alias("timeout"))
    return topology.rebind(r.drop("nk"), old).select("replica_id", "uri", "fails", "timeout")


@query("SELECT replica_id, nk % 3 = 0 AS outdated FROM replicas")
def topology_outdated(spark, d) -> DataFrame:
    r = demo.replicas(spark, d)
    return topology.outdated(r, r.where("nk % 3 != 0")).select("replica_id", "outdated")


@query("SELECT id, rs_id FROM buckets WHERE rs_id <> (SELECT max(rs_id) FROM shards)")
def router_survivors(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    kept = s.withColumn("last", F.max("rs_id").over(Window.partitionBy())).where("rs_id != last").drop("last")
    e = engine.Engine(spark, model.Config(bucket_count=COUNT), demo.buckets(spark, d), s, name=None)
    e.reconfigure(model.Config(bucket_count=COUNT), kept)
    return e.buckets.select("id", "rs_id")


@query("SELECT unnest(['discovery', 'failover', 'gc', 'master_search', 'master_sync', 'rebalancer', 'rebalancer_applier', 'recovery']) AS service, unnest([false, true, true, true, true, false, true, true]) AS runs")
def background_services(spark, d) -> DataFrame:
    return spark.createDataFrame(sorted(topology.services({"discovery": "off", "rebalancer": "off"}, True, True).items()), "service string, runs boolean")


@query("SELECT a AS zone, b AS other, CAST(w AS DOUBLE) AS weight FROM (VALUES ('1', '0', 2.0), ('1', '1', 0.0), ('2', '1', 5.0), ('2', '2', 0.0)) t(a, b, w)")
def zone_weights(spark, d) -> DataFrame:
    return spark.createDataFrame(topology.zone_rows(model.Config(weights={"1": {"0": 2.0}, "2": {"1": 5.0}}).check().weights), "zone string, other string, weight double")


# -- calls ---------------------------------------------------------------------
def _hop(n: int, last: bool) -> str:
    """One hop as SQL: looks the bucket up on the shard, and goes on where that's possible."""
    go = "CAST(0 AS BOOLEAN)" if last else "NOT done AND (again OR coalesce(nxt <> rs_id, false))"
    return f"""h{n} AS (SELECT id, mode, real, CASE WHEN {go} AND NOT again THEN nxt ELSE rs_id END AS rs_id, hops + CAST({go} AS INT) AS hops, CASE WHEN done OR ({go}) THEN error ELSE code END AS error,
      done OR NOT ({go}) AS done, renewed OR (again AND ({go})) AS renewed
    FROM (SELECT *, CASE WHEN code IN ('WRONG_BUCKET', 'TRANSFER_IS_IN_PROGRESS') THEN coalesce(destination, real) END AS nxt, coalesce(code = 'NON_MASTER' AND NOT renewed, false) AS again
      FROM (SELECT p.*, m.destination, CASE WHEN p.rs_id IS NULL THEN 'NO_ROUTE_TO_BUCKET' WHEN m.status IS NULL THEN 'WRONG_BUCKET' WHEN mode = 'read' AND m.status NOT IN {_RO} THEN 'WRONG_BUCKET'
        WHEN mode = 'write' AND m.status IN ('sending', 'receiving', 'readonly') THEN 'TRANSFER_IS_IN_PROGRESS' WHEN mode = 'write' AND m.status NOT IN {_RW} THEN 'WRONG_BUCKET'
        WHEN mode = 'write' AND NOT (renewed OR p.rs_id <> (SELECT min(rs_id) FROM shards)) THEN 'NON_MASTER' END AS code
      FROM h{n - 1} p LEFT JOIN moved m ON m.id = p.id AND m.rs_id = p.rs_id)))"""


@query(f"""SELECT * FROM (WITH live AS (SELECT id, arg_max(rs_id, (CASE WHEN status IN {_RW} THEN 1 ELSE 0 END, gen, rs_id)) AS real FROM moved WHERE status IN {_RO} GROUP BY id),
  h0 AS (SELECT i AS id, mode, real, coalesce(CASE WHEN i % 10 <> 9 THEN f.rs_id END, real) AS rs_id, 0 AS hops, CAST(NULL AS VARCHAR) AS error, false AS done, false AS renewed
    FROM (SELECT unnest(range(1, {COUNT + 1})) AS i) CROSS JOIN (SELECT unnest(['read', 'write']) AS mode) LEFT JOIN live ON live.id = i LEFT JOIN fresh f ON f.id = i),
  {", ".join(_hop(n, n == calls.HOPS) for n in range(1, calls.HOPS + 1))}
  SELECT event_id, q.bucket_id, q.mode, rs_id, hops, error FROM requests q JOIN h{calls.HOPS} h ON h.id = q.bucket_id AND h.mode = q.mode) WHERE (SELECT count(*) FROM shards) > 0 AND (SELECT count(*) FROM moved) > 0 AND (SELECT count(*) FROM fresh) > 0""")
def call_reroute(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    masters = s.select("rs_id", (F.col("rs_id") != F.min("rs_id").over(Window.partitionBy())).alias("is_master"), F.lit(True).alias("found"))
    cache = demo.fresh(spark, d).where("id % 10 != 9").select(F.col("id").alias("bucket_id"), "rs_id")
    got = calls.serve(demo.requests(spark, d), cache, demo.moved(spark, d), COUNT, masters)
    return got.select("event_id", "bucket_id", "mode", "rs_id", "hops", "error")


_KIND = "CASE event_id % 5 WHEN 0 THEN 'callrw' WHEN 1 THEN 'callro' WHEN 2 THEN 'callbro' WHEN 3 THEN 'callre' ELSE 'callbre' END"


@query(f"""SELECT event_id, q.rs_id, q.kind, replica_id FROM (SELECT event_id, rs_id, {_KIND} AS kind, row_number() OVER (PARTITION BY rs_id, {_KIND} ORDER BY event_id) AS n FROM requests JOIN routes USING (bucket_id)) q
  JOIN (SELECT rs_id, k AS kind, replica_id, row_number() OVER (PARTITION BY rs_id, k ORDER BY priority) AS pos, count(*) OVER (PARTITION BY rs_id, k) AS size
    FROM (SELECT *, nk % 4 <> 1 AS up, count(*) FILTER (nk % 4 <> 1) OVER (PARTITION BY rs_id) AS live, count(*) FILTER (nk % 4 <> 1 AND NOT is_master) OVER (PARTITION BY rs_id) AS others FROM prio) p, (SELECT unnest(['callrw', 'callro', 'callbro', 'callre', 'callbre']) AS k)
    WHERE CASE WHEN k = 'callrw' THEN is_master WHEN k IN ('callro', 'callbro') OR others = 0 THEN up OR (live = 0 AND priority = 1) ELSE up AND NOT is_master END) c
  ON c.rs_id = q.rs_id AND c.kind = q.kind AND c.pos = CASE WHEN q.kind IN ('callbro', 'callbre') THEN (q.n - 1) % c.size + 1 ELSE 1 END""")
def call_replicas(spark, d) -> DataFrame:
    e = F.col("event_id") % 5
    kind = F.when(e == 0, "callrw").when(e == 1, "callro").when(e == 2, "callbro").when(e == 3, "callre").otherwise("callbre")
    rows = demo.requests(spark, d).join(placement.small(placement.route_map(demo.buckets(spark, d)), COUNT), "bucket_id").select("event_id", "rs_id", kind.alias("kind"))
    return calls.pick_replica(rows, _priorities(spark, d), ["event_id"], F.col("nk") % 4 != 1).select("event_id", "rs_id", "kind", "replica_id")


@query(f"SELECT 'buckets_count' AS name, CAST(count(*) AS VARCHAR) AS result FROM buckets UNION ALL SELECT 'sharded_tables', 'customer,orders' UNION ALL SELECT 'bucket_count', '{COUNT}' UNION ALL SELECT 'test', 'NO_SUCH_PROC'")
def service_calls(spark, d) -> DataFrame:
    e = engine.Engine(spark, model.Config(bucket_count=COUNT), demo.buckets(spark, d), name=None)
    for name, t in (("customer", demo.customers(spark, d)), ("orders", demo.orders(spark, d))):
        e.register(name, t)
    told = {"buckets_count": str(e.service("buckets_count")), "sharded_tables": ",".join(e.service("sharded_tables")), "bucket_count": str(e.service("bucket_count"))}
    try:
        e.service("test")
    except model.BucketError as error:
        told["test"] = error.name
    return spark.createDataFrame(sorted(told.items()), "name string, result string")


@query("SELECT bucket_id, count(*) AS n FROM cust WHERE bucket_id IN (6, 7, 8, 700) GROUP BY bucket_id UNION ALL SELECT i, 0 FROM (SELECT unnest([6, 7, 8, 700]) AS i) WHERE i NOT IN (SELECT bucket_id FROM cust)")
def call_futures(spark, d) -> DataFrame:
    e = engine.Engine(spark, model.Config(bucket_count=COUNT), demo.fresh(spark, d), name=None)
    e.register("customer", demo.customers(spark, d))
    asked = {b: e.call_async(b, "read", lambda t: t["customer"].count()) for b in (6, 7, 8, 700)}
    return spark.createDataFrame([(b, f.result(600)) for b, f in asked.items()], "bucket_id long, n long")


@query("SELECT rs_id, (bucket_id - 1) // 100 AS chunk, string_agg(CAST(bucket_id AS VARCHAR), ',' ORDER BY bucket_id) AS ids FROM (SELECT DISTINCT bucket_id FROM ord) JOIN routes USING (bucket_id) GROUP BY ALL")
def buckets_group_chunks(spark, d) -> DataFrame:
    got = placement.group(demo.orders(spark, d), placement.route_map(demo.buckets(spark, d)), 100)
    return got.select("rs_id", "chunk", F.array_join(F.col("bucket_ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT rs_id, (bucket_id - 1) // 500 AS chunk, string_agg(bucket_id || ':' || bucket_id * 10, ',' ORDER BY bucket_id) AS args FROM (SELECT * FROM routes WHERE bucket_id % 20 = 1) GROUP BY ALL")
def split_args_chunks(spark, d) -> DataFrame:
    args = spark.range(1, COUNT + 1).where("id % 20 = 1").select(F.col("id").alias("bucket_id"), (F.col("id") * 10).alias("args"))
    text = F.transform(F.map_entries("args"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return mapreduce.split_args(args, demo.buckets(spark, d), 500).select("rs_id", "chunk", F.array_join(text, ",").alias("args"))


@query("""SELECT f.rs_id, NOT bool_and(m.id IS NULL) AS made, coalesce(string_agg(CASE WHEN m.id IS NULL THEN CAST(f.id AS VARCHAR) END, ',' ORDER BY f.id), '') AS moved
  FROM fresh f LEFT JOIN (SELECT * FROM moved WHERE status IN ('active', 'pinned')) m ON m.id = f.id AND m.rs_id = f.rs_id WHERE f.id % 50 < 4 GROUP BY f.rs_id""")
def map_references(spark, d) -> DataFrame:
    cache = demo.fresh(spark, d).select(F.col("id").alias("bucket_id"), "rs_id")
    got = mapreduce.referenced(cache.where("bucket_id % 50 < 4"), cache, demo.moved(spark, d))
    return got.select("rs_id", "made", F.array_join(F.transform("moved", lambda x: x.cast("string")), ",").alias("moved"))


# -- background ------------------------------------------------------------------
@query("""SELECT * FROM (WITH RECURSIVE p AS (SELECT rs_id, nk, priority, count(*) OVER (PARTITION BY rs_id) AS places FROM prio),
  e AS (SELECT p.rs_id, event_id, epoch(ts) AS now, p.priority AS place, event_type NOT IN ('error', 'click') AS well, places, row_number() OVER (PARTITION BY p.rs_id ORDER BY event_id) AS n FROM events JOIN p ON p.nk = user_id % 25),
  f AS (SELECT DISTINCT rs_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS ill, CAST(1 AS BIGINT) AS here, CAST(NULL AS DOUBLE) AS up FROM e
    UNION ALL SELECT rs_id, n, event_id, ill, CASE WHEN list_contains(ill, h1) AND h1 < places THEN h1 + 1 ELSE h1 END, CASE WHEN due AND here = 1 AND NOT list_contains(ill, 1) THEN now ELSE up END
    FROM (SELECT *, CASE WHEN due AND here > 1 THEN coalesce(list_min(list_filter(range(1, here), lambda x: NOT list_contains(ill, x))), here) ELSE here END AS h1
      FROM (SELECT e.rs_id, e.n, e.event_id, e.now, e.places, f.here, f.up, f.up IS NULL OR e.now - f.up >= 20000 AS due,
          CASE WHEN e.well THEN list_filter(f.ill, lambda x: x <> e.place) WHEN list_contains(f.ill, e.place) THEN f.ill ELSE list_append(f.ill, e.place) END AS ill FROM f JOIN e ON e.rs_id = f.rs_id AND e.n = f.n + 1)))
  SELECT rs_id, event_id, here AS place FROM f WHERE n > 0)""")
def failover_moves(spark, d) -> DataFrame:
    p = _priorities(spark, d)
    places = p.select("nk", "rs_id", F.col("priority").cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy("rs_id")).alias("places"))
    e = demo.table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), (~F.col("event_type").isin("error", "click")).alias("healthy"), (F.col("user_id") % 25).alias("nk"))
    return background.failovers(e.join(F.broadcast(places), "nk").select("rs_id", "event_id", "now", "place", "healthy", "places"), 20000)  # a row a replica


@query("""WITH RECURSIVE e AS (SELECT user_id % 10 AS owner, event_id, epoch(ts) AS now, CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 1 END AS wake, CASE WHEN event_type = 'error' THEN user_id % 2 + 1 END AS fails, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS fails, CAST([0, 0] AS DOUBLE[]) AS due, [false, false] AS ran FROM e
    UNION ALL SELECT owner, n, event_id, fails, list_transform([1, 2], lambda k: CASE WHEN NOT ran[k] THEN due[k] WHEN fails = k THEN 0 ELSE now + [40000.0, 90000.0][k] END), ran
    FROM (SELECT *, list_transform([1, 2], lambda k: now >= due[k]) AS ran FROM (SELECT e.owner, e.n, e.event_id, e.now, e.fails, list_transform([1, 2], lambda k: CASE WHEN e.wake = k THEN 0 ELSE f.due[k] END) AS due FROM f JOIN e ON e.owner = f.owner AND e.n = f.n + 1)))
  SELECT owner, event_id, ['failover', 'recovery'][k] AS service, fails IS DISTINCT FROM k AS ok FROM (SELECT *, unnest([1, 2]) AS k FROM f WHERE n > 0) WHERE ran[k]""")
def service_runs(spark, d) -> DataFrame:
    t, names = F.col("event_type"), F.array(F.lit("failover"), F.lit("recovery"))
    wake = F.when(t == "click", "recovery").when(t == "view", "failover")
    fails = F.when(t == "error", F.element_at(names, (F.col("user_id") % 2 + 1).cast("int")))
    rows = demo.table(spark, d, "events").select((F.col("user_id") % 10).alias("owner"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), wake.alias("wake"), fails.alias("fails"))
    return background.worker_runs(rows, {"failover": 40000, "recovery": 90000})


@query("""SELECT user_id % 25 AS replica_id, coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'error')) = 'signup', false) AS connected, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS requests,
  coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'error')) = 'signup', false) AND (SELECT max(event_id) FROM events) - max(event_id) FILTER (event_type <> 'error') >= 20 AS stale FROM events GROUP BY 1""")
def connection_states(spark, d) -> DataFrame:
    t, e = F.col("event_type"), demo.table(spark, d, "events")
    log = e.select((F.col("user_id") % 25).alias("replica_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.when(t == "signup", "connect").when(t == "error", "disconnect").otherwise("request").alias("event"))
    return topology.connections(log, F.lit(e.agg(F.max("event_id")).first()[0]), 20)


@query("SELECT n.id, n.rs_id, o_n FROM (SELECT replica_id AS id, rs_id FROM replicas WHERE nk IN (3, 7)) n JOIN (SELECT rs_id, count(*) AS o_n FROM cust JOIN routes USING (bucket_id) GROUP BY rs_id) c ON c.rs_id = n.rs_id")
def replica_calls(spark, d) -> DataFrame:
    r = demo.replicas(spark, d)
    e = engine.Engine(spark, model.Config(bucket_count=COUNT), demo.buckets(spark, d), demo.shards(spark, d), r, name=None)
    e.register("customer", demo.customers(spark, d))
    rows = [(x.replica_id, x.rs_id, e.replica_call(x.replica_id, lambda t: t["customer"].count())) for x in r.where("nk in (3, 7)").collect()]
    return spark.createDataFrame(rows, "id string, rs_id string, o_n long")


# -- transfers and plans ---------------------------------------------------------
_TRANSFERS = "SELECT event_id AS seq, user_id % 50 AS id, CASE WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'end' END AS op FROM events"


def _transfers(spark, d) -> tuple[DataFrame, DataFrame]:
    op = F.when(F.col("event_type").isin("view", "click"), "start").otherwise("end")
    return lifecycle.transfers(demo.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("id"), op.alias("op")))


@query(f"SELECT id FROM (SELECT id, arg_max(op, seq) AS op FROM ({_TRANSFERS}) GROUP BY id) WHERE op = 'start'")
def transfer_registry(spark, d) -> DataFrame:
    return _transfers(spark, d)[0]


@query(f"SELECT id, seq, op FROM (SELECT *, coalesce(lag(op) OVER (PARTITION BY id ORDER BY seq), 'end') AS before FROM ({_TRANSFERS})) WHERE op = before")
def transfer_errors(spark, d) -> DataFrame:
    return _transfers(spark, d)[1].select("id", "seq", "op")


_WAYS = "SELECT a.r_name AS src, b.r_name AS dst, 10 * (a.r_regionkey + 1) AS cnt, a.r_regionkey * 5 + b.r_regionkey AS k FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey"


@query(f"""SELECT src, dst, CASE WHEN count(*) FILTER (ev = 'skip') > 0 THEN 0 ELSE greatest(cnt - count(*) FILTER (ev = 'pop') + count(*) FILTER (ev = 'put'), 0) END AS left,
  count(*) FILTER (ev = 'sent') AS sent, count(*) FILTER (ev = 'throttle') > 0 AS throttled, count(*) FILTER (ev = 'sent') >= cnt AS finished
  FROM ({_WAYS}) w LEFT JOIN (SELECT user_id % 25 AS k, CASE WHEN event_id % 997 = 1 THEN 'skip' WHEN event_id % 499 = 2 THEN 'throttle' WHEN event_id % 5 = 0 THEN 'put' WHEN event_id % 2 = 0 THEN 'pop' ELSE 'sent' END AS ev FROM events) e ON e.k = w.k GROUP BY src, dst, cnt""")
def dispenser_corrections(spark, d) -> DataFrame:
    r, e = demo.table(spark, d, "region"), F.col("event_id")
    a, b = (r.select(F.col("r_name").alias(n), F.col("r_regionkey").alias(k)) for n, k in (("src", "ka"), ("dst", "kb")))
    ways = a.join(F.broadcast(b), F.col("ka") != F.col("kb")).select("src", "dst", (10 * (F.col("ka") + 1)).cast("long").alias("count"), (F.col("ka") * 5 + F.col("kb")).alias("k"))  # shards by shards
    event = F.when(e % 997 == 1, "skip").when(e % 499 == 2, "throttle").when(e % 5 == 0, "put").when(e % 2 == 0, "pop").otherwise("sent")
    log = demo.table(spark, d, "events").select((F.col("user_id") % 25).alias("k"), event.alias("event")).join(F.broadcast(ways.select("src", "dst", "k")), "k")
    return balance.corrected(ways.drop("k"), log)


@query("SELECT rs_id AS src, CAST(ceil(n / 4.0) AS BIGINT) AS batch, count(*) AS prepared, min(id) AS first, max(id) AS last FROM (SELECT rs_id, id, row_number() OVER (PARTITION BY rs_id ORDER BY id) AS n FROM fresh) GROUP BY ALL")
def batch_handoff(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("rs_id").orderBy("id"))
    return balance.handoffs(demo.fresh(spark, d).select(F.col("rs_id").alias("src"), F.ceil(n / F.lit(4)).alias("batch"), F.col("id").alias("bucket_id")))


@query("SELECT event_id, CASE WHEN 100 - user_id + event_id % 7 - 3 >= 0 THEN least(100 - user_id + event_id % 7 - 3, 100) ELSE -1 END AS quota FROM events")
def receiving_quota(spark, d) -> DataFrame:
    return demo.table(spark, d, "events").select("event_id", F.coalesce(balance.quota(F.col("user_id"), F.col("event_id") % 7 - 3), F.lit(-1)).alias("quota"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def heap_top(spark, d) -> DataFrame:
    return balance.first_of(demo.table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id % 10 AS queue, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events")
def fifo_order(spark, d) -> DataFrame:
    return calls.numbered(demo.table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("queue")), ["queue"], ["event_id"]).select("event_id", "queue", "n")


@query("SELECT event_id, bucket_id, CAST(sum(CASE WHEN mode = 'read' THEN delta ELSE 0 END) OVER w AS BIGINT) AS ro, CAST(sum(CASE WHEN mode = 'write' THEN delta ELSE 0 END) OVER w AS BIGINT) AS rw FROM (SELECT event_id, bucket_id, mode, CASE WHEN row_number() OVER (PARTITION BY bucket_id, mode ORDER BY event_id) % 3 = 0 THEN -1 ELSE 1 END AS delta FROM (SELECT event_id, user_id % 50 AS bucket_id, mode FROM requests)) WINDOW w AS (PARTITION BY bucket_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_ref_counters(spark, d) -> DataFrame:
    """The counters as a stream keeps them: files are read by triggers, and rows of all triggers are told."""
    from bucketlane.streaming import state

    rows = _log(spark, d).select("bucket_id", "event_id", F.when(F.col("delta") > 0, "ref").otherwise("unref").alias("op"), "mode", F.lit("active").alias("status"))
    return state.replayed(rows, "event_id", state.ref_counters, triggers=3).select("event_id", "bucket_id", "ro", "rw")
