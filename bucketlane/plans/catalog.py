"""The registry of the engine's own queries and their SQL twins. Each runs over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bucketlane import engine
from bucketlane.functions import hashing, scalars
from bucketlane.operators import balance, lifecycle, mapreduce, placement, topology
from bucketlane.sources import demo
from bucketlane.sources.demo import COUNT, crc_sql, sql
from bucketlane.streaming import state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = sql(oracle)
        return fn

    return add


def _money(c) -> F.Column:
    return F.sum(F.round(F.col(c) * 100).cast("long")).alias("cents")


_CENTS = "CAST(sum(CAST(round({} * 100) AS BIGINT)) AS BIGINT) AS cents"


# -- hashing ---------------------------------------------------------------
@query(f"SELECT o_orderkey, {crc_sql('o_orderkey')} AS bucket_id FROM orders")
def bucket_id_strcrc32(spark, d) -> DataFrame:
    return demo.table(spark, d, "orders").select("o_orderkey", hashing.bucket_id_strcrc32("o_orderkey").alias("bucket_id"))


_PACK = """unhex(CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 256 THEN 'CC' || printf('%02X', o_orderkey)
  WHEN o_orderkey < 65536 THEN 'CD' || printf('%04X', o_orderkey) ELSE 'CE' || printf('%08X', o_orderkey) END)"""


@query(f"SELECT o_orderkey, {hashing.oracle_crc('b')} % {COUNT} + 1 AS bucket_id FROM (SELECT o_orderkey, {_PACK} AS b FROM orders)")
def bucket_id_mpcrc32(spark, d) -> DataFrame:
    t = demo.table(spark, d, "orders")
    return t.select("o_orderkey", hashing.bucket_id_mpcrc32("o_orderkey", schema=t.schema).alias("bucket_id"))


@query(f"SELECT bucket_id, count(*) AS n FROM (SELECT {hashing.oracle_crc('''encode(CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR))''')} % {COUNT} + 1 AS bucket_id FROM lineitem) GROUP BY bucket_id")
def bucket_id_composite(spark, d) -> DataFrame:
    t = demo.table(spark, d, "lineitem").select(hashing.bucket_id_strcrc32("l_orderkey", "l_linenumber").alias("bucket_id"))
    return t.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))


# -- placement -------------------------------------------------------------
@query("SELECT rs_id, etalon, first, last FROM ranges")
def bootstrap_ranges(spark, d) -> DataFrame:
    return placement.ranges(demo.shards(spark, d), COUNT)


@query("SELECT rs_id, etalon FROM etalon")
def etalon_balance(spark, d) -> DataFrame:
    return balance.etalon_unpinned(demo.shards(spark, d), COUNT).select("rs_id", "etalon")


@query("""SELECT rs_id, CAST(CASE WHEN rs_id = (SELECT min(rs_id) FROM shards) THEN 900 ELSE up - CASE WHEN cut AND n <= s - 2100 THEN 1 ELSE 0 END END AS BIGINT) AS etalon
  FROM (SELECT *, row_number() OVER (PARTITION BY rs_id = (SELECT min(rs_id) FROM shards), cut ORDER BY rs_id) AS n, sum(CASE WHEN rs_id = (SELECT min(rs_id) FROM shards) THEN 0 ELSE up END) OVER () AS s
  FROM (SELECT rs_id, ceil(weight * (2100 / w)) AS up, weight * (2100 / w) <> floor(weight * (2100 / w)) AS cut
  FROM shards, (SELECT sum(weight) AS w FROM shards WHERE rs_id <> (SELECT min(rs_id) FROM shards))))""")
def etalon_pinned(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    first = F.min("rs_id").over(Window.partitionBy())
    return balance.etalon(s.withColumn("pinned", F.when(F.col("rs_id") == first, 900).otherwise(0)), COUNT).select("rs_id", "etalon")


@query("SELECT c_custkey, c.bucket_id, rs_id, CASE WHEN rs_id IS NULL THEN 'NO_ROUTE_TO_BUCKET' END AS error FROM cust c LEFT JOIN routes r ON r.bucket_id = c.bucket_id")
def route_lookup(spark, d) -> DataFrame:
    rows = demo.customers(spark, d).select("c_custkey", "bucket_id")
    return placement.resolve(rows, placement.route_map(demo.buckets(spark, d)), COUNT).select("c_custkey", "bucket_id", "rs_id", "error")


@query("SELECT rs_id, string_agg(CAST(bucket_id AS VARCHAR), ',' ORDER BY bucket_id) AS ids FROM (SELECT DISTINCT bucket_id FROM ord) JOIN routes USING (bucket_id) GROUP BY rs_id")
def buckets_group(spark, d) -> DataFrame:
    got = placement.group(demo.orders(spark, d), placement.route_map(demo.buckets(spark, d)))
    return got.select("rs_id", F.array_join(F.col("bucket_ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT id, CASE WHEN n = 1000 THEN last + 1 END AS next_from FROM (SELECT id, status, count(*) OVER () AS n, max(id) OVER () AS last FROM (SELECT * FROM buckets WHERE id >= 501 ORDER BY id LIMIT 1000)) WHERE status IN ('active', 'pinned')")
def discovery_page(spark, d) -> DataFrame:
    return placement.discovery_page(demo.buckets(spark, d), 501)


@query("SELECT status, id FROM buckets WHERE status IN ('active', 'pinned')")
def discovery_full(spark, d) -> DataFrame:
    return placement.discovery(demo.buckets(spark, d))


@query(f"SELECT i AS bucket_id, rs_id, CASE WHEN rs_id IS NULL THEN 'unknown' ELSE 'available_rw' END AS status FROM (SELECT unnest(range(2501, {COUNT + 1})) AS i) LEFT JOIN routes ON bucket_id = i")
def buckets_info_page(spark, d) -> DataFrame:
    return placement.routes_page(spark, placement.route_map(demo.buckets(spark, d)), COUNT, 2500, 1000)


@query("SELECT id, rs_id, status, destination, gen AS generation, status NOT IN ('active', 'pinned') AS rw_lock, status NOT IN ('active', 'pinned', 'sending', 'readonly') AS ro_lock FROM buckets")
def storage_buckets_info(spark, d) -> DataFrame:
    return placement.buckets_info(demo.buckets(spark, d)).drop("ref_ro", "ref_rw")


@query("""SELECT event_id, mode, b.rs_id, CASE WHEN status IS NULL THEN 'WRONG_BUCKET' WHEN mode = 'read' THEN CASE WHEN status NOT IN ('active', 'pinned', 'sending', 'readonly') THEN 'WRONG_BUCKET' END
  WHEN status IN ('active', 'pinned') THEN CASE WHEN b.rs_id = (SELECT min(rs_id) FROM shards) THEN 'NON_MASTER' END WHEN status IN ('sending', 'receiving', 'readonly') THEN 'TRANSFER_IS_IN_PROGRESS' ELSE 'WRONG_BUCKET' END AS code,
  CASE WHEN (mode = 'read' AND status NOT IN ('active', 'pinned', 'sending', 'readonly')) OR (mode = 'write' AND status NOT IN ('active', 'pinned')) THEN destination END AS destination
  FROM requests q LEFT JOIN buckets b ON b.id = q.bucket_id""")
def access_check(spark, d) -> DataFrame:
    s = demo.shards(spark, d)
    masters = s.select("rs_id", (F.col("rs_id") != F.min("rs_id").over(Window.partitionBy())).alias("is_master"))
    got = placement.check_access(demo.requests(spark, d), demo.buckets(spark, d), COUNT, masters)
    return got.select("event_id", "mode", "rs_id", F.col("error.code").alias("code"), F.col("error.destination").alias("destination"))


@query("SELECT q.id, destination AS dst, status FROM (SELECT DISTINCT event_id % 4000 + 1 AS id FROM events) q LEFT JOIN buckets b ON b.id = q.id WHERE status IS NULL OR status IN ('sent', 'garbage')")
def moved_buckets(spark, d) -> DataFrame:
    ids = demo.table(spark, d, "events").select((F.col("event_id") % 4000 + 1).alias("id"))
    return placement.moved(ids, demo.buckets(spark, d))


def _refs(spark, d) -> tuple[DataFrame, DataFrame]:
    ids = spark.range(1, COUNT + 1)
    return ids.select("id", F.when(F.col("id") % 11 == 0, 1).otherwise(0).alias("ro"), F.when(F.col("id") % 13 == 0, 1).otherwise(0).alias("rw")), ids.where("id % 29 = 0")


@query("SELECT id FROM buckets WHERE status IN ('garbage', 'sent') AND id % 11 <> 0 AND id % 29 <> 0")
def gc_eligible(spark, d) -> DataFrame:
    b, (refs, moving) = demo.buckets(spark, d), _refs(spark, d)
    ids = b.where("status in ('garbage', 'sent')").select("id")
    return ids.join(placement.not_collectable(ids, b, refs, moving), "id", "left_anti")


@query("SELECT id, rs_id, CASE WHEN status = 'sent' AND id % 11 <> 0 AND id % 29 <> 0 THEN 'garbage' ELSE status END AS status FROM buckets")
def promote_sent(spark, d) -> DataFrame:
    b, (refs, moving) = demo.buckets(spark, d), _refs(spark, d)
    no = placement.not_collectable(b.where("status = 'sent'").select("id"), b, refs, moving)
    return lifecycle.promote_sent(b, no).select("id", "rs_id", "status")


@query("SELECT rs_id, bool_and(status IN ('active', 'pinned')) AS all_rw FROM buckets GROUP BY rs_id")
def all_writable(spark, d) -> DataFrame:
    return placement.all_writable(demo.buckets(spark, d))


@query("SELECT o_orderkey, bucket_id FROM ord WHERE bucket_id NOT IN (SELECT id FROM buckets WHERE status <> 'garbage')")
def consistency_check(spark, d) -> DataFrame:
    return placement.inconsistent(demo.orders(spark, d), demo.buckets(spark, d).where("status != 'garbage'")).select("o_orderkey", "bucket_id")


# -- calls and map-reduce --------------------------------------------------
_LITERAL = hashing.literal_bucket_id(1)


@query(f"SELECT 'customer' AS space, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM cust WHERE bucket_id = {_LITERAL} UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM ord WHERE bucket_id = {_LITERAL}")
def bucket_collect(spark, d) -> DataFrame:
    rows = engine.bucket_collect({"customer": demo.customers(spark, d), "orders": demo.orders(spark, d)}, _LITERAL)
    key = F.get_json_object("row", "$.c_custkey").cast("long"), F.get_json_object("row", "$.o_orderkey").cast("long")
    return rows.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(*key)).alias("keys"))


@query(f"SELECT rs_id, count(*) AS n, {_CENTS.format('o_totalprice')} FROM ord JOIN fresh ON id = bucket_id GROUP BY rs_id")
def map_reduce_full(spark, d) -> DataFrame:
    return mapreduce.aggregate(demo.orders(spark, d), demo.fresh(spark, d), COUNT, F.count(F.lit(1)).alias("n"), _money("o_totalprice"))


@query(f"SELECT rs_id, count(*) AS n, {_CENTS.format('o_totalprice')} FROM ord JOIN routes USING (bucket_id) WHERE rs_id IN (SELECT rs_id FROM routes WHERE bucket_id IN (1, 2, 700, 701)) GROUP BY rs_id")
def map_reduce_by_buckets(spark, d) -> DataFrame:
    ids = spark.createDataFrame([(b,) for b in (1, 2, 700, 701, 1)], "bucket_id long")
    return mapreduce.aggregate(demo.orders(spark, d), demo.buckets(spark, d), COUNT, F.count(F.lit(1)).alias("n"), _money("o_totalprice"), bucket_ids=ids)


@query("SELECT rs_id, count(*) AS n, string_agg(bucket_id || ':' || bucket_id * 10, ',' ORDER BY bucket_id) AS args FROM (SELECT * FROM routes WHERE bucket_id % 100 = 1) GROUP BY rs_id")
def map_reduce_split_args(spark, d) -> DataFrame:
    args = spark.range(1, COUNT + 1).where("id % 100 = 1").select(F.col("id").alias("bucket_id"), (F.col("id") * 10).alias("args"))
    got = mapreduce.split_args(args, demo.buckets(spark, d))
    text = F.transform(F.map_entries("args"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return got.select("rs_id", F.size("args").cast("long").alias("n"), F.array_join(text, ",").alias("args"))


@query("SELECT rs_id, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM cust JOIN fresh ON id = bucket_id GROUP BY rs_id")
def map_reduce_python(spark, d) -> DataFrame:
    def one(rs, frames, _):
        import pandas as pd

        n = total = 0
        for f in frames:
            n, total = n + len(f), total + int(f["c_custkey"].sum())
        yield pd.DataFrame({"rs_id": [rs], "n": [n], "total": [total]})

    def merge(parts):
        return parts.groupby("rs_id", as_index=False).sum()

    data = demo.customers(spark, d).select("bucket_id", "c_custkey")
    return mapreduce.apply(data, demo.fresh(spark, d), COUNT, one, "rs_id string, n long, total long", parts=4, merge=merge)


@query(f"SELECT c_custkey, c.bucket_id, count(*) AS n, {_CENTS.format('o_totalprice')} FROM cust c JOIN ord o ON o.bucket_id = c.bucket_id AND o_custkey = c_custkey GROUP BY ALL")
def colocated_join(spark, d) -> DataFrame:
    c, o = demo.customers(spark, d).select("c_custkey", "bucket_id"), demo.orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "bucket_id", "o_totalprice")
    return c.join(o, ["bucket_id", "c_custkey"]).groupBy("c_custkey", "bucket_id").agg(F.count(F.lit(1)).alias("n"), _money("o_totalprice"))


@query("SELECT replica_id, count(id) AS n FROM replicas r LEFT JOIN buckets b ON b.rs_id = r.rs_id WHERE is_master AND replica_id <> '00' GROUP BY replica_id")
def map_on_replicas(spark, d) -> DataFrame:
    return mapreduce.on_replicas(demo.buckets(spark, d), demo.replicas(spark, d), F.count("id").alias("n"), without="00", masters_only=True)


# -- balance ---------------------------------------------------------------
_MEASURED = "SELECT e.rs_id, e.etalon, c.bucket_count, e.etalon - c.bucket_count AS needed FROM even e JOIN counted c ON c.rs_id = e.rs_id"
_EVEN = """even AS (SELECT rs_id, CAST(up - CASE WHEN cut AND row_number() OVER (PARTITION BY cut ORDER BY rs_id) <= sum(up) OVER () - t THEN 1 ELSE 0 END AS BIGINT) AS etalon
  FROM (SELECT rs_id, t, ceil(1.0 * t / k) AS up, t % k <> 0 AS cut FROM shards, (SELECT sum(bucket_count) AS t, count(*) AS k FROM counted)))"""


def _even(spark, d) -> DataFrame:
    s = balance.states(demo.buckets(spark, d), demo.shards(spark, d).select("rs_id", F.lit(1.0).alias("weight")))
    total = s.agg(F.sum("bucket_count")).first()[0]
    return balance.disbalance(balance.etalon(s, int(total)))


def _with(text: str) -> str:
    return f"SELECT * FROM (WITH {_EVEN} {text})"


@query(_with(f"SELECT rs_id, etalon, bucket_count, needed, round(CASE WHEN etalon <> 0 THEN abs(needed) * 100.0 / etalon ELSE 0 END, 6) AS disbalance FROM ({_MEASURED})"))
def disbalance(spark, d) -> DataFrame:
    return _even(spark, d).select("rs_id", "etalon", "bucket_count", "needed", F.round("disbalance", 6).alias("disbalance"))


@query(_with(f"SELECT round(abs(needed) * 100.0 / etalon, 6) AS max_disbalance, rs_id AS max_disbalance_id FROM ({_MEASURED}) ORDER BY abs(needed) * 1.0 / etalon DESC, rs_id LIMIT 1"))
def max_disbalance(spark, d) -> DataFrame:
    return balance.max_disbalance(_even(spark, d)).select(F.round("max_disbalance", 6).alias("max_disbalance"), "max_disbalance_id")


_ROUTES = f"""m AS ({_MEASURED}),
  p AS (SELECT rs_id AS src, sum(-needed) OVER (ORDER BY rs_id) AS hi, -needed AS n FROM m WHERE needed < 0),
  q AS (SELECT rs_id AS dst, sum(needed) OVER (ORDER BY rs_id) AS hi, needed AS n FROM m WHERE needed > 0),
  ways AS (SELECT src, dst, CAST(least(p.hi, q.hi) - greatest(p.hi - p.n, q.hi - q.n) AS BIGINT) AS cnt FROM p JOIN q ON p.hi - p.n < q.hi AND q.hi - q.n < p.hi)"""


@query(f"SELECT * FROM (WITH {_EVEN}, {_ROUTES} SELECT src, dst, cnt AS count FROM ways) WHERE (SELECT count(*) FROM counted) > 0")
def rebalance_routes(spark, d) -> DataFrame:
    return balance.routes(_even(spark, d))


@query(f"""SELECT * FROM (WITH {_EVEN}, {_ROUTES},
  turns AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY turn, dst) AS seq FROM (SELECT src, dst, unnest(range(1, cnt + 1)) AS turn FROM ways)),
  total AS (SELECT src, CAST(sum(cnt) AS BIGINT) AS k FROM ways GROUP BY src),
  ready AS (SELECT rs_id AS src, id, row_number() OVER (PARTITION BY rs_id ORDER BY id) AS pos FROM buckets WHERE status = 'active')
  SELECT r.id AS bucket_id, t.src, t.dst, t.seq, CAST(ceil(t.seq / 4.0) AS BIGINT) AS batch, CAST(ceil(row_number() OVER (PARTITION BY t.dst ORDER BY t.seq, t.src) / 100.0) AS BIGINT) AS wave
  FROM turns t JOIN total k ON k.src = t.src JOIN ready r ON r.src = t.src AND r.pos = k.k - t.seq + 1) WHERE (SELECT count(*) FROM counted) > 0""")
def rebalance_plan(spark, d) -> DataFrame:
    return balance.plan(demo.buckets(spark, d), demo.shards(spark, d).select("rs_id", F.lit(1.0).alias("weight")), workers=4)


@query("SELECT rs_id, min(replica_id) AS replica_id FROM replicas WHERE is_master AND rs_id = (SELECT rs_id FROM replicas WHERE is_master ORDER BY replica_id LIMIT 1) GROUP BY rs_id")
def elect_rebalancer(spark, d) -> DataFrame:
    none = F.lit(None)
    sets = demo.shards(spark, d).select("rs_id", none.cast("boolean").alias("rebalancer"), none.cast("string").alias("master_mode"))
    return balance.elect(sets, demo.replicas(spark, d).withColumn("rebalancer", none.cast("boolean")))


# -- lifecycle -------------------------------------------------------------
_EDGES = "('active','pinned'),('active','sending'),('active','readonly'),('pinned','active'),('readonly','active'),('readonly','sending'),('sending','active'),('sending','sent'),('sent','garbage'),('receiving','garbage'),('receiving','active')"


@query(f"SELECT bucket_id, event_id, status, old_status FROM (SELECT *, lag(status) OVER (PARTITION BY bucket_id ORDER BY ts, event_id) AS old_status FROM changes) WHERE NOT (CASE WHEN old_status IS NULL THEN status = 'receiving' ELSE old_status = status OR (old_status, status) IN ({_EDGES}) END)")
def fsm_violations(spark, d) -> DataFrame:
    return lifecycle.violations(demo.changes(spark, d), ["ts", "event_id"]).select("bucket_id", "event_id", "status", "old_status")


@query("SELECT bucket_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY ts DESC, event_id DESC) AS n FROM changes) WHERE n = 1")
def current_buckets(spark, d) -> DataFrame:
    return lifecycle.current(demo.changes(spark, d), ["ts", "event_id"]).select("bucket_id", "status", "event_id")


_LOG = "SELECT event_id, bucket_id, mode, CASE WHEN row_number() OVER (PARTITION BY bucket_id, mode ORDER BY event_id) % 3 = 0 THEN -1 ELSE 1 END AS delta FROM (SELECT event_id, user_id % 50 AS bucket_id, mode FROM requests)"


def _log(spark, d) -> DataFrame:
    q = demo.requests(spark, d).select("event_id", (F.col("user_id") % 50).alias("bucket_id"), "mode")
    n = F.row_number().over(Window.partitionBy("bucket_id", "mode").orderBy("event_id"))
    return q.withColumn("delta", F.when(n % 3 == 0, -1).otherwise(1))


_COUNTERS = f"SELECT event_id, bucket_id, CAST(sum(CASE WHEN mode = 'read' THEN delta ELSE 0 END) OVER w AS BIGINT) AS ro, CAST(sum(CASE WHEN mode = 'write' THEN delta ELSE 0 END) OVER w AS BIGINT) AS rw FROM ({_LOG}) WINDOW w AS (PARTITION BY bucket_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(_COUNTERS)
def ref_counters(spark, d) -> DataFrame:
    return lifecycle.ref_counters(_log(spark, d), ["event_id"]).select("event_id", "bucket_id", "ro", "rw")


@query(_COUNTERS)
def ref_counters_fold(spark, d) -> DataFrame:
    rows = _log(spark, d).select("bucket_id", "event_id", F.when(F.col("delta") > 0, "ref").otherwise("unref").alias("op"), "mode", F.lit("active").alias("status"))
    return state.ref_counters(rows).select("event_id", "bucket_id", "ro", "rw")


@query("""SELECT b.id, b.rs_id, b.status, CASE WHEN b.status = 'readonly' THEN 'active' WHEN b.status NOT IN ('sending', 'receiving') THEN b.status
  WHEN o.id IS NOT NULL AND o.gen > b.gen THEN 'garbage' WHEN o.id IS NOT NULL AND o.gen < b.gen THEN 'active'
  WHEN b.status = 'sending' AND o.status IN ('active', 'pinned') THEN 'sent' WHEN b.status = 'receiving' AND o.status IN ('active', 'pinned', 'sending') THEN 'garbage'
  WHEN o.id IS NULL OR o.status IN ('sent', 'garbage') THEN 'active' ELSE b.status END AS new_status
  FROM (SELECT * FROM buckets UNION ALL SELECT id, destination, CASE id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'sending' WHEN 2 THEN 'sent' ELSE 'receiving' END, rs_id, id % 3 + id % 2 FROM buckets WHERE status IN ('sending', 'receiving') AND id % 5 < 4) b
  LEFT JOIN (SELECT * FROM buckets UNION ALL SELECT id, destination, CASE id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'sending' WHEN 2 THEN 'sent' ELSE 'receiving' END, rs_id, id % 3 + id % 2 FROM buckets WHERE status IN ('sending', 'receiving') AND id % 5 < 4) o
  ON o.id = b.id AND o.rs_id <> b.rs_id""")
def recovery_decision(spark, d) -> DataFrame:
    return lifecycle.recover(demo.paired(spark, d)).select("id", "rs_id", "status", "new_status")


@query("SELECT c_custkey, bucket_id FROM cust WHERE bucket_id NOT IN (SELECT id FROM buckets WHERE status = 'garbage')")
def gc_sweep(spark, d) -> DataFrame:
    kept, _, _ = lifecycle.sweep({"customer": demo.customers(spark, d)}, demo.buckets(spark, d))
    return kept["customer"].select("c_custkey", "bucket_id")


@query("SELECT id AS bucket_id, destination AS dst FROM buckets WHERE status = 'garbage' AND id % 2 = 0")
def redirect_expiry(spark, d) -> DataFrame:
    _, _, told = lifecycle.sweep({}, demo.buckets(spark, d))
    return lifecycle.expire(told, told.where("bucket_id % 2 = 1"))


@query("SELECT id, rs_id, CASE WHEN status = 'active' AND id % 10 = 6 THEN 'pinned' ELSE status END AS status FROM buckets")
def pin_buckets(spark, d) -> DataFrame:
    return lifecycle.pin(demo.buckets(spark, d), spark.range(1, COUNT + 1).where("id % 10 = 6")).select("id", "rs_id", "status")


@query("""SELECT id, CASE WHEN hit THEN 'sent' ELSE status END AS status, rs_id, gen + CASE WHEN hit THEN 1 ELSE 0 END AS generation FROM (SELECT *, id % 50 = 7 AND status IN ('active', 'readonly') AS hit FROM buckets)
  UNION ALL SELECT id, 'active', nxt, gen + 1 FROM buckets b JOIN follow f ON f.rs_id = b.rs_id WHERE id % 50 = 7 AND status IN ('active', 'readonly')""")
def bucket_send(spark, d) -> DataFrame:
    b = demo.buckets(spark, d)
    names = demo.shards(spark, d).select("rs_id")
    order = Window.orderBy("rs_id")
    follow = names.select("rs_id", F.coalesce(F.lead("rs_id").over(order), F.first("rs_id").over(order)).alias("dst"))
    moves = b.where("id % 50 = 7").join(F.broadcast(follow), "rs_id").select("id", "rs_id", "dst")
    done = lifecycle.end_send(lifecycle.begin_send(b, moves))
    return done.select("id", "status", "rs_id", F.col("opts")["generation"].alias("generation"))


@query("SELECT c_custkey, bucket_id, CAST(ceil(row_number() OVER (PARTITION BY bucket_id ORDER BY c_custkey) / 1000.0) AS BIGINT) AS chunk FROM cust")
def transfer_chunks(spark, d) -> DataFrame:
    return lifecycle.chunks(demo.customers(spark, d).select("c_custkey", "bucket_id"), ["c_custkey"])


# -- topology --------------------------------------------------------------
@query("SELECT rs_id, count(*) AS total, count(*) FILTER (status IN ('active', 'pinned')) AS active, count(*) FILTER (status = 'sent') AS garbage, count(*) FILTER (status = 'receiving') AS receiving, count(*) FILTER (status = 'sending') AS sending, count(*) FILTER (status = 'readonly') AS readonly, count(*) FILTER (status = 'pinned') AS pinned FROM buckets GROUP BY rs_id")
def status_histogram(spark, d) -> DataFrame:
    return topology.storage_info(demo.buckets(spark, d))


_UP = "SELECT rs_id, row_number() OVER (ORDER BY rs_id) <> 2 AS master_up, row_number() OVER (ORDER BY rs_id) <> 3 AS replica_up FROM shards"


@query(f"""SELECT rs_id, CAST(sum(CASE WHEN master_up THEN n ELSE 0 END) AS BIGINT) AS available_rw, CAST(sum(CASE WHEN NOT master_up AND replica_up THEN n ELSE 0 END) AS BIGINT) AS available_ro,
  CAST(sum(CASE WHEN NOT master_up AND NOT replica_up THEN n ELSE 0 END) AS BIGINT) AS unreachable, CASE WHEN grouping(rs_id) = 1 THEN CAST({COUNT} - sum(n) AS BIGINT) ELSE -1 END AS unknown,
  CASE WHEN sum(CASE WHEN NOT master_up AND NOT replica_up THEN n ELSE 0 END) > 0 THEN 3 WHEN sum(CASE WHEN NOT master_up AND replica_up THEN n ELSE 0 END) > 0 THEN 2 WHEN grouping(rs_id) = 1 AND {COUNT} - sum(n) > 0 THEN 1 ELSE 0 END AS colour
  FROM ({_UP}) u JOIN (SELECT rs_id, count(*) AS n FROM routes GROUP BY rs_id) USING (rs_id) GROUP BY GROUPING SETS ((rs_id), ())""")
def router_info(spark, d) -> DataFrame:
    n = F.row_number().over(Window.orderBy("rs_id"))
    up = demo.shards(spark, d).select("rs_id", (n != 2).alias("master_up"), (n != 3).alias("replica_up"))
    return topology.router_info(placement.route_map(demo.buckets(spark, d)), up, COUNT).withColumn("unknown", F.coalesce("unknown", F.lit(-1).cast("long")))


def _priorities(spark, d) -> DataFrame:
    return topology.priorities(demo.replicas(spark, d), {"1": {"0": 2.0}}, "1")


@query("SELECT rs_id, replica_id, priority FROM prio")
def replica_priority(spark, d) -> DataFrame:
    return _priorities(spark, d).select("rs_id", "replica_id", F.col("priority").cast("long").alias("priority"))


@query("""SELECT event_id, q.rs_id, replica_id FROM (SELECT event_id, rs_id, row_number() OVER (PARTITION BY rs_id ORDER BY event_id) AS n FROM requests JOIN routes USING (bucket_id)) q
  JOIN (SELECT *, count(*) OVER (PARTITION BY rs_id) AS k FROM prio) p ON p.rs_id = q.rs_id AND p.priority = (q.n - 1) % p.k + 1""")
def balanced_pick(spark, d) -> DataFrame:
    rows = demo.requests(spark, d).select("event_id", "bucket_id").join(placement.small(placement.route_map(demo.buckets(spark, d)), COUNT), "bucket_id")
    return topology.balanced(rows.select("event_id", "rs_id"), _priorities(spark, d), ["event_id"]).select("event_id", "rs_id", "replica_id")


@query("""SELECT rs_id, arg_min(replica_id, priority + CASE WHEN nk % 4 = 1 THEN 1000 ELSE 0 END) AS replica_id FROM prio GROUP BY rs_id""")
def failover_pick(spark, d) -> DataFrame:
    r = demo.replicas(spark, d)
    states = r.select("replica_id", (F.col("nk") % 4 != 1).alias("connected"), F.lit(0).alias("health"))
    return topology.failover(_priorities(spark, d), states)


@query("""SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 3 WHEN user_id % 7 = 0 THEN 3 WHEN value > 30 THEN 3 WHEN event_type = 'error' THEN 1 ELSE 0 END AS health FROM events""")
def health_status(spark, d) -> DataFrame:
    e = demo.table(spark, d, "events")
    lag = F.when((F.col("event_type") != "error") | (F.col("value") > 30), F.col("value"))
    colour = topology.health(F.lit(0), F.when(F.col("user_id") % 7 == 0, 3).otherwise(0), F.when(F.col("user_id") % 17 == 0, 1).otherwise(100), lag, F.lit(None).cast("double"))
    return e.select("event_id", colour.alias("health"))


@query("""SELECT rs_id, arg_max(replica_id, event_id) AS replica_id FROM (SELECT n_regionkey AS rs_id, n_nationkey AS replica_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS t FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY ALL) WHERE t IN ('view', 'click') GROUP BY rs_id""")
def locate_master(spark, d) -> DataFrame:
    e, n = demo.table(spark, d, "events"), demo.table(spark, d, "nation")
    beats = e.join(F.broadcast(n), F.col("n_nationkey") == F.col("user_id") % 25).select(F.col("n_regionkey").alias("rs_id"), F.col("n_nationkey").alias("replica_id"), F.col("event_type").isin("view", "click").alias("is_master"), "event_id")
    return topology.locate_masters(beats, ["event_id"])


_A, _B = "[o_orderkey % 5, o_custkey % 3, o_orderkey % 2]", "[o_orderkey % 4, o_custkey % 2]"


@query("""SELECT o_orderkey, CASE WHEN g AND l THEN 2 WHEN g THEN 1 WHEN l THEN -1 ELSE 0 END AS cmp FROM (SELECT o_orderkey, (o_orderkey % 5 > o_orderkey % 4 OR o_custkey % 3 > o_custkey % 2 OR o_orderkey % 2 > 0) AS g,
  (o_orderkey % 5 < o_orderkey % 4 OR o_custkey % 3 < o_custkey % 2 OR o_orderkey % 2 < 0) AS l FROM orders)""")
def vclock_compare(spark, d) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ids = lambda n: F.array(*(F.lit(i) for i in range(1, n + 1)))
    left = F.map_from_arrays(ids(3), F.array(o % 5, c % 3, o % 2))
    right = F.map_from_arrays(F.array(F.lit(1), F.lit(2), F.lit(9)), F.array(o % 4, c % 2, F.lit(99).cast("long")))
    return demo.table(spark, d, "orders").select("o_orderkey", F.coalesce(scalars.vclock_compare(left, right), F.lit(2)).alias("cmp"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 WHEN p_size < 25 THEN -1 ELSE CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE -1 END END AS cmp FROM part")
def version_compare(spark, d) -> DataFrame:
    text = F.concat(F.lit("2."), F.col("p_size").cast("string"), F.lit(".1"), F.when(F.col("p_partkey") % 2 == 1, "-rc1-5-gabc").otherwise(""))
    return demo.table(spark, d, "part").select("p_partkey", scalars.version_compare(text, F.lit("2.25.1")).alias("cmp"))


@query("SELECT replica_id, replace(uri, ':pw@', '@') AS uri FROM replicas")
def safe_uri(spark, d) -> DataFrame:
    return demo.replicas(spark, d).select("replica_id", scalars.safe_uri(F.col("uri")).alias("uri"))


@query("SELECT event_id, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['b', 'c'] ELSE ['a', 'b', 'c'] END) AS k FROM events) GROUP BY event_id")
def map_minus(spark, d) -> DataFrame:
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.lit("c"), F.lit(3))
    other = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(9))).otherwise(F.create_map(F.lit("b"), F.lit(9)))
    return demo.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(scalars.map_minus(m, other))), ",").alias("keys"))


@query("SELECT func, since_core FROM (SELECT event_type AS func, user_id AS since_core, row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) WHERE user_id <= 100) WHERE n = 1")
def exports_latest(spark, d) -> DataFrame:
    e = demo.table(spark, d, "events").select(F.col("event_type").alias("func"), F.col("user_id").alias("since_core")).distinct()
    return topology.latest_exports(e, F.lit(100))


@query("SELECT w.n_name AS func, CASE WHEN n_nationkey % 3 = 0 THEN 'add' WHEN n_nationkey % 3 = 1 THEN 'update' END AS change FROM nation w WHERE n_nationkey % 3 < 2 UNION ALL SELECT r_name || '*', 'drop' FROM region")
def exports_diff(spark, d) -> DataFrame:
    n, r = demo.table(spark, d, "nation"), demo.table(spark, d, "region")
    wanted = n.select(F.col("n_name").alias("func"), F.lit("new").alias("body"))
    have = n.where("n_nationkey % 3 > 0").select("n_name", F.when(F.col("n_nationkey") % 3 == 1, "old").otherwise("new")).toDF("func", "body")
    return topology.export_changes(wanted, have.unionByName(r.select(F.concat("r_name", F.lit("*")).alias("func"), F.lit("x").alias("body"))))


# -- stateful --------------------------------------------------------------
@query("""WITH RECURSIVE e AS (SELECT event_type || (user_id % 3) AS key, event_id, epoch(ts) AS now, row_number() OVER (PARTITION BY event_type || (user_id % 3) ORDER BY event_id) AS n FROM events),
  f AS (SELECT key, n, event_id, now, true AS passes, now AS first FROM e WHERE n = 1
    UNION ALL SELECT e.key, e.n, e.event_id, e.now, e.now >= f.first + 3600, CASE WHEN e.now >= f.first + 3600 THEN e.now ELSE f.first END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
  SELECT key, event_id, passes FROM f""")
def log_ratelimit(spark, d) -> DataFrame:
    e = demo.table(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    return state.ratelimit(e, 3600).select("key", "event_id", "passes")


@query("""WITH RECURSIVE e AS (SELECT user_id AS sid, event_id, epoch(ts) AS now, event_id % 4 + 1 AS r, CASE WHEN event_type IN ('signup', 'view') THEN 'add' WHEN event_type = 'click' THEN 'use' WHEN event_type = 'error' THEN 'kill' ELSE 'del' END AS op,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([NULL, NULL, NULL, NULL] AS DOUBLE[]) AS d, [0, 0, 0, 0] AS u, false AS dead, CAST(NULL AS VARCHAR) AS error FROM e
    UNION ALL SELECT sid, n, event_id, CASE WHEN dead2 AND list_sum(u2) = 0 THEN CAST([NULL, NULL, NULL, NULL] AS DOUBLE[]) ELSE d2 END, u2, dead2, error
    FROM (SELECT sid, n, event_id, error, dead OR op = 'kill' AS dead2, list_transform([1, 2, 3, 4], lambda k: CASE WHEN k = r AND op = 'add' AND error IS NULL THEN now + 40000 WHEN k = r AND op = 'del' THEN NULL ELSE d1[k] END) AS d2,
        list_transform([1, 2, 3, 4], lambda k: CASE WHEN k = r AND op = 'use' AND error IS NULL THEN 1 WHEN k = r AND op IN ('add', 'del') AND error IS NULL THEN 0 WHEN d1[k] IS NULL THEN 0 ELSE u[k] END) AS u2
      FROM (SELECT *, CASE WHEN op = 'add' AND (dead OR d1[r] IS NOT NULL) THEN 'STORAGE_REF_ADD' WHEN op = 'use' AND (d1[r] IS NULL OR u[r] = 1) THEN 'STORAGE_REF_USE' WHEN op = 'del' AND d1[r] IS NULL THEN 'STORAGE_REF_DEL' END AS error
        FROM (SELECT e.*, f.u, f.dead, list_transform([1, 2, 3, 4], lambda k: CASE WHEN f.u[k] = 0 AND f.d[k] <= e.now THEN NULL ELSE f.d[k] END) AS d1 FROM f JOIN e ON e.sid = f.sid AND e.n = f.n + 1))))
  SELECT sid, event_id, len(list_filter(d, lambda x: x IS NOT NULL)) AS held, error FROM f WHERE n > 0""")
def ref_deadlines(spark, d) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t.isin("signup", "view"), "add").when(t == "click", "use").when(t == "error", "kill").otherwise("del")
    e = demo.table(spark, d, "events").select(F.col("user_id").alias("sid"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), op.alias("op"), (F.col("event_id") % 4).alias("rid"), F.lit(40000.0).alias("timeout"))
    return state.ref_deadlines(e)


@query("""WITH RECURSIVE e AS (SELECT user_id % 5 AS shard, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'ref' WHEN event_type = 'click' THEN 'move' WHEN event_type = 'error' THEN 'end_move' ELSE 'end_ref' END AS op, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT shard, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS by_event, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS op, 0 AS rc, 0 AS mc, 0 AS rs, 0 AS ms, CAST([] AS BIGINT[]) AS rq, CAST([] AS BIGINT[]) AS mq FROM e
    UNION ALL SELECT shard, CASE WHEN pr OR pm THEN n ELSE n + 1 END, k + 1, CASE WHEN pr OR pm THEN by_event ELSE ev END, CASE WHEN pr THEN rq[1] WHEN pm THEN mq[1] WHEN sr OR sm THEN ev END, CASE WHEN pr OR sr THEN 'ref' WHEN pm OR sm THEN 'move' END,
      CASE WHEN pr OR sr THEN rc + 1 WHEN NOT pm AND eop = 'end_ref' THEN greatest(rc - 1, 0) ELSE rc END, CASE WHEN pm OR sm THEN mc + 1 WHEN NOT pr AND eop = 'end_move' THEN greatest(mc - 1, 0) ELSE mc END,
      CASE WHEN pr OR sr THEN rs + 1 WHEN pm OR sm THEN 0 ELSE rs END, CASE WHEN pm OR sm THEN ms + 1 WHEN pr OR sr THEN 0 ELSE ms END,
      CASE WHEN pr THEN rq[2:] WHEN NOT pm AND eop = 'ref' AND NOT sr THEN list_append(rq, ev) ELSE rq END, CASE WHEN pm THEN mq[2:] WHEN NOT pr AND eop = 'move' AND NOT sm THEN list_append(mq, ev) ELSE mq END
    FROM (SELECT *, NOT pr AND NOT pm AND coalesce(eop = 'ref', false) AND may_r AS sr, NOT pr AND NOT pm AND coalesce(eop = 'move', false) AND may_m AS sm
      FROM (SELECT *, len(rq) > 0 AND may_r AS pr, NOT (len(rq) > 0 AND may_r) AND len(mq) > 0 AND may_m AS pm
        FROM (SELECT f.*, e.event_id AS ev, e.op AS eop, f.mc = 0 AND NOT (len(f.mq) > 0 AND f.rs >= 3) AS may_r, f.rc = 0 AND NOT (len(f.rq) > 0 AND f.ms >= 1) AS may_m FROM f LEFT JOIN e ON e.shard = f.shard AND e.n = f.n + 1))
      WHERE pr OR pm OR ev IS NOT NULL))
  SELECT shard, event_id, by_event AS started_by, op FROM f WHERE op IS NOT NULL""")
def sched_fairness(spark, d) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t.isin("signup", "view"), "ref").when(t == "click", "move").when(t == "error", "end_move").otherwise("end_ref")
    return state.schedule(demo.table(spark, d, "events").select((F.col("user_id") % 5).alias("shard"), "event_id", op.alias("op")), 3, 1)


@query("""WITH RECURSIVE e AS (SELECT user_id % 25 AS replica_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT replica_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0.5 AS DOUBLE) AS t, 0 AS fails, 0 AS oks FROM e
    UNION ALL SELECT e.replica_id, e.n, e.event_id, CASE WHEN ok THEN CASE WHEN f.oks >= 9 THEN 0.5 ELSE t END WHEN f.fails >= 1 AND t * 2 <= 64 THEN t * 2 ELSE t END, CASE WHEN ok THEN 0 ELSE f.fails + 1 END,
      CASE WHEN NOT ok THEN 0 WHEN f.oks >= 9 THEN 1 ELSE f.oks + 1 END FROM f JOIN e ON e.replica_id = f.replica_id AND e.n = f.n + 1)
  SELECT replica_id, event_id, t AS timeout FROM f WHERE n > 0""")
def adaptive_timeout(spark, d) -> DataFrame:
    return state.adaptive_timeouts(demo.table(spark, d, "events").select((F.col("user_id") % 25).alias("replica_id"), "event_id", (F.col("event_type") != "error").alias("ok")))


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS bucket_id, event_id, epoch(ts) AS now, CASE WHEN event_type = 'purchase' THEN 'rs' || (user_id % 3) END AS new, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT bucket_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS dst, CAST(0 AS DOUBLE) AS since, false AS told FROM e
    UNION ALL SELECT bucket_id, n, event_id, coalesce(new, cur), CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM cur THEN now ELSE since END, new IS NULL
    FROM (SELECT e.*, f.since, CASE WHEN floor(e.now / 86400) < floor(f.since / 86400) + 2 THEN f.dst END AS cur FROM f JOIN e ON e.bucket_id = f.bucket_id AND e.n = f.n + 1))
  SELECT bucket_id, event_id, dst FROM f WHERE told""")
def redirect_ttl(spark, d) -> DataFrame:
    dst = F.when(F.col("event_type") == "purchase", F.concat(F.lit("rs"), (F.col("user_id") % 3).cast("string")))
    return state.redirects(demo.table(spark, d, "events").select((F.col("user_id") % 50).alias("bucket_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"), dst.alias("dst")), 86400)
