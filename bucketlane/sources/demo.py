"""A cluster derived from the test tables: shards from region, replicas from nation, buckets by rule, requests from events.
`SQL` holds the same tables as common table expressions, for the SQL twins of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketlane.functions.hashing import bucket_id_strcrc32, oracle_crc
from bucketlane.operators import placement

COUNT = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("rs_id"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # both have a handful of rows
    first = F.min("n_nationkey").over(Window.partitionBy("r_name"))
    return rows.select(
        F.col("r_name").alias("rs_id"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("replica_id"), F.col("n_nationkey").alias("nk"),
        (F.col("n_nationkey") % 3).cast("string").alias("zone"), (F.col("n_nationkey") == first).alias("is_master"), F.concat(F.lit("user:pw@"), "n_name", F.lit(":3301")).alias("uri"),
    )


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets as bootstrap places them, all active."""
    return placement.bootstrap(shards(spark, sf_dir), COUNT)


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with statuses by id % 97, generations by id % 3, destinations: the next shard in order."""
    names = shards(spark, sf_dir).select("rs_id")
    follow = names.select("rs_id", F.coalesce(F.lead("rs_id").over(Window.orderBy("rs_id")), F.first("rs_id").over(Window.orderBy("rs_id"))).alias("next"))
    m = F.col("id") % 97
    status = F.when(m == 0, "sending").when(m == 1, "receiving").when(m == 2, "sent").when(m == 3, "garbage").when(m == 4, "readonly").when(m == 5, "pinned").otherwise("active")
    rows = fresh(spark, sf_dir).drop("status", "destination", "opts").join(F.broadcast(follow), "rs_id").withColumn("status", status)
    return rows.select(
        "id", "status", F.when(F.col("status").isin("sending", "receiving", "sent", "garbage"), F.col("next")).alias("destination"),
        F.map_from_arrays(F.array(F.lit("generation")), F.array((F.col("id") % 3 + 1).cast("long"))).alias("opts"), "rs_id",
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """buckets plus what the destination shards have of some of them, by id % 5."""
    b = buckets(spark, sf_dir)
    there = b.where("destination is not null and status in ('sending', 'receiving') and id % 5 < 4")
    status = F.when(F.col("id") % 5 == 0, "active").when(F.col("id") % 5 == 1, "sending").when(F.col("id") % 5 == 2, "sent").otherwise("receiving")
    gen = (F.col("id") % 3 + F.col("id") % 2).cast("long")
    other = there.select("id", status.alias("status"), F.col("rs_id").alias("destination"), F.map_from_arrays(F.array(F.lit("generation")), F.array(gen)).alias("opts"), F.col("destination").alias("rs_id"))
    return b.unionByName(other)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") % COUNT + 1).alias("bucket_id"), F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read").alias("mode"), "user_id", "ts", "event_type", "value")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of bucket changes: statuses by event type."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    status = F.when(t == "signup", "active").when(t == "purchase", "readonly").when(t == "error", "sending").when(t == "view", "sent").otherwise("garbage")
    return e.select((F.col("user_id") % 50).alias("bucket_id"), "ts", "event_id", status.alias("status"))


def _known(bucket: F.Column) -> F.Column:
    """Null keys are in bucket 0, which no shard has; so the id is never null, and no join tests (computes) it once more."""
    return F.coalesce(bucket, F.lit(0).cast("bigint"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """buckets plus what their destinations have: active where they went, the other half of transfers."""
    b = buckets(spark, sf_dir)
    there = b.where("destination is not null")
    status = F.when(F.col("status") == "sending", "receiving").when(F.col("status") == "receiving", "sending").otherwise("active")
    dst = F.when(F.col("status").isin("sending", "receiving"), F.col("rs_id"))
    return b.unionByName(there.select("id", status.alias("status"), dst.alias("destination"), "opts", F.col("destination").alias("rs_id")))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rs_id, replica_id, nk, vclock) of replicas."""
    r = replicas(spark, sf_dir)
    n = F.col("nk").cast("bigint")
    return r.select("rs_id", "replica_id", "nk", "is_master", F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(n % 5, n % 3)).alias("vclock"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("bucket_id", _known(bucket_id_strcrc32("o_custkey")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("bucket_id", _known(bucket_id_strcrc32("c_custkey")))


def crc_sql(key: str) -> str:
    return f"({oracle_crc(f'encode(CAST({key} AS VARCHAR))')} % {COUNT} + 1)"


SQL = {
    "shards": "SELECT r_name AS rs_id, CAST(r_regionkey + 1 AS DOUBLE) AS weight FROM region",
    "etalon": f"""SELECT rs_id, weight, CAST(up - CASE WHEN cut AND row_number() OVER (PARTITION BY cut ORDER BY rs_id) <= sum(up) OVER () - {COUNT} THEN 1 ELSE 0 END AS BIGINT) AS etalon
      FROM (SELECT *, ceil(weight * ({COUNT} / sum(weight) OVER ())) AS up, weight * ({COUNT} / sum(weight) OVER ()) <> floor(weight * ({COUNT} / sum(weight) OVER ())) AS cut FROM shards)""",
    "ranges": "SELECT rs_id, etalon, CAST(sum(etalon) OVER (ORDER BY rs_id ROWS UNBOUNDED PRECEDING) - etalon + 1 AS BIGINT) AS first, CAST(sum(etalon) OVER (ORDER BY rs_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last FROM etalon",
    "fresh": f"SELECT i AS id, rs_id FROM (SELECT unnest(range(1, {COUNT + 1})) AS i) JOIN ranges ON i BETWEEN first AND last",
    "follow": "SELECT rs_id, coalesce(lead(rs_id) OVER (ORDER BY rs_id), first_value(rs_id) OVER (ORDER BY rs_id)) AS nxt FROM shards",
    "buckets": """SELECT id, f.rs_id, CASE id % 97 WHEN 0 THEN 'sending' WHEN 1 THEN 'receiving' WHEN 2 THEN 'sent' WHEN 3 THEN 'garbage' WHEN 4 THEN 'readonly' WHEN 5 THEN 'pinned' ELSE 'active' END AS status,
      CASE WHEN id % 97 < 4 THEN nxt END AS destination, id % 3 + 1 AS gen FROM fresh f JOIN follow w ON f.rs_id = w.rs_id""",
    "moved": """SELECT id, rs_id, status, destination, gen FROM buckets UNION ALL SELECT id, destination, CASE status WHEN 'sending' THEN 'receiving' WHEN 'receiving' THEN 'sending' ELSE 'active' END,
      CASE WHEN status IN ('sending', 'receiving') THEN rs_id END, gen FROM buckets WHERE destination IS NOT NULL""",
    "routes": "SELECT id AS bucket_id, rs_id FROM buckets WHERE status IN ('active', 'pinned', 'sending', 'readonly')",
    "replicas": """SELECT r_name AS rs_id, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS replica_id, n_nationkey AS nk, CAST(n_nationkey % 3 AS VARCHAR) AS zone,
      n_nationkey = min(n_nationkey) OVER (PARTITION BY r_name) AS is_master, 'user:pw@' || n_name || ':3301' AS uri FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "requests": f"SELECT event_id, event_id % {COUNT} + 1 AS bucket_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS mode, user_id, ts, event_type, value FROM events",
    "changes": """SELECT user_id % 50 AS bucket_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'readonly' WHEN 'error' THEN 'sending' WHEN 'view' THEN 'sent' ELSE 'garbage' END AS status FROM events""",
    "cust": f"SELECT *, {crc_sql('c_custkey')} AS bucket_id FROM customer",
    "ord": f"SELECT o.*, k.bucket_id FROM orders o JOIN (SELECT DISTINCT o_custkey AS k, {crc_sql('o_custkey')} AS bucket_id FROM orders) k ON o.o_custkey = k.k",
    "prio": """SELECT *, row_number() OVER (PARTITION BY rs_id ORDER BY w, is_master DESC, replica_id) AS priority
      FROM (SELECT *, CASE zone WHEN '1' THEN 0.0 WHEN '0' THEN 2.0 ELSE 'Infinity'::DOUBLE END AS w FROM replicas)""",
    "counted": "SELECT rs_id, count(*) FILTER (status IN ('active', 'pinned')) AS bucket_count, count(*) FILTER (status = 'pinned') AS pinned FROM buckets GROUP BY rs_id",
}


def sql(query: str) -> str:
    """query behind the expressions that it needs, in order."""
    import re

    need, todo = set(), [query]
    while todo:
        text = todo.pop()
        for k in SQL:
            if k not in need and re.search(rf"\b{k}\b", text):
                need.add(k)
                todo.append(SQL[k])
    head = ",\n".join(f"{k} AS ({v})" for k, v in SQL.items() if k in need)
    return f"WITH {head}\n{query}" if head else query
