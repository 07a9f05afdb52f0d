"""Replicas: priorities, picks, health, masters and the monitoring reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketlane.functions import status as S
from bucketlane.functions.scalars import vclock_compare
from bucketlane.operators import calls
from bucketlane.sources.model import (
    FAILOVER_DOWN_FAILS, FAILOVER_DOWN_TIMEOUT, GREEN, ORANGE, RED, REPLICA_BACKOFF, REPLICA_LAG_LIMIT, REPLICATION_FAIL, REPLICATION_HARD, REPLICATION_SOFT, YELLOW, alert,
)


def priorities(replicas: DataFrame, weights: dict, zone) -> DataFrame:
    """replicas plus weight and priority (1 is nearest) as seen from `zone`: by zone weight, own zone 0 and unknown ones
    last, then masters, then ids."""
    row = {str(k): float(v) for k, v in weights.get(zone, {}).items()} | {str(zone): 0.0}
    known = F.create_map(*(F.lit(x) for kv in row.items() for x in kv))
    w = F.coalesce(F.try_element_at(known, F.col("zone").cast("string")), F.lit(float("inf")))
    order = Window.partitionBy("rs_id").orderBy("weight", F.col("is_master").desc(), "replica_id")
    return replicas.withColumn("weight", w).withColumn("priority", F.row_number().over(order))


def health(row_age: Column, fails: Column, backoff_age: Column, lag: Column, idle: Column, lag_limit: float = REPLICA_LAG_LIMIT) -> Column:
    """Colour of a replica: red in backoff, when down for FAILOVER_DOWN_TIMEOUT or after as many failures as it takes, or
    when its upstream lags or idles beyond the limit; yellow if the upstream is unknown."""
    return (
        F.when(backoff_age < REPLICA_BACKOFF, RED).when(row_age >= FAILOVER_DOWN_TIMEOUT, RED).when(fails >= FAILOVER_DOWN_FAILS, RED)
        .when((lag > lag_limit) | (idle > lag_limit), RED).when(lag.isNull() & idle.isNull(), YELLOW).otherwise(GREEN)
    )


def failover(prioritized: DataFrame, states: DataFrame) -> DataFrame:
    """(rs_id, replica_id): the nearest replica that is connected and not red; the nearest of all if none is."""
    rows = prioritized.join(states.select("replica_id", "connected", "health"), "replica_id", "left")
    bad = ~(F.coalesce("connected", F.lit(False)) & (F.coalesce("health", F.lit(RED)) < RED))
    return rows.groupBy("rs_id").agg(F.min_by("replica_id", F.struct(bad, F.col("priority"))).alias("replica_id"))


def balanced(requests: DataFrame, prioritized: DataFrame, order: list[str], prefer_replica: bool = False, healthy: Column | None = None) -> DataFrame:
    """requests (rs_id, ...) plus n and replica_id: request n of a shard goes to healthy replica (n - 1) mod their number,
    in order of priority; with prefer_replica, masters take part only where nothing else is."""
    rows = prioritized if healthy is None else prioritized.where(healthy)
    if prefer_replica:
        own = F.min(F.col("is_master").cast("int")).over(Window.partitionBy("rs_id"))
        rows = rows.withColumn("__m", own).where(~F.col("is_master") | (F.col("__m") == 1))
    # a shard has few replicas
    lists = rows.groupBy("rs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "replica_id"))), lambda s: s["replica_id"]).alias("__all"))
    out = calls.numbered(requests, ["rs_id"], order).join(F.broadcast(lists), "rs_id", "left")
    return out.withColumn("replica_id", F.try_element_at("__all", ((F.col("n") - 1) % F.size("__all") + 1).cast("int"))).drop("__all")


def locate_masters(heartbeats: DataFrame, order: list[str]) -> DataFrame:
    """(rs_id, replica_id): of the replicas whose newest heartbeat says master, the one that said so last."""
    last = heartbeats.groupBy("rs_id", "replica_id").agg(F.max_by(F.struct("is_master", *order), F.struct(*order)).alias("h"))
    return last.where("h.is_master").groupBy("rs_id").agg(F.max_by("replica_id", F.struct(*(F.col(f"h.{c}") for c in order), "replica_id")).alias("replica_id"))


def synced(local: DataFrame, downstreams: DataFrame) -> DataFrame:
    """(rs_id, synced): whether each downstream's clock (rs_id, vclock) is not behind the local one's."""
    rows = local.select("rs_id", F.col("vclock").alias("__l")).join(downstreams.select("rs_id", F.col("vclock").alias("__d")), "rs_id", "left")
    behind = vclock_compare(F.col("__l"), F.coalesce("__d", F.create_map().cast("map<int,bigint>")))
    return rows.groupBy("rs_id").agg(F.bool_and(F.coalesce(behind <= 0, F.lit(False))).alias("synced"))


def storage_info(buckets: DataFrame, replicas: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Counts of a shard's buckets by status, and with replicas and their states (replica_id, lag, connected) alerts and
    colour. As monitoring expects it, `garbage` counts sent buckets, and `active` includes pinned ones."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    out = buckets.groupBy("rs_id").agg(
        F.count(F.lit(1)).alias("total"), is_(S.ACTIVE, S.PINNED).alias("active"), is_(S.SENT).alias("garbage"), is_(S.RECEIVING).alias("receiving"),
        is_(S.SENDING).alias("sending"), is_(S.READONLY).alias("readonly"), is_(S.PINNED).alias("pinned"),
    )
    if replicas is None:
        return out
    rows = replicas.join(states, "replica_id", "left") if states is not None else replicas.withColumn("lag", F.lit(None).cast("double")).withColumn("connected", F.lit(True))
    seen = rows.groupBy("rs_id").agg(
        F.count_if("is_master").alias("masters"), F.max(F.when(~F.col("is_master"), F.col("lag"))).alias("lag"),
        F.count_if(F.coalesce("connected", F.lit(False)) & ~F.col("is_master")).alias("up"), F.count_if(~F.col("is_master")).alias("copies"),
    )
    out = out.join(seen, "rs_id", "left")
    found = [
        (F.coalesce("masters", F.lit(0)) == 0, ORANGE, "MISSING_MASTER", "Master is not configured"),
        ((F.col("copies") > 0) & (F.col("up") == 0), ORANGE, "UNREACHABLE_REPLICASET", "No replica is connected"),
        ((F.col("up") > 0) & (F.col("up") < F.col("copies")), YELLOW, "UNREACHABLE_REPLICA", "A replica is not connected"),
        (F.col("lag") >= REPLICATION_FAIL, RED, "OUT_OF_SYNC", "A replica is out of sync"),
        ((F.col("lag") >= REPLICATION_HARD) & (F.col("lag") < REPLICATION_FAIL), ORANGE, "HIGH_REPLICATION_LAG", "Replication lag is high"),
        ((F.col("lag") >= REPLICATION_SOFT) & (F.col("lag") < REPLICATION_HARD), YELLOW, "HIGH_REPLICATION_LAG", "Replication lag is raised"),
        (F.col("copies") == 0, YELLOW, "LOW_REDUNDANCY", "Only the master is there"),
    ]
    hit = lambda c: F.coalesce(c, F.lit(False))
    alerts = F.filter(F.array(*(F.when(hit(c), alert(n, m)) for c, _, n, m in found)), lambda a: a.isNotNull())
    colour = F.greatest(*(F.when(hit(c), F.lit(k)).otherwise(F.lit(GREEN)) for c, k, _, _ in found))
    return out.withColumn("alerts", alerts).withColumn("colour", colour).drop("masters", "lag", "up", "copies")


def router_info(routes: DataFrame, shards: DataFrame, bucket_count: int) -> DataFrame:
    """Per shard and in total (rs_id null): available_rw, available_ro, unreachable, and in total unknown and colour.
    shards (rs_id, master_up, replica_up) tells what can be reached."""
    counts = routes.groupBy("rs_id").agg(F.count(F.lit(1)).alias("n"))
    rows = shards.join(counts, "rs_id", "left").fillna(0, ["n"])
    got = rows.rollup("rs_id").agg(
        F.sum(F.when(F.col("master_up"), F.col("n")).otherwise(0)).alias("available_rw"),
        F.sum(F.when(~F.col("master_up") & F.col("replica_up"), F.col("n")).otherwise(0)).alias("available_ro"),
        F.sum(F.when(~F.col("master_up") & ~F.col("replica_up"), F.col("n")).otherwise(0)).alias("unreachable"), F.grouping("rs_id").alias("g"),
    )
    known = F.col("available_rw") + F.col("available_ro") + F.col("unreachable")
    unknown = F.when(F.col("g") == 1, F.lit(bucket_count) - known)
    colour = F.when((F.col("unreachable") > 0) | (unknown < 0), RED).when(F.col("available_ro") > 0, ORANGE).when(unknown > 0, YELLOW).otherwise(GREEN)
    return got.select("rs_id", "available_rw", "available_ro", "unreachable", unknown.cast("long").alias("unknown"), colour.alias("colour"))


def instance_info(configured: Column, connected: Column) -> Column:
    """available, unreachable or missing."""
    return F.when(~configured, "missing").when(connected, "available").otherwise("unreachable")


def latest_exports(exports: DataFrame, core: Column) -> DataFrame:
    """Of exported functions (func, since_core, body), the newest definition that a core version allows."""
    last = F.row_number().over(Window.partitionBy("func").orderBy(F.col("since_core").desc()))
    return exports.where(F.col("since_core") <= core).withColumn("n", last).where("n = 1").drop("n")


def export_changes(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(func, change): add, update or drop, to make the installed functions (func, body) the wanted ones."""
    both = wanted.select("func", F.col("body").alias("w")).join(installed.select("func", F.col("body").alias("i")), "func", "full")
    change = F.when(F.col("i").isNull(), "add").when(F.col("w").isNull(), "drop").when(F.col("w") != F.col("i"), "update")
    return both.select("func", change.alias("change")).where("change is not null")


# Alerts that stand in the way of a recovery point.
RECOVERY_ALERTS = ("MISSING_MASTER", "UNREACHABLE_MASTER", "UNREACHABLE_REPLICASET", "UNKNOWN_BUCKETS", "INVALID_CFG")


def recovery_alerts(info: DataFrame) -> DataFrame:
    """(rs_id, message) of the alerts that a recovery point waits for."""
    rows = info.select("rs_id", F.explode("alerts").alias("a")).where(F.col("a.name").isin(*RECOVERY_ALERTS))
    return rows.select("rs_id", F.concat_ws(": ", "a.name", "a.message").alias("message"))


def outdated(old: DataFrame, new: DataFrame) -> DataFrame:
    """old replicas (replica_id, uri, ...) plus `outdated`: whether new ones lack them; calls to those give OBJECT_IS_OUTDATED."""
    held = new.select("replica_id", "uri", F.lit(False).alias("__o"))
    return old.join(held, ["replica_id", "uri"], "left").withColumn("outdated", F.coalesce("__o", F.lit(True))).drop("__o")


def zone_rows(weights: dict) -> list[tuple[str, str, float]]:
    """(zone, other zone, weight) of configured zone weights, each zone's own included."""
    return sorted({(str(a), str(b), float(w)) for a, row in weights.items() for b, w in {**row, a: 0}.items()})


def rebind(new: DataFrame, old: DataFrame) -> DataFrame:
    """New replicas (replica_id, uri, ...) with the health counters (fails, oks, timeout) of the old ones of equal id and
    address; replicas that are gone are outdated and not returned."""
    held = old.select("replica_id", "uri", "fails", "oks", "timeout")
    out = new.join(held, ["replica_id", "uri"], "left")
    return out.fillna(0, ["fails", "oks"]).fillna(0.5, ["timeout"])


def master_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(replica_id, kind) of replicas that became masters (enable) or are no longer (disable)."""
    was, now = old.where("is_master").select("replica_id"), new.where("is_master").select("replica_id")
    return now.join(was, "replica_id", "left_anti").withColumn("kind", F.lit("enable")).unionByName(was.join(now, "replica_id", "left_anti").withColumn("kind", F.lit("disable")))


def may_write(masters: DataFrame, clocks: DataFrame) -> DataFrame:
    """(rs_id, replica_id, error) for replicas (rs_id, replica_id, is_master): NON_MASTER, or MASTER_NOT_SYNCED while the
    clock (replica_id, vclock, peer) of any peer is ahead of its own, else null."""
    ahead = clocks.groupBy("replica_id").agg(F.bool_or(F.coalesce(vclock_compare(F.col("peer"), F.col("vclock")) != -1, F.lit(True)) & (F.coalesce(vclock_compare(F.col("peer"), F.col("vclock")), F.lit(1)) != 0)).alias("behind"))
    error = F.when(~F.col("is_master"), "NON_MASTER").when(F.coalesce("behind", F.lit(False)), "MASTER_NOT_SYNCED")
    return masters.join(ahead, "replica_id", "left").select("rs_id", "replica_id", error.alias("error"))


def storages(replicasets: DataFrame, replicas: DataFrame) -> DataFrame:
    """What each instance is configured as: (replica_id, rs_id, role, read_only, locked, collects_garbage, recovers). Masters of
    shards that find theirs themselves (master_mode auto) are told by the database, not by the configuration."""
    rows = replicas.join(F.broadcast(replicasets.select("rs_id", "lock", "master_mode")), "rs_id")  # a row a shard
    own = F.coalesce(F.col("is_master"), F.lit(False))
    role = F.when(F.coalesce(F.col("master_mode") == "auto", F.lit(False)), "auto").when(own, "master").otherwise("replica")
    return rows.withColumn("role", role).select(
        "replica_id", "rs_id", "role", (F.col("role") == "replica").alias("read_only"), F.coalesce("lock", F.lit(False)).alias("locked"),
        (F.col("role") == "master").alias("collects_garbage"), (F.col("role") == "master").alias("recovers"),
    )


def services(modes: dict[str, str], is_master: bool, is_rebalancer: bool) -> dict[str, bool]:
    """Which background services run: by `discovery` (on, off, once), `rebalancer` (auto, manual, off) and the instance's role."""
    return {
        "discovery": modes.get("discovery", "on") != "off", "failover": True, "master_search": True, "recovery": is_master, "gc": is_master, "master_sync": is_master,
        "rebalancer": is_rebalancer and modes.get("rebalancer", "auto") != "off", "rebalancer_applier": is_master,
    }


def router_alerts(info: DataFrame, bucket_count: int) -> DataFrame:
    """(rs_id, name, message) alerts of `router_info`; rs_id is null for those of the whole router."""
    whole = F.col("rs_id").isNull()
    told = F.array(
        F.when(~whole & (F.col("unreachable") > 0), alert("UNREACHABLE_REPLICASET", F.concat(F.lit("There is no active replicas in replicaset "), F.col("rs_id")))),
        F.when(~whole & (F.col("available_ro") > 0), alert("UNREACHABLE_MASTER", F.concat(F.lit("Master of replicaset "), F.col("rs_id"), F.lit(" is unreachable")))),
        F.when(whole & (F.col("unknown") > 0), alert("UNKNOWN_BUCKETS", F.concat(F.col("unknown").cast("string"), F.lit(" buckets are not discovered")))),
        F.when(whole & (F.col("unknown") < 0), alert("INVALID_CFG", F.concat(F.lit("more buckets are known than "), F.lit(str(bucket_count))))),
    )
    return info.select("rs_id", F.explode(F.filter(told, lambda a: a.isNotNull())).alias("a")).select("rs_id", "a.name", "a.message")


def connections(log: DataFrame, now: Column, idle: float) -> DataFrame:
    """(replica_id, connected, requests, stale) of a log (replica_id, seq, at, event): `connect`, `disconnect` and `request`
    events. stale: connected, but without a request for `idle` seconds, so it can be closed."""
    of = lambda *kinds: F.col("event").isin(*kinds)
    seen = log.groupBy("replica_id").agg(
        F.max_by("event", F.when(of("connect", "disconnect"), F.col("seq"))).alias("last"), F.max(F.when(of("connect", "request"), F.col("at"))).alias("used"), F.count_if(of("request")).alias("requests"),
    )
    up = F.coalesce(F.col("last") == "connect", F.lit(False))
    return seen.select("replica_id", up.alias("connected"), "requests", (up & (now - F.col("used") >= idle)).alias("stale"))


def load_report(log: DataFrame) -> DataFrame:
    """One row: operations, errors, mean latency and operations a second of a log (started, ended, ok)."""
    span = F.max("ended") - F.min("started")
    return log.agg(F.count(F.lit(1)).alias("ops"), F.count_if(~F.col("ok")).alias("errors"), F.avg(F.col("ended") - F.col("started")).alias("mean_latency"), F.when(span > 0, F.count(F.lit(1)) / span).alias("ops_per_s"))
