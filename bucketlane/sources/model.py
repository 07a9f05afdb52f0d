"""Schemas of the system tables, constants, errors and configuration checks."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_f = T.StructField
BUCKETS = T.StructType([_f("id", T.LongType(), False), _f("status", T.StringType(), False), _f("destination", T.StringType()), _f("opts", T.MapType(T.StringType(), T.LongType())), _f("rs_id", T.StringType(), False)])
REPLICASETS = T.StructType([_f("rs_id", T.StringType(), False), _f("weight", T.DoubleType()), _f("lock", T.BooleanType()), _f("master_mode", T.StringType()), _f("rebalancer", T.BooleanType())])
REPLICAS = T.StructType([_f("replica_id", T.StringType(), False), _f("rs_id", T.StringType(), False), _f("uri", T.StringType()), _f("zone", T.StringType()), _f("is_master", T.BooleanType()), _f("rebalancer", T.BooleanType())])
ROUTES = T.StructType([_f("bucket_id", T.LongType(), False), _f("rs_id", T.StringType(), False)])

#: Versions of the bucket table, in order: the columns that each one adds.
SCHEMA_VERSIONS = {"0.1.15.0": ("id", "status", "destination"), "0.1.16.0": (), "0.1.41.0": ("opts",)}

# Limits and intervals in seconds.
CHUNK = 1000
SENT_GARBAGE_DELAY = 60
FAILOVER_DOWN_TIMEOUT, FAILOVER_UP_TIMEOUT, FAILOVER_DOWN_FAILS = 1, 5, 3
REPLICA_BACKOFF, REPLICA_LAG_LIMIT, TIMEOUT_INFINITY = 5, 30, 500 * 365 * 86400
CALL_TIMEOUT_MIN, CALL_TIMEOUT_MAX = 0.5, 64
RATELIMIT_INTERVAL = 30
REF_QUOTA, MOVE_QUOTA = 300, 1
MAX_SENDING, MAX_SENDING_LIMIT, MAX_RECEIVING = 1, 15, 100
DISBALANCE_THRESHOLD = 1
REPLICATION_SOFT, REPLICATION_HARD, REPLICATION_FAIL = 1, 5, 10
GREEN, YELLOW, ORANGE, RED = range(4)

# Error names with their numbers and messages.
ERRORS = {
    "WRONG_BUCKET": (1, "Cannot perform action with bucket {bucket_id}, reason: {reason}"),
    "NON_MASTER": (2, "Replica {replica} is not a master for replicaset {replicaset} anymore"),
    "BUCKET_ALREADY_EXISTS": (3, "Bucket {bucket_id} already exists"),
    "NO_SUCH_REPLICASET": (4, "Replicaset {replicaset} not found"),
    "MOVE_TO_SELF": (5, "Cannot move: bucket {bucket_id} is already on replicaset {replicaset}"),
    "MISSING_MASTER": (6, "Master is not configured for replicaset {replicaset}"),
    "TRANSFER_IS_IN_PROGRESS": (7, "Bucket {bucket_id} is transferring to replicaset {destination}"),
    "UNREACHABLE_REPLICASET": (8, "There is no active replicas in replicaset {replicaset}"),
    "NO_ROUTE_TO_BUCKET": (9, "Bucket {bucket_id} cannot be found. Is rebalancing in progress?"),
    "NON_EMPTY": (10, "Cluster is already bootstrapped"),
    "UNREACHABLE_MASTER": (11, "Master of replicaset {replicaset} is unreachable: {reason}"),
    "OUT_OF_SYNC": (12, "Replica is out of sync"),
    "HIGH_REPLICATION_LAG": (13, "High replication lag: {lag}"),
    "UNREACHABLE_REPLICA": (14, "Replica {replica} isn't active"),
    "LOW_REDUNDANCY": (15, "Only one replica is active"),
    "INVALID_REBALANCING": (16, "Sending and receiving buckets at same time is not allowed"),
    "SUBOPTIMAL_REPLICA": (17, "A current read replica in replicaset {replicaset} is not optimal"),
    "UNKNOWN_BUCKETS": (18, "{not_discovered_cnt} buckets are not discovered"),
    "REPLICASET_IS_LOCKED": (19, "Replicaset is locked"),
    "OBJECT_IS_OUTDATED": (20, "Object is outdated after module reload/reconfigure. Use new instance."),
    "ROUTER_ALREADY_EXISTS": (21, "Router with name {router_name} already exists"),
    "BUCKET_IS_LOCKED": (22, "Bucket {bucket_id} is locked"),
    "INVALID_CFG": (23, "Invalid configuration: {reason}"),
    "BUCKET_IS_PINNED": (24, "Bucket {bucket_id} is pinned"),
    "TOO_MANY_RECEIVING": (25, "Too many receiving buckets at once, please, throttle"),
    "STORAGE_IS_REFERENCED": (26, "Storage is referenced"),
    "STORAGE_REF_ADD": (27, "Can not add a storage ref: {reason}"),
    "STORAGE_REF_USE": (28, "Can not use a storage ref: {reason}"),
    "STORAGE_REF_DEL": (29, "Can not delete a storage ref: {reason}"),
    "BUCKET_RECV_DATA_ERROR": (30, "Can not receive the bucket {bucket_id} data in space \"{space}\" at tuple {tuple}: {reason}"),
    "REPLICASET_IN_BACKOFF": (32, "Replicaset {replicaset} is in backoff, can't take requests right now. Last error was {error}"),
    "STORAGE_IS_DISABLED": (33, "Storage is disabled: {reason}"),
    "BUCKET_IS_CORRUPTED": (34, "Bucket {bucket_id} is corrupted: {reason}"),
    "ROUTER_IS_DISABLED": (35, "Router is disabled: {reason}"),
    "BUCKET_GC_ERROR": (36, "Error during bucket GC: {reason}"),
    "STORAGE_CFG_IS_IN_PROGRESS": (37, "Configuration of the storage is in progress"),
    "ROUTER_CFG_IS_IN_PROGRESS": (38, "Configuration of the router with name {router_name} is in progress"),
    "BUCKET_INVALID_UPDATE": (39, "Bucket {bucket_id} update is invalid: {reason}"),
    "VHANDSHAKE_NOT_COMPLETE": (40, "Handshake with {replica} have not been completed yet"),
    "INSTANCE_NAME_MISMATCH": (41, "Mismatch server name: expected \"{expected_name}\", but got \"{actual_name}\""),
    "MASTER_NOT_SYNCED": (42, "Master {replica} of replicaset {replicaset} has not synchronized yet"),
}


class _Blank(dict):
    """Arguments of a message; those that are missing are empty."""

    def __missing__(self, key: str) -> str:
        return ""


class BucketError(Exception):
    """An error with a name, a number and its arguments; `to_json` and `from_json` keep all of them."""

    def __init__(self, name: str, **args):
        self.name, self.args_ = name, args
        self.code, text = ERRORS.get(name, (0, name.replace("_", " ").capitalize()))
        self.message = text.format_map(_Blank(args))
        super().__init__(self.message)

    def to_json(self) -> str:
        return json.dumps({"type": "ShardingError", "code": self.code, "name": self.name, "message": self.message, "args": self.args_}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "BucketError":
        told = json.loads(text)
        return cls(told["name"], **told.get("args", {}))

    @property
    def is_timeout(self) -> bool:
        return self.name in ("TIMEOUT", "TimedOut")


def error_table(spark) -> DataFrame:
    """(name, code, text) of all errors."""
    return spark.createDataFrame([(n, c, t) for n, (c, t) in sorted(ERRORS.items())], "name string, code int, text string")


def message(text: Column | str, **args: Column) -> Column:
    """An error's text with its arguments filled in; those that aren't given are empty."""
    out = F.col(text) if isinstance(text, str) else text
    for k, v in args.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), F.coalesce(v, F.lit("")))
    return F.regexp_replace(out, r"\{[a-z_]+\}", "")


def alert(name: str, message: Column | str) -> Column:
    """struct<name, message>."""
    return F.struct(F.lit(name).alias("name"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


# Options without effect, and the values of options that have a few.
DEPRECATED = ("collect_bucket_garbage_interval", "collect_lua_garbage")
ENUMS = {"box_cfg_mode": ("auto", "manual"), "schema_management_mode": ("auto", "manual_access"), "identification_mode": ("uuid_as_key", "name_as_key")}


@dataclass
class Config:
    """Cluster options with their defaults; `check` raises ValueError for what they don't allow."""

    bucket_count: int = 3000
    shard_index: str = "bucket_id"
    rebalancer_disbalance_threshold: float = DISBALANCE_THRESHOLD
    rebalancer_max_receiving: int = MAX_RECEIVING
    rebalancer_max_sending: int = MAX_SENDING
    rebalancer_mode: str = "auto"
    discovery_mode: str = "on"
    failover_ping_timeout: float = 5
    sync_timeout: float = 1
    rebalancer_bucket_send_timeout: float = TIMEOUT_INFINITY
    connection_outdate_delay: float | None = None
    failover_sequential_fail_count: int = FAILOVER_DOWN_FAILS
    failover_interval: float = FAILOVER_DOWN_TIMEOUT
    failover_replica_lag_limit: float = REPLICA_LAG_LIMIT
    box_cfg_mode: str = "auto"
    schema_management_mode: str = "auto"
    identification_mode: str = "uuid_as_key"
    connection_fetch_schema: bool = True
    sched_ref_quota: int = REF_QUOTA
    sched_move_quota: int = MOVE_QUOTA
    zone: str | int | None = None
    weights: dict = field(default_factory=dict)
    sharding: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, options: dict) -> tuple["Config", dict]:
        """The engine's options, and the others. Options that had a meaning once are left out."""
        known = {f.name for f in fields(cls)}
        options = {k: v for k, v in options.items() if k not in DEPRECATED}
        return cls(**{k: v for k, v in options.items() if k in known}), {k: v for k, v in options.items() if k not in known}

    @classmethod
    def problem(cls, options: dict) -> str | None:
        """What is wrong with options, null if nothing is."""
        try:
            cls.from_dict(options)[0].check()
        except ValueError as e:
            return str(e)
        return None

    def check(self, old: "Config | None" = None) -> "Config":
        def positive(name: str, zero: bool = False) -> None:
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0 or (v == 0 and not zero) or not math.isfinite(v):
                raise ValueError(f"{name} must be a {'non-negative' if zero else 'positive'} number")

        for name in ("bucket_count", "rebalancer_max_receiving", "rebalancer_max_sending", "failover_sequential_fail_count"):
            positive(name)
            if int(getattr(self, name)) != getattr(self, name):
                raise ValueError(f"{name} must be whole")
        for name in ("rebalancer_disbalance_threshold", "sync_timeout", "sched_ref_quota", "sched_move_quota"):
            positive(name, zero=True)
        for name in ("failover_ping_timeout", "rebalancer_bucket_send_timeout", "failover_interval", "failover_replica_lag_limit"):
            positive(name)
        if self.connection_outdate_delay is not None:
            positive("connection_outdate_delay", zero=True)
        for name, allowed in ENUMS.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if not isinstance(self.connection_fetch_schema, bool):
            raise ValueError("connection_fetch_schema must be true or false")
        if self.zone is not None and (isinstance(self.zone, bool) or not isinstance(self.zone, (str, int, float))):
            raise ValueError("zone must be a text or a number")
        if self.rebalancer_max_sending > MAX_SENDING_LIMIT:
            raise ValueError(f"rebalancer_max_sending must not exceed {MAX_SENDING_LIMIT}")
        if self.discovery_mode not in ("on", "off", "once") or self.rebalancer_mode not in ("auto", "manual", "off"):
            raise ValueError("unknown discovery or rebalancer mode")
        if not isinstance(self.shard_index, str) or not self.shard_index:
            raise ValueError("shard_index must be a name")
        if old and (old.bucket_count != self.bucket_count or old.shard_index != self.shard_index):
            raise ValueError("bucket_count and shard_index can't change")
        self._check_weights()
        self._check_sharding()
        return self

    def _check_weights(self) -> None:
        for a, row in self.weights.items():
            if not isinstance(a, (str, int)) or not isinstance(row, dict):
                raise ValueError("zones are texts or numbers and have maps of weights")
            for b, w in row.items():
                if not isinstance(b, (str, int)) or isinstance(w, bool) or not isinstance(w, (int, float)) or w < 0:
                    raise ValueError("weights of zones are non-negative numbers")
                if a == b and w != 0:
                    raise ValueError("the weight of a zone for itself must be 0")

    def _check_sharding(self) -> None:
        seen: set[str] = set()
        flags, weights = 0, []
        for rs, s in self.sharding.items():
            w = s.get("weight", 1)
            if isinstance(w, bool) or not isinstance(w, (int, float)) or w < 0 or not math.isfinite(w):
                raise ValueError(f"weight of {rs} must be finite and non-negative")
            weights.append(w)
            flags += s.get("rebalancer") is True
            masters = 0
            for name, r in s.get("replicas", {}).items():
                for x in (name, r.get("uri")):
                    if x is None:
                        raise ValueError(f"replica {name} has no uri")
                    if x in seen:
                        raise ValueError(f"{x} occurs twice")
                    seen.add(x)
                masters += bool(r.get("master"))
                flags += r.get("rebalancer") is True
                if "uuid" in r and self.identification_mode != "name_as_key":
                    raise ValueError(f"{name} can have a uuid only if names identify instances")
                if "name" in r and self.identification_mode != "uuid_as_key":
                    raise ValueError(f"{name} can have a name only if uuids identify instances")
                if r.get("rebalancer") and s.get("rebalancer") is False:
                    raise ValueError(f"{rs} can't rebalance, but its instance {name} should")
                if "uuid" in r and not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r["uuid"]):
                    raise ValueError(f"uuid of {name} is malformed")
            if masters > 1:
                raise ValueError(f"{rs} has {masters} masters")
            if masters and s.get("master") == "auto":
                raise ValueError(f"{rs} finds its master itself but names one")
        if flags > 1:
            raise ValueError("more than one rebalancer is named")
        if weights and not any(weights):
            raise ValueError("all weights are 0")


def topology_errors(replicasets: DataFrame, replicas: DataFrame) -> DataFrame:
    """(error, subject) rows of what is wrong in topology tables."""
    told = lambda df, error, c: df.select(F.lit(error).alias("error"), F.col(c).cast("string").alias("subject"))
    out = told(replicas.groupBy("replica_id").count().where("count > 1"), "duplicate replica", "replica_id")
    out = out.unionByName(told(replicas.groupBy("uri").count().where("count > 1 and uri is not null"), "duplicate uri", "uri"))
    out = out.unionByName(told(replicas.where("is_master").groupBy("rs_id").count().where("count > 1"), "several masters", "rs_id"))
    out = out.unionByName(told(replicasets.groupBy("rs_id").count().where("count > 1"), "duplicate replicaset", "rs_id"))
    out = out.unionByName(told(replicasets.where("weight < 0 or isnan(weight) or weight = double('infinity')"), "bad weight", "rs_id"))
    return out.unionByName(told(replicas.join(replicasets, "rs_id", "left_anti"), "unknown replicaset", "rs_id"))


def upgrade(buckets: DataFrame) -> DataFrame:
    """A bucket table of any version with the columns of the newest."""
    for c, kind in (("destination", "string"), ("opts", "map<string,bigint>"), ("rs_id", "string")):
        if c not in buckets.columns:
            buckets = buckets.withColumn(c, F.lit(None).cast(kind))
    return buckets.select(*BUCKETS.fieldNames())


def downgrade(buckets: DataFrame, version: str) -> DataFrame:
    """The columns that a version knows, and the shard."""
    known = [c for v, cs in SCHEMA_VERSIONS.items() if [int(x) for x in v.split(".")] <= [int(x) for x in version.split(".")] for c in cs]
    return buckets.select(*known, "rs_id")


def generation(opts: str = "opts") -> Column:
    return F.coalesce(F.try_element_at(F.col(opts), F.lit("generation")), F.lit(0))
