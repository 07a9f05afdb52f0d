"""Stateful operators: reference counters with locks, references with deadlines, fair scheduling, rate limits anchored at
the first event, adaptive timeouts and redirects that expire.

Each is a fold over the rows of a key in order of their time: a step function from (state, row) to (state, outputs). The
same step runs over batches (`fold`, which streams sorted rows, so a key of any size takes the memory of its state) and
over streams (`fold_stream`, on applyInPandasWithState).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.sources.model import CALL_TIMEOUT_MAX, CALL_TIMEOUT_MIN, MOVE_QUOTA, RATELIMIT_INTERVAL, REF_QUOTA

Step = Callable[[dict, dict], list[dict]]


def fold(df: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """Runs the step over the rows of each key, in order. The state starts as {}; outputs are rows of schema."""
    ordered = df.repartition(key).sortWithinPartitions(key, *order)

    def run(frames):
        import pandas as pd

        now, state, first = None, {}, True
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                this = None if pd.isna(row[key]) else row[key]  # nulls are one key
                if first or this != now:
                    now, state, first = this, {}, False
                out += step(state, row)
            if out:
                yield pd.DataFrame(out)

    return ordered.mapInPandas(run, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], step: Step, schema: str, expire: float | None = None) -> DataFrame:
    """The same over a stream; rows of one trigger are ordered, state is kept as JSON between triggers. expire: seconds
    without rows after which a key's state says nothing any more and is dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(_, frames, held):
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        out = []
        # a trigger's rows of one key
        rows = [r for f in frames for r in f.to_dict("records")]
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
            out += step(state, row)
        held.update((json.dumps(state),))
        if expire is not None:
            held.setTimeoutDuration(max(1, int(expire * 1000)))
        if out:
            yield pd.DataFrame(out)

    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout if expire is None else GroupStateTimeout.ProcessingTimeTimeout)


def replayed(df: DataFrame, order: str, operator: Callable, triggers: int = 3, **options) -> DataFrame:
    """What a stream operator gives for the rows of df, in order of a number, as `triggers` runs of one stream: each run
    finds the next rows in a folder and the state that the last one left. All files are in the shared folder."""
    import uuid

    from bucketlane.sources import shared

    spark, base = df.sparkSession, f"{shared.folder(df.sparkSession)}/replay-{uuid.uuid4().hex}"
    cuts = df.agg(F.percentile_approx(order, [i / triggers for i in range(1, triggers)], 1000).alias("c")).first().c or []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        some = df if low is None else df.where(F.col(order) > low)
        (some if high is None else some.where(F.col(order) <= high)).write.mode("append").parquet(f"{base}/in")
        out = operator(spark.readStream.schema(df.schema).parquet(f"{base}/in"), streaming=True, **options)
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def ref_step(state: dict, row: dict) -> list[dict]:
    """A bucket's counters. row: bucket_id, event_id, op (ref or unref), mode (read or write), status. Writable buckets take
    both modes, readable ones reads alone; taking back what isn't held is an error."""
    error, m = None, "rw" if row["mode"] == "write" else "ro"
    status = row.get("status") or "active"
    locked = status not in (("active", "pinned") if m == "rw" else ("active", "pinned", "sending", "readonly"))
    if row["op"] == "ref":
        if locked:
            error = "BUCKET_IS_LOCKED"
        else:
            state[m] = state.get(m, 0) + 1
    elif state.get(m, 0) == 0:
        error = "BUCKET_IS_CORRUPTED"
    else:
        state[m] -= 1
    return [{"bucket_id": row["bucket_id"], "event_id": row["event_id"], "ro": state.get("ro", 0), "rw": state.get("rw", 0), "error": error}]


REF_SCHEMA = "bucket_id long, event_id long, ro long, rw long, error string"


def ref_counters(df: DataFrame, streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "bucket_id", ["event_id"], ref_step, REF_SCHEMA)


def deadline_step(state: dict, row: dict) -> list[dict]:
    """A session's references with deadlines. row: sid, event_id, now (seconds), op (add, use, del, kill), rid, timeout. A
    reference in use outlives its deadline until it is deleted; a killed session is gone once nothing of it is in use."""
    refs, now, rid, error = state.setdefault("refs", {}), row["now"], str(row["rid"]), None
    for k in [k for k, r in refs.items() if not r["used"] and r["deadline"] <= now]:
        del refs[k]
    if row["op"] == "kill":
        state["dead"] = True
    elif state.get("dead") and row["op"] == "add":
        error = "STORAGE_REF_ADD"
    elif row["op"] == "add":
        if rid in refs:
            error = "STORAGE_REF_ADD"
        else:
            refs[rid] = {"deadline": now + row["timeout"], "used": 0}
    elif rid not in refs:
        error = "STORAGE_REF_USE" if row["op"] == "use" else "STORAGE_REF_DEL"
    elif row["op"] == "use":
        if refs[rid]["used"]:
            error = "STORAGE_REF_USE"
        refs[rid]["used"] = 1
    else:
        del refs[rid]
    if state.get("dead") and not any(r["used"] for r in refs.values()):
        refs.clear()
    return [{"sid": row["sid"], "event_id": row["event_id"], "held": len(refs), "error": error}]


DEADLINE_SCHEMA = "sid long, event_id long, held long, error string"


def ref_deadlines(df: DataFrame, streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "sid", ["event_id"], deadline_step, DEADLINE_SCHEMA)


def sched_step(ref_quota: int = REF_QUOTA, move_quota: int = MOVE_QUOTA) -> Step:
    """A shard's turns between references and moves. row: shard, event_id, op (ref, move, end_ref, end_move). Both never run
    together; after a quota of starts in a row one side waits while the other does; a quota of 0 never blocks the other
    side. Waiting requests start, oldest first and references before moves, as soon as they may."""

    def may(state: dict, op: str) -> bool:
        other = "move" if op == "ref" else "ref"
        quota, others = (ref_quota, move_quota) if op == "ref" else (move_quota, ref_quota)
        return not state.get(f"{other}_count") and not (state.get(f"{other}_queue") and state.get(f"{op}_strike", 0) >= quota and others > 0)

    def start(state: dict, op: str) -> None:
        state[f"{op}_count"] = state.get(f"{op}_count", 0) + 1
        state[f"{op}_strike"] = state.get(f"{op}_strike", 0) + 1
        state["move_strike" if op == "ref" else "ref_strike"] = 0

    def step(state: dict, row: dict) -> list[dict]:
        started, op = [], row["op"]
        tell = lambda event, what: started.append({"shard": row["shard"], "event_id": event, "started_by": row["event_id"], "op": what})
        if op.startswith("end_"):
            k = f"{op[4:]}_count"
            state[k] = max(0, state.get(k, 0) - 1)
        elif may(state, op):
            start(state, op)
            tell(row["event_id"], op)
        else:
            state.setdefault(f"{op}_queue", []).append(row["event_id"])
        again = True
        while again:
            again = False
            for kind in ("ref", "move"):
                queue = state.get(f"{kind}_queue") or []
                if queue and may(state, kind):
                    event = queue.pop(0)
                    start(state, kind)
                    tell(event, kind)
                    again = True
        return started

    return step


SCHED_SCHEMA = "shard long, event_id long, started_by long, op string"


def schedule(df: DataFrame, ref_quota: int = REF_QUOTA, move_quota: int = MOVE_QUOTA, streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "shard", ["event_id"], sched_step(ref_quota, move_quota), SCHED_SCHEMA)


def ratelimit_step(interval: float = RATELIMIT_INTERVAL) -> Step:
    """A key passes once and is then silent for the interval that starts with what passed. row: key, event_id, now."""

    def step(state: dict, row: dict) -> list[dict]:
        first = state.get("first")
        passes = first is None or row["now"] >= first + interval
        silent = 0 if passes else state.get("silent", 0) + 1
        before = state.get("silent", 0) if passes else None
        if passes:
            state["first"] = row["now"]
        state["silent"] = silent
        return [{"key": row["key"], "event_id": row["event_id"], "passes": passes, "suppressed_before": before}]

    return step


RATELIMIT_SCHEMA = "key string, event_id long, passes boolean, suppressed_before long"


def ratelimit(df: DataFrame, interval: float = RATELIMIT_INTERVAL, streaming: bool = False) -> DataFrame:
    """Rows of null key (unsigned entries) always pass; they aren't kept in state."""
    free = df.where("key is null").select(F.lit(None).cast("string").alias("key"), "event_id", F.lit(True).alias("passes"), F.lit(0).cast("long").alias("suppressed_before"))
    signed = df.where("key is not null"), "key", ["event_id"], ratelimit_step(interval), RATELIMIT_SCHEMA
    return (fold_stream(*signed, expire=interval) if streaming else fold(*signed)).unionByName(free)


def timeout_step(state: dict, row: dict) -> list[dict]:
    """A replica's call timeout: doubled from the second failure in a row on, up to the greatest; back to the least after
    ten successes in a row. row: replica_id, event_id, ok."""
    t = state.get("timeout", CALL_TIMEOUT_MIN)
    if row["ok"]:
        state["fails"], state["oks"] = 0, state.get("oks", 0) + 1
        if state["oks"] >= 10:
            t, state["oks"] = CALL_TIMEOUT_MIN, 1  # the tenth success starts the next count
    else:
        state["oks"], state["fails"] = 0, state.get("fails", 0) + 1
        if state["fails"] >= 2 and t * 2 <= CALL_TIMEOUT_MAX:
            t *= 2
    state["timeout"] = t
    return [{"replica_id": row["replica_id"], "event_id": row["event_id"], "timeout": float(t)}]


TIMEOUT_SCHEMA = "replica_id long, event_id long, timeout double"


def adaptive_timeouts(df: DataFrame, streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "replica_id", ["event_id"], timeout_step, TIMEOUT_SCHEMA)


def redirect_step(ttl: float = 60) -> Step:
    """A bucket's redirect is dropped by the second round of `ttl` seconds that finds it unchanged. row: bucket_id, event_id,
    now, dst (null: a lookup)."""

    def step(state: dict, row: dict) -> list[dict]:
        now = row["now"]
        if state.get("dst") is not None and now // ttl >= state["at"] // ttl + 2:
            state.pop("dst")
        if isinstance(row["dst"], str):
            if state.get("dst") != row["dst"]:
                state["dst"], state["at"] = row["dst"], now
            return []
        return [{"bucket_id": row["bucket_id"], "event_id": row["event_id"], "dst": state.get("dst")}]

    return step


REDIRECT_SCHEMA = "bucket_id long, event_id long, dst string"


def redirects(df: DataFrame, ttl: float = 60, streaming: bool = False) -> DataFrame:
    how = df, "bucket_id", ["event_id"], redirect_step(ttl), REDIRECT_SCHEMA
    return fold_stream(*how, expire=2 * ttl) if streaming else fold(*how)
