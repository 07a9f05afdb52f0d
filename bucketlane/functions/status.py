"""Bucket statuses: predicates, the allowed changes, access and recovery decisions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses and the allowed changes between them (None: no row).
ACTIVE, PINNED, READONLY, SENDING, SENT, RECEIVING, GARBAGE = "active", "pinned", "readonly", "sending", "sent", "receiving", "garbage"
STATUSES = (ACTIVE, PINNED, READONLY, SENDING, SENT, RECEIVING, GARBAGE)
EDGES = {
    None: (RECEIVING,),
    ACTIVE: (PINNED, SENDING, READONLY),
    PINNED: (ACTIVE,),
    READONLY: (ACTIVE, SENDING),
    SENDING: (ACTIVE, SENT),
    SENT: (GARBAGE,),
    RECEIVING: (GARBAGE, ACTIVE),
    GARBAGE: (None,),
}


def is_writable(status: Column) -> Column:
    return status.isin(ACTIVE, PINNED)


def is_readable(status: Column) -> Column:
    return status.isin(ACTIVE, PINNED, SENDING, READONLY)


def is_in_transfer(status: Column) -> Column:
    return status.isin(SENDING, RECEIVING, READONLY)


def has_destination(status: Column) -> Column:
    return ~status.isin(ACTIVE, PINNED, READONLY)


def is_edge(old: Column, new: Column) -> Column:
    """Whether the status may change so; null stands for no row. Keeping the status is allowed."""
    ok = old.eqNullSafe(new)
    for a, bs in EDGES.items():
        for b in bs:
            ok = ok | (old.eqNullSafe(F.lit(a)) & new.eqNullSafe(F.lit(b)))
    return ok


def change_error(old: Column, new: Column, old_generation: Column, new_generation: Column, ro: Column, rw: Column) -> Column:
    """Why a change of a bucket is refused, null if it isn't. Null statuses stand for no row."""
    ro, rw = F.coalesce(ro, F.lit(0)), F.coalesce(rw, F.lit(0))
    old_gen, new_gen = F.coalesce(old_generation, F.lit(0)), F.coalesce(new_generation, F.lit(0))
    return (
        F.when(~is_edge(old, new), F.concat(F.lit("prohibited: "), F.coalesce(old, F.lit("nil")), F.lit(" to "), F.coalesce(new, F.lit("nil"))))
        .when(old.isNull() & ((ro > 0) | (rw > 0)), F.lit("new bucket has references"))
        .when(new.isin(SENDING, SENT) & (rw > 0), F.lit("bucket has rw references"))
        .when((new.isNull() | new.isin(GARBAGE, RECEIVING)) & ((ro > 0) | (rw > 0)), F.lit("bucket has references"))
        .when(old.isNotNull() & new.isNotNull() & (old_gen > 0) & (new_gen == 0), F.lit("generation was dropped"))
        .when(old.isNotNull() & (new == SENDING) & (old != SENDING) & (new_gen != old_gen + 1), F.lit("generation must grow by one"))
        .when(old.isNotNull() & new.isin(SENT, GARBAGE) & (new_gen != old_gen), F.lit("generation must stay"))
    )


def access(mode: Column, status: Column, is_master: Column, destination: Column) -> Column:
    """struct<code, reason, destination> of a refused access, null if it is allowed. A null status stands for no row."""
    error = lambda code, reason, dst: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"), dst.cast("string").alias("destination"))
    nowhere = F.lit(None)
    return (
        F.when(status.isNull(), error("WRONG_BUCKET", "Not found", destination))
        .when((mode == "read") & ~is_readable(status), error("WRONG_BUCKET", "read is prohibited", destination))
        .when((mode == "write") & ~is_writable(status) & is_in_transfer(status), error("TRANSFER_IS_IN_PROGRESS", "write is prohibited", destination))
        .when((mode == "write") & ~is_writable(status), error("WRONG_BUCKET", "write is prohibited", destination))
        .when((mode == "write") & ~is_master, error("NON_MASTER", "not a master", nowhere))
        .when(~mode.isin("read", "write"), error("UNKNOWN_MODE", "unknown mode", nowhere))
    )


def recovered(local: Column, local_generation: Column, remote: Column, remote_generation: Column, reachable: Column) -> Column:
    """The status a bucket in transfer recovers to, after what the other shard says; its own status if it stays."""
    here, there = F.coalesce(local_generation, F.lit(0)), F.coalesce(remote_generation, F.lit(0))
    return (
        F.when(~is_in_transfer(local), local)
        .when(local == READONLY, F.lit(ACTIVE))
        .when(~reachable, local)
        .when(remote.isNotNull() & (there > here), F.lit(GARBAGE))
        .when(remote.isNotNull() & (there < here), F.lit(ACTIVE))
        .when((local == SENDING) & remote.isin(ACTIVE, PINNED), F.lit(SENT))
        .when((local == RECEIVING) & remote.isin(ACTIVE, PINNED, SENDING), F.lit(GARBAGE))
        .when(remote.isNull() | remote.isin(SENT, GARBAGE), F.lit(ACTIVE))
        .otherwise(local)
    )


def can_retry(name: Column, is_timeout: Column) -> Column:
    """Whether a read can be tried on another replica after this error."""
    return F.coalesce(name.isin("WRONG_BUCKET", "TRANSFER_IS_IN_PROGRESS"), F.lit(False)) | F.coalesce(is_timeout, F.lit(False))


def can_backoff(name: Column, function: Column, service_prefix: str) -> Column:
    """Whether a replica needs a pause after this error: only for the engine's own functions, as others may have had
    effects before they failed."""
    pause = name.isin("ACCESS_DENIED", "NO_SUCH_PROC", "STORAGE_IS_DISABLED", "INSTANCE_NAME_MISMATCH")
    return F.coalesce(pause & F.startswith(function, F.lit(service_prefix)), F.lit(False))
