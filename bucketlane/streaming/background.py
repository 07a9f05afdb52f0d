"""Background work: moves between replicas as their health changes, services that run by deadlines, and functions that run
again and again beside the engine."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from bucketlane.sources.model import FAILOVER_UP_TIMEOUT
from bucketlane.streaming.state import Step, fold, fold_stream

log = logging.getLogger(__name__)


def failover_step(up_timeout: float = FAILOVER_UP_TIMEOUT) -> Step:
    """Which replica a shard's reads go to. row: rs_id, event_id, now, place (a replica's priority, 1 is nearest), healthy,
    places (how many there are). Once in up_timeout seconds the nearest healthy one before the present one is taken; the
    clock starts anew only when the nearest of all is found well. Whenever the present one is ill, the next one is taken,
    whatever its health; the last one stays."""

    def step(state: dict, row: dict) -> list[dict]:
        ill, now = state.setdefault("ill", []), row["now"]
        at = state.get("at", 1)
        if row["healthy"]:
            ill[:] = [p for p in ill if p != row["place"]]
        elif row["place"] not in ill:
            ill.append(int(row["place"]))
        if state.get("up") is None or now - state["up"] >= up_timeout:
            if at == 1:
                if 1 not in ill:
                    state["up"] = now
            else:
                at = next((p for p in range(1, at) if p not in ill), at)
        if at in ill and at < row["places"]:
            at += 1
        state["at"] = at
        return [{"rs_id": row["rs_id"], "event_id": row["event_id"], "place": at}]

    return step


FAILOVER_SCHEMA = "rs_id string, event_id long, place long"


def failovers(df: DataFrame, up_timeout: float = FAILOVER_UP_TIMEOUT, streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "rs_id", ["event_id"], failover_step(up_timeout), FAILOVER_SCHEMA)


def worker_step(intervals: dict[str, float]) -> Step:
    """Services of an owner that run when their deadline has come. row: owner, event_id, now, wake (a service that is woken
    up, or null), fails (a service that would fail now, or null). A service that fails is due again at once; others after
    their interval. New services are due."""

    def step(state: dict, row: dict) -> list[dict]:
        due, out = state.setdefault("due", {}), []
        if isinstance(row["wake"], str) and row["wake"] in intervals:
            due[row["wake"]] = 0
        for name in sorted(intervals):
            if row["now"] >= due.get(name, 0):
                ok = row["fails"] != name
                due[name] = row["now"] + intervals[name] if ok else 0
                out.append({"owner": row["owner"], "event_id": row["event_id"], "service": name, "ok": ok})
        return out

    return step


WORKER_SCHEMA = "owner long, event_id long, service string, ok boolean"


def worker_runs(df: DataFrame, intervals: dict[str, float], streaming: bool = False) -> DataFrame:
    return (fold_stream if streaming else fold)(df, "owner", ["event_id"], worker_step(intervals), WORKER_SCHEMA)


class Background:
    """A thread that calls a function again and again until it's stopped. The function is looked up before each call, so a
    new one takes over at the next call; a call that fails is logged and tried again after `pause` seconds. The function
    returns how many seconds to wait."""

    def __init__(self, name: str, find: Callable[[], Callable], data=None, pause: float = 0.1):
        self.name, self.failures, self.calls = name, 0, 0
        self._find, self._data, self._pause = find, data, pause
        self._stop, self._wake = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._run, name=name, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                wait = self._find()(self._data)
                self.calls += 1
            except Exception:
                log.exception("%s failed", self.name)
                self.failures, wait = self.failures + 1, self._pause
            self._wake.wait(wait if wait is not None else self._pause)
            self._wake.clear()

    def wakeup(self) -> None:
        self._wake.set()

    def stop(self, timeout: float | None = None) -> bool:
        """Whether it has ended within `timeout` seconds."""
        self._stop.set()
        self._wake.set()
        self._thread.join(timeout)
        return not self._thread.is_alive()
