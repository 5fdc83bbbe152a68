"""Sessions as a state machine over a stream of events, with timers; and answers that are kept for a while.

Both keep their state in RocksDB (`stateful` sets the provider) and bound it by event time: a session that says nothing
for `idle` seconds, and a kept answer when its time is over, leave the state by a timer that the watermark fires. That
takes the place of a fixed number of sessions of which the least recently used goes: what goes is what wasn't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = ("succeeded", "failed", "cancelled")
#: Events of a session that wait for an earlier one, at most; beyond that the gap is passed over.
WAITING = 1_000

STATE = "status string, model string, tier int, failures int, escalations int, repairs int, iterations int, ended_at long, next_seq long, last_at long"
OUT = f"session long, {STATE.partition(', next_seq')[0]}, evicted boolean"
START = {"status": "running", "model": None, "tier": 0, "failures": 0, "escalations": 0, "repairs": 0, "iterations": 0, "ended_at": None, "next_seq": 0, "last_at": 0}
EVENT = ["seq", "at", "kind", "action", "failed", "model", "tier"]


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def applied(run: dict, event: dict) -> dict:
    """A run after one event.

    gate: repair, escalate, ask_human, fail or go on, and whether the evidence failed. finish: the first close stays
    unless it failed later. approve moves a run to a model, reject fails a blocked one."""
    r, kind, action = dict(run), event["kind"], event["action"]
    if kind == "gate":
        up = action == "escalate"
        r["iterations"] += 1
        r["failures"] = 0 if up or not event["failed"] else r["failures"] + 1
        r["repairs"] += action == "repair"
        r["escalations"] += up
        if up:
            r["model"], r["tier"] = event["model"], event["tier"]
        r["status"] = {"fail": "failed", "ask_human": "blocked"}.get(action, "running")
        if action == "fail":
            r["ended_at"] = event["at"]
    elif kind == "finish" and action in CLOSED:
        if r["status"] != "failed" and (r["ended_at"] is None or action == "failed"):
            r["status"] = action
        r["ended_at"] = event["at"] if r["ended_at"] is None else r["ended_at"]
    elif kind == "approve" and event["model"]:
        r.update(model=event["model"], tier=event["tier"], status="running", escalations=r["escalations"] + 1, failures=0)
    elif kind == "reject" and r["status"] == "blocked":
        r.update(status="failed", ended_at=event["at"] if r["ended_at"] is None else r["ended_at"])
    return r


def _plain(x: Any) -> Any:
    """A value of a pandas row as Python has it; missing ones are None."""
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) else x  # whole numbers with gaps come as floats


class Sessions(StatefulProcessor):
    """Events of a session are applied by seq, each once; those that come before their turn wait, WAITING at most."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)
        self.waiting = handle.getMapState("waiting", "seq long", "at long, kind string, action string, failed boolean, model string, tier int")

    def _row(self, key: tuple, run: dict, evicted: bool) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame([[key[0], *(run[c] for c in names[1:-1]), evicted]], columns=names).astype({"ended_at": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = list(START)
        run = dict(zip(names, self.run.get(), strict=True)) if self.run.exists() else dict(START)
        events = {k[0]: dict(zip(EVENT, (k[0], *v), strict=True)) for k, v in self.waiting.iterator()}
        held = set(events)
        for batch in rows:
            for values in batch[EVENT].itertuples(index=False):
                event = dict(zip(EVENT, map(_plain, values), strict=True))
                if event["seq"] >= run["next_seq"]:  # else it was applied before
                    events.setdefault(event["seq"], event)
                run["last_at"] = max(run["last_at"], event["at"])
        while events and (run["next_seq"] in events or len(events) > WAITING):
            event = events.pop(min(events))
            run = applied(run, event)
            run["next_seq"] = event["seq"] + 1
        for seq in held - set(events):
            self.waiting.removeKey((seq,))
        for seq in set(events) - held:
            self.waiting.updateValue((seq,), tuple(events[seq][c] for c in EVENT[1:]))
        self.run.update(tuple(run[c] for c in names))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer((run["last_at"] + self.idle) * 1000)
        yield self._row(key, run, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The session is idle: what still waits is applied over its gaps, and the state goes."""
        run = dict(zip(list(START), self.run.get(), strict=True)) if self.run.exists() else dict(START)
        for event in sorted(({**dict(zip(EVENT[1:], v, strict=True)), "seq": k[0]} for k, v in self.waiting.iterator()), key=lambda e: e["seq"]):
            run = applied(run, event)
        self.run.clear()
        self.waiting.clear()
        yield self._row(key, run, True)

    def close(self) -> None:
        pass


def session_runs(events: DataFrame, ts: str, idle: int = 3_600, late: str = "10 minutes") -> DataFrame:
    """The state of each session that an event touched, and of those that go idle (evicted), in update mode.

    events: session (long), seq (long, from 0), kind, action, failed, model, tier, and a time ts. Repeated events are
    applied once, those out of order when their turn comes; events behind the watermark are dropped by Spark. A session
    that speaks again after it was evicted starts anew at the seq it comes with, once that is its turn or WAITING is full.
    """
    rows = events.withWatermark(ts, late).selectExpr("CAST(session AS LONG) AS session", "CAST(seq AS LONG) AS seq", f"CAST(unix_timestamp({ts}) AS LONG) AS at", "kind", "action", "failed", "model", "CAST(tier AS INT) AS tier", ts)
    return rows.groupBy("session").transformWithStateInPandas(Sessions(idle), OUT, "Update", "EventTime")


class Answers(StatefulProcessor):
    """One answer's time for each key: until when it is kept."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        for batch in rows:
            batch = batch.sort_values(["at", "id"], kind="stable")
            hits = []
            for at, human, failed in zip(batch["at"], batch["needs_human"], batch["failed"], strict=True):
                hit = until is not None and at < until
                if not hit and not human and not failed:
                    until = int(at) + self.ttl
                    self.handle.registerTimer(until * 1000)
                hits.append(hit)
            yield pd.DataFrame({"id": batch["id"], "key": key[0], "cached": hits})
        if until is not None:
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "key": pd.Series([], dtype="object"), "cached": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ts: str, ttl: int, late: str = "10 minutes") -> DataFrame:
    """id, key, cached of each request of a stream (id, key, needs_human, failed, and a time ts): `merges.cached` as a
    stream. Requests of a batch are read in order of time; an answer's state goes when its time is over."""
    rows = requests.withWatermark(ts, late).selectExpr("id", "key", f"CAST(unix_timestamp({ts}) AS LONG) AS at", "needs_human", "failed", ts).where("key IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(Answers(ttl), "id long, key string, cached boolean", "Append", "EventTime")


RUN = "run string, tools long, status string, ended boolean"


class Runs(StatefulProcessor):
    """The lines of a run of server-sent events: tool starts up to the first terminal event, in the order of their
    numbers, in whatever order they come. A run leaves the state when it was silent for a while."""

    def __init__(self, terminal: tuple[str, ...], idle: int):
        self.terminal, self.idle = terminal, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.tools = handle.getMapState("tools", "n long", "seen boolean")
        self.end = handle.getValueState("end", "n long, type string, at long")

    def _row(self, key: tuple, end: tuple, ended: bool) -> pd.DataFrame:
        count = sum(1 for k in self.tools.keys() if end[0] is None or k[0] < end[0])  # noqa: SIM118
        return pd.DataFrame({"run": [key[0]], "tools": [count], "status": pd.Series([end[1]], dtype="object"), "ended": [ended]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, kind, last = self.end.get() if self.end.exists() else (None, None, 0)
        for batch in rows:
            for at, place, name in zip(batch["at"], batch["n"], batch["type"], strict=True):
                last = max(last, int(at))
                if name in self.terminal and (n is None or place < n):
                    n, kind = int(place), name
                elif name == "tool.started" and (n is None or place < n):
                    self.tools.updateValue((int(place),), (True,))
        for k in [k[0] for k in self.tools.keys()]:  # noqa: SIM118
            if n is not None and k > n:
                self.tools.removeKey((k,))
        self.end.update((n, kind, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer((last + self.idle) * 1000)
        yield self._row(key, (n, kind), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, self.end.get()[:2] if self.end.exists() else (None, None), True)
        self.tools.clear()
        self.end.clear()
        yield row

    def close(self) -> None:
        pass


def run_events(lines: DataFrame, ts: str, terminal: tuple[str, ...] = ("run.completed", "run.failed", "run.cancelled"), idle: int = 3_600, late: str = "10 minutes") -> DataFrame:
    """`files.event_stream` as a stream: lines (run, n, line, and a time ts) become run, tools, status and ended, after
    each batch that told of the run and once more when it leaves the state. Lines that are no data are left out."""
    body = "regexp_extract(line, '^data:\\\\s?(.*)$', 1)"
    kind = f"coalesce(get_json_object({body}, '$.event'), get_json_object({body}, '$.type'))"
    rows = lines.withWatermark(ts, late).where("line LIKE 'data:%'").selectExpr("CAST(run AS STRING) AS run", "CAST(n AS LONG) AS n", f"{kind} AS type", f"CAST(unix_timestamp({ts}) AS LONG) AS at", ts)
    return rows.groupBy("run").transformWithStateInPandas(Runs(terminal, idle), RUN, "Update", "EventTime")
