"""Operators with state a key: sliding-window limits, idempotent requests, replay guards.

What a row gets depends on which earlier rows were let through, so no window function gives it. One step function serves
both forms: in a stream, ``transformWithStateInPandas`` keeps the state of a key and drops it by an event-time timer;
in a batch, rows are dealt by key, sorted by time, and folded as they pass, so a task holds one key's state at a time
(at most ``limit`` times, or one request) and never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shipping import ship

#: Requests let through in a window, its seconds, the life of a kept response, and the tolerance of a signature's time.
CONTACT_LIMIT, CONTACT_WINDOW_S = 10, 60
IDEMPOTENCY_S = 24 * 3600
REPLAY_TOLERANCE_S = 300


def let_through(state: list[int], row: dict, limit: int, window_us: int) -> tuple[list[int], str]:
    """The times let through within the window, and whether the row is. A time exactly one window old still counts."""
    held = [t for t in state if t >= row["us"] - window_us]
    return (held + [row["us"]], "allowed") if len(held) < limit else (held, "limited")


def replayed(state: list, row: dict, ttl_us: int) -> tuple[list, str]:
    """The kept request as [hash, expiry], and what becomes of the row: new, replayed (the same hash) or conflict (another)."""
    if state and state[1] > row["us"]:
        return state, "replayed" if state[0] == row["hash"] else "conflict"
    return [row["hash"], row["us"] + ttl_us], "new"


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[list, dict], tuple[list, str]]) -> DataFrame:
    """``rows`` with an ``outcome``: the step applied to the rows of each key in order. A NULL key is a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state: list = []
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, []
                state, outcome = step(state, row)
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "outcome"])

    ship(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", outcome string"
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sliding_limit(requests: DataFrame, key: str, ts: str, order: str, limit: int = CONTACT_LIMIT, window_s: int = CONTACT_WINDOW_S) -> DataFrame:
    """Batch form: (key, order column, outcome); rejected requests are not recorded. Ties in time go by ``order``."""
    rows = requests.select(F.col(key), F.col(order), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return folded(rows, [key], ["us", order], lambda s, r: let_through(s, r, limit, window_s * 1_000_000)).select(key, order, "outcome")


def idempotent(requests: DataFrame, keys: list[str], ts: str, order: str, request_hash: str, ttl_s: int = IDEMPOTENCY_S) -> DataFrame:
    """Batch form: (keys, order column, outcome)."""
    rows = requests.select(*keys, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(request_hash).alias("hash"))
    return folded(rows, keys, ["us", order], lambda s, r: replayed(s, r, ttl_s * 1_000_000)).select(*keys, order, "outcome")


def replay_guard(calls: DataFrame, call: str, received: str, signed: str, order: str, tolerance_s: int = REPLAY_TOLERANCE_S) -> DataFrame:
    """(order column, outcome): stale if signed too long before or after it came, else accepted the first time and duplicate later."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    rows = calls.select(call, order, F.col(received).alias("at"), F.coalesce(F.abs(seconds(received) - seconds(signed)) > tolerance_s, F.lit(True)).alias("stale"))
    first = rows.filter("NOT stale").groupBy(call).agg(F.min(F.struct("at", order)).alias("first"))
    outcome = F.when(F.col("stale"), "stale").when(F.struct("at", order) == F.col("first"), "accepted").otherwise("duplicate")
    return rows.join(first, call, "left").select(order, outcome.alias("outcome"))


class Folding(StatefulProcessor):
    """The step over a stream: rows of a key in the order of time within each micro-batch; the state goes ``keep_us`` after the last row."""

    def __init__(self, step: Callable[[list, dict], tuple[list, str]], columns: list[str], keep_us: int):
        self.step, self.columns, self.keep_us = step, columns, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "kept string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import json

        frame = pd.concat(list(rows)).sort_values(["us", self.columns[1]], kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else []
        out = []
        for row in frame.to_dict("records"):
            state, outcome = self.step(state, row)
            out.append(outcome)
        self.state.update((json.dumps(state),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(frame["us"].max()) + self.keep_us) // 1000 + 1)
        yield frame[self.columns].assign(outcome=out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed(requests: DataFrame, key: str, order: str, ts: str, extra: list[str], step, keep_us: int, late: str) -> DataFrame:
    ship(requests.sparkSession)
    rows = requests.withWatermark(ts, late).withColumn("us", F.unix_micros(F.col(ts)))
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}
    rows = rows.select(key, order, ts, "us", *extra)
    return rows.groupBy(key).transformWithStateInPandas(Folding(step, [key, order], keep_us), f"{key} {kind[key]}, {order} {kind[order]}, outcome string", "append", "eventTime")


def sliding_limit_stream(requests: DataFrame, key: str, ts: str, order: str, limit: int = CONTACT_LIMIT, window_s: int = CONTACT_WINDOW_S, late: str = "1 minute") -> DataFrame:
    """Streaming form of :func:`sliding_limit`; ts must be a timestamp. Needs the RocksDB state store."""
    us = window_s * 1_000_000
    return streamed(requests, key, order, ts, [], lambda s, r: let_through(s, r, limit, us), us, late)


def idempotent_stream(requests: DataFrame, key: str, ts: str, order: str, request_hash: str, ttl_s: int = IDEMPOTENCY_S, late: str = "1 minute") -> DataFrame:
    """Streaming form of :func:`idempotent` for one key column."""
    us = ttl_s * 1_000_000
    return streamed(requests.withColumn("hash", F.col(request_hash)), key, order, ts, ["hash"], lambda s, r: replayed(s, r, us), us, late)
