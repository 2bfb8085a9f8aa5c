"""Streams with state of their own for each key: values and lists in the state store, timers that forget.

These need the RocksDB state store, which comes with Spark; ``use_state_store`` sets it where the session has none set.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wardline.operators import folds
from wardline.operators.campaigns import FOUND_AT, JOIN_AT

#: How late a row may come, and how long after its last row a key is remembered, in the time of the rows.
LATE, IDLE_MS = "10 minutes", 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, unless another such store is set."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, in time order; its parts may come in any order."""
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class Stepped(StatefulProcessor):
    """A step function over the rows of each key, with its state as one value; a key idle for ``idle_ms`` is forgotten."""

    def __init__(self, step: folds.Step, state: str, order: list[str], columns: list[str], pack: Any = None, unpack: Any = None, idle_ms: int = IDLE_MS):
        self.step, self.shape, self.order, self.columns, self.idle_ms = step, state, order, columns, idle_ms
        self.pack, self.unpack = pack or (lambda s: s), unpack or (lambda s: s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.shape)
        self.seen = handle.getValueState("seen", "last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, self.order)
        state = self.unpack(tuple(self.value.get())) if self.value.exists() else None
        out, last = [], 0
        for row in batch.to_dict("records"):
            state, made = self.step(state, row)
            out.append(made)
            last = max(last, row["us"] // 1000)
        self.value.update(self.pack(state))
        if self.seen.exists():
            last = max(last, self.seen.get()[0])
        self.seen.update((int(last),))
        self.handle.registerTimer(max(int(timerValues.getCurrentWatermarkInMs()), int(last)) + self.idle_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
            self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stepped(rows: DataFrame, key: str, processor: StatefulProcessor, output: str) -> DataFrame:
    use_state_store(rows.sparkSession)
    timed = rows.withWatermark("ts", LATE).withColumn("us", folds.micros(F.col("ts")))
    return timed.groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime")


def rate_limited(rows: DataFrame, per_minute: float, burst: int) -> DataFrame:
    """(client, ts, allowed): a token bucket for each client, refilled by the time between its calls.

    A client idle for IDLE_MS is forgotten, and starts with a full bucket.
    """
    columns = ["client", "ts", "allowed"]
    step = folds.token_bucket(per_minute, burst, ("client", "ts"))
    return _stepped(rows, "client", Stepped(step, "tokens double, last long", ["us"], columns), "client string, ts timestamp, allowed boolean")


def breaker_events(rows: DataFrame, threshold: int = 4, cooldown: float = 120.0) -> DataFrame:
    """(provider, ts, state): closed, open or half-open before each call; consecutive failures open it."""
    columns = ["provider", "ts", "state"]
    step = folds.circuit_breaker(threshold, cooldown, ("provider", "ts"))
    return _stepped(rows, "provider", Stepped(step, "failures int, opened long", ["us"], columns), "provider string, ts timestamp, state string")


def campaign_events(rows: DataFrame, key: str = "channel", join_at: float = JOIN_AT, found_at: float = FOUND_AT, idle_ms: int = 14 * 86_400_000) -> DataFrame:
    """(key, id, ts, campaign, how, similarity) of messages (key, id, ts, vector, risk): campaigns are found and joined message by message,
    in time order (ties: by id), also within a micro-batch. ``operators.campaigns.online`` is the batch twin."""
    use_state_store(rows.sparkSession)
    kind, ident = rows.schema[key].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    columns = [key, "id", "ts", "campaign", "how", "similarity"]
    pack = lambda s: ([c[0] for c in s], [c[1] for c in s], [float(x) for c in s for x in c[2]], [c[3] for c in s])

    def unpack(s: tuple) -> list:
        ids, n, flat, last = s
        return [(i, k, np.asarray(v), t) for i, k, v, t in zip(ids, n, np.asarray(flat, np.float64).reshape(len(ids), -1) if len(ids) else [], last, strict=True)]

    step = folds.online_campaigns(join_at, found_at, (key, "id", "ts"))
    shape = f"ids array<{ident}>, n array<long>, totals array<double>, last array<long>"
    return _stepped(rows, key, Stepped(step, shape, ["us", "id"], columns, pack, unpack, idle_ms), f"{key} {kind}, id {ident}, ts timestamp, campaign {ident}, how string, similarity double")


class Cached(StatefulProcessor):
    """Look-ups answered from what the key's rows have brought within ``hours``; entries leave the state by a timer once they are older."""

    def __init__(self, hours: float):
        self.width = int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "fetched_us long, value double")

    def _kept(self, since: int) -> list[tuple[int, float]]:
        return [tuple(e) for e in self.entries.get() if e[0] > since] if self.entries.exists() else []

    def _store(self, kept: list[tuple[int, float]]) -> None:
        self.entries.put(kept) if kept else self.entries.clear()
        if kept:
            self.handle.registerTimer(min(t for t, _ in kept) // 1000 + self.width // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["us"])
        kept = dict(self._kept(int(timerValues.getCurrentWatermarkInMs()) * 1000 - self.width))
        brought = batch[batch["value"].notna()]
        for t, v in brought.groupby("us")["value"].max().items():  # of entries of one time the greatest counts
            kept[int(t)] = max(float(v), kept.get(int(t), float("-inf")))
        times = np.array(sorted(kept), np.int64)
        asked = batch["us"].to_numpy(np.int64)
        at = np.searchsorted(times, asked, "right") - 1
        found = [kept[int(times[k])] if k >= 0 and times[k] > t - self.width else None for k, t in zip(at, asked, strict=True)]
        self._store(sorted(kept.items()))
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "value": pd.array(found, "Float64")})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._store(self._kept(expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width))
        return iter([])

    def close(self) -> None:
        pass


def cached_stream(rows: DataFrame, key: str, hours: float = 6.0, late: str = LATE) -> DataFrame:
    """(id, value) of look-ups (key, id, ts, value): the value that the key's latest row with one brought, no older than ``hours``.

    A row with a value brings it and is answered with it; one without only asks. The time is the rows' own: an entry is
    forgotten by a timer when the watermark has passed the end of its ``hours``, so state holds no more than
    they brought. ``queries.cached_lookup`` is the batch twin.
    """
    use_state_store(rows.sparkSession)
    ident = rows.schema["id"].dataType.simpleString()
    timed = rows.withWatermark("ts", late).withColumn("us", folds.micros(F.col("ts")))
    return timed.groupBy(key).transformWithStateInPandas(Cached(hours), f"id {ident}, value double", "Append", "EventTime")


class Fetched(StatefulProcessor):
    """The last value of each key, which the state store itself forgets after a time to live by the clock."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if batch["value"].notna().any():
            self.entry.update((float(batch["value"].max()),))
        value = self.entry.get()[0] if self.entry.exists() else None
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "value": pd.array([value] * len(batch), "Float64")})

    def close(self) -> None:
        pass


def cached_by_clock(rows: DataFrame, key: str, hours: float = 6.0) -> DataFrame:
    """Like ``cached_stream``, by the clock instead of the rows' time: entries carry a time to live in the state store."""
    use_state_store(rows.sparkSession)
    ident = rows.schema["id"].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Fetched(int(hours * 3_600_000)), f"id {ident}, value double", "Append", "ProcessingTime")
