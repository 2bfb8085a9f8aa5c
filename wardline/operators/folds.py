"""Folds over the time-ordered rows of each key, in a batch and in a stream, by the same step functions.

In a batch the rows are dealt by key and sorted by key and time within each partition; a task walks through them
once and keeps one state, so a key with a third of all rows is streamed, never listed. In a stream the state of each key
is in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A step takes a key's state (None before its first row) and a row, and gives the new state and what the row yields.
Step = Callable[[Any, dict], tuple[Any, dict]]


def fold(rows: DataFrame, keys: list[str], order: list[str | Column], step: Step, output: str) -> DataFrame:
    """Rows of ``output``: what ``step`` yields for each row, in ``order`` (all columns that break ties included), key by key.

    Null keys are a key. A lost task walks through its partition again, from its first row.
    """
    kind = rows.sparkSession.createDataFrame([], output).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, arrow = None, None, to_arrow_schema(StructType.fromJson(shape), timestamp_utc=True)
        for batch in it:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, None
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, arrow)

    shape = kind.jsonValue()
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def token_bucket(per_minute: float, burst: float, keep: tuple[str, ...]) -> Step:
    """Rows (us: microseconds) with ``allowed``: a bucket of ``burst`` tokens that fills by the time between calls."""

    def step(state: tuple[float, int] | None, row: dict) -> tuple[tuple[float, int], dict]:
        tokens, last = state or (float(burst), row["us"])
        tokens = min(float(burst), tokens + max(0, row["us"] - last) * per_minute / 60e6)
        ok = tokens >= 1
        return (tokens - ok, row["us"]), {**{k: row[k] for k in keep}, "allowed": ok}

    return step


def circuit_breaker(threshold: int, cooldown: float, keep: tuple[str, ...]) -> Step:
    """Rows (us, failed) with ``state`` before each call: closed, open or half-open, and ``failures`` in a row after it.

    Calls while it is open are refused and change nothing. After the cooldown one is tried: if it
    fails, the breaker is open again from then on, if not, closed.
    """

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], dict]:
        failures, opened = state or (0, 0)
        now = "closed" if failures < threshold else "half-open" if row["us"] - opened > cooldown * 1e6 else "open"
        if now != "open":
            failures = failures + 1 if row["failed"] else 0
            opened = row["us"] if failures >= threshold else opened
        return (int(failures), int(opened)), {**{k: row[k] for k in keep}, "state": now, "failures": int(failures)}

    return step


#: Campaigns that a key remembers: those that got a message last.
MOST_CAMPAIGNS = 200


def online_campaigns(join_at: float, found_at: float, keep: tuple[str, ...], most: int = MOST_CAMPAIGNS) -> Step:
    """Rows (id, us, vector, risk) with ``campaign`` (the id of its first message), ``how`` (joined, founded, none) and ``similarity``.

    A message joins the campaign whose centre, the running mean of its messages, is nearest by cosine, if that
    reaches ``join_at`` (ties: the older campaign); else it founds one if its risk reaches ``found_at``. So a message may join what the one
    before it founded. Vectors that are null or of length 0 join nothing. State: at most ``most`` campaigns, those with the latest message.
    """

    def step(state: list | None, row: dict) -> tuple[list, dict]:
        state = state or []  # (founder, number of messages, sum of vectors, time of the last message), by founding
        v = None if row["vector"] is None else np.asarray([0.0 if x is None else x for x in row["vector"]], np.float64)
        norm = 0.0 if v is None else float(np.sqrt(v @ v))
        best, near = None, 0.0
        if norm and state:
            sums = np.stack([c[2] for c in state])
            like = np.round(np.maximum(0.0, sums @ v / np.maximum(np.sqrt((sums * sums).sum(1)) * norm, 1e-300)), 9)
            k = int(like.argmax())
            best, near = k, float(like[k])
        out = {**{k: row[k] for k in keep}, "campaign": None, "how": "none", "similarity": near}
        if best is not None and near >= join_at:
            founder, n, total, _ = state[best]
            state = [*state[:best], (founder, n + 1, total + v, row["us"]), *state[best + 1 :]]
            out |= {"campaign": founder, "how": "joined"}
        elif norm and row["risk"] is not None and row["risk"] >= found_at:
            state = [*state, (row["id"], 1, v, row["us"])]
            out |= {"campaign": row["id"], "how": "founded"}
            if len(state) > most:
                oldest = min(range(len(state)), key=lambda k: (state[k][3], k))
                state = state[:oldest] + state[oldest + 1 :]
        return state, out

    return step


def micros(time: Column) -> Column:
    """Microseconds of a time, as the steps count it."""
    return F.unix_micros(time.cast("timestamp"))
