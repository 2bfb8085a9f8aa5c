"""Runs of words that repeat with a period, found by divide and conquer, and texts without the repeats.

A text is halved again and again. A run that crosses a midpoint and holds at least four
periods has two of them on one side of it, so its period p shows in that side's Z-function, taken
outwards from the midpoint: Z[p] >= p. Such squares are extended both ways to the run. The first
comparisons of the Z-functions are made for all midpoints of a level of all texts at once; a
midpoint where some period is left gets its whole Z-function, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W

#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Comparisons of each Z-function that all midpoints of a level make together.
LOOK = 6

Run = tuple[int, int, int]  # start, length, period


def z_function(s: list[int]) -> list[int]:
    """For each i the length of the longest common prefix of s and s[i:]; 0 at i = 0."""
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _periods(side: list[int]) -> list[int]:
    """Periods p whose square starts ``side``, without those that a smaller one explains."""
    found, z = [], z_function(side)
    for p in range(1, len(side) // 2 + 1):
        if z[p] >= p and not any(p % q == 0 and q + z[q] >= p + z[p] for q in found):
            found.append(p)
    return found


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How far two arrays agree from their starts."""
    n = min(len(a), len(b))
    size = 64
    for at in range(0, n, size):
        unlike = np.flatnonzero(a[at : min(n, at + size)] != b[at : min(n, at + size)])
        if len(unlike):
            return at + int(unlike[0])
    return n


def _crossing(ids: np.ndarray, lo: int, mid: int, hi: int, right: bool, periods: list[int]) -> Iterator[Run]:
    """The stretches within [lo, hi) around the squares that start at ``mid`` and go right, or left, and are long enough."""
    for p in periods:
        at = mid if right else mid - p  # words at - 1, at and at + p - 1, at + p stand a period apart, from here outwards
        start = at - _reach(ids[lo:at][::-1], ids[lo + p : at + p][::-1])
        end = at + p + _reach(ids[at : hi - p], ids[at + p : hi])
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
            yield start, end - start, p


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, Run]]:
    """(text, run) of all runs, by text, start and period; ``ids`` holds the words of all texts, ``first`` the texts' bounds.

    A run is a maximal stretch with smallest period q of at least 6 words and 4 q. It lies within the part
    whose midpoint is the first one to cut it, so nothing beyond a part is looked at; what reaches a part's end is
    cut short there and belongs to a part above. Of equal stretches the smallest period is kept.
    """
    lo, hi = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    smallest: dict[tuple[int, int], int] = {}
    while len(lo):
        big = hi - lo >= LEAST_WORDS
        lo, hi = lo[big], hi[big]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        for part, right in _looked_at(ids, lo, mid, hi):
            a, m, b = int(lo[part]), int(mid[part]), int(hi[part])
            side = ids[m:b] if right else ids[a:m][::-1]
            for start, length, p in _crossing(ids, a, m, b, right, _periods(side.tolist())):
                cut = (start > 0 and start == a and not _starts_text(first, a) and ids[a - 1] == ids[a - 1 + p]) or (start + length == b and not _starts_text(first, b) and ids[b] == ids[b - p])
                if not cut and smallest.get((start, length), p) >= p:
                    smallest[start, length] = p
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    out = sorted((start, p, length) for (start, length), p in smallest.items())
    text = np.searchsorted(first, [s for s, _, _ in out], "right") - 1
    return [(int(t), (s - int(first[t]), length, p)) for t, (s, p, length) in zip(text, out, strict=True)]


def _starts_text(first: np.ndarray, at: int) -> bool:
    k = int(np.searchsorted(first, at))
    return k < len(first) and first[k] == at


def _looked_at(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> list[tuple[int, bool]]:
    """(part, side) of the midpoints beside which a square may start, by LOOK comparisons of each Z-function."""
    out = []
    for right in (True, False):
        size = (hi - mid if right else mid - lo) // 2
        part = np.repeat(np.arange(len(lo)), size)
        p = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + 1
        sign = 1 if right else -1
        at = mid[part] if right else mid[part] - 1
        for k in range(LOOK):
            same = (ids[at + sign * k] == ids[at + sign * (p + k)]) if k == 0 else (p <= k) | (ids[at + sign * np.minimum(k, p - 1)] == ids[at + sign * (p + np.minimum(k, p - 1))])
            part, p, at = part[same], p[same], at[same]
        out += [(int(k), right) for k in np.unique(part)]
    return out


def interned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids of the words, n + 1 bounds, the words) of texts; null counts as empty. Equal words have equal ids."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    flat, of = flat.filter(some), of[some.to_numpy(zero_copy_only=False)]
    return flat.dictionary_encode().indices.to_numpy().astype(np.int32), np.searchsorted(of, np.arange(len(texts) + 1)), flat


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """True for the words that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        step[start + p] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: its runs by start and period, and its words without the repeats.

    Words are stretches without ASCII white space, letter case counts. ``runs`` is an array of (start, length,
    period) in words; ``collapsed`` holds the words that no run has after its first period, joined by one space.
    Null and empty texts have no runs and an empty ``collapsed``. A text of n words costs n log n, however
    it repeats, and is worked on by one task, whole. Repeated rows give repeated results; other columns play no part.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 2 << 20, "__text"):
            ids, first, flat = interned(b.column("__text"))
            found: list[list[Run]] = [[] for _ in range(b.num_rows)]
            for t, r in find_runs(ids, first):
                found[t].append(r)
            keep = np.ones(len(ids), bool)
            for t, rs in enumerate(found):
                if rs:
                    keep[first[t] : first[t + 1]] = ~dropped(int(first[t + 1] - first[t]), rs)
            left = np.concatenate([[0], np.cumsum(keep)])[first]
            words = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(keep)))
            bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            columns = [pa.array([r[k] for rs in found for r in rs], pa.int64()) for k in range(3)]
            runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            collapsed = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(np.diff(first), pa.int64()), runs, collapsed], [key, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: F.Column) -> F.Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
