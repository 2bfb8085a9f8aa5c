"""Product codes of vectors: codebooks by rounds of exact integer assignment, found by exponion search.

A point starts at the entry that it had in the round before, at squared distance u. An entry
further than twice that distance from the start is further from the point than the start is,
so only the start's neighbours with squared distance up to 4u can be nearest: a prefix of its
list of neighbours, which is sorted once a round. Everything is in integers, so results don't
depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch
from wardline.llm.spread import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond it, scaled, count as it: squared distances of up to 4,096 components then fit 64 bits.
LIMIT = 1 << 24
#: Neighbours that a first look compares; each further look doubles it. Points compared at once.
SHELL, POINTS = 8, 1024


@dataclass(frozen=True)
class Codebook:
    """Entries of one part, and for each entry all entries by distance, then index, itself included."""

    entries: np.ndarray  # (k, width) int64
    order: np.ndarray  # (k, k) int64
    gaps: np.ndarray  # (k, k) int64, squared distances in that order


def codebook(entries: np.ndarray) -> Codebook:
    """A codebook with its sorted lists of neighbours."""
    gaps = np.stack([((entries - e) ** 2).sum(1) for e in entries]) if len(entries) else np.zeros((0, 0), np.int64)
    order = np.argsort(gaps, axis=1, kind="stable")
    return Codebook(entries, order, np.take_along_axis(gaps, order, 1))


def nearest(points: np.ndarray, book: Codebook, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index, searched from entry ``start``."""
    best = start.astype(np.int64)
    dist = ((points - book.entries[best]) ** 2).sum(1)
    for a in np.unique(start):
        own = np.flatnonzero(start == a)
        reach = np.searchsorted(book.gaps[a], 4 * dist[own], "right")
        lo, hi = 0, SHELL
        while len(own):
            near = np.sort(book.order[a, lo:hi])  # by index: the first smallest distance is the tie's winner
            for at in range(0, len(own), POINTS):
                rows = own[at : at + POINTS]
                d = ((points[rows, None, :] - book.entries[near]) ** 2).sum(2)
                col = d.argmin(1)
                low, index = d[np.arange(len(rows)), col], near[col]
                better = (low < dist[rows]) | ((low == dist[rows]) & (index < best[rows]))
                dist[rows[better]], best[rows[better]] = low[better], index[better]
            own, reach = own[reach > hi], reach[reach > hi]
            lo, hi = hi, 2 * hi
    return best, dist


def _points(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(rows, parts, width) of a batch's vectors."""
    flat = batch.column("__point").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return batch.column("__code").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(columns.values()), names + list(columns))


def _assigned(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """The rows with the nearest entries to their parts as ``__code`` and the summed squared distance as ``error``."""
    sent, parts = rows.sparkSession.sparkContext.broadcast(books), len(books)  # parts * entries vectors, whatever the data

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            points, codes = _points(batch, parts), _codes(batch, parts)
            found = [nearest(points[:, p], sent.value[p], codes[:, p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], 1)
            yield _with(batch, __code=_lists(code, pa.int16()), error=pa.array(np.sum([f[1] for f in found], axis=0), pa.int64()))

    names = [c for c in rows.columns if c not in ("__code", "error")]
    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "__code array<smallint>", "error long"])
    return rows.mapInArrow(run, schema)


def _moved(rows: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Each entry at the floor of the mean of its parts; one without parts stays.

    Tasks sum what they hold, Spark adds the sums up, and a row for each component of each entry reaches the driver.
    """
    parts, (k, width) = len(books), books[0].entries.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in it:
            if batch.num_rows:
                points, codes = _points(batch, parts), _codes(batch, parts)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], points[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=k)
        cell = np.flatnonzero(count.ravel())
        where = (cell[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(sums.reshape(-1, width)[cell].ravel()), pa.array(np.repeat(count.ravel()[cell], width))], ["place", "total", "n"])

    total = rows.mapInArrow(run, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    flat = np.stack([b.entries for b in books]).ravel()
    at, sums, n = (total.column(c).to_numpy() for c in ("place", "total", "n"))
    flat[at] = sums // n
    return [codebook(e) for e in flat.reshape(parts, k, width)]


def integers(vectors: DataFrame, vector: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The rows whose vector is whole, with it as integers in ``__point``: floor(scale * x), at most LIMIT away from 0."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    scaled = lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v.cast("double") * scale))).cast("int")
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0)).filter(whole).withColumn("__point", F.transform(x, scaled))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((key, ``keep``, code, error) of each whole vector, codebooks as (part, entry, position)).

    A codebook starts as the parts of the ``entries`` rows smallest by key (nulls last), then by vector;
    with fewer rows it has fewer entries. Each round assigns all parts and moves the entries, and a last pass
    assigns again. ``code`` holds an index for each part, ``error`` the squared distances summed.

    Left out are vectors that are null, empty, hold null or non-finite components, can't be cut into
    ``parts``, or haven't the length of the smallest key's. Repeated rows give repeated results and count as
    often; an empty table gives no rows and no entries. Columns but key, vector and ``keep`` play no part.
    Only the codebooks pass the driver; each round is a written table, so that a lost executor costs no round.
    """
    if not 0 < entries <= 1 << 15 or parts < 1:
        raise ValueError("entries must be between 1 and 32,768 and parts at least 1")
    scratch = Scratch(vectors.sparkSession)
    names = [key, *keep]
    whole = integers(vectors.select(*names, F.col(vector).alias("__vector")), "__vector", scale, parts).select(*names, "__point")
    first = whole.orderBy(F.col(key).asc_nulls_last(), "__point").limit(entries).select("__point").collect()
    first = [r[0] for r in first if len(r[0]) == len(first[0][0])]
    code = F.col("__code").alias("code")
    if not first:
        empty = whole.filter("false").withColumn("__code", F.array().cast("array<smallint>")).withColumn("error", F.lit(0).cast("long"))
        return scratch.keep(empty.select(*names, code, "error")), np.zeros((parts, 0, 0), np.int64)
    start = np.array(first, np.int64).reshape(len(first), parts, -1)
    books = [codebook(start[:, p]) for p in range(parts)]
    nowhere = F.array_repeat(F.lit(0).cast("smallint"), parts)
    rows = whole.filter(F.size("__point") == len(first[0])).withColumn("__code", nowhere)
    for _ in range(rounds):
        rows, old = scratch.keep(_assigned(rows, books)), rows
        books = _moved(rows, books)
        if hasattr(old, "_wardline_path"):
            scratch.drop(old)
    out = scratch.last(_assigned(rows, books).select(*names, code, "error"))
    return out, np.stack([b.entries for b in books])


def decode(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE, code: str = "code") -> DataFrame:
    """The rows with ``approximate``: the vector that each code stands for (entries are sent along as a literal)."""
    table = F.from_json(F.lit(str(codebooks.tolist())), "array<array<array<bigint>>>")
    pick = F.transform(code, lambda c, p: F.element_at(F.element_at(table, p + 1), c.cast("int") + 1))
    return codes.withColumn("approximate", F.transform(F.flatten(pick), lambda v: (v + F.lit(0.5)) / F.lit(float(scale))))


def error_by(rows: DataFrame, label: str) -> DataFrame:
    """The rows with ``label_error``: the error summed over rows of equal label, nulls together.

    Sums are partial before they are shuffled, and frequent labels are split when they are joined back.
    """
    named = rows.withColumn("__no", F.col(label).isNull()).withColumn("__label", F.coalesce(F.col(label).cast("string"), F.lit("")))
    total = named.groupBy("__no", "__label").agg(F.sum("error").alias("label_error"))
    return spread_join(named, total, ["__no", "__label"], ["code", "error"]).drop("__no", "__label")
