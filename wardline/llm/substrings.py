"""Bytes of repeated substrings removed from texts, by suffix arrays of shards.

A match is a window of LENGTH bytes that also starts earlier, in document order. Windows that are
equal must meet in one shard, wherever they stand:

1. Each window names an anchor, the KGRAM bytes in it with the smallest hash (the first of them). Equal windows
   name equal anchors. Neighbouring windows with one anchor form a segment, some 35 windows long.
2. Sieve: anchors, and whether their segments differ, are told over all texts. Only segments whose anchor occurs again
   go on, with their bytes where the anchor has different ones.
3. Equal segments are one from here on (partial minima): the first stays, of the others all windows are repeats. So a
   group of copies of any size, or a passage that a third of all texts holds, is one segment a place.
4. The different segments of an anchor go to one shard. A shard sorts the suffixes of its segments (induced
   sorting) and takes their permuted common prefixes; suffixes next to each other with LENGTH bytes in common
   are equal windows, of which all but the first are repeats.
5. An anchor with more than SETS different segments, such as the edge of a passage that very many texts quote, would
   fill a shard by itself. Its segments are cut into two by where the anchor stands in a window, and the bytes that all
   windows of a half have in common are the new anchor; equal halves are one again. That goes on, at most until
   windows stand alone, whose anchor is the whole window.
6. Covered bytes leave each text.

Nothing in a step holds more than a text, a shard of about SHARD_BYTES or a row a task for any key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import suffixes
from wardline.llm import words as W
from wardline.llm.scratch import Scratch, bitmap
from wardline.llm.spread import spread_join

LENGTH, KGRAM = 100, 32
#: Bytes of segments that a shard is meant for, and different segments of an anchor up to which it is whole.
SHARD_BYTES, SETS = 1 << 20, 1024
#: Bits of the sieve at most (64 MB): with more anchors some pass that needn't, which costs time only.
FILTER_BITS = 1 << 29
BATCH_BYTES = 1 << 20

_U = np.uint64
_TABLES = [W.mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) for k in range(2)]
_BASES = (0x5851F42D4C957F2F, 0x2545F4914F6CDD1F)
_POSITION = "none boolean, id long, tie long"


def _rolled(raw: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from each place on."""
    h, k = _TABLES[which][raw], 1
    while k < size:
        h, k = _doubled(h, k, which), 2 * k
    return h


def _doubled(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of twice as many bytes, from those of ``size``."""
    return h[:-size] * _U(pow(_BASES[which], size, 1 << 64)) + h[size:] if len(h) > size else h[:0]


def _digest(rolled: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of 64 to 192 bytes, from the hashes of 64."""
    last = end - 64
    return W.mix(W.combine([rolled[start], rolled[start + np.minimum(52, last - start)], rolled[last]]) + (end - start).astype(np.uint64))


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        h, k = np.minimum(h[:-k], h[k:]), 2 * k
    rest = width - k
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Segments:
    """Segments of a batch of texts, in order: text, first byte in the batch, number of windows, anchor."""

    def __init__(self, texts: pa.Array):
        self.raw, self.off = W.utf8(texts)
        windows = np.maximum(0, np.diff(self.off) - LENGTH + 1)
        total = int(windows.sum())
        empty = np.zeros(0, np.int64)
        self.text, self.start, self.windows, self.at, self.anchor = empty, empty, empty, empty, empty.astype(np.uint64)
        self.rolled = self.anchor
        if not total:
            return
        rolled = _rolled(self.raw, KGRAM)
        gram = W.mix(rolled)
        self.rolled = _doubled(rolled, KGRAM)
        place = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        best = _minima(place, LENGTH - KGRAM + 1)
        first = np.cumsum(windows) - windows
        at = np.arange(total) + np.repeat(self.off[:-1] - first, windows)
        chosen = (best[at] & _U(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1])]))
        self.start = at[cut]
        self.windows = np.diff(cut, append=total)
        self.text = np.searchsorted(self.off, self.start, "right") - 1
        self.at = chosen[cut]
        self.anchor = gram[self.at]

    @property
    def end(self) -> np.ndarray:
        return self.start + self.windows + LENGTH - 1

    def digest(self) -> np.ndarray:
        """Half of what tells segments apart; the other half is of another base."""
        return _digest(self.rolled, self.start, self.end)

    def only(self, keep: np.ndarray) -> None:
        for name in ("text", "start", "windows", "at", "anchor"):
            setattr(self, name, getattr(self, name)[keep])


def _anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each anchor occurs, and the smallest and the largest digest of its segments."""
    for b in W.batches(it, BATCH_BYTES, lean=False):
        s = Segments(b.column("text"))
        order = np.argsort(s.anchor)
        anchor, digest = s.anchor[order].view(np.int64), s.digest()[order].view(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else order
        low, high = (f.reduceat(digest, cut) if len(cut) else digest for f in (np.minimum, np.maximum))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[cut], np.diff(cut, append=len(anchor)), low, high)], ["anchor", "n", "low", "high"])


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & _U(64 * len(bits) - 1)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def _pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of bytes as an array."""
    cut = np.concatenate([[0], np.cumsum(end - start)])
    data = raw[np.arange(cut[-1]) + np.repeat(start - cut[:-1], end - start)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])


def _joined(start: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches sorted by text and start, with those put together that touch or overlap."""
    if not len(start):
        return start, end, text
    far = np.maximum.accumulate(end + 0)
    new = np.concatenate([[True], (start[1:] > far[:-1]) | (text[1:] != text[:-1])])
    cut = np.flatnonzero(new)
    return start[cut], np.maximum.reduceat(end, cut), text[cut]


def _emitter(sent):
    """Segments whose anchor the sieve holds: the first of equal ones, with its bytes if others may differ, the rest as stretches to be removed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, unlike = sent.value
        for b in W.batches(it, BATCH_BYTES, lean=False):
            s = Segments(b.column("text"))
            s.only(_holds(again, s.anchor))
            if not len(s.start):
                continue
            position = [b.column(c) for c in ("none", "id", "tie")]
            rank = np.empty(b.num_rows, np.int64)
            rank[np.lexsort([c.to_numpy(zero_copy_only=False) for c in reversed(position)])] = np.arange(b.num_rows)
            d1, d2 = s.digest(), _digest(_rolled(s.raw, 64, 1), s.start, s.end)
            order = np.lexsort((s.start, rank[s.text], d2, d1))
            same = (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
            later = np.zeros(len(order), bool)
            later[order[1:]] = same
            one = np.flatnonzero(~later)
            known = _holds(unlike, s.anchor[one])
            contents = _pieces(s.raw, s.start[one][known], s.end[one][known]).take(pa.array(np.where(known, np.cumsum(known) - 1, -1), mask=~known))
            start, end, text = _joined(s.start[later], s.end[later], s.text[later])
            of = np.concatenate([s.text[one], text])
            none = pa.nulls(len(text), pa.int64())
            keys = [pa.concat_arrays([pa.array(x[one].view(np.int64)), none]) for x in (d1, d2, s.anchor)]
            starts, ends = np.concatenate([s.start[one], start]) - s.off[of], np.concatenate([s.end[one], end]) - s.off[of]
            at = pa.concat_arrays([pa.array(s.at[one] - s.off[s.text[one]]), none])
            columns = [*(c.take(pa.array(of)) for c in position), pa.array(starts), pa.array(ends), *keys, at, pa.concat_arrays([contents, pa.nulls(len(text), pa.binary())])]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


def _halves(low_width: int):
    """The segments in two, by the place of the anchor in a window: halves of ``low_width`` places, and what their windows share as anchor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, BATCH_BYTES, "bytes", lean=False):
            raw, off = W.utf8(b.column("bytes"))
            start, end, at, low = (b.column(c).to_numpy() for c in ("start", "end", "at", "low"))
            for k in range(2):
                first, last = low + k * low_width, low + (k + 1) * low_width - 1  # bytes of a window before the anchor
                a, z = np.maximum(start, at - last), np.minimum(end - LENGTH, at - first)
                some = np.flatnonzero(a <= z)
                base = off[:-1][some] - start[some]
                a, z = a[some], z[some] + LENGTH
                rolled = [_rolled(raw, 64, w) for w in range(2)]
                d1, d2 = (_digest(r, a + base, z + base) for r in rolled)
                core = _digest(rolled[0], at[some] - first[some] + base, at[some] - last[some] + LENGTH + base)
                anchor = W.combine([core, first[some].astype(np.uint64)])
                rows = [b.column(c).take(pa.array(some)) for c in ("none", "id", "tie")]
                numbers = [pa.array(x) for x in (a, z, d1.view(np.int64), d2.view(np.int64), anchor.view(np.int64), at[some])]
                yield pa.RecordBatch.from_arrays([*rows, *numbers, _pieces(raw, a + base, z + base), pa.array(first[some])], [*_NAMES, "low"])

    return run


def _shard_repeats(table: pa.Table) -> pa.Table:
    """The stretches of a shard's segments whose windows also start earlier in the shard."""
    table = table.combine_chunks().sort_by([(c, "ascending") for c in ("none", "id", "tie", "start")])
    raw, off = W.utf8(table.column("bytes"))
    number = len(off) - 1
    # a separator ends each segment; symbols: 0 the end, 1 the separator, bytes from 2 on
    symbols = np.ones(len(raw) + number + 1, np.uint16)
    of = np.repeat(np.arange(number), np.diff(off))
    symbols[np.arange(len(raw)) + of] = raw.astype(np.uint16) + 2
    symbols[-1] = 0
    order = suffixes.suffix_array(symbols, 258)
    prefix = suffixes.common_prefixes(symbols, order)
    begin = off[:-1] + np.arange(number)
    windows = np.diff(off) - LENGTH + 1
    real = np.zeros(len(symbols), bool)
    real[np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())] = True
    order = order[real[order]]
    # segments are in document order, so a smaller place is an earlier start
    group = np.cumsum(prefix[order] < LENGTH)
    least = np.minimum.reduceat(order, np.flatnonzero(np.diff(group, prepend=-1))) if len(order) else order
    again = np.sort(order[order != least[group - group[0]]]) if len(order) else order
    owner = np.searchsorted(begin, again, "right") - 1
    start, end, owner = _joined(again, again + LENGTH, owner)
    here = table.column("start").to_numpy()[owner] - begin[owner]
    rows = table.select(["none", "id", "tie"]).take(pa.array(owner))
    return rows.append_column("start", pa.array(start + here, pa.int64())).append_column("end", pa.array(end + here, pa.int64()))


_STRETCH = ["none", "id", "tie", "start", "end"]
_NAMES = [*_STRETCH, "d1", "d2", "anchor", "at", "bytes"]
_SCHEMA = f"{_POSITION}, start long, end long, d1 long, d2 long, anchor long, at long, bytes binary"


def _here() -> Column:
    return F.struct("none", "id", "tie", "start")


def _filter(hashes: DataFrame) -> np.ndarray:
    return bitmap(hashes, "anchor", min(FILTER_BITS, 1 << max(16, int(hashes.count() * 16).bit_length())))


def _told(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """The segments with whether they are the first of equal ones, and the number of different ones of their anchor (null: no other)."""
    firsts = scratch.keep(segments.groupBy("d1", "d2").agg(F.min(_here()).alias("first"), F.min("anchor").alias("anchor")))
    sets = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    firsts = scratch.keep(spread_join(firsts, sets, ["anchor"], ["d1"], "left"))
    told = spread_join(segments, firsts.drop("anchor"), ["d1", "d2"], ["id", "tie", "start"]).withColumn("is_first", _here() == F.col("first")).drop("first")
    return scratch.keep(told.filter("not is_first or sets is not null").withColumn("bytes", F.when(F.col("is_first"), F.col("bytes"))))


def stretches(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(none, id, tie, start, end): bytes to be removed from the texts of ``rows`` (none, id, tie, text), in pieces that may overlap."""
    spark = rows.sparkSession
    texts = rows.select("none", "id", "tie", "text")
    anchors = texts.select("text").mapInArrow(_anchors, "anchor long, n long, low long, high long")
    anchors = anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    anchors = scratch.keep(anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("unlike")))
    sieves = (_filter(anchors), _filter(anchors.filter("unlike")))
    scratch.drop(anchors)
    found = scratch.keep(texts.mapInArrow(_emitter(spark.sparkContext.broadcast(sieves)), _SCHEMA))
    parts, shards, size = [found.filter("d1 is null").select(*_STRETCH)], [], 0
    segments, width = found.filter("d1 is not null").withColumn("low", F.lit(0).cast("long")), LENGTH - KGRAM + 1
    while True:
        told = _told(segments, scratch)
        parts.append(told.filter("not is_first").select(*_STRETCH))
        whole = told.filter("is_first").filter(F.col("sets") <= SETS).select("none", "id", "tie", "start", "anchor", "bytes")
        shards.append(whole)
        size += whole.agg(F.sum(F.length("bytes"))).first()[0] or 0
        crowd = told.filter("is_first").filter(F.col("sets") > SETS).select(*_STRETCH, "at", "low", "bytes")
        if crowd.isEmpty():
            break
        width = -(-width // 2)
        segments = scratch.keep(crowd.mapInArrow(_halves(width), f"{_SCHEMA}, low long"))
    if size:
        shard = F.pmod(F.xxhash64("anchor"), F.lit(-(-size // SHARD_BYTES))).alias("shard")
        dealt = reduce(DataFrame.unionByName, shards).select("none", "id", "tie", "start", "bytes", shard)
        parts.append(dealt.groupBy("shard").applyInArrow(_shard_repeats, f"{_POSITION}, start long, end long"))
    return reduce(DataFrame.unionByName, parts)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.batches(it, 4 << 20, lean=False):
        raw, off = W.utf8(b.column("text"))
        found = b.column("found")
        pieces = found.flatten()
        many = np.where(found.is_null(), 0, np.asarray(found.value_lengths().fill_null(0)))
        text = np.repeat(np.arange(b.num_rows), many)
        start, end = (pieces.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        order = np.lexsort((start, text))
        start, end, text = _joined(start[order] + off[text[order]], end[order] + off[text[order]], text[order])
        step = np.zeros(len(raw) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8) == 0
        cut = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(cut), pa.py_buffer(raw[keep])])
        of = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array(start - off[text]), pa.array(end - off[text])], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("none", "id", "copies")), pa.array(np.diff(off)), spans, kept], ["none", "id", "copies", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of each row: the byte stretches covered by strings of 100 bytes that also start
    earlier, and the bytes that are left.

    Earlier is a smaller key (an integer; null comes last), or an earlier byte of one text. Of rows with one key and
    unlike texts the order is that of a hash of the text; of rows alike in both, one comes first and the
    others are copies of it. Strings are judged on the input, overlaps count, and null counts as empty. ``kept`` is binary: a
    stretch may end within a character. Other columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    at = ["none", "id", "tie"]
    repeated = not rows.groupBy(*at).count().filter("count > 1").isEmpty()
    if repeated:
        rows = Scratch(docs.sparkSession).keep(rows.groupBy(*at, "text").agg(F.count(F.lit(1)).alias("copies")))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    pieces = scratch.last(stretches(rows, scratch))
    found = pieces.groupBy(*at).agg(F.collect_list(F.struct("start", "end")).alias("found"))  # a text has one for every few windows
    out = rows.join(found, at, "left").select(*at, "copies", "text", "found")
    out = out.mapInArrow(_cut, "none boolean, id long, copies long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    if repeated:
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
        gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        out = out.withColumn("copy", copy).withColumns({"spans": F.when(gone, whole).otherwise(F.col("spans")), "kept": F.when(gone, F.lit(b"")).otherwise(F.col("kept"))})
    out = out.select(F.when(~F.col("none"), F.col("id")).alias(key), "n_bytes", "spans", "kept")
    return Scratch(docs.sparkSession).keep(out)
