"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every run of as many words as an item has is a window of the text. Each window and each
item has a fingerprint of BITS bits. The index is a table: every item stands under every
value of each of its BLOCKS blocks that differs in BLOCK_RADIUS bits or less, so two
fingerprints within RADIUS bits of each other always meet in some block; at a similarity
of 0.8 they nearly always do beyond it too (see RADIUS). Spark joins the windows' blocks
with the table. Pairs within FAR bits are checked by the weighted Jaccard similarity of
their shingles, each weighing as often as it occurs.

Before it is fingerprinted a window passes a sieve that can't lose a match: similarity
0.8 with any item needs 4/9 of both their shingles together, so at least that many of
the window's shingles must be ones that some item of its size has. The sieve is a bitmap
of items' shingles; what it lets through wrongly costs time and is refused by the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import words as W
from wardline.llm.scratch import Scratch, bitmap
from wardline.llm.spread import spread_join

#: Words of a shingle, and the similarity from which a window is a leak.
SIZE, THRESHOLD = 5, 0.8
#: A fingerprint and its blocks; an item stands under the values of a block within this radius.
LANES, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 16, 2
BITS = 64 * LANES
#: What the blocks guarantee. At similarity 0.8 two fingerprints differ in 38.8 bits, give or take 5.7. Beyond the radius a
#: pair is missed only if all 16 blocks differ in 3 bits or more: 2 in a million at similarity 0.8.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Bits beyond which a pair isn't checked: 7 deviations above those at similarity 0.8, 6 below those of unlike texts.
FAR = 80
#: Bits of the sieve's bitmap at most (32 MB); more items' shingles than fit well cost time, not matches.
SIEVE_BITS = 1 << 28
#: Items, and their shingles, up to which they are broadcast to be checked; beyond it they are joined.
BROADCAST_ITEMS, BROADCAST_SHINGLES = 20_000, 2_000_000
#: Shingles that windows fingerprinted together span.
SPAN = 1 << 15
BATCH_BYTES = 2 << 20

_LANES = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def least(k, n):
    """Shingles that runs of k and n shingles share at similarity 0.8, at least."""
    return -(-4 * (k + n) // 9)


def simhash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints [run, lane] of the runs h[start:end]; a shingle weighs as often as it occurs in the run."""
    out = np.zeros((len(start), LANES), np.uint64)
    for lane, salt in enumerate(_LANES):
        bits = np.unpackbits(W.mix(h ^ salt).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        total = np.zeros((len(h) + 1, 64), np.int32)
        np.cumsum(2 * bits - 1, axis=0, out=total[1:])
        for a in range(0, len(start), 4096):
            votes = total[end[a : a + 4096]] - total[start[a : a + 4096]]
            out[a : a + 4096, lane] = np.packbits(votes > 0, axis=1).reshape(-1, 8).view(np.uint64)[:, 0]
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two runs share, each as often as both have it."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


_ITEM = "no long, size int, words int, shingles array<long>, f array<long>"


def _items(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(no, size, words, shingles, f, item_id) of the items that have words; items of fewer than SIZE words are one shingle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, BATCH_BYTES):
            w = W.words(pc.utf8_lower(b.column("text")), W.ALNUM_WORDS)
            length = np.diff(w.first)
            for size in range(1, SIZE + 1):
                own = np.flatnonzero(np.minimum(length, SIZE) == size)
                if not len(own):
                    continue
                h, doc, _ = W.shingles(w, size)
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                runs = [h[cut[k] : cut[k + 1]] for k in own]
                prints = np.concatenate([simhash(r, np.zeros(1, int), np.array([len(r)])) for r in runs])
                yield pa.RecordBatch.from_arrays(
                    [b.column("no").take(pa.array(own)), pa.array(np.full(len(own), size, np.int32)), pa.array(length[own].astype(np.int32)),
                     W.list_array(pa.array(np.concatenate(runs).view(np.int64)), np.concatenate([[0], np.cumsum([len(r) for r in runs])])),
                     W.list_array(pa.array(prints.view(np.int64).ravel()), np.arange(len(own) + 1) * LANES)],
                    ["no", "size", "words", "shingles", "f"],
                )

    numbered = items.select("item_id", "text").withColumn("no", F.monotonically_increasing_id())
    numbered = scratch.keep(numbered)  # the numbers must stay as they are
    return numbered.select("no", "text").mapInArrow(run, _ITEM).join(numbered.select("no", "item_id"), "no")


def _sized(h: np.ndarray, words: int) -> np.ndarray:
    """Shingles as those of items of so many words."""
    return W.mix(h + np.full(1, words, np.uint64) * np.uint64(0xA0761D6478BD642F))


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(bits) * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def windows(h: np.ndarray, doc: np.ndarray, bits: np.ndarray, size: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle, end, words of the item) of all windows that pass the sieve, sorted by place.

    ``bits`` holds the items' shingles, alone and with the words of their item. A window
    that passes holds some m known shingles in a row of those, so it is found between the
    first and the last of them. A text shorter than an item is one window.
    """
    known = np.flatnonzero(_in(bits, h))
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    size_of = np.diff(np.append(first, len(doc)))
    text = np.searchsorted(first, known, "right") - 1
    found = []
    for words in lengths.tolist():
        n = words - size + 1
        m = least(n, n)
        own = _in(bits, _sized(h[known], words))
        at, t = known[own], text[own]
        if not len(at):
            continue
        if len(at) >= m:
            i = np.flatnonzero((at[m - 1 :] - at[: len(at) - m + 1] < n) & (t[m - 1 :] == t[: len(at) - m + 1]))
            lo = np.maximum(at[i + m - 1] - n + 1, first[t[i]])
            hi = np.minimum(at[i], first[t[i]] + size_of[t[i]] - n)
            span = np.maximum(0, hi - lo + 1)
            a = np.unique(np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(lo, span))
            found.append((a, a + n, np.full(len(a), words)))
        some, count = np.unique(t, return_counts=True)
        short = some[(size_of[some] < n) & (count >= least(size_of[some], n))]
        found.append((first[short], first[short] + size_of[short], np.full(len(short), words)))
    a, e, words = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((words, a))
    return a[order], e[order], words[order]


def _regions(a: np.ndarray, e: np.ndarray) -> Iterator[slice]:
    """Windows, sorted by start, in groups that overlap or span SPAN shingles at most."""
    if not len(a):
        return
    far = np.maximum.accumulate(e)
    gaps = np.append(np.flatnonzero(a[1:] >= far[:-1]) + 1, len(a))
    at = 0
    for stop in gaps.tolist():
        while at < stop:
            to = max(at + 1, min(stop, int(np.searchsorted(a, a[at] + SPAN, "right"))))
            yield slice(at, to)
            at = to


_REGION = "row long, h1 long, h2 long, part int, size int, run array<long>, first int, start array<int>, len array<int>, words array<int>, f array<array<long>>"


def _sieved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the sieve holds of items (words, shingles)."""
    for b in it:
        for words, run in zip(b.column("words").to_pylist(), b.column("shingles"), strict=True):
            h = run.values.to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, _sized(h, words)]).view(np.int64))], ["h"])


def _window_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Overlapping windows of each text of ``docs`` (key, row, h1, h2, text): a row for each region, with its shingles and its windows."""
    spark = docs.sparkSession
    # lengths of items: as many values as the longest item has words, at most
    kinds = sorted(tuple(r) for r in items.select("size", "words").distinct().collect())
    sieves = []
    for size in sorted({k[0] for k in kinds}):
        own = items.filter(F.col("size") == size)
        bits = min(SIEVE_BITS, 1 << max(16, int(own.agg(F.sum(F.size("shingles"))).first()[0] * 32).bit_length()))
        sieves.append((size, np.array([w for s, w in kinds if s == size]), bitmap(own.mapInArrow(_sieved, "h long"), "h", bits)))
    sent = spark.sparkContext.broadcast(sieves)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, BATCH_BYTES):
            w = W.words(pc.utf8_lower(b.column("text")), W.ALNUM_WORDS)
            part = 0
            for size, lengths, bits in sent.value:
                h, doc, at = W.shingles(w, size)
                a, e, words = windows(h, doc, bits, size, lengths)
                out = []
                for g in _regions(a, e):
                    lo, hi = int(a[g][0]), int(e[g].max())
                    prints = simhash(h[lo:hi], a[g] - lo, e[g] - lo)
                    out.append((int(doc[lo]), part, size, h[lo:hi].view(np.int64), int(at[lo] - w.first[doc[lo]]), (a[g] - lo), (e[g] - a[g]), words[g], prints.view(np.int64)))
                    part += 1
                    if sum(len(o[3]) + 8 * len(o[5]) for o in out) > SPAN * 4:
                        yield _packed(b, out)
                        out = []
                if out:
                    yield _packed(b, out)

    kind = T.StructType([docs.schema["key"], *T.StructType.fromDDL(_REGION)])
    return docs.mapInArrow(run, kind)


def _packed(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    cut = lambda k: np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])])
    ints = lambda k: W.list_array(pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32)), cut(k))
    prints = np.concatenate([r[8] for r in rows])
    inner = W.list_array(pa.array(prints.ravel()), np.arange(len(prints) + 1) * LANES)
    own = pa.array([r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(b.column(c).take(own) for c in ("key", "row", "h1", "h2")), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), W.list_array(pa.array(np.concatenate([r[3] for r in rows])), cut(3)),
         pa.array([r[4] for r in rows], pa.int32()), ints(5), ints(6), ints(7), W.list_array(inner, cut(8))],
        ["key", "row", "h1", "h2", "part", "size", "run", "first", "start", "len", "words", "f"],
    )


def _keys(masks: list[int]) -> Column:
    """Where a fingerprint ``f`` of a run of ``words`` words stands in the index: its blocks' values under each mask."""
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    per_lane, low = BLOCKS // LANES, F.lit((1 << BLOCK_BITS) - 1)

    def block(f: Column, lane: Column, k: int) -> Column:
        value = F.shiftrightunsigned(f, k * BLOCK_BITS).bitwiseAND(low)
        key = (F.col("words").cast("long") * BLOCKS + lane * per_lane + k) * (1 << BLOCK_BITS) + value
        return F.transform(flips, lambda m: key.bitwiseXOR(m))

    return F.flatten(F.transform("f", lambda f, lane: F.flatten(F.array(*[block(f, lane, k) for k in range(per_lane)]))))


def block_masks() -> list[int]:
    """All values within BLOCK_RADIUS bits of 0."""
    return [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def _found(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str, text: str) -> DataFrame:
    """(key, row, h1, h2, no, item_id, similarity, start_word, n_words, distance): the best window of each row for each item."""
    items = scratch.keep(_items(items, scratch))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    texts = texts.select("key", F.monotonically_increasing_id().alias("row"), *_digest(F.col("text")), "text")
    regions = scratch.keep(_window_table(texts, items))  # which numbers the rows once and for all
    spans = regions.select("row", "part", F.explode(F.arrays_zip("start", "len", "words", "f")).alias("w")).select("row", "part", "w.*")
    index = items.select("no", "words", F.explode(_keys(block_masks())).alias("key")).select("key", "no")
    met = spans.withColumn("key", F.explode(_keys([0]))).join(index, "key")
    met = scratch.keep(met.groupBy("row", "part", "start", "words", "no").agg(F.first("len").alias("len"), F.first("f").alias("f")))
    size = items.agg(F.count(F.lit(1)), F.sum(F.size("shingles"))).first()
    small = size[0] <= BROADCAST_ITEMS and (size[1] or 0) <= BROADCAST_SHINGLES

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "no") if small else spread_join(left, right, ["no"], ["row", "part"])

    far = sum((F.bit_count(F.col("f")[k].bitwiseXOR(F.col("g")[k])) for k in range(LANES)), F.lit(0))
    near = beside(met, items.select("no", F.col("f").alias("g"))).withColumn("distance", far).filter(F.col("distance") <= FAR)
    near = scratch.keep(near.groupBy("row", "part", "no").agg(F.sort_array(F.collect_list(F.struct("start", "len", "distance"))).alias("w")))
    both = near.join(regions.select("row", "part", "run", "first", "size"), ["row", "part"])
    checked = beside(both, items.select("no", "item_id", "shingles"))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in range(b.num_rows):
                run, item = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("run", "shingles"))
                best = None
                for w in b.column("w")[r].as_py():
                    a, n = w["start"], w["len"]
                    same = overlap(run[a : a + n], item)
                    if same >= least(n, len(item)):
                        s = same / (n + len(item) - same)
                        if best is None or s > best[0]:
                            best = (s, a, n, w["distance"])
                out.append(best)
            on = [r for r, x in enumerate(out) if x]
            if on:
                take = pa.array(on, pa.int64())
                first, size = (b.column(c).to_numpy()[on] for c in ("first", "size"))
                s, a, n, far = zip(*(out[r] for r in on), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(take), b.column("no").take(take), b.column("item_id").take(take), pa.array(s, pa.float64()), pa.array(first + np.array(a), pa.int64()),
                     pa.array(np.array(n) + size - 1, pa.int64()), pa.array(far, pa.int64())],
                    ["row", "no", "item_id", "similarity", "start_word", "n_words", "distance"],
                )

    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("no", T.LongType()), items.schema["item_id"], T.StructField("similarity", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("start_word", "n_words", "distance"))])
    found = checked.select("row", "no", "item_id", "run", "first", "size", "shingles", "w").mapInArrow(check, kind)
    first = F.struct("similarity", (-F.col("start_word")).alias("back"), "start_word", "n_words", "distance", "item_id")
    best = found.groupBy("row", "no").agg(F.max(first).alias("b"))
    rows = regions.select("row", "key", "h1", "h2").distinct()
    best = best.select("row", "no", *[f"b.{c}" for c in ("item_id", "similarity", "start_word", "n_words", "distance")])
    return best.join(rows, "row")


def _digest(text: Column) -> list[Column]:
    """128 bits by which equal texts are told, as two columns."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): items that stand in a text, nearly or exactly.

    One row for each text and item, with the item's best window, the first of equals.
    Words are lower-cased runs of letters and digits. Items of fewer than five words are
    looked for as one shingle; a text shorter than an item is one window. Null and empty
    texts and items give nothing; repeated rows repeated rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = _found(docs, items, scratch, key, text)
    return scratch.last(found.select(F.col("key").alias(key), "item_id", "similarity", "start_word", "n_words", "distance"))


#: Leaked texts up to which their digests (16 bytes each) are broadcast.
BROADCAST_TEXTS = 500_000


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item stands, all columns kept."""
    scratch = Scratch(docs.sparkSession)
    found = docs.withColumn("__key", F.lit(0))
    leaked = scratch.last(_found(found, items, scratch, "__key", text).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct())
    if leaked.count() <= BROADCAST_TEXTS:
        leaked = F.broadcast(leaked)
    h1, h2 = _digest(F.col(text))
    marked = docs.withColumn("__h1", h1).withColumn("__h2", h2)
    return marked.join(leaked, ["__h1", "__h2"], "left_anti").select(*docs.columns)
