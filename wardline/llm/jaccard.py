"""Exact n-gram Jaccard join with set-relation skipping, down to connected components.

Sets are the distinct word shingles of a text, as 64-bit hashes in one global order.
Two sets whose Jaccard similarity reaches the threshold share at least k hashes among
their first n - ceil(0.8 n) + k ones. Four steps rest on that:

1. Sieve. All texts' prefixes meet in buckets of hashes. A set stays only if enough of
   its prefix occurs in another set. Within a chunk of a task's texts equal hashes
   travel once, so a passage that all texts share costs one entry a chunk.
2. Leaders. Sets with the same min-hash are compared with one of them, their leader.
   Whoever links with a leader shares the leader's answer: inside one component no
   further pair is compared, so a group of copies costs its size, not its square.
3. Sieve again, between components: only sets with enough hashes that other components
   hold as well can still have a link that matters.
4. Index join of these. Hashes are ordered by the number of components that hold them.
   Each hash's list is cut into blocks by size and position; a set skips whole blocks
   whose sizes or positions leave too few hashes for the needed overlap. Sets that may be
   linked are asked by component: a part of a component is kept as one set and, for the
   others, what they have more and less than it. The overlap with the one is counted, the
   others' follow from the differences, and the first link ends the asking.

Equal sets are told by 128 bits and every link is checked on whole sets. Steps 1, 3 and 4
lose none, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.components import components
from wardline.llm.scratch import Scratch, bitmap
from wardline.llm.spread import spread_join

#: Words of a shingle, and the threshold in hundredths.
SIZE, PERCENT = 5, 80
#: A set's prefix is long enough to share one in so many of its hashes with a linked set: the smaller, the stricter the
#: sieve and the longer the prefixes.
PART = 5
#: Texts whose prefixes one bucket of the sieve is meant for.
BUCKET_TEXTS = 256
#: Hashes that a block of a component's sets holds, about.
BLOCK_HASHES = 16_384
#: Sets up to which a component's sets stand in the index one by one, and entries that each remembers before it.
SMALL, BEFORE = 8, 32
#: Positions that a block of an index list spans, and entries that it is meant for.
BLOCK_PLACES, BLOCK_ENTRIES = 8, 64
#: Prefix hashes that a task gathers before it sends them on: 16 bytes each.
CHUNK = 1 << 20
#: Bits of the filter that leads back from sets to texts, at most (64 MB): with more sets, more texts pass it that needn't.
FILTER_BITS = 1 << 29
#: Min-hashes by which leaders are found, in each round.
ROUNDS = (4, 8)
BATCH_BYTES = 3 << 20


def _alpha(n):
    """Hashes that a set of n shares with any set linked to it, at least."""
    return -(-PERCENT * n // 100)


def _extra(n):
    """k of a set of n: shared hashes that its longer prefix stands for."""
    return np.maximum(1, n // PART)


def _alpha_col(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def _need_col(n: Column) -> Column:
    """Prefix hashes that a linked set must find in other sets' prefixes; the partner may be a fifth smaller."""
    return F.greatest(F.lit(1), F.floor(_alpha_col(n) / PART)).cast("int")


def _prefix_col(n: Column) -> Column:
    return n - _alpha_col(n) + F.greatest(F.lit(1), F.floor(n / PART)).cast("int")


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all texts' sets end to end, their bounds, and the digest of each set, [text, half]."""
    w = W.words(texts, W.SPACE_WORDS)
    h, doc, _ = W.shingles(w, SIZE)
    h, cut = W.distinct_by_doc(h, doc, len(texts))
    digest = np.zeros((len(texts), 2), np.uint64)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        for half, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            digest[full, half] = W.mix(np.add.reduceat(W.mix(h ^ np.uint64(salt)), cut[full]) + np.diff(cut)[full].astype(np.uint64))
    return h, cut, digest


def _first_of_each(digest: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One text of each set that isn't empty."""
    _, first = np.unique(digest, axis=0, return_index=True)
    return first[n[first] > 0]


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of several ranges end to end, and the number of the range of each."""
    which = np.repeat(np.arange(len(start)), length)
    return np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + start[which], which


_SHEET = "kind int, doc_id long, n int, digest long, other long, text_hash long, hits long, bucket int, hashes binary, owners binary"


class _Chunk:
    """Prefixes of a task's sets, gathered until they are worth sending."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.size, self.n, self.digest, self.hashes, self.which, self.sets = 0, [], [], [], [], 0

    def add(self, h: np.ndarray, cut: np.ndarray, digest: np.ndarray, own: np.ndarray) -> None:
        n = np.diff(cut)[own]
        idx, which = _ranges(cut[own], n - _alpha(n) + _extra(n))
        self.n.append(n), self.digest.append(digest[own]), self.hashes.append(h[idx]), self.which.append(which + self.sets)
        self.sets += len(own)
        self.size += len(idx)

    def sheets(self) -> Iterator[dict[str, pa.Array]]:
        """The hits of each set among the others here, then for each bucket one entry for each hash."""
        n, digest, hashes, which = (np.concatenate(c) for c in (self.n, self.digest, self.hashes, self.which))
        # a set that came in two batches is one set
        _, first, same = np.unique(digest, axis=0, return_index=True, return_inverse=True)
        once = first[same.reshape(-1)] == np.arange(len(n))
        hashes, which = hashes[once[which]], which[once[which]]
        order = np.argsort(hashes, kind="stable")
        hashes, which = hashes[order], which[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        count = np.diff(np.append(start, len(hashes)))
        hits = np.bincount(which[np.repeat(count > 1, count)], minlength=len(n))
        on = np.flatnonzero(once)
        yield {"kind": pa.array(np.full(len(on), 1)), "n": pa.array(n[on]), "digest": pa.array(digest[on, 0].view(np.int64)), "hits": pa.array(hits[on])}
        hashes, owners, alone = hashes[start], digest[which[start], 0], count == 1
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, low, owners, alone = bucket[order], hashes[order].astype(np.uint32), owners[order], alone[order]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        # the owner 0 stands for several sets, whose hits are counted already
        owners = np.where(alone, owners, np.uint64(0))
        cuts = list(zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True))
        for k in range(0, len(cuts), 4096):
            some = cuts[k : k + 4096]
            yield {
                "kind": pa.array(np.full(len(some), 2)), "bucket": pa.array(bucket[[i for i, _ in some]]), "hashes": pa.array([low[i:j].tobytes() for i, j in some], pa.binary()),
                "owners": pa.array([owners[i:j].tobytes() for i, j in some], pa.binary()),
            }


def _sheets(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts: a row for each text (kind 0), each set's hits within its chunk (1), entries for the buckets (2)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.int64()), ("other", pa.int64()), ("text_hash", pa.int64()), ("hits", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary())])

    def row(given: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(given["kind"])
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(buckets)
        for b in W.batches(it, BATCH_BYTES):
            h, cut, digest = _sets(b.column("text"))
            n = np.diff(cut)
            halves = [pa.array(digest[:, k].copy().view(np.int64)) for k in (0, 1)]
            yield row({"kind": pa.array(np.zeros(b.num_rows)), "doc_id": b.column("doc_id"), "n": pa.array(n), "digest": halves[0], "other": halves[1], "text_hash": b.column("text_hash")})
            own = _first_of_each(digest, n)
            if len(own):
                chunk.add(h, cut, digest, own)
            if chunk.size >= CHUNK:
                yield from map(row, chunk.sheets())
                chunk.clear()
        if chunk.sets:
            yield from map(row, chunk.sheets())

    return docs.mapInArrow(run, _SHEET)


def _bucket_hits(entries: DataFrame) -> DataFrame:
    """(digest, hits): how many of a set's entries stand in a bucket beside another set's of the same hash.

    A bucket gets an entry a chunk of each hash at most: a hash that all texts share is 12 MB of a bucket for a
    million chunks, which are some 15 TB of text.
    """

    def meet(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")])
        owners = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("owners")])
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        several = np.minimum.reduceat(owners, start) != np.maximum.reduceat(owners, start)
        owners = owners[np.repeat(several, np.diff(np.append(start, len(hashes))))]
        digest, hits = np.unique(owners[owners != 0], return_counts=True)
        return pa.table({"digest": pa.array(digest.view(np.int64)), "hits": pa.array(hits, pa.int64())})

    return entries.groupBy("bucket").applyInArrow(meet, "digest long, hits long")


def _candidate_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(digest, other, n, hashes, mins) of the sets of the texts whose hash the bitmap holds."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    total = sum(ROUNDS)
    seeds = W.mix(np.arange(1, total + 1, dtype=np.uint64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, BATCH_BYTES):
            at = b.column("text_hash").to_numpy() & (len(sent.value) * 64 - 1)
            b = b.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
            if not b.num_rows:
                continue
            h, cut, digest = _sets(b.column("text"))
            own = _first_of_each(digest, np.diff(cut))
            if not len(own):
                continue
            n = np.diff(cut)[own]
            idx, _ = _ranges(cut[own], n)
            h, bounds = h[idx], np.concatenate([[0], np.cumsum(n)])
            mins = np.stack([np.minimum.reduceat(W.mix(h ^ s), bounds[:-1]) for s in seeds], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(digest[own, k].view(np.int64)) for k in (0, 1)), pa.array(n, pa.int32()), W.list_array(pa.array(h.view(np.int64)), bounds), W.list_array(pa.array(mins.view(np.int64).ravel()), np.arange(len(own) + 1) * total)],
                ["digest", "other", "n", "hashes", "mins"],
            )

    raw = docs.select("text", "text_hash").mapInArrow(run, "digest long, other long, n int, hashes array<long>, mins array<long>")
    return raw.groupBy("digest", "other").agg(*[F.first(c).alias(c) for c in ("n", "hashes", "mins")])


def _named(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets`` with a number of each one's own, ``digest``: half its digest, or a new hash of both where halves clash."""
    sets, seed = scratch.keep(sets.withColumnRenamed("digest", "half").withColumn("digest", F.col("half"))), 0
    while True:
        clash = sets.groupBy("digest").count().filter("count > 1").select("digest")
        if clash.isEmpty():
            return sets
        seed += 1
        again = sets.join(F.broadcast(clash.withColumn("again", F.lit(True))), "digest", "left")
        sets = scratch.keep(again.withColumn("digest", F.when(F.col("again"), F.xxhash64(F.lit(seed), "half", "other")).otherwise(F.col("digest"))).drop("again"))


def _linked(a: Column, b: Column) -> Column:
    """Whether the intersection of two sets, counted in full, reaches the threshold."""
    same = F.size(F.array_intersect(a, b))
    return same * (100 + PERCENT) >= (F.size(a) + F.size(b)) * PERCENT


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked; ``pairs`` is a written table. Sets travel once for each pair they are the second of."""
    second = pairs.join(sets.select(F.col("digest").alias("v"), F.col("hashes").alias("hv")), "v")
    both = spread_join(second, sets.select(F.col("digest").alias("u"), F.col("hashes").alias("hu")), ["u"], ["v"], like=pairs)
    return both.filter(_linked(F.col("hu"), F.col("hv"))).select("u", "v")


def component_links(asks: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): components found linked by asking.

    ``asks`` (u, a, b, part) has a set of component a ask a part of component b, whose
    sets ``members`` (digest, comp, part) names. A part is its smallest set and, for each
    set, its size and what it has more and less than that one. The overlap with the
    smallest set answers for all: |u & s| = |u & m| + |u & (s - m)| - |u & (m - s)|. A part
    stops answering at its first link: what follows in it has the same answer.
    """
    wanted = members.join(asks.select(F.col("b").alias("comp"), "part").distinct(), ["comp", "part"], "left_semi")
    own = wanted.join(sets.select("digest", "n", "hashes"), "digest")
    first = own.groupBy("comp", "part").agg(F.min(F.struct("n", "digest", "hashes")).alias("m")).select("comp", "part", F.col("m.hashes").alias("lead"))
    more = F.struct("n", F.array_except("hashes", "lead").alias("more"), F.array_except("lead", "hashes").alias("less"))
    held = own.join(first, ["comp", "part"]).groupBy(F.col("comp").alias("b"), "part").agg(F.first("lead").alias("lead"), F.collect_list(more).alias("others"))
    asking = asks.join(sets.select(F.col("digest").alias("u"), F.col("hashes").alias("hu")), "u")
    met = spread_join(asking, held, ["b", "part"], ["u"], like=asks).withColumn("base", F.size(F.array_intersect("hu", "lead")))
    count = lambda x: F.size(F.array_intersect("hu", x))
    same = lambda s: F.col("base") + F.when(F.size(s["more"]) > 0, count(s["more"])).otherwise(0) - F.when(F.size(s["less"]) > 0, count(s["less"])).otherwise(0)
    linked = F.exists("others", lambda s: same(s) * (100 + PERCENT) >= (F.size("hu") + s["n"]) * PERCENT)
    return met.filter(linked).select("a", "b").distinct()


def _merge(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` (digest, comp, size) after components were joined along ``links`` (a, b) of theirs."""
    links = scratch.keep(links)
    if links.isEmpty():
        return comps
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    named = spread_join(comps, roots.withColumnRenamed("node", "comp"), ["comp"], ["digest"], "left")
    named = scratch.keep(named.select("digest", F.coalesce("root", "comp").alias("comp")))
    sizes = named.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return scratch.keep(spread_join(named, sizes, ["comp"], ["digest"]).select("digest", "comp", "size"))


def _between(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Linked sets (u, v) as the components (a, b) that they stand in."""
    u = comps.select(F.col("digest").alias("u"), F.col("comp").alias("a"))
    v = comps.select(F.col("digest").alias("v"), F.col("comp").alias("b"))
    return links.join(v, "v").join(u, "u").select("a", "b").filter("a <> b").distinct()


def _close(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _leader_pairs(sets: DataFrame, comps: DataFrame, mins: slice, scratch: Scratch) -> DataFrame:
    """(leader, set) pairs of different components among the sets of each min-hash; leaders are of the largest component there."""
    picked = F.slice("mins", mins.start + 1, mins.stop - mins.start)
    rows = scratch.keep(sets.select("digest", "n", picked.alias("picked")).join(comps, "digest").select("digest", "n", "comp", "size", F.explode("picked").alias("m")))
    first = F.struct(-F.col("size"), F.xxhash64("digest", F.lit(mins.start)), "digest", "n", "comp")
    lead = rows.groupBy("m").agg(F.min(first).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    lead = lead.select("m", F.col("l.digest").alias("u"), F.col("l.n").alias("un"), F.col("l.comp").alias("uc"))
    pairs = spread_join(rows, lead, ["m"], ["digest"]).filter((F.col("comp") != F.col("uc")) & _close(F.col("n"), F.col("un")))
    return scratch.keep(pairs.select("u", F.col("digest").alias("v")).distinct())


def _residual(sets: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, n, comp, size, parts, part) of the sets that may have a link into another component.

    ``size`` counts such sets of the component, ``parts`` is into how many it is cut.
    """
    prefix = sets.select("digest", "n", F.slice("hashes", F.lit(1), _prefix_col(F.col("n"))).alias("hs")).join(comps, "digest").select("digest", "n", "comp", F.explode("hs").alias("h"))
    mixed = prefix.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    hits = prefix.join(mixed, "h").groupBy("digest").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    left = scratch.keep(hits.filter(F.col("hits") >= _need_col(F.col("n"))).select("digest", "n", "comp"))
    parts = F.when(F.count(F.lit(1)) > SMALL, F.ceil(F.sum("n") / BLOCK_HASHES)).otherwise(1)
    totals = left.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), parts.cast("long").alias("parts"))
    return scratch.keep(spread_join(left, totals, ["comp"], ["digest"]).withColumn("part", F.pmod(F.xxhash64("digest"), "parts")))


def _index(sets: DataFrame, residual: DataFrame) -> DataFrame:
    """The index's entries: (h, digest, n, comp, size, part, held, place, block, before).

    Each set's hashes stand in order of the components that hold them, the rarest first,
    and its prefix enters the lists of those that two components hold. ``block`` is the
    class of the set's size; ``before`` are the entries just before in the same set.
    """
    rows = sets.select("digest", "hashes").join(residual.drop("parts"), "digest").withColumn("h", F.explode("hashes")).drop("hashes")
    spread = rows.select("h", "comp").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    ranked = rows.join(spread, "h").selectExpr("*", "row_number() over (partition by digest order by held, h) as place")
    index = ranked.filter((F.col("place") <= F.col("n") - _alpha_col(F.col("n")) + 1) & (F.col("held") > 1))
    index = index.selectExpr("*", f"collect_list(h) over (partition by digest order by place rows between {BEFORE} preceding and 1 preceding) as before")
    return index.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int"))


def _asks(index: DataFrame) -> DataFrame:
    """(u, a, b, part): sets that the index can't rule out to be linked with a set in a part of another component.

    Sets of small components meet each other one by one, at the first hash they share. A
    list's blocks are rows: sizes of one class, positions of one range, the least size and
    the most hashes that follow a position. What is out of reach is skipped block by block
    before any of its entries is looked at. A large component stands in each list as one
    entry for each part and class of sizes.
    """
    columns = ("digest", "n", "comp", "size", "place", "before")
    a = index.select("h", "block", *[F.col(c).alias(f"a_{c}") for c in columns])
    reached = lambda df, classes: df.withColumn("block", F.explode(F.array(*[F.col("block") + k for k in classes])))
    need = lambda m, n: F.ceil((m + n) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)
    after = F.col("a_n") - F.col("a_place")
    small = index.filter(F.col("size") <= SMALL).withColumn("range", F.floor(F.col("place") / BLOCK_PLACES)).withColumn("slot", F.pmod(F.xxhash64("digest"), F.ceil(F.col("held") / BLOCK_ENTRIES).cast("long")))
    entry = F.struct(*[F.col(c).alias(f"b_{c}") for c in ("digest", "n", "comp", "place", "before")], "part")
    lists = small.groupBy("h", "block", "range", "slot").agg(F.min("n").alias("lo"), F.max(F.col("n") - F.col("place")).alias("follow"), F.collect_list(entry).alias("entries"))
    # a class of sizes reaches itself and the next one; one more for rounding of logarithms
    within = F.least(after, F.col("follow")) + 1 >= need(F.col("a_n"), F.greatest("a_n", "lo"))
    one = reached(a.filter(F.col("a_size") <= SMALL), (0, 1, 2)).join(lists, ["h", "block"]).filter(within)
    one = one.drop("h", "block", "range", "slot", "lo", "follow").select("*", F.explode("entries").alias("e")).drop("entries").select("*", "e.*").drop("e")
    larger = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_digest") < F.col("b_digest")))
    reach = F.least(after, F.col("b_n") - F.col("b_place")) + 1
    one = one.filter((F.col("a_comp") != F.col("b_comp")) & larger & _close(F.col("a_n"), F.col("b_n")) & (reach >= need(F.col("a_n"), F.col("b_n"))) & ~F.arrays_overlap("a_before", "b_before"))
    large = index.filter(F.col("size") > SMALL).groupBy("h", "block", "part", F.col("comp").alias("b_comp"), F.col("size").alias("b_size"))
    large = large.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("follow"))
    other = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_comp") < F.col("b_comp")))
    many = reached(a, (-2, -1, 0, 1, 2)).join(large, ["h", "block"])
    many = many.filter(
        other & (F.col("a_n") * PERCENT <= F.col("hi") * 100) & (F.col("lo") * PERCENT <= F.col("a_n") * 100)
        & (F.least(after, F.col("follow")) + 1 >= need(F.col("a_n"), F.col("lo")))
    )
    pick = lambda df: df.select(F.col("a_digest").alias("u"), F.col("a_comp").alias("a"), F.col("b_comp").alias("b"), "part")
    return pick(one).unionByName(pick(many)).distinct()


def text_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row.

    component_id is the smallest doc_id reachable by links, the row's own included. A
    text without words has no shingles and is linked with nothing. Null ids take part
    but name a component only if no other id is in it. Repeated rows are linked, and
    give a row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    buckets = max(8, docs.count() // BUCKET_TEXTS)
    sheets = scratch.keep(_sheets(rows, buckets))
    texts = scratch.keep(sheets.filter("kind = 0").select("doc_id", "n", "digest", "other", "text_hash"))
    hits = sheets.filter("kind = 1").select("digest", "n", "hits").unionByName(_bucket_hits(sheets.filter("kind = 2").select("bucket", "hashes", "owners")), allowMissingColumns=True)
    hits = hits.groupBy("digest").agg(F.max("n").alias("n"), F.sum("hits").alias("hits")).filter(F.col("hits") >= _need_col(F.col("n")))
    classes = scratch.keep(texts.filter("n > 0").groupBy("digest", "other").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least")))
    wanted = scratch.keep(classes.join(hits.select("digest"), "digest", "left_semi").select("text_hash"))
    scratch.drop(sheets)
    many = wanted.count()
    named = classes.select("digest", "other", F.col("least").alias("component_id"))
    if many:
        size = min(FILTER_BITS, 1 << max(16, int(many * 16).bit_length()))
        sets = _named(_candidate_sets(rows, bitmap(wanted, "text_hash", size).view(np.int64)), scratch)
        comps = scratch.keep(sets.select("digest", F.col("digest").alias("comp"), F.lit(1).cast("long").alias("size")))
        at = 0
        for k in ROUNDS:
            comps = _merge(comps, _between(verified(_leader_pairs(sets, comps, slice(at, at + k), scratch), sets), comps), scratch)
            at += k
        residual = _residual(sets, comps, scratch)
        if not residual.isEmpty():
            asks = scratch.keep(_asks(scratch.keep(_index(sets, residual))))
            comps = _merge(comps, component_links(asks, sets, residual.select("digest", "comp", "part")), scratch)
        own = sets.select(F.col("half").alias("digest"), "other", F.col("digest").alias("node")).join(comps.withColumnRenamed("digest", "node"), "node")
        whole = scratch.keep(classes.join(own, ["digest", "other"], "left").select("digest", "other", "least", "comp"))
        joined = whole.filter("comp is not null")
        low = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
        single = whole.filter("comp is null").select("digest", "other", F.col("least").alias("component_id"))
        named = spread_join(joined, low, ["comp"], ["digest"]).select("digest", "other", "component_id").unionByName(single)
    out = spread_join(texts, named, ["digest", "other"], ["doc_id"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return scratch.last(out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component; rows without words all stay."""
    found = text_components(docs)
    keep = found.filter("n_shingles > 0").groupBy(F.coalesce("component_id", "text_hash").alias("c")).agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = docs.filter(has_words).withColumn("__hash", F.xxhash64("text")).withColumn("__id", F.col("doc_id").cast("long"))
    same = full["__hash"].eqNullSafe(keep["__hash"]) & full["__id"].eqNullSafe(keep["__id"])
    kept = full.join(keep, same, "left_semi").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
    return kept.unionByName(docs.filter(~has_words))
