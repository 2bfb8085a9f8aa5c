"""Linear and factorisation models over hashed terms, trained by mixing shard models.

Training reads a bounded, hash-picked sample of labelled rows. In each round every
shard of the sample starts from the same model and passes once over its rows; the
shard models are averaged. What reaches the driver is the vocabulary and one model a
shard, both bounded by the parameters, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import words as W
from wardline.llm.scratch import Scratch

#: Hash space of the terms.
BUCKETS = 1 << 22
#: Texts' bytes handled at once in a task.
BATCH_BYTES = 2 << 20

#: Bytes of a word's stems.
STEM_BYTES = (4, 5)


@dataclass(frozen=True)
class Settings:
    """What a model is made of and how it is trained."""

    factors: int = 0  # length of each term's interaction vector; 0: none, a linear model
    sample_rows: int = 24_000  # labelled rows to fit on, at most about this many
    max_terms: int = 1 << 16  # terms of the model, the most frequent ones
    min_rows: int = 3  # sampled rows in which a term occurs at least
    shard_rows: int = 4_000  # rows of the sample that one shard's model learns from, about
    rounds: int = 3
    epochs: int = 3  # passes of a shard over its rows in each round
    batch: int = 32
    alpha: float = 0.5  # learning rate
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.01
    seed: int = 11


#: (row, bucket, value) of each distinct term of each text, rows in order.
Terms = tuple[np.ndarray, np.ndarray, np.ndarray]


def _totals(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs and how often each occurs."""
    key = np.sort(row.astype(np.uint64) << np.uint64(22) | bucket)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(22)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), count


def ngram_terms(texts: pa.Array, keep: np.ndarray | None = None) -> Terms:
    """Words, pairs of neighbours and a mark for a word said again, weighted by the root of their share.

    Words are runs of letters and digits or of signs, in their own case. The roots of
    the shares of all words have length 1, so long and short texts weigh the same.
    ``keep`` marks the buckets that matter; others are left out early.
    """
    w = W.words(texts, W.SIGN_WORDS, lower=False)
    mask = np.uint64(BUCKETS - 1)
    same = w.doc[1:] == w.doc[:-1]
    pair = W.combine([w.hash[:-1], w.hash[1:]])[same] if len(w.hash) > 1 else np.zeros(0, np.uint64)
    twice = same & (w.hash[1:] == w.hash[:-1]) if len(w.hash) > 1 else np.zeros(0, bool)
    row = np.concatenate([w.doc, w.doc[1:][same], w.doc[1:][twice]])
    bucket = np.concatenate([w.hash & mask, pair & mask, np.full(int(twice.sum()), 1, np.uint64)])
    if keep is not None:
        on = keep[bucket]
        row, bucket = row[on], bucket[on]
    row, bucket, count = _totals(row, bucket)
    return row, bucket, np.sqrt(count / np.maximum(1, np.diff(w.first))[row])


def presence_terms(texts: pa.Array, keep: np.ndarray | None = None) -> Terms:
    """Lower-cased words and the stems of longer ones, each counting once."""
    w = W.words(texts, W.ALNUM_WORDS)
    rows, hashes = [w.doc], [w.hash]
    for size in STEM_BYTES:
        long = np.flatnonzero(w.length > size)
        rows.append(w.doc[long]), hashes.append(W.prefix_hash(w, long, size))
    row, bucket = np.concatenate(rows), np.concatenate(hashes) & np.uint64(BUCKETS - 1)
    if keep is not None:
        on = keep[bucket]
        row, bucket = row[on], bucket[on]
    row, bucket, _ = _totals(row, bucket)
    return row, bucket, np.ones(len(row))


@dataclass
class Model:
    """State of follow-the-regularised-leader for each term, and interaction vectors."""

    terms: np.ndarray  # sorted buckets
    z: np.ndarray = field(default=None)
    n: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)
    vn: np.ndarray = field(default=None)
    z0: float = 0.0
    n0: float = 0.0

    @classmethod
    def fresh(cls, terms: np.ndarray, s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        return cls(terms, np.zeros(len(terms)), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), s.factors)), np.zeros((len(terms), s.factors)))

    def weights(self, s: Settings, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def bias(self, s: Settings) -> float:
        return -self.z0 / ((s.beta + np.sqrt(self.n0)) / s.alpha)

    def learn(self, s: Settings, row: np.ndarray, term: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One update from a batch of rows; ``row`` is sorted and counts from 0."""
        used, inv = np.unique(term, return_inverse=True)
        w = self.weights(s, used)
        v = np.where(w[:, None] != 0, self.v[used], 0.0)
        p = _chance(self.bias(s), w[inv], v[inv], row, x, len(y))
        slope = p - y
        g = np.bincount(inv, slope[row] * x, len(used))
        n = self.n[used]
        self.z[used] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[used] = n + g * g
        g0 = slope.sum()
        b = self.bias(s)
        self.z0 += g0 - (np.sqrt(self.n0 + g0 * g0) - np.sqrt(self.n0)) / s.alpha * b
        self.n0 += g0 * g0
        for f in range(s.factors):
            vx = v[inv, f] * x
            total = np.bincount(row, vx, len(y))
            gv = np.bincount(inv, slope[row] * x * (total[row] - vx), len(used)) + s.l2 * v[:, f]
            live = w != 0
            self.vn[used[live], f] += gv[live] ** 2
            self.v[used[live], f] -= 0.1 * gv[live] / (1.0 + np.sqrt(self.vn[used[live], f]))

    def pack(self) -> bytes:
        return np.concatenate([[self.z0, self.n0], self.z, self.n, self.v.ravel(), self.vn.ravel()]).tobytes()

    def unpack(self, flat: np.ndarray) -> Model:
        m, k = len(self.terms), self.v.shape[1]
        cut = np.cumsum([2, m, m, m * k, m * k])
        return Model(self.terms, flat[2 : cut[1]].copy(), flat[cut[1] : cut[2]].copy(), flat[cut[2] : cut[3]].reshape(m, k).copy(), flat[cut[3] : cut[4]].reshape(m, k).copy(), float(flat[0]), float(flat[1]))


def _chance(bias: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Probability of label 1 for each row: bias, weights and pairwise products of the vectors."""
    sums = bias + np.bincount(row, w * x, rows)
    for f in range(v.shape[1]):
        vx = v[:, f] * x
        sums += 0.5 * (np.bincount(row, vx, rows) ** 2 - np.bincount(row, vx * vx, rows))
    return 1.0 / (1.0 + np.exp(-np.clip(sums, -40, 40)))


@dataclass(frozen=True)
class Scorer:
    """The terms of a trained model that have a weight."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def score(self, texts: pa.Array, featurise: Callable[..., Terms], keep: np.ndarray) -> np.ndarray:
        row, bucket, x = featurise(texts, keep)
        at = np.searchsorted(self.terms, bucket)
        return _chance(self.bias, self.w[at], self.v[at], row, x, len(texts))


def _sample(labelled: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """Rows (key, label) picked by a hash of the key, about ``sample_rows`` of them, and into how many shards they go."""
    n = labelled.count()
    part = min(1.0, s.sample_rows / max(1, n))
    return labelled.filter(F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))), max(1, int(part * n) // s.shard_rows)


def train(rows: DataFrame, labelled: DataFrame, featurise: Callable[..., Terms], s: Settings) -> Scorer:
    """A model of ``labelled`` (key, label 0 or 1) over ``rows`` (key, text).

    Without any labelled row the model gives every text 0.5. Keys labelled twice count
    by their larger label; null labels, keys and texts are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    labels = labelled.filter("key is not null and label is not null").groupBy("key").agg(F.max("label").cast("int").alias("label"))
    sample, shards = _sample(labels, s)  # its bound allows the broadcast
    picked = rows.filter("key is not null and text is not null").join(F.broadcast(sample), "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def to_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, BATCH_BYTES):
            row, bucket, x = featurise(b.column("text"))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            packed = lambda v, cut=cut: pa.array([v[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "label", "who", "tie")), packed(bucket.astype(np.int32)), packed(x.astype(np.float32))], ["shard", "label", "who", "tie", "terms", "x"])

    # a key that several rows have counts once, by the text with the smallest hash: the bound of the sample is one of rows
    told = picked.select("shard", "label", "text", F.xxhash64("key").alias("who"), F.xxhash64("text").alias("tie"))
    found = told.mapInArrow(to_terms, "shard int, label int, who long, tie long, terms binary, x binary")
    once = found.groupBy("shard", "who").agg(F.min(F.struct("tie", "label", "terms", "x")).alias("r"))
    data = scratch.keep(once.select("shard", "r.label", "r.terms", "r.x"))
    common = data.select("terms").mapInArrow(_term_rows, "term int, rows long").groupBy("term").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= s.min_rows)
    terms = np.array(sorted(r[0] for r in common.orderBy(F.desc("rows"), "term").limit(s.max_terms).select("term").collect()), dtype=np.int64)
    model = Model.fresh(terms, s)
    if not len(terms):
        mean = sample.agg(F.avg("label")).first()[0]
        odds = np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)) if mean is not None else 0.0
        scratch.drop()
        return Scorer(terms, np.zeros(0), np.zeros((0, s.factors)), float(odds))
    for k in range(s.rounds):
        start = spark.sparkContext.broadcast(model)

        # a shard is a group, however its rows are stored: one model each
        parts = data.groupBy("shard").applyInArrow(_learner(start, s, k), "n long, model binary").toArrow()
        # sums of floats in one order; the driver holds the shards' models once
        order = sorted(range(parts.num_rows), key=lambda i: (parts["n"][i].as_py(), parts["model"][i].as_py()[:16]))
        total, flat = float(sum(parts["n"].to_pylist())), 0.0
        for i in order:
            flat = flat + parts["n"][i].as_py() / total * np.frombuffer(parts["model"][i].as_buffer())
        del parts
        model = model.unpack(flat)
        start.destroy()
    scratch.drop()
    w = model.weights(s)
    on = np.flatnonzero(w)
    return Scorer(terms[on], w[on], model.v[on], float(model.bias(s)))


def _learner(start, s: Settings, k: int) -> Callable[[pa.Table], pa.Table]:
    """A function that learns from a shard, beginning with the model of all shards so far."""

    def one_pass(table: pa.Table) -> pa.Table:
        shard = _shard(table)
        m = start.value.unpack(np.frombuffer(start.value.pack()))
        for e in range(s.epochs):
            _pass_over(m, *shard, s, k * s.epochs + e)
        return pa.table({"n": pa.array([len(shard[0])], pa.int64()), "model": pa.array([m.pack()], pa.binary())})

    return one_pass


def _shard(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(labels, lengths, terms, values) of a shard, its rows end to end; the sample's bound is theirs."""
    whole = lambda c, t: np.frombuffer(b"".join(v.as_buffer() for v in table.column(c)), t)
    lengths = (pc.binary_length(table.column("terms")).to_numpy() // 4).astype(np.int32)
    return table.column("label").to_numpy().astype(np.int32), lengths, whole("terms", np.int32), whole("x", np.float32)


def _term_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, rows) of the rows of each batch: a row holds a term once."""
    for b in W.batches(it, BATCH_BYTES, "terms"):
        whole = np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32)
        term, rows = np.unique(whole, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(rows, pa.int64())], ["term", "rows"])


def _pass_over(m: Model, y: np.ndarray, length: np.ndarray, bucket: np.ndarray, x: np.ndarray, s: Settings, k: int) -> int:
    """Learn from all rows once, in an order of its own; returns the number of rows."""
    cut = np.concatenate([[0], np.cumsum(length)])
    y = y.astype(float)
    at = np.searchsorted(m.terms, bucket)
    known = m.terms[np.minimum(at, len(m.terms) - 1)] == bucket
    # rows may have come in any order: they are told apart by what they hold
    sign = [zlib.crc32(bucket[cut[r] : cut[r + 1]].tobytes(), int(y[r])) for r in range(len(y))]
    order = np.argsort(sign, kind="stable")[np.random.default_rng(s.seed + k).permutation(len(y))]
    for a in range(0, len(order), s.batch):
        rows = order[a : a + s.batch]
        idx = np.concatenate([np.arange(cut[r], cut[r + 1]) for r in rows])
        row = np.repeat(np.arange(len(rows)), cut[rows + 1] - cut[rows])
        on = known[idx]
        m.learn(s, row[on], at[idx][on], x[idx][on].astype(float), y[rows])
    return len(y)


def scores(docs: DataFrame, scorer: Scorer, featurise: Callable[..., Terms], column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and the score of each text; null and empty texts get the bias alone.

    The columns pass through Arrow unchanged; one named like the new column is replaced.
    """
    names = [c for c in keep or docs.columns if c != column]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(BUCKETS, bool)
        on[sent.value.terms] = True
        for b in W.batches(it, BATCH_BYTES):
            out = sent.value.score(b.column("text"), featurise, on)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.float64())], [*names, column])

    used = docs.select(*dict.fromkeys([*names, "text"]))
    return used.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(column, T.DoubleType())]))
