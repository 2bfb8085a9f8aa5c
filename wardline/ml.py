"""Models of links and texts with ``pyspark.ml``: training, blending, calibration, clusters, explanations."""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardline.functions import text as X
from wardline.functions import urls as U


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` so that both classes count the same."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))  # two rows
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return rows.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("__all") / F.col("__k") / F.col("__n")).drop("__n", "__all", "__k")


def ngram_model(rows: DataFrame, buckets: int = 1 << 20, c: float = 4.0, iterations: int = 30) -> PipelineModel:
    """Logistic regression over hashed character n-grams of ``normalized`` links with ``label``."""
    prepared = balanced(rows).withColumn("grams", U.char_ngrams(F.col("normalized")))
    n = prepared.count()
    steps = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets), Normalizer(inputCol="tf", outputCol="features")]
    return Pipeline(stages=[*steps, LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(1, n)), maxIter=iterations)]).fit(prepared)


def tree_model(rows: DataFrame, columns: list[str], boosted: bool = True, trees: int = 50) -> PipelineModel:
    """Boosted trees, or a forest, over numeric features with ``label``."""
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    made = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=5, seed=7) if boosted else RandomForestClassifier(weightCol="weight", numTrees=trees, seed=7)
    return Pipeline(stages=[assemble, made]).fit(balanced(rows))


def word_features(text: Column, limit: int | None = None) -> Column:
    """Tokens and their pairs; the prior system's feature takes the first 800 tokens as ``limit``."""
    words = X.tokens(text) if limit is None else F.slice(X.tokens(text), 1, limit)
    return F.concat(words, X.bigrams(words))


@functools.lru_cache(1 << 17)
def bucket_of(term: str, buckets: int) -> int:
    """The place that ``HashingTF`` gives a term: 32-bit murmur3 of its bytes with seed 42."""
    data, h, mask = term.encode(), 42, 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> (32 - n)) & mask
    for k in range(0, len(data) - len(data) % 4, 4):
        h = (turn(h ^ turn(int.from_bytes(data[k : k + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if len(data) % 4:
        h ^= turn(int.from_bytes(data[len(data) - len(data) % 4 :], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def sublinear(terms: list[str], idf: np.ndarray) -> dict[int, float]:
    """Weights of a text's places: (1 + ln tf) (idf + 1), to length 1. ``idf`` is ``pyspark.ml``'s, ln((n + 1) / (df + 1))."""
    tf = Counter(bucket_of(t, len(idf)) for t in terms)
    raw = {k: (1 + math.log(n)) * (idf[k] + 1) for k, n in sorted(tf.items())}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {k: v / norm for k, v in raw.items()}


def sublinear_vectors(terms: Column, idf: np.ndarray) -> Column:
    """Sparse vectors of ``sublinear``; idf, of a fixed number of places, goes to every task.

    Vectors don't pass Arrow, so this runs row by row; only training needs it, scoring uses ``TextModel``.
    """

    def one(ts: list[str] | None) -> SparseVector:
        return SparseVector(len(idf), sublinear(ts or [], idf))

    return F.udf(one, VectorUDT())(terms)


@dataclass(frozen=True)
class TextModel:
    """Logistic regression over ``sublinear`` weights: idf, coefficients by place (those that aren't 0), intercept."""

    idf: np.ndarray
    coefficients: dict[int, float]
    intercept: float

    def margins(self, terms: Column) -> Column:
        """The log odds of a text."""
        return self.explained(terms, 0)["margin"]

    def explained(self, terms: Column, most: int = 8) -> Column:
        """(margin, rest, reasons) of a text: reasons (term, weight) are the ``most`` terms that add most to the margin, best first, of which
        none holds another or is held by one before it; ``rest`` is the intercept and what all other terms add, so that
        it and the reasons sum up to the margin. Coefficients are looked up by place in each task; nothing is exploded or joined."""
        idf, known, intercept = self.idf, self.coefficients, self.intercept

        def one(ts: list[str]) -> dict:
            weights = sublinear(ts, idf)
            at = {t: bucket_of(t, len(idf)) for t in ts}
            tf, own = Counter(at[t] for t in ts), Counter(ts)
            adds = {t: weights[at[t]] * known.get(at[t], 0.0) * n / tf[at[t]] for t, n in own.items()}
            margin = intercept + sum(adds.values())
            chosen: list[tuple[str, float]] = []
            for t, w in sorted(adds.items(), key=lambda x: (-x[1], x[0])):
                if w <= 0 or len(chosen) >= most:
                    break
                if not any(t in c or c in t for c, _ in chosen):
                    chosen.append((t, w))
            return {"margin": margin, "rest": margin - sum(w for _, w in chosen), "reasons": [{"term": t, "weight": w} for t, w in chosen]}

        kind = pa.struct([("margin", pa.float64()), ("rest", pa.float64()), ("reasons", pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())])))])

        @arrow_udf("struct<margin: double, rest: double, reasons: array<struct<term: string, weight: double>>>")
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([one(ts or []) for ts in rows.to_pylist()], kind)

        return run(terms)


def tfidf_model(rows: DataFrame, buckets: int = 1 << 18, c: float = 8.0, iterations: int = 30) -> TextModel:
    """A model of ``text`` and ``label``: words and pairs, sublinear term frequency, smoothed idf, classes balanced."""
    prepared = balanced(rows).withColumn("words", word_features(F.col("text")))
    n = prepared.count()
    places = HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets, binary=True).transform(prepared)
    idf = IDF(inputCol="tf", outputCol="idf").fit(places).idf.toArray()
    features = prepared.select("label", "weight", sublinear_vectors(F.col("words"), idf).alias("features"))
    fitted = LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(1, n)), maxIter=iterations).fit(features)
    coefficients = fitted.coefficients.toArray()
    on = np.flatnonzero(coefficients)
    return TextModel(idf, dict(zip(on.tolist(), coefficients[on].tolist(), strict=True)), float(fitted.intercept))


def embedding_model(rows: DataFrame, vector: str = "embedding", label: str = "label", iterations: int = 50) -> PipelineModel:
    """Logistic regression over dense vectors."""
    prepared = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return Pipeline(stages=[LogisticRegression(maxIter=iterations, regParam=1e-3)]).fit(prepared)


def positive(scored: DataFrame, name: str = "p") -> DataFrame:
    """Adds the probability of class 1."""
    return scored.withColumn(name, vector_to_array("probability")[1])


def calibrate(scored: DataFrame, score: str = "p", label: str = "label"):
    """Isotonic regression of the label on a score."""
    rows = scored.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression().fit(VectorAssembler(inputCols=["features"], outputCol="v").transform(rows).select(F.col("v").alias("features"), "label"))


def clusters(rows: DataFrame, vector: str = "embedding", k: int = 64, seed: int = 7) -> DataFrame:
    """(cluster, centre): centres of length 1 of k clusters of the vectors."""
    prepared = Normalizer(inputCol="features", outputCol="unit").transform(rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    model = KMeans(k=k, seed=seed, featuresCol="unit").fit(prepared)
    centres = [(i, [float(x) for x in c / max(1e-12, float((c * c).sum()) ** 0.5)]) for i, c in enumerate(model.clusterCenters())]  # k rows
    return rows.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")


def contributions(rows: DataFrame, weights: DataFrame, key: str, terms: Column, most: int = 8) -> DataFrame:
    """(key, reasons): the terms of each row that add most to its score, by a table of weights (term, weight)."""
    each = rows.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(weights, "term").filter("weight > 0")
    found = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("weight", "term")), asc=False).alias("r"))
    return found.select(key, F.slice("r", 1, most).alias("reasons"))


def blend(scored: list[DataFrame], key: str, weights: list[float] | None = None, name: str = "p") -> DataFrame:
    """(key, p): weighted mean of the probabilities of several models over the same rows; rows that one model lacks take the others' mean."""
    weights = weights or [1.0] * len(scored)
    rows = [df.select(key, (F.col(name) * w).alias("__s"), F.when(F.col(name).isNotNull(), w).alias("__w")) for df, w in zip(scored, weights, strict=True)]
    return reduce(DataFrame.unionAll, rows).groupBy(key).agg((F.sum("__s") / F.sum("__w")).alias(name))
