"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import hashed

SETTINGS = hashed.Settings(factors=0, alpha=2.0, l1=0.3, l2=0.01)
THRESHOLD = 0.3


def held_out(key: str = "doc_id"):
    """True for the fifth of the keys that training never sees."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str, featurise, settings: hashed.Settings) -> hashed.Scorer:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    rows = docs.select(F.col("doc_id").alias("key"), "text")
    known = labels.filter(~held_out()).select(F.col("doc_id").alias("key"), F.col(label).alias("label"))
    return hashed.train(rows, known, featurise, settings)


def score_quality(docs: DataFrame, labels: DataFrame, settings: hashed.Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely label 1 is for each row of ``docs``.

    Only the text enters the score, whole. Null and empty texts are scored by the
    bias. A null doc_id is scored too; its held_out is null. Repeated rows get equal
    scores; other columns of the input play no part.
    """
    scorer = train(docs, labels, "quality", hashed.ngram_terms, settings)
    scored = hashed.scores(docs, scorer, hashed.ngram_terms, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
