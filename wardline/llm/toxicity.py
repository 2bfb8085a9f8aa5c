"""Toxicity: a factorisation machine over hashed terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import hashed
from wardline.llm.quality import held_out, train

SETTINGS = hashed.Settings(factors=4, min_rows=5, batch=8, alpha=1.0, l1=10.0, l2=0.01, rounds=2)
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, settings: hashed.Settings = SETTINGS) -> hashed.Scorer:
    """Weights of single terms and vectors whose products weigh pairs, as an insult beside a group's name."""
    return train(docs, labels, "toxic", hashed.presence_terms, settings)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: hashed.Settings = SETTINGS) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely label 1 is for each row of ``docs``.

    Only the text enters the score, whole. Null and empty texts are scored by the
    bias. A null doc_id is scored too; its held_out is null. Repeated rows get equal
    scores; other columns of the input play no part.
    """
    scored = hashed.scores(docs, fit(docs, labels, settings), hashed.presence_terms, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: hashed.Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, all columns kept."""
    scored = hashed.scores(docs, fit(docs, labels, settings), hashed.presence_terms, "__toxicity")
    return scored.filter(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
