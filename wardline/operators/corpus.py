"""Training corpora: conflicts, duplicates, feedback, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicting_keys(labelled: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys that carry more than one label. Least and greatest are compared, so each task sends one row a key."""
    return labelled.groupBy(*key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select(*key)


def _first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the first row of each key: partial minima, so a key with a third of all rows is a row a task."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__order"))


def deduplicate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``, which tells rows of a key apart; conflicts are to be removed before."""
    first = _first(rows, key, order)
    return rows.join(first, rows[key].eqNullSafe(first["__key"]) & (rows[order] == first["__order"]), "left_semi")


def clean_corpus(rows: DataFrame, seen: DataFrame, key: str, order: str, size: Column, least: int) -> DataFrame:
    """``rows`` with ``outcome``: short, seen, duplicate or kept; ``order`` tells rows of a key apart."""
    known = seen.select(key).distinct().withColumn("__seen", F.lit(True))
    first = _first(rows, key, order)
    marked = rows.join(first, rows[key].eqNullSafe(first["__key"]) & (rows[order] == first["__order"]), "left").join(known, key, "left")
    outcome = F.when(size < least, "short").when(F.col("__seen"), "seen").when(F.col("__order").isNull(), "duplicate").otherwise("kept")
    return marked.withColumn("outcome", outcome).drop("__key", "__order", "__seen")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows that come first in the order of a seeded hash of their key."""
    hashed = rows.withColumn("hash_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return hashed.orderBy("hash_key", key).limit(n)
