"""Deterministic splits by hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_percent(key: Column) -> Column:
    """0 to 99 from the md5 of the key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100


def group_fold(key: Column, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test: all rows of a key in one fold."""
    p = hash_percent(key)
    return F.when(p < train, "train").when(p < train + validation, "validation").otherwise("test")


def cross_splits(rows: DataFrame, by: str = "source") -> DataFrame:
    """(train_on, test_on, and the rows): each row once as training row of its own source or channel and once as test row of every other one.

    Sources are few; their list is joined with itself, never the rows with each other.
    """
    names = rows.select(F.col(by).alias("train_on")).distinct()
    pairs = names.crossJoin(names.withColumnRenamed("train_on", "test_on")).filter("train_on <> test_on")
    learn = rows.join(F.broadcast(pairs), rows[by] == pairs["train_on"]).withColumn("part", F.lit("train"))
    held = rows.join(F.broadcast(pairs), rows[by] == pairs["test_on"]).withColumn("part", F.lit("test"))
    return learn.unionByName(held)
