"""Mixing sources to target weights by Poisson replication (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import uniform

#: A rate is split into equal parts of at most this mean, so that exp(-mean) never underflows.
PART_MEAN = 16.0
#: Sources up to which their rates are broadcast; beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def poisson_cdf(mean: Column) -> Column:
    """P(X <= j) for j = 0, 1, ... far into the tail, for a mean of at most PART_MEAN."""
    last = F.ceil(mean + F.sqrt(mean) * 12 + 24).cast("int")
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("term"), F.array(first).alias("cdf")),
        lambda acc, j: F.struct(
            (acc["term"] * mean / j).alias("term"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / j)).alias("cdf"),
        ),
    )
    return steps["cdf"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source: str = "source") -> DataFrame:
    """(source, rate): mean number of copies of each document of a source.

    ``weights`` are shares of the mix; sources not named get none, and without
    weights each source gets the same share. ``total`` is the expected size of the
    mix, by default the number of documents. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        counts = counts.withColumn("__w", F.lit(1.0))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
        counts = counts.withColumn("__w", share)
    row = counts.agg(F.sum("__n").alias("n"), F.sum("__w").alias("w"), F.count(F.lit(1)).alias("sources")).first()
    size = float(total if total is not None else row["n"] or 0)
    rate = F.lit(size) * F.col("__w") / F.lit(float(row["w"] or 1.0)) / F.col("__n")
    out = counts.select("__source", rate.alias("__rate"))
    return F.broadcast(out) if row["sources"] <= BROADCAST_SOURCES else out


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document as often as a Poisson number with its source's rate says.

    The number is the inverse of the Poisson distribution at a uniform number made
    from the seed and the document's key, so the same input gives the same mix at
    any partitioning. Adds ``rate``, ``copy`` (from 1) and ``mix_key``; columns of
    these names in the input are replaced. Rows with the same key (null too) get the
    same number of copies each. Texts play no part, so null, empty and long ones
    are kept as they are; an empty table gives an empty mix.
    """
    rates = source_rates(docs, weights, total, source)
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART_MEAN)).cast("int")
    rates = rates.withColumn("__parts", parts).withColumn("__cdf", poisson_cdf(F.col("__rate") / F.col("__parts")))
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda i: uniform(F.lit(seed), F.col(key), i))
    number = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))
    mixed = (
        docs.drop("rate", "copy", "mix_key")
        .join(rates, docs[source].eqNullSafe(F.col("__source")), "inner")
        .withColumn("__number", number)
        .filter(F.col("__number") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__number"))))
        .withColumnRenamed("__rate", "rate")
        .drop("__source", "__parts", "__cdf", "__number")
    )
    return mixed.withColumn("mix_key", uniform(F.lit(seed), F.lit("order"), F.col(key), F.col("copy")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``replicate`` in a global pseudo-random order: sorted by ``mix_key`` over all partitions."""
    return replicate(docs, weights, total, seed, key, source).orderBy("mix_key", key, "copy")
