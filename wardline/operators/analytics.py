"""Statistics over decisions: buckets, histograms, drift, rates, quantiles, evaluation, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.steps import Scratch

DECISIONS = ("ALLOW", "FLAG", "QUARANTINE", "BLOCK")


def newest(rows: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The latest ``n`` rows, ties by id."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def keep_last(rows: DataFrame, by: list[str], time: str, tie: str, n: int) -> DataFrame:
    """The latest ``n`` rows of each kind, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def hourly_decisions(rows: DataFrame, time: str, decision: str) -> DataFrame:
    """(hour, n, and one count for each decision) for every hour between first and last, empty ones too.

    Hours are full timestamps, so days never fold into each other.
    """
    hourly = rows.groupBy(F.date_trunc("hour", time).alias("hour")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(decision) == d).alias(f"n_{d.lower()}") for d in DECISIONS])
    spine = rows.agg(F.min(F.date_trunc("hour", time)).alias("a"), F.max(F.date_trunc("hour", time)).alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return spine.join(hourly, "hour", "left").na.fill(0)


def bin_of(score: Column) -> Column:
    """Tenth of a score of 0 to 100; the last one holds 100."""
    return F.least(F.lit(9), F.floor(score / 10)).cast("int")


def histogram(rows: DataFrame, score: Column) -> DataFrame:
    """(bin, n) of the ten bins, empty ones too."""
    spine = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return spine.join(rows.groupBy(bin_of(score).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bin", "left").na.fill(0)


def psi(rows: DataFrame, score: Column, recent: Column, least: int = 20) -> DataFrame:
    """(n_old, n_recent, psi): population stability between older and recent rows; null below ``least`` rows a side.

    Shares are floored at 0.0001, psi has 4 digits; 0.1 is a drift, 0.25 a strong one.
    """
    spine = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    bins = rows.groupBy(bin_of(score).alias("bin")).agg(F.count_if(~recent).alias("p"), F.count_if(recent).alias("q"))
    full = spine.join(bins, "bin", "left").na.fill(0)
    total = full.agg(F.sum("p").alias("n_old"), F.sum("q").alias("n_recent"))
    floor = F.lit(1e-4)
    p, q = F.greatest(F.col("p") / F.col("n_old"), floor), F.greatest(F.col("q") / F.col("n_recent"), floor)
    one = full.join(F.broadcast(total)).groupBy("n_old", "n_recent").agg(F.sum((q - p) * F.ln(q / p)).alias("s"))  # ten rows beside one
    return one.select("n_old", "n_recent", F.when((F.col("n_old") >= least) & (F.col("n_recent") >= least), F.round("s", 4)).alias("psi"))


def new_values(rows: DataFrame, values: list[str], recent: Column, most: int | None = None) -> DataFrame:
    """Values that only recent rows have; for a report the ``most`` frequent ones with how often they occur, ties in order."""
    found = rows.groupBy(*values).agg(F.max((~recent).cast("int")).alias("__old"), F.count(F.lit(1)).alias("n")).filter("__old = 0").drop("__old")
    return found.drop("n") if most is None else found.orderBy(F.desc("n"), *values).limit(most)


def rate(condition: Column, among: Column) -> Column:
    """Share of the rows of ``among`` that fulfil the condition; null without any."""
    return F.count_if(condition & among) / F.nullif(F.count_if(among), F.lit(0))


def _ranged(counts: DataFrame, by: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """``counts`` with running sums over ``by`` in ``order``, its row's own included: new columns named by ``sums`` (column: name).

    Rows are cut into ranges of the order, each summed by itself; what the ranges before it come to is added.
    There are as many ranges as shuffle partitions, so the second step has that many rows a group. Ranges are cut by a
    sample, so the rows are written once with their range: both steps must see the same ones.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = Scratch(spark).keep(counts.repartitionByRange(n, *by, order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({name: F.sum(c).over(own) for c, name in sums.items()})
    totals = inside.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{name}") for c, name in sums.items()])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__{name}": F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)) for name in sums.values()})
    met = inside.join(totals, [*by, "__part"])
    return met.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums.values()}).drop("__part", *[f"__{name}" for name in sums.values()])


def latency_quantiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, p50, p95, p99): p50 is the true median, the others are the value at place min(n - 1, floor(n * p)).

    Equal values are counted first, in partial sums; places are found in the running sums of the counts.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__c"))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("__n"))
    placed = _ranged(counts, [by], F.col(value), {"__c": "__to"}).join(total, by)
    holds = lambda k: (F.col("__to") > k) & (F.col("__to") - F.col("__c") <= k)
    at = lambda k: F.max(F.when(holds(k), F.col(value)))
    n = F.col("__n")
    place = lambda p: F.least(n - 1, F.floor(n * p))
    out = placed.groupBy(by, "n").agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("p50"), at(place(0.95)).alias("p95"), at(place(0.99)).alias("p99"))
    return out.select(by, "n", "p50", "p95", "p99")


def confusion(rows: DataFrame, score: Column, label: Column, threshold: float = 0.5) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1); ratios are 0 where they have no rows."""
    hit, pos = score >= threshold, label == 1
    out = rows.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def by_score(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """(score, pos, neg) of each distinct score: what ranks need, however many rows share a score."""
    return rows.groupBy(score.alias("score")).agg(F.count_if(label == 1).alias("pos"), F.count_if(label != 1).alias("neg"))


def roc_auc(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """(auc): chance that a positive scores above a negative, ties counting half."""
    upto = _ranged(by_score(rows, score, label), [], F.col("score"), {"neg": "upto"})
    total = upto.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select((F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """(ap): precision at each distinct score, weighted by the recall that it adds."""
    counted = by_score(rows, score, label).withColumn("all", F.col("pos") + F.col("neg")).withColumn("down", -F.col("score"))
    cum = _ranged(counted, [], F.col("down"), {"pos": "tp", "all": "n"})
    return cum.agg((F.sum(F.col("pos") * F.col("tp") / F.col("n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def versions(rows: DataFrame, name: str, time: str, tie: str) -> DataFrame:
    """Rows numbered by name; the last version is active, the others are archived."""
    order = Window.partitionBy(name).orderBy(time, tie)
    return rows.withColumn("version", F.row_number().over(order)).withColumn("status", F.when(F.lead(tie).over(order).isNull(), "active").otherwise("archived"))


def breaker_states(rows: DataFrame, key: str, time: str, tie: str, failed: Column, threshold: int = 4) -> DataFrame:
    """Consecutive failures up to each row, and whether the breaker is open after it: the batch twin of the stream's state."""
    order = Window.partitionBy(key).orderBy(time, tie)
    marked = rows.withColumn("__fail", failed.cast("int")).withColumn("__island", F.sum(1 - F.col("__fail")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "__island").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum("__fail").over(run)).withColumn("open", F.col("failures") >= threshold).drop("__fail", "__island")
