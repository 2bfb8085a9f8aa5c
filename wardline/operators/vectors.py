"""The nearest of very many centres by cosine, by an inverted file of cells, and what is near in time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from wardline.operators.campaigns import cosine
from wardline.steps import Scratch

#: Cells of the inverted file at most, and cells that a vector looks into.
MOST_CELLS, PROBES = 1024, 12
#: Vectors of a cell for which a group is made, and cosine by which a centre may be off the best and is still scored exactly.
GROUP_ROWS, MARGIN = 20_000, 1e-5


def cells_of(centres: DataFrame, centre: str = "centre", most: int = MOST_CELLS, seed: int = 7) -> np.ndarray:
    """Unit vectors of about the square root of the number of centres, ``most`` at most: those with the smallest hash. A sample of that bound reaches the driver."""
    n = min(most, max(1, 2 * int(centres.count() ** 0.5)))
    rows = centres.select(centre).orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(centre))), centre).limit(n).collect()
    out = np.array([[0.0 if x is None else float(x) for x in r[0]] for r in rows], np.float64)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300) if len(rows) else out


def nearest_cells(vector: Column, cells: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` nearest cells, the nearest first; a null vector has none. The cells are bounded, so they go to every task."""

    @arrow_udf("array<int>")
    def run(vectors: pa.Array) -> pa.Array:
        sizes = np.asarray(vectors.value_lengths().fill_null(0))
        out: list = [None] * len(vectors)
        fit = np.flatnonzero(sizes == cells.shape[1]) if cells.ndim == 2 else []
        for at in range(0, len(fit), 2048):
            part = fit[at : at + 2048]
            flat = np.nan_to_num(vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(part), -1)
            score = flat @ cells.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :n]
            for k, row in zip(part.tolist(), order.tolist(), strict=True):
                out[k] = row
        return pa.array(out, pa.list_(pa.int32()))

    return run(vector)


def indexed_best(rows: DataFrame, campaigns: DataFrame, key: str, vector: str, label: str, probes: int = PROBES, most_cells: int = MOST_CELLS) -> DataFrame:
    """(key, best, similarity): the nearest campaign (label, centre) among those in the cells nearest to each vector, scored exactly.

    Every campaign stands in its nearest cell; each vector looks into ``probes`` of them, so a campaign in
    another cell may be missed: ``campaigns.best_campaign`` is the exact way. Vectors without a campaign in their cells
    get null. A cell that very many vectors look into is dealt over several tasks.
    """
    scratch = Scratch(rows.sparkSession)
    campaigns = scratch.keep(campaigns.select(label, "centre"))
    cells = cells_of(campaigns, most=most_cells)
    listed = scratch.keep(campaigns.select(F.col(label).alias("__label"), "centre", F.explode(nearest_cells(F.col("centre"), cells, 1)).alias("__cell")))
    asked = scratch.keep(rows.select(key, vector, F.explode(nearest_cells(F.col(vector), cells, probes)).alias("__cell")))
    # a cell that more vectors look into is more groups, and its centres are copied to each; cells are bounded, so their sizes are sent to all
    sizes = F.broadcast(asked.groupBy("__cell").agg((F.floor(F.count(F.lit(1)) / GROUP_ROWS) + 1).alias("__n")))
    dealt = asked.join(sizes, "__cell").withColumn("__block", F.pmod(F.xxhash64(key), F.col("__n"))).drop("__n")
    copied = listed.join(sizes, "__cell").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    schema = T.StructType([asked.schema[key], asked.schema[vector], listed.schema["__label"], listed.schema["centre"]])
    met = dealt.groupBy("__cell", "__block").cogroup(copied.groupBy("__cell", "__block")).applyInArrow(_shortlist(key, vector), schema)
    scored = met.select(key, F.struct(F.round(cosine(F.col(vector), F.col("centre")), 6).alias("similarity"), F.col("__label").alias("best")).alias("m"))
    best = scored.groupBy(key).agg(F.max("m").alias("m"))
    return rows.select(key).join(best, key, "left").select(key, F.col("m.best").alias("best"), F.col("m.similarity").alias("similarity"))


def _shortlist(key: str, vector: str):
    """A function of a group's vectors and centres that gives (key, vector, label, centre) of those within MARGIN of each vector's best in the group.

    What has nulls, other lengths or values that aren't finite is left to the exact score beside all.
    """

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.asarray(values.value_lengths().fill_null(-1))
        good, out = sizes == width, np.zeros((len(values), width))
        at = np.flatnonzero(good)
        out[at] = values.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
        norm = np.sqrt((out * out).sum(1))
        good &= np.isfinite(norm) & (norm > 1e-150)
        out[~good] = 0.0
        return out / np.where(good, norm, 1.0)[:, None], good

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = len(right)
        lefts, rights = [], []
        if n and len(left):
            width = int(np.asarray(right["centre"].combine_chunks().value_lengths().fill_null(0)).max())
            centres, fit = matrix(right["centre"], width)
            vectors, good = matrix(left[vector], width)
            step = max(1, 4_000_000 // n)
            for at in range(0, len(left), step):
                score = np.maximum(vectors[at : at + step] @ centres.T, 0.0)  # the exact score has no negative values
                near = score >= np.where(fit, score, -1.0).max(1, keepdims=True) - MARGIN
                near |= ~fit[None, :] | ~good[at : at + step, None]
                i, j = np.nonzero(near)
                lefts.append(i + at)
                rights.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
        l, r = left.select([key, vector]).take(pa.array(i)), right.select(["__label", "centre"]).take(pa.array(j))
        return pa.table([*l.columns, *r.columns], names=[key, vector, "__label", "centre"])

    return run


def latest(campaigns: DataFrame, time: str, label: str, most: int = 200) -> DataFrame:
    """The ``most`` campaigns that got a message last, ties by label."""
    return campaigns.orderBy(F.desc(time), label).limit(most)


def near_in_time(rows: DataFrame, others: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """The rows with ``n_near``: how many of ``others`` (key, time) have their key and lie within ``days`` of their time, both ends included.

    Rows and others are laid side by side in buckets of ``days``, others in three of them, and counted by a window over
    times: nothing is paired, and a key with very many rows is as many groups as it has buckets. Null keys and times have none.
    """
    width = days * 86_400_000_000
    us = F.unix_micros(F.col(time).cast("timestamp"))
    none = F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema["x"].dataType)
    beside = others.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__k"), us.alias("__t"), none.alias("__r"), F.lit(1).alias("__n"))
    bucket = F.floor(F.col("__t") / width)
    beside = beside.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    own = rows.select(F.col(key).alias("__k"), us.alias("__t"), F.struct("*").alias("__r"), F.lit(0).alias("__n")).withColumn("__b", bucket)
    around = Window.partitionBy("__k", "__b").orderBy("__t").rangeBetween(-width, width)
    counted = own.filter("__k is not null and __t is not null").unionByName(beside).withColumn("n_near", F.sum("__n").over(around)).filter("__r is not null")
    rest = own.filter("__k is null or __t is null").withColumn("n_near", F.lit(0).cast("long"))
    return counted.unionByName(rest.select(*counted.columns)).select("__r.*", "n_near")
