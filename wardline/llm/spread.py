"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than this share of the rows is split, and rows up to which a key never is.
PARTS, ROWS = 4096, 2000
#: Rows looked at to find such keys; they decide how a join is dealt, never what it gives.
LOOK_ROWS = 400_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for an inner, left, semi or anti join, with frequent keys of ``left`` split.

    ``left`` should be a written table, for it is counted first; else ``like`` is one with
    the same keys as often. Rows of a frequent key
    are dealt by a hash of the columns ``by`` over several pieces, and what ``right``
    holds of that key is copied to each. At most PARTS keys can be that frequent, so
    their list is small whatever the input. Null keys match nothing.
    """
    like = left if like is None else like
    total = like.count()
    looked = like.select(*keys)
    share = min(1.0, LOOK_ROWS / max(1, total))
    if share < 1.0:
        looked = looked.sample(share, seed=5)
    bound = max(ROWS, total // PARTS) * share
    hot = looked.na.drop().groupBy(*keys).count().filter(F.col("count") > bound).collect() if total > ROWS else []
    if not hot:
        return left.join(right, keys, how)
    rows = [(*(r[k] for k in keys), int(r["count"] / bound) + 1) for r in hot]
    schema = left.select(*keys).schema.add("__pieces", T.IntegerType())
    pieces = F.broadcast(left.sparkSession.createDataFrame(rows, schema))
    number = F.coalesce(F.col("__pieces"), F.lit(1))
    dealt = left.join(pieces, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(*by), number).cast("int")).drop("__pieces")
    copied = right.join(pieces, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), number - 1))).drop("__pieces")
    return dealt.join(copied, [*keys, "__piece"], how).drop("__piece")
