"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the smallest node that it reaches.

    Each round every node takes the smallest root among its neighbours, then its root's
    root, so a chain of n nodes needs about log n rounds. Each round is a written table.
    """
    both = scratch.keep(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    roots = scratch.keep(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("low"))
        taken = roots.join(near, roots["node"] == near["u"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(taken.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        scratch.drop(roots)
        roots = new
        if roots.filter("root <> was").isEmpty():
            scratch.drop(both)
            return roots.select("node", "root")
