"""Queries of the fusion, its flags and the evidence behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import scores as S
from wardline.plans.registry import query, table

_SCORES_SQL = """
sc AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey % 7 <> 0 THEN (l_extendedprice % 100) END AS nlp, CASE WHEN l_orderkey % 5 <> 0 THEN (l_extendedprice * 7 % 100) END AS url,
  CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey % 101)::DOUBLE END AS ti, CASE WHEN l_orderkey % 4 = 0 THEN (l_suppkey % 101)::DOUBLE END AS graph,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 END AS brand, CASE WHEN l_orderkey % 11 <> 0 THEN l_discount * 1000 END AS meta,
  l_orderkey % 13 = 0 AS hard_bad, l_orderkey % 17 = 0 AS strong_brand, l_partkey % 3 = 0 AS trusted, l_partkey % 5 = 0 AS evasion, (l_linenumber % 4)::INT AS families, l_suppkey % 6 = 0 AS verified, l_suppkey % 9 = 0 AS guard FROM lineitem),
w AS (SELECT *, CASE WHEN nlp IS NULL THEN 0.0::DOUBLE ELSE 0.30::DOUBLE END + CASE WHEN url IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END + CASE WHEN ti IS NULL THEN 0.0::DOUBLE ELSE 0.20::DOUBLE END
  + CASE WHEN graph IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN brand IS NULL THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END + CASE WHEN meta IS NULL THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS total FROM sc),
li AS (SELECT *, CASE WHEN total > 0 THEN coalesce(round(0.30::DOUBLE / total, 4) * nlp, 0) + coalesce(round(0.25::DOUBLE / total, 4) * url, 0) + coalesce(round(0.20::DOUBLE / total, 4) * ti, 0)
  + coalesce(round(0.15::DOUBLE / total, 4) * graph, 0) + coalesce(round(0.05::DOUBLE / total, 4) * brand, 0) + coalesce(round(0.05::DOUBLE / total, 4) * meta, 0) ELSE 0 END AS linear,
  coalesce(greatest(nlp, url, ti, graph, brand, meta), 0) AS peak FROM w),
fu AS (SELECT *, CASE WHEN peak >= 85 THEN greatest(linear, peak * 0.85) ELSE linear END AS fused FROM li)"""


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as messages: six scores made from prices and keys, missing by divisibility, and the flags of the ladder."""
    key, part, supp, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        key.alias("k"), line.alias("line"), F.when(key % 7 != 0, price % 100).alias("nlp"), F.when(key % 5 != 0, price * 7 % 100).alias("url"),
        F.when(key % 3 == 0, (part % 101).cast("double")).alias("ti"), F.when(key % 4 == 0, (supp % 101).cast("double")).alias("graph"),
        F.when(line % 2 == 0, F.col("l_quantity") * 2).alias("brand"), F.when(key % 11 != 0, F.col("l_discount") * 1000).alias("meta"),
        (key % 13 == 0).alias("hard_bad"), (key % 17 == 0).alias("strong_brand"), (part % 3 == 0).alias("trusted"), (part % 5 == 0).alias("evasion"),
        (line % 4).cast("int").alias("families"), (supp % 6 == 0).alias("verified"), (supp % 9 == 0).alias("guard"),
    )


def fused(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_rows(spark, sf)
    return rows.withColumn("fused", S.fuse({n: F.col(n) for n, _ in refdata.FUSION_WEIGHTS}))


@query(f"WITH {_SCORES_SQL} SELECT k, line, round(fused, 6) AS fused, CASE WHEN fused >= 85 THEN 'BLOCK' WHEN fused >= 60 THEN 'QUARANTINE' WHEN fused >= 30 THEN 'FLAG' ELSE 'ALLOW' END AS decision FROM fu")
def fusion_renormalise(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).select("k", "line", F.round("fused", 6).alias("fused"), S.decision(F.col("fused")).alias("decision"))


@query(
    f"""WITH {_SCORES_SQL},
a AS (SELECT *, CASE WHEN hard_bad THEN greatest(fused, 92.0) ELSE fused END AS f1, NOT hard_bad AND NOT strong_brand AS soft FROM fu),
b AS (SELECT *, CASE WHEN strong_brand AND coalesce(nlp, 0) >= 40 THEN greatest(f1, 85.0) ELSE f1 END AS f2 FROM a),
c AS (SELECT *, CASE WHEN evasion AND f2 >= 30 THEN least(100.0, f2 + 8) ELSE f2 END AS f3 FROM b),
d AS (SELECT *, CASE WHEN trusted AND soft AND coalesce(meta, 0) < 40 THEN least(f3, CASE WHEN coalesce(nlp, 0) >= 70 THEN 45.0 ELSE 30.0 END) ELSE f3 END AS f4 FROM c),
e AS (SELECT *, CASE WHEN soft AND families = 0 THEN least(f4, 40.0) WHEN soft AND families = 1 THEN least(f4, 55.0) ELSE f4 END AS f5 FROM d),
g AS (SELECT *, CASE WHEN verified AND soft THEN f5 * 0.6 ELSE f5 END AS f6 FROM e),
h AS (SELECT *, least(100.0, greatest(0.0, CASE WHEN guard THEN greatest(f6, 35.0) ELSE f6 END)) AS final FROM g)
SELECT k, line, round(final, 6) AS final, CASE WHEN final >= 85 THEN 'BLOCK' WHEN final >= 60 THEN 'QUARANTINE' WHEN final >= 30 THEN 'FLAG' ELSE 'ALLOW' END AS decision,
  coalesce(ti IS NOT NULL AND ((families > 1 AND coalesce(graph, 0) >= 60) OR (ti >= 70 AND coalesce(nlp, 0) < 20 AND coalesce(url, 0) < 30)), false) AS conflict FROM h"""
)
def fusion_override_ladder(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    final = S.override(c("fused"), c("nlp"), c("meta"), c("hard_bad"), c("strong_brand"), c("trusted"), c("evasion"), c("families"), c("verified"), c("guard"))
    rows = fused(spark, sf).withColumn("final", final)
    clash = S.conflict(c("nlp"), c("url"), c("ti"), c("graph"), F.when(c("families") > 1, 1).otherwise(0))
    return rows.select("k", "line", F.round("final", 6).alias("final"), S.decision(c("final")).alias("decision"), clash.alias("conflict"))


@query(
    """WITH o AS (SELECT l_orderkey AS k, list({'p': l_partkey, 'd': l_discount, 'f': l_returnflag}) AS urls FROM lineitem GROUP BY 1)
SELECT k, len(list_filter(urls, lambda u: u.f = 'R')) > 0 AS hard_bad, len(list_filter(urls, lambda u: u.p % 50 = 0)) > 0 AS strong_brand, len(list_filter(urls, lambda u: u.d > 0.05)) = 0 AS all_trusted,
  CASE WHEN len(list_filter(urls, lambda u: u.f = 'R')) > 0 THEN 'block_and_list' ELSE 'deliver' END AS action FROM o"""
)
def evidence_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags over each order's nested items, and what the playbook does."""
    orders = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct("l_partkey", "l_discount", "l_returnflag")).alias("urls"))
    hard = F.exists("urls", lambda u: u["l_returnflag"] == "R")
    play = dict(refdata.PLAYBOOK)
    return orders.select(
        "k", hard.alias("hard_bad"), F.exists("urls", lambda u: u["l_partkey"] % 50 == 0).alias("strong_brand"), F.forall("urls", lambda u: u["l_discount"] <= 0.05).alias("all_trusted"),
        F.when(hard, play["BLOCK"]).otherwise(play["ALLOW"]).alias("action"),
    )




@query(
    f"""WITH a AS (SELECT o_orderkey AS k, floor(epoch(o_orderdate - (SELECT min(o_orderdate) FROM orders)) / 86400)::BIGINT AS age, o_orderkey % 5 AS cert FROM orders)
SELECT k, age, round(1 - (1 - CASE WHEN age <= 7 THEN 0.35::DOUBLE WHEN age <= 30 THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END) * (1 - CASE WHEN cert <= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS weight FROM a"""
)
def age_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days of 86,400 seconds since the first order, as a domain's age; the key's remainder as a certificate's."""
    orders = table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderdate")).first()[0]
    age = F.floor((F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lit(first))) / 86400)
    rows = orders.select(F.col("o_orderkey").alias("k"), age.alias("age"), (F.col("o_orderkey") % 5).alias("cert"))
    weights = F.array(F.when(F.col("age") <= 7, 0.35).when(F.col("age") <= 30, 0.22).otherwise(0.0), F.when(F.col("cert") <= 3, 0.1).otherwise(0.0))
    return rows.select("k", "age", F.round(S.noisy_or(weights), 6).alias("weight"))


@query(
    """WITH m AS (SELECT l_suppkey, l_shipdate::DATE::VARCHAR AS reason, max(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, reason) AS position FROM m) SELECT l_suppkey AS k, reason, weight, position::INT AS position FROM r WHERE position <= 24"""
)
def reasons_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest weight of each reason, the first 24 of each supplier; ship days stand in for reasons."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("reason")).agg(F.max("l_extendedprice").alias("weight"))
    order = Window.partitionBy("k").orderBy(F.desc("weight"), "reason")
    return rows.withColumn("position", F.row_number().over(order)).filter("position <= 24")


@query(
    """SELECT o_orderkey, count(l_orderkey) AS n_items, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_part
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def detail_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its items in line order, as a detection with its actions."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    joined = table(spark, sf, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.col("items")[0]["l_partkey"].alias("first_part"), F.element_at("items", -1)["l_partkey"].alias("last_part")
    )


@query(
    """SELECT o_orderpriority AS channel, o_orderstatus AS decision, grouping(o_orderpriority) + 2 * grouping(o_orderstatus) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)"""
)
def decision_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by channel and decision with all subtotals; an addition of this engine."""
    level = F.grouping("o_orderpriority").cast("long") + 2 * F.grouping("o_orderstatus").cast("long")
    cube = table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return cube.withColumnsRenamed({"o_orderpriority": "channel", "o_orderstatus": "decision"})


