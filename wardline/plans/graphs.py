"""Queries over a graph of customers, orders, parts, suppliers and nations, and over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import campaigns as C
from wardline.operators import graph as G
from wardline.plans.registry import query, table

_EDGES_SQL = """
edges AS (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'PLACED' AS rel FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'HOLDS' FROM lineitem UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'SHIPPED_BY' FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier),
both_ways AS (SELECT src AS a, dst AS b, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders placed, parts held, shipments, seats as (src, dst, rel)."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    rows = table(spark, sf, "orders").select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("rel"))
    items = table(spark, sf, "lineitem")
    rows = rows.unionAll(items.select(name("order", "l_orderkey"), name("part", "l_partkey"), F.lit("HOLDS"))).unionAll(items.select(name("order", "l_orderkey"), name("supplier", "l_suppkey"), F.lit("SHIPPED_BY")))
    return rows.unionAll(table(spark, sf, "supplier").select(name("supplier", "s_suppkey"), name("nation", "s_nationkey"), F.lit("BASED_IN")))


@query(
    """WITH n AS (SELECT 'supplier:' || s_suppkey AS id, greatest(0.0, -s_acctbal / 100) AS risk, s_acctbal < 0 AS malicious FROM supplier
  UNION ALL SELECT 'supplier:' || l_suppkey, l_discount * 100, l_returnflag = 'R' AND l_tax > 0.07 FROM lineitem UNION ALL SELECT 'customer:' || o_custkey, 0.0, o_orderstatus = 'P' FROM orders)
SELECT id, round(max(risk), 6) AS risk, bool_or(malicious) AS malicious, count(*) AS n FROM n GROUP BY id"""
)
def graph_nodes_merge(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("id")
    rows = table(spark, sf, "supplier").select(name("supplier", "s_suppkey"), F.greatest(F.lit(0.0), -F.col("s_acctbal") / 100).alias("risk"), (F.col("s_acctbal") < 0).alias("malicious"))
    rows = rows.unionAll(table(spark, sf, "lineitem").select(name("supplier", "l_suppkey"), F.col("l_discount") * 100, (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)))
    rows = rows.unionAll(table(spark, sf, "orders").select(name("customer", "o_custkey"), F.lit(0.0), F.col("o_orderstatus") == "P"))
    seen = rows.withColumns({"first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    return G.merge_nodes(seen).select("id", F.round("risk", 6).alias("risk"), "malicious").join(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")


@query("SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'SELLS' AS rel, count(*) AS count, max(1 - l_discount) AS confidence FROM lineitem GROUP BY 1, 2")
def graph_edges_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("SELLS").alias("rel"),
        F.lit(1).cast("long").alias("count"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"),
    )
    return G.merge_edges(rows).drop("first_seen", "last_seen")


@query(
    f"""WITH {_EDGES_SQL}, d AS (SELECT a AS id, count(*) AS degree FROM both_ways GROUP BY a)
SELECT id, degree, round(CASE split_part(id, ':', 1) WHEN 'nation' THEN 0.25 ELSE 0.3 END * CASE WHEN degree > 4 THEN 1 / log2(1 + degree) ELSE 1 END, 9) AS specificity FROM d"""
)
def graph_degree_specificity(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.substring_index("id", ":", 1)
    spec = G.specificity(F.when(kind == "nation", "asn").otherwise(kind), F.lit(""), F.col("degree"))
    return G.degrees(edges(spark, sf)).select("id", "degree", F.round(spec, 9).alias("specificity"))


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, u AS (SELECT DISTINCT a, b FROM both_ways), hub AS (SELECT a FROM u GROUP BY a HAVING count(*) > 150),
w(id, hops) AS (SELECT unnest(['customer:1', 'customer:2']), 0 UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.id WHERE w.hops < 3 AND (w.hops = 0 OR w.id NOT IN (SELECT a FROM hub)))
SELECT id, min(hops) AS hops FROM w GROUP BY id"""
)
def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("customer:1",), ("customer:2",)], "id string")
    return G.khop(edges(spark, sf), seeds, 3)


_SPEC_SQL = "sp AS (SELECT a AS id, (CASE WHEN split_part(a, ':', 1) = 'order' THEN 0.9 ELSE 0.7 END) * CASE WHEN count(*) > 4 THEN 1 / log2(1 + count(*)) ELSE 1 END AS spec FROM both_ways GROUP BY a)"


@query(
    f"""WITH {_EDGES_SQL}, u AS (SELECT DISTINCT a, b FROM both_ways), {_SPEC_SQL}, bad AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0),
seeds AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0),
s1 AS (SELECT DISTINCT seeds.id AS seed, u.b AS node FROM seeds JOIN u ON u.a = seeds.id),
f1 AS (SELECT s1.seed, s1.node, least(1.0, sp.spec) AS spec FROM s1 JOIN sp ON sp.id = s1.node WHERE sp.spec >= 0.3),
s2 AS (SELECT f1.seed, u.b AS node, max(f1.spec) AS spec FROM f1 JOIN u ON u.a = f1.node WHERE u.b <> f1.seed AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.seed = f1.seed AND s1.node = u.b) GROUP BY 1, 2)
SELECT seed, node AS bad, 2 AS hops, round(spec, 9) AS spec FROM s2 WHERE node IN (SELECT id FROM bad)"""
)
def graph_known_bad_paths(spark: SparkSession, sf: str) -> DataFrame:
    """From every customer with a negative balance; two steps, since suppliers lie an even number of steps from customers and a third one reaches none."""
    e = edges(spark, sf)
    kind = F.substring_index("id", ":", 1)
    spec = G.degrees(e).select("id", (F.when(kind == "order", 0.9).otherwise(0.7) * G.damping(F.col("degree"))).alias("spec"))
    seeds = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    bad = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.bad_paths(e, spec, seeds, bad, depth=2).withColumn("spec", F.round("spec", 9))


@query()
def graph_known_bad_paths_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of up to three steps from every customer with a negative balance to suppliers with one."""
    e = edges(spark, sf)
    kind = F.substring_index("id", ":", 1)
    spec = G.degrees(e).select("id", (F.when(kind == "order", 0.9).otherwise(0.7) * G.damping(F.col("degree"))).alias("spec"))
    below = lambda name, key, balance: table(spark, sf, name).filter(F.col(balance) < 0).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"))
    return G.bad_paths(e, spec, below("customer", "c_custkey", "c_acctbal"), below("supplier", "s_suppkey", "s_acctbal")).withColumn("spec", F.round("spec", 9))


_SHARED_SQL = """
own AS (SELECT DISTINCT l_suppkey AS src, l_orderkey AS dst FROM lineitem), deg AS (SELECT dst, count(*) AS degree FROM own GROUP BY dst),
rare AS (SELECT dst, 0.9 * CASE WHEN degree > 4 THEN 1 / log2(1 + degree) ELSE 1 END AS spec FROM deg), kept AS (SELECT src, own.dst, spec FROM own JOIN rare ON own.dst = rare.dst WHERE spec >= 0.3 - 1e-9),
sh AS (SELECT x.src AS a, y.src AS b, count(*) AS n, least(1.0, sum(x.spec) / 1.5) AS overlap FROM kept x JOIN kept y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2)"""


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"), F.lit("USES").alias("rel"))
    return G.shared_infrastructure(used, ("USES",))


@query(f"WITH {_SHARED_SQL} SELECT a, b, n, round(overlap, 6) AS overlap FROM sh")
def graph_shared_infra(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share orders."""
    return _shared(spark, sf).withColumn("overlap", F.round("overlap", 6))


@query(
    f"""WITH {_SHARED_SQL}, r AS (SELECT s_suppkey AS id, least(100.0, greatest(0.0, (4000 - s_acctbal) / 50)) AS risk FROM supplier),
j AS (SELECT a, b, overlap, risk / 100 AS weight FROM sh JOIN r ON r.id = b),
c AS (SELECT a, least(1.0, sum(CASE WHEN weight >= 0.5 THEN overlap * weight ELSE 0 END) / 1.5) AS infrastructure, avg(CASE WHEN weight >= 0.5 THEN 1.0 ELSE 0.0 END) AS cluster,
  least(1.0, count(*) FILTER (weight >= 0.9) / 3.0) AS recent FROM j GROUP BY a)
SELECT a AS id, round(100 * (0.20 * infrastructure + 0.15 * cluster + 0.10 * recent), 4) AS score, CASE WHEN round(100 * (0.20 * infrastructure + 0.15 * cluster + 0.10 * recent), 4) > 30 THEN 'good' ELSE 'partial' END AS quality FROM c"""
)
def graph_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (4000 - F.col("s_acctbal")) / 50))
    other = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("b"), (risk / 100).alias("weight"))
    near = _shared(spark, sf).join(other, "b").groupBy("a")
    heavy = F.col("weight") >= 0.5
    parts = near.agg(
        F.least(F.lit(1.0), F.sum(F.when(heavy, F.col("overlap") * F.col("weight")).otherwise(0.0)) / 1.5).alias("infrastructure_overlap"),
        F.avg(F.when(heavy, 1.0).otherwise(0.0)).alias("suspicious_domain_cluster"), F.least(F.lit(1.0), F.count_if(F.col("weight") >= 0.9) / 3.0).alias("temporal_proximity"),
    )
    score = F.round(G.graph_score({c: F.col(c) for c in parts.columns[1:]}), 4)
    return parts.select(F.col("a").alias("id"), score.alias("score"), F.when(score > 30, "good").otherwise("partial").alias("quality"))


_SLICE_SQL = "WITH RECURSIVE e AS (SELECT DISTINCT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b FROM lineitem WHERE l_orderkey % 40 = 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"{_SLICE_SQL}, w(id, reach) AS (SELECT a, a FROM u UNION SELECT w.id, u.b FROM w JOIN u ON u.a = w.reach) SELECT id, min(reach) AS component FROM w GROUP BY id")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of every 40th order and its parts: the sparse graph whose components differ."""
    rows = table(spark, sf, "lineitem").filter("l_orderkey % 40 = 0")
    e = rows.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("HOLDS").alias("rel"))
    return G.components(e)


@query()
def graph_components_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all orders and their parts."""
    return G.components(edges(spark, sf).filter("rel = 'HOLDS'"))


@query(
    f"""WITH {_EDGES_SQL} SELECT a AS id, count(DISTINCT b) FILTER (starts_with(b, 'order:')) AS n_orders, count(DISTINCT b) FILTER (starts_with(b, 'part:')) AS n_parts,
  count(DISTINCT b) FILTER (starts_with(b, 'supplier:')) AS n_suppliers, count(DISTINCT b) FILTER (starts_with(b, 'nation:')) AS n_nations FROM both_ways GROUP BY a"""
)
def entity_view(spark: SparkSession, sf: str) -> DataFrame:
    near = G.undirected(edges(spark, sf)).select("a", "b").distinct().withColumn("kind", F.substring_index("b", ":", 1))
    counts = near.groupBy(F.col("a").alias("id"))
    return counts.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("order", "part", "supplier", "nation")])


@query(
    f"""WITH {_EDGES_SQL}, d AS (SELECT a AS id, split_part(a, ':', 1) AS kind, count(*) AS degree FROM both_ways GROUP BY a), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS k FROM d)
SELECT id, kind, degree FROM r WHERE (kind = 'customer' AND k <= 16 AND degree >= 2) OR (kind = 'supplier' AND k <= 40) OR (kind = 'part' AND k <= 60)"""
)
def overview_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Three top lists by degree, united."""
    ranked = G.degrees(edges(spark, sf)).withColumn("kind", F.substring_index("id", ":", 1))
    top = lambda kind, n, least: ranked.filter((F.col("kind") == kind) & (F.col("degree") >= least)).orderBy(F.desc("degree"), "id").limit(n)
    return top("customer", 16, 2).unionAll(top("supplier", 40, 0)).unionAll(top("part", 60, 0)).select("id", "kind", "degree")


@query(
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, 'old' AS part FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_suppkey, l_partkey, 'new' FROM lineitem WHERE l_orderkey % 2 = 0),
g AS (SELECT src, dst, bool_or(part = 'old') AS o, bool_or(part = 'new') AS n FROM e GROUP BY 1, 2)
SELECT CASE WHEN o AND n THEN 'both' WHEN n THEN 'added' ELSE 'gone' END AS state, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM g GROUP BY 1"""
)
def new_vs_old_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping extracts merged without double edges."""
    items = table(spark, sf, "lineitem")
    pick = lambda cond, name: items.filter(cond).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(name).alias("part"))
    merged = pick("l_orderkey % 3 <> 0", "old").unionByName(pick("l_orderkey % 2 = 0", "new")).groupBy("src", "dst").agg(F.bool_or(F.col("part") == "old").alias("o"), F.bool_or(F.col("part") == "new").alias("n"))
    state = F.when(F.col("o") & F.col("n"), "both").when(F.col("n"), "added").otherwise("gone")
    return merged.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_sources"))


_CENTROID_SQL = "x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i)"


@query(f"WITH {_CENTROID_SQL} SELECT label, i::INT AS position, round(v, 6) AS value FROM c")
def campaign_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return C.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", "position", F.round("value", 6).alias("value"))


@query(
    f"""WITH {_CENTROID_SQL}, cv AS (SELECT label, list(v ORDER BY i) AS centre FROM c GROUP BY label),
s AS (SELECT vec_id, cv.label AS best, round(greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], centre)), 6) AS similarity FROM embeddings, cv),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, best DESC) AS k FROM s) SELECT vec_id, best, similarity FROM r WHERE k = 1"""
)
def campaign_match(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return C.best_campaign(vectors, C.centroid_vectors(vectors, "label", "embedding"), "vec_id", "embedding", "label")


@query("SELECT user_id, printf('CAMPAIGN-%d-%04d', 2024, 7 + row_number() OVER (ORDER BY first_seen, user_id)) AS campaign FROM (SELECT user_id, min(ts) AS first_seen FROM events WHERE value > 250 GROUP BY user_id)")
def campaign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that go on after the seven campaigns that exist."""
    founders = table(spark, sf, "events").filter("value > 250").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return C.number_campaigns(founders, 2024, 7, "first_seen", "user_id").select("user_id", "campaign")


@query(
    """WITH a AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem),
t AS (SELECT k FROM p WHERE s = 1) SELECT p.s AS supplier, least(1.0, count(t.k) / 2.0) AS infra, count(t.k) AS n_shared FROM p LEFT JOIN t ON p.k = t.k WHERE p.s <> 1 GROUP BY p.s"""
)
def infra_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each supplier that supplier 1 sells too, as a campaign's infrastructure; an equi-join, not sets in memory."""
    sold = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("node")).distinct()
    return C.set_overlap(sold.filter("supplier <> 1"), sold.filter("supplier = 1").select("node"), "supplier", "node")
