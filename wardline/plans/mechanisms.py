"""Queries over whole tables of verdicts, spans, pages, vectors and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import phrases
from wardline.functions import tagstream as T
from wardline.functions import urls as U
from wardline.operators import brands as B
from wardline.operators import campaigns as C
from wardline.operators import graph as G
from wardline.operators import lookalike as L
from wardline.operators import vectors as V
from wardline.operators.verdicts import Known, verdicts
from wardline.plans.graphs import _EDGES_SQL, edges
from wardline.plans.links import parsed_pages
from wardline.plans.registry import query, table
from wardline.steps import Scratch


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, html, meta): documents as mails, each with the page of a quarter of its number; every eleventh one's sender is suspicious."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.floor(F.col("doc_id") / 4).cast("long").alias("page_id"))
    pages = table(spark, sf, "pages").select("page_id", "html")
    return docs.join(pages, "page_id", "left").select("id", "text", "html", F.when(F.col("id") % 11 == 0, 45.0).alias("meta"))


def known(spark: SparkSession, sf: str) -> Known:
    """Every seventh page's link is listed, every third page's domain is official, hosts that look like another one are findings, domains by their number of pages have a graph score."""
    p = parsed_pages(spark, sf).filter("host is not null").select("page_id", "normalized", U.registrable(F.col("host")).alias("registrable"))
    p = Scratch(spark).keep(p)  # links are parsed once for all five tables
    listed = p.filter("page_id % 7 = 0").select(F.lit("url").alias("ioc_type"), F.col("normalized").alias("value"))
    names = p.select(F.split("registrable", r"\.")[0].alias("name"), "registrable").distinct()
    pairs = L.by_skeleton(names.select("name").distinct(), names.select("name").distinct())
    like = names.join(pairs.select("name").distinct(), "name").select("registrable", F.lit(0.9).alias("confidence"), F.lit("substitution").alias("kind"))
    graph = p.groupBy("registrable").agg(F.least(F.lit(100.0), 20.0 * F.count(F.lit(1))).alias("score")).withColumn("quality", F.when(F.col("score") > 30, "good").otherwise("limited"))
    return Known(listed, spark.createDataFrame([], "host string"), p.filter("page_id % 3 = 0").select("registrable").distinct(), like, graph)


@query()
def message_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every document as a message, over all six engines."""
    out = verdicts(messages(spark, sf), known(spark, sf))
    return out.withColumn("intents", F.array_join("intents", ",")).select("id", "nlp", "url", "ti", "graph", "brand", "meta", "families", "final", "decision", "intents", "n_links", "evasion")


@query()
def page_reading(spark: SparkSession, sf: str) -> DataFrame:
    """What each page shows, hides and asks for."""
    rows = table(spark, sf, "pages").select("page_id", T.page_parts(F.col("html")).alias("p"))
    return rows.select("page_id", F.md5("p.text").alias("text_md5"), F.length("p.text").cast("long").alias("n_chars"), F.length("p.hidden").cast("long").alias("n_hidden"), "p.forms", "p.passwords", "p.fields", F.array_join("p.buttons", "|").alias("buttons"))


_FOLD = "replace(replace(translate({x}, '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w')"


@query(
    rf"""WITH k AS (SELECT item_id AS brand, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z]+'), 3, 3 + item_id % 3), ' ') AS keyword FROM benchmark),
kw AS (SELECT brand, keyword, string_split({_FOLD.format(x="keyword")}, ' ') AS pw FROM k WHERE keyword <> ''),
d AS (SELECT doc_id AS id, translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'oe', '03') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+') AS words, regexp_split_to_array(t, '[\p{{L}}\p{{M}}\p{{N}}]+') AS gaps FROM d),
u AS (SELECT id, unnest(words) AS word, unnest(list_slice(gaps, 1, len(words))) AS gap, unnest(range(1, len(words) + 1)) AS i FROM w),
p AS (SELECT id, i, {_FOLD.format(x="translate(word, 'асеорхуіјѕԁԛԝӏοανικρτυ', 'aceopxyijsdqwloavikptu')")} AS word, length(word) AS n, sum(length(gap) + length(word)) OVER (PARTITION BY id ORDER BY i) AS upto FROM u),
h AS (SELECT p.id, p.i, brand, keyword, pw FROM p JOIN kw ON p.word = pw[1]),
g AS (SELECT h.id, h.i, brand, keyword, count(*) AS met, max(q.upto) AS "end" FROM h, range(0, 4) AS r(j), p q WHERE j < len(pw) AND q.id = h.id AND q.i = h.i + j AND q.word = pw[j + 1] GROUP BY 1, 2, 3, 4)
SELECT g.id, g.brand::VARCHAR AS brand, (p.upto - p.n)::INT AS start, g."end"::INT AS "end" FROM g JOIN p ON g.id = p.id AND g.i = p.i WHERE met = len(string_split(keyword, ' '))"""
)
def brand_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of the benchmark as brands, found in documents that spell o as 0 and e as 3, with their places."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    n = (F.col("item_id") % 3 + 1).cast("int")
    listed = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(words, F.lit(3), n), " ").alias("keyword")).filter("keyword <> ''").orderBy("item_id").limit(phrases.MOST_PHRASES + 1).collect()
    groups = tuple((str(r["item_id"]), (r["keyword"],)) for r in listed)  # a stated list: more phrases than the bound raise
    spelt = F.translate(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "oe", "03")
    each = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(phrases.spans(spelt, groups, folded=True)).alias("s"))
    return each.select("id", F.col("s.name").alias("brand"), "s.start", "s.end")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.centroid_vectors(table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("campaign"), "embedding"), "campaign", "embedding")


@query()
def campaign_match_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of the centres of every four vectors, for every vector, by an inverted file."""
    return V.indexed_best(table(spark, sf, "embeddings"), _groups(spark, sf), "vec_id", "embedding", "campaign")


@query(
    """WITH s AS (SELECT c_custkey AS id, c_nationkey AS nation, min(o_orderdate)::TIMESTAMP AS first_seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT id AS other, nation, first_seen AS at FROM s JOIN customer ON c_custkey = id WHERE c_acctbal < 0)
SELECT s.id, count(other) AS n_near, round(least(1.0, count(other) / 3.0), 6) AS temporal_proximity FROM s
LEFT JOIN b ON b.nation = s.nation AND b.at BETWEEN s.first_seen - INTERVAL 7 DAY AND s.first_seen + INTERVAL 7 DAY GROUP BY s.id"""
)
def temporal_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose first order came within seven days of that of customers of their nation with a negative balance."""
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("timestamp").alias("first_seen"))
    seen = table(spark, sf, "customer").join(first, "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), "first_seen", "c_acctbal")
    near = V.near_in_time(seen.select("id", "nation", "first_seen"), seen.filter("c_acctbal < 0").select("nation", "first_seen"), "nation", "first_seen", 7)
    return near.select("id", "n_near", F.round(F.least(F.lit(1.0), F.col("n_near") / 3.0), 6).alias("temporal_proximity"))


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, u AS (SELECT DISTINCT a, b FROM both_ways), hub AS (SELECT a FROM u GROUP BY a HAVING count(*) > 150),
w(id, hops) AS (SELECT 'customer:' || c_custkey, 0 FROM customer WHERE c_acctbal < -990 UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.id WHERE w.hops < 3 AND (w.hops = 0 OR w.id NOT IN (SELECT a FROM hub)))
SELECT id, min(hops) AS hops FROM w GROUP BY id ORDER BY hops, id LIMIT 400"""
)
def graph_khop_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The 400 nodes nearest to customers deep in debt: layers are walked until there are so many."""
    seeds = table(spark, sf, "customer").filter("c_acctbal < -990").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return G.khop(edges(spark, sf), seeds, 3, limit=400)


@query(
    f"""WITH {_EDGES_SQL}, u AS (SELECT DISTINCT a, b FROM both_ways), hub AS (SELECT a FROM u GROUP BY a HAVING count(*) > 60), s AS (SELECT DISTINCT a AS id FROM u WHERE starts_with(a, 'customer:')),
one AS (SELECT s.id, b AS near, 1 AS hops FROM s JOIN u ON u.a = s.id), two AS (SELECT one.id, u.b AS near, 2 AS hops FROM one JOIN u ON u.a = one.near WHERE one.near NOT IN (SELECT a FROM hub) AND u.b <> one.id),
n AS (SELECT id, near, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2)
SELECT id, count(*) FILTER (hops = 1) AS n_first, count(*) FILTER (hops = 2) AS n_second, count(*) FILTER (starts_with(near, 'part:')) AS n_parts, count(*) FILTER (starts_with(near, 'supplier:')) AS n_suppliers FROM n GROUP BY id"""
)
def entity_view_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    """What lies within two steps of each customer; hubs are reached, not walked through."""
    return G.two_hops(edges(spark, sf), "customer", hub=60).groupBy("id").agg(
        F.count_if(F.col("hops") == 1).alias("n_first"), F.count_if(F.col("hops") == 2).alias("n_second"), F.count_if(F.col("near").startswith("part:")).alias("n_parts"), F.count_if(F.col("near").startswith("supplier:")).alias("n_suppliers")
    )


@query(
    """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,12}')) AS keyword FROM benchmark), k AS (SELECT keyword, min(item_id) AS brand FROM w GROUP BY keyword),
h AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,13}')) || '.example.com' AS host FROM conversations), t AS (SELECT host, split_part(host, '.', 1) AS token FROM h)
SELECT host, brand, keyword, token FROM t JOIN k ON token <> keyword AND abs(length(token) - length(keyword)) <= 1 AND damerau_levenshtein(token, keyword) = 1"""
)
def brand_keyword_typos(spark: SparkSession, sf: str) -> DataFrame:
    """Words of conversations as hosts, words of the benchmark as keywords: pieces one edit away."""
    word = lambda name, pattern: table(spark, sf, name).select("*", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("w"))
    known = word("benchmark", "[a-z]{6,12}").groupBy(F.col("w").alias("keyword")).agg(F.min("item_id").alias("brand"))
    hosts = word("conversations", "[a-z]{5,13}").select(F.concat("w", F.lit(".example.com")).alias("host")).distinct()
    found = B.keyword_typos(hosts, known)
    return found.filter(F.col("token") == F.split("host", r"\.")[0])
