"""Queries of wrappers, hidden links, brands, feedback and sinks on made-up inputs from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import obfuscation as O
from wardline.operators import brands as B
from wardline.operators import feedback as K
from wardline.plans.decisions import detections
from wardline.plans.links import PARSED_SQL, parsed_pages, parts
from wardline.plans.registry import query, table
from wardline.sources import sinks


@query(
    """WITH w AS (SELECT page_id, url, 'https://www.google.com/url?q=' || url_encode(url) || '&sa=D' AS one, page_id % 3 AS k FROM pages),
t AS (SELECT page_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS depth, url AS inner_url FROM w) SELECT page_id, depth::INT AS depth, inner_url FROM t"""
)
def url_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Links wrapped none, one or two times, unwrapped."""
    once = F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url"), F.lit("&sa=D"))
    twice = F.concat(F.lit("https://nam02.safelinks.protection.outlook.com/?url="), F.url_encode(once), F.lit("&data=x"))
    k = F.col("page_id") % 3
    wrapped = table(spark, sf, "pages").select("page_id", F.when(k == 0, F.col("url")).when(k == 1, once).otherwise(twice).alias("u"))
    chain = wrapped.select("page_id", O.unwrap(F.col("u")).alias("c"))
    return chain.select("page_id", F.size("c").alias("depth"), F.element_at("c", -1).alias("inner_url"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^ ]+') AS link FROM pages WHERE page_id % 4 = 0")
def base64_hidden_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth page's link hidden as base64 in a sentence, found again."""
    hidden = F.concat(F.lit("open "), F.base64(F.encode("url", "UTF-8")), F.lit(" now"))
    rows = table(spark, sf, "pages").filter("page_id % 4 = 0").select("page_id", hidden.alias("t"))
    return rows.select("page_id", F.explode(O.base64_links(F.col("t"))).alias("link"))


@query()
def base64_hidden_links_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's link hidden as base64 in a sentence, found again."""
    hidden = F.concat(F.lit("open "), F.base64(F.encode("url", "UTF-8")), F.lit(" now"))
    return table(spark, sf, "pages").select("page_id", F.explode(O.base64_links(hidden)).alias("link"))


@query(
    f"""WITH {PARSED_SQL} SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'FLAG' END AS decision FROM p"""
)
def offline_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth link gets a user name, every seventh a punycode label."""
    p = parts()
    host = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("xn--abc."), "host")).otherwise(F.col("host"))
    user = F.when(F.col("page_id") % 5 == 0, "someone").otherwise("")
    return parsed_pages(spark, sf).withColumns({"host": host, "userinfo": user}).select("page_id", O.offline_check(p).alias("decision"))


@query(
    """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), t AS (SELECT host, unnest(string_split_regex(host, '[.\\-_]')) AS token FROM h),
k(brand, keyword) AS (VALUES ('Pills', 'pills'), ('Farm', 'farm'), ('Blog', 'blog'), ('Exam', 'example')), m AS (SELECT host, brand, keyword, length(keyword) AS l FROM t JOIN k ON token = keyword),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY l DESC, brand) AS n FROM m) SELECT host, brand, keyword, 'exact' AS kind FROM r WHERE n = 1"""
)
def brand_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the hosts as brands' keywords."""
    hosts = parsed_pages(spark, sf).select("host").distinct()
    words = spark.createDataFrame([("Pills", "pills"), ("Farm", "farm"), ("Blog", "blog"), ("Exam", "example")], "brand string, keyword string")
    return B.keyword_hits(hosts, words)


@query(
    """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), k(brand, keyword) AS (VALUES ('Apache', 'apache license'), ('MIT', 'mit'), ('GNU', 'gnu'), ('Trash', 'trash')),
s AS (SELECT id, i - 1 AS place, w[i] AS keyword FROM w, range(1, 100000) AS r(i) WHERE i <= len(w) UNION ALL SELECT id, i - 1, w[i] || ' ' || w[i + 1] FROM w, range(1, 100000) AS r(i) WHERE i < len(w))
SELECT id, brand, min(place)::INT AS first_word FROM s JOIN k USING (keyword) GROUP BY id, brand"""
)
def brand_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Names in texts as brands' spellings of one and two words."""
    words = spark.createDataFrame([("Apache", "apache license"), ("MIT", "mit"), ("GNU", "gnu"), ("Trash", "trash")], "brand string, keyword string")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.claims(texts, words).select("id", "brand", F.col("at").alias("first_word"))


@query(
    """WITH d AS (SELECT o_orderkey AS id FROM orders), f AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE l_returnflag WHEN 'R' THEN 'confirmed_phishing' WHEN 'A' THEN 'false_positive' ELSE 'unsure' END AS label, l_partkey AS p FROM lineitem),
l AS (SELECT id, arg_max(label, (place, label)) AS label FROM f GROUP BY id) SELECT coalesce(CASE label WHEN 'confirmed_phishing' THEN 'confirmed' ELSE label END, 'new') AS status, count(*) AS n FROM d LEFT JOIN l USING (id) GROUP BY 1"""
)
def feedback_status(spark: SparkSession, sf: str) -> DataFrame:
    """Items as verdicts on their orders; the last line's verdict counts."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", "confirmed_phishing").when(flag == "A", "false_positive").otherwise("unsure")
    verdicts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("detection_id"), label.alias("label"), F.struct(F.col("l_linenumber"), label.alias("l")).alias("at"))
    return K.with_status(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), verdicts).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'detections_total{decision="' || CASE WHEN least(100.0, value) >= 85 THEN 'BLOCK' WHEN least(100.0, value) >= 60 THEN 'QUARANTINE' WHEN least(100.0, value) >= 30 THEN 'FLAG' ELSE 'ALLOW' END || '"} ' || count(*) AS line
FROM events GROUP BY CASE WHEN least(100.0, value) >= 85 THEN 'BLOCK' WHEN least(100.0, value) >= 60 THEN 'QUARANTINE' WHEN least(100.0, value) >= 30 THEN 'FLAG' ELSE 'ALLOW' END"""
)
def metrics_lines(spark: SparkSession, sf: str) -> DataFrame:
    counts = detections(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return sinks.metrics_text(counts, "detections_total", "decision")
