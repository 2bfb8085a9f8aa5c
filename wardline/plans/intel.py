"""Queries of indicator matching and look-alikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import urls as U
from wardline.functions.text import skeleton
from wardline.operators import intel as I
from wardline.operators import lookalike as L
from wardline.plans.links import PARSED_SQL, REGISTRABLE_SQL, parsed_pages
from wardline.plans.registry import listed, query, table
from wardline.sources.feeds import merge_iocs


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_pages(spark, sf).select("page_id", F.col("normalized").alias("url"), "host", U.registrable(F.col("host")).alias("registrable"))


@query(
    f"""WITH {REGISTRABLE_SQL}, iu AS (SELECT DISTINCT normalized FROM g WHERE page_id % 7 = 0), id AS (SELECT DISTINCT host FROM g WHERE page_id % 11 = 0),
sh AS (SELECT host FROM g GROUP BY host HAVING count(*) >= 8), ok AS (SELECT host FROM id WHERE host NOT IN (SELECT host FROM sh)),
m AS (SELECT page_id, CASE WHEN normalized IN (SELECT normalized FROM iu) THEN 'url' WHEN host IN (SELECT host FROM ok) THEN 'host' WHEN registrable IN (SELECT host FROM ok) THEN 'registrable' ELSE 'none' END AS match FROM g)
SELECT page_id, match, CASE match WHEN 'url' THEN 95.0 WHEN 'none' THEN 0.0 ELSE 70.0 END::DOUBLE AS risk, CASE match WHEN 'url' THEN 0.95 WHEN 'none' THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM m"""
)
def ioc_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh page's link and every eleventh's host as indicators; hosts of eight pages and more are shared services."""
    links = _links(spark, sf)
    iocs = links.filter("page_id % 7 = 0").select(F.lit("url").alias("ioc_type"), F.col("url").alias("value")).unionByName(links.filter("page_id % 11 = 0").select(F.lit("domain").alias("ioc_type"), F.col("host").alias("value")))
    shared = links.groupBy("host").count().filter("count >= 8")
    return I.match_iocs(links, iocs, shared).select("page_id", "match", "risk", "confidence")


@query(f"WITH {PARSED_SQL}, i AS (SELECT DISTINCT normalized FROM p WHERE page_id % 7 = 0) SELECT p.page_id, p.host FROM p JOIN i USING (normalized)")
def ioc_exact(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    return links.join(links.filter("page_id % 7 = 0").select("url").distinct(), "url").select("page_id", "host")


@query(
    f"""WITH {PARSED_SQL}, n AS (SELECT DISTINCT host AS value, 'feed' || (page_id % 3) AS source FROM p), o AS (SELECT DISTINCT host AS value, 'feed' || (page_id % 3) AS source FROM p WHERE page_id % 4 = 0)
SELECT n.source, count(*) AS n_new FROM n LEFT JOIN o ON n.value = o.value AND n.source = o.source WHERE o.value IS NULL GROUP BY n.source"""
)
def ioc_upsert(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("feed"), (F.col("page_id") % 3).cast("string"))
    rows = _links(spark, sf).select("page_id", F.lit("domain").alias("ioc_type"), F.col("host").alias("value"), source.alias("source"))
    key = ["ioc_type", "value", "source"]
    return merge_iocs(rows.filter("page_id % 4 = 0").select(*key).distinct(), rows.select(*key))[1]


@query(
    f"""WITH {PARSED_SQL}, c AS (SELECT regexp_replace(host, '^(www|blog|m)[.]', '') AS root, count(*) AS n FROM p GROUP BY 1), t AS (SELECT root FROM c WHERE n >= 3),
h AS (SELECT DISTINCT host FROM p) SELECT host, arg_max(root, length(root)) AS root FROM h JOIN t ON host = root OR ends_with(host, '.' || root) GROUP BY host"""
)
def official_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    """Roots with three pages and more as official domains."""
    links = _links(spark, sf)
    roots = links.groupBy(F.regexp_replace("host", r"^(?:www|blog|m)\.", "").alias("root")).count().filter("count >= 3")
    return I.official_root(links, roots)


_NAMES_SQL = "nm AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,12}')) AS name FROM benchmark)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,12})"), F.lit(1))).alias("name")).distinct()


@query(
    f"""WITH {_NAMES_SQL}, a AS (SELECT DISTINCT translate(name, 'ol', '01') AS name FROM nm WHERE contains(name, 'o') OR contains(name, 'l')),
s AS (SELECT name, replace(replace(translate(name, '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w') AS s FROM a), t AS (SELECT name AS target, replace(replace(translate(name, '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w') AS s FROM nm)
SELECT DISTINCT name, target FROM s JOIN t USING (s) WHERE name <> target"""
)
def lookalike_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """Names with digits for letters against the names themselves."""
    names = _names(spark, sf)
    forged = names.filter(F.col("name").rlike("[ol]")).select(F.translate("name", "ol", "01").alias("name")).distinct()
    return L.by_skeleton(forged, names)


@query(f"WITH {_NAMES_SQL} SELECT a.name, b.name AS target FROM nm a JOIN nm b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 1 AND damerau_levenshtein(a.name, b.name) = 1")
def lookalike_typo(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    return L.by_typo(names, names).select("name", "target")


@query(
    f"""WITH {_NAMES_SQL}, s AS (SELECT name, array_to_string(list_sort(string_split(name, '')), '') AS s FROM nm)
SELECT a.name, b.name AS target, len(list_filter(range(1, length(a.name) + 1), lambda i: substr(a.name, i, 1) <> substr(b.name, i, 1)))::INT AS moved FROM s a JOIN s b USING (s)
WHERE a.name <> b.name AND left(a.name, 1) = left(b.name, 1) AND len(list_filter(range(1, length(a.name) + 1), lambda i: substr(a.name, i, 1) <> substr(b.name, i, 1))) <= 4"""
)
def lookalike_anagram(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    return L.by_anagram(names, names)


@query(
    f"""WITH {PARSED_SQL}, h AS (SELECT DISTINCT host || '.evil.test' AS host FROM p WHERE page_id % 2 = 0), t AS (SELECT DISTINCT host AS domain FROM p WHERE page_id % 3 = 0),
l AS (SELECT host, string_split(host, '.') AS l FROM h), s AS (SELECT host, i, k, array_to_string(list_slice(l, i, i + k - 1), '.') AS domain FROM l, range(1, 12) AS a(i), range(2, 5) AS b(k) WHERE i + k <= len(l)),
r AS (SELECT s.*, row_number() OVER (PARTITION BY host ORDER BY i, k) AS n FROM s JOIN t USING (domain)) SELECT host, domain AS target, i::INT AS at, k::INT AS parts FROM r WHERE n = 1"""
)
def subdomain_spoof(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the hosts put in front of another domain, against a third of them as protected ones."""
    links = _links(spark, sf)
    hosts = links.filter("page_id % 2 = 0").select(F.concat("host", F.lit(".evil.test")).alias("host")).distinct()
    return L.spoofed_subdomains(hosts, links.filter("page_id % 3 = 0").select(F.col("host").alias("domain")))


_ATTACKS_SQL = f"""{_NAMES_SQL}, sp AS (SELECT name, i FROM nm, range(1, 13) AS r(i) WHERE i <= length(name)),
at0 AS (SELECT name, 'omission' AS kind, substr(name, 1, i - 1) || substr(name, i + 1) AS attack FROM sp UNION ALL SELECT name, 'repetition', substr(name, 1, i) || substr(name, i) FROM sp
  UNION ALL SELECT name, 'transposition', substr(name, 1, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) FROM sp WHERE i < length(name)
  UNION ALL SELECT name, 'substitution', translate(name, 'ol', '01') FROM nm UNION ALL SELECT name, 'substitution', translate(name, 'ei', '31') FROM nm
  UNION ALL SELECT name, 'combosquat', name || '-login' FROM nm UNION ALL SELECT name, 'combosquat', 'secure-' || name FROM nm),
att AS (SELECT DISTINCT name, kind, attack FROM at0 WHERE attack <> name AND attack <> '')"""


@query(f"WITH {_ATTACKS_SQL} SELECT name, kind, attack FROM att")
def attack_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return L.attacks(_names(spark, sf))


@query(
    f"""WITH {_ATTACKS_SQL}, e AS (SELECT a.* FROM att a WHERE attack NOT IN (SELECT name FROM nm)),
f AS (SELECT *, replace(replace(translate(attack, '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w') = replace(replace(translate(name, '013457@$', 'oleastas'), 'rn', 'm'), 'vv', 'w') AS strong, levenshtein(attack, name) = 1 AS weak FROM e)
SELECT kind, count(*) AS total, count(*) FILTER (strong) AS strong, count(*) FILTER (weak AND NOT strong) AS weak, count(*) FILTER (NOT weak AND NOT strong) AS missed FROM f GROUP BY kind"""
)
def eval_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """How generated attacks fare against skeletons (strong) and one edit (weak), real names left out."""
    names = _names(spark, sf)
    made = L.attacks(names).join(names.select(F.col("name").alias("attack")), "attack", "left_anti")
    strong = skeleton(F.col("attack")) == skeleton(F.col("name"))
    weak = F.levenshtein("attack", "name") == 1
    return made.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(strong).alias("strong"), F.count_if(weak & ~strong).alias("weak"), F.count_if(~weak & ~strong).alias("missed"))


@query(
    """WITH s AS (SELECT DISTINCT s_suppkey AS k, lower(regexp_extract(trim(n_name), '^([^ /]+)', 1)) AS claimed, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT DISTINCT l_suppkey AS k, lower(regexp_extract(trim(n_name), '^([^ /]+)', 1)) AS linked FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT s.k, s.claimed, count(*) FILTER (c.linked <> s.claimed) AS n_foreign, count(*) FILTER (c.linked = s.claimed) > 0 AS own FROM s JOIN c USING (k) GROUP BY 1, 2"""
)
def family_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as claimed brands, customers' as linked ones: how many linked families differ from the claim."""
    nation = table(spark, sf, "nation").select("n_nationkey", I.family(F.col("n_name")).alias("family"))
    claimed = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.col("family").alias("claimed"))
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("family").alias("linked"))
    linked = items.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("l_suppkey").alias("k"), "linked").distinct()
    both = claimed.join(linked, "k").groupBy("k", "claimed")
    return both.agg(F.count_if(F.col("linked") != F.col("claimed")).alias("n_foreign"), (F.count_if(F.col("linked") == F.col("claimed")) > 0).alias("own"))


@query(
    f"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages), x AS (SELECT CASE WHEN length(host) % 5 = 0 THEN host || '.github.io' ELSE host END AS host FROM h)
SELECT host, max(root) AS root FROM x JOIN (SELECT unnest({list(refdata.FREE_HOSTING)}) AS root) ON host = root OR ends_with(host, '.' || root) WHERE host NOT IN {listed(("",))} GROUP BY host"""
)
def free_hosting_join(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts on platforms where anybody can publish; a fifth of the hosts is put on one."""
    hosts = _links(spark, sf).select("host").distinct().select(F.when(F.length("host") % 5 == 0, F.concat("host", F.lit(".github.io"))).otherwise(F.col("host")).alias("host"))
    roots = spark.createDataFrame([(r,) for r in refdata.FREE_HOSTING], "root string")
    return I.official_root(hosts, roots)


