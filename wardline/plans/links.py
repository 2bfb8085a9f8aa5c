"""Queries over links and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import pages as P
from wardline.functions import urls as U
from wardline.functions.scores import decision
from wardline.functions.splits import group_fold
from wardline.plans.registry import listed, query, table
from wardline.sources.feeds import clean_domain, usable_domain

#: Parsed links as SQL, shared by the twins below.
PARSED_SQL = r"""
u0 AS (SELECT page_id, url, html, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN url ELSE 'http://' || url END AS full_url FROM pages),
u1 AS (SELECT *, lower(regexp_extract(full_url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(full_url, '^[^:]+://([^/?#]*)', 1) AS authority,
  regexp_extract(full_url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(full_url, '^[^?#]*\?([^#]*)', 1) AS query,
  regexp_extract(full_url, '#(.*)$', 1) AS fragment FROM u0),
u2 AS (SELECT *, regexp_extract(authority, '^(.*)@', 1) AS userinfo, regexp_replace(authority, '^.*@', '') AS hostport,
  CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM u1),
u3 AS (SELECT *, lower(regexp_replace(hostport, ':[0-9]*$', '')) AS host, TRY_CAST(regexp_extract(hostport, ':([0-9]+)$', 1) AS INT) AS port FROM u2),
p AS (SELECT *, scheme || '://' || host || CASE WHEN port IS NOT NULL AND port NOT IN (80, 443) THEN ':' || port ELSE '' END || path
  || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized FROM u3)"""

#: Registrable domains as SQL: the longest listed suffix and one label more.
REGISTRABLE_SQL = rf"""
{PARSED_SQL},
tails AS (SELECT page_id, i, array_to_string(list_slice(string_split(host, '.'), i, 100), '.') AS suffix FROM p, range(1, 20) AS s(i)
  WHERE i <= len(string_split(host, '.'))),
longest AS (SELECT page_id, arg_min(suffix, i) AS suffix FROM tails WHERE suffix IN {listed(refdata.PUBLIC_SUFFIXES)} GROUP BY page_id),
r AS (SELECT p.*, coalesce(l.suffix, string_split(host, '.')[-1]) AS suffix FROM p LEFT JOIN longest l USING (page_id)),
g AS (SELECT *, CASE WHEN host = suffix OR regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN host
  ELSE string_split(substr(host, 1, length(host) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS registrable FROM r)"""


def _entropy(s: str) -> str:
    """Entropy of a string as SQL without correlated subqueries: over its distinct characters."""
    n = f"length({s})"
    share = f"(({n} - length(replace({s}, ch, ''))) * 1.0 / {n})"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: -{share} * log2({share}))), 0)"


def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the parts of their links as columns."""
    pages = table(spark, sf, "pages")
    return pages.select("page_id", "url", "html", *[c.alias(n) for n, c in U.parse(F.col("url")).items()])


def parts() -> dict:
    """Columns of ``parsed_pages`` as the mapping that the URL functions take."""
    return {n: F.col(n) for n in ("scheme", "userinfo", "host", "port", "path", "query", "fragment", "normalized")}


@query(f"WITH {PARSED_SQL} SELECT page_id, scheme, userinfo, host, port, path, query, fragment, normalized FROM p")
def url_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_pages(spark, sf).drop("url", "html")


@query(f"WITH {REGISTRABLE_SQL} SELECT page_id, host, suffix, registrable FROM g")
def url_registrable(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_pages(spark, sf).select("page_id", "host", U.suffix_of(F.col("host")).alias("suffix"), U.registrable(F.col("host")).alias("registrable"))


_FEATURES_SQL = rf"""
{REGISTRABLE_SQL},
f0 AS (SELECT *, CASE WHEN regexp_matches(host, '^www[.].*[.]') THEN regexp_replace(host, '^www[.]', '') ELSE host END AS h,
  regexp_replace(regexp_replace(normalized, '^[a-z][a-z0-9+.-]*://', ''), '^www[.]', '') AS u,
  string_split(registrable, '.')[1] AS label,
  CASE WHEN length(host) > length(registrable) THEN substr(host, 1, length(host) - length(registrable) - 1) ELSE '' END AS before,
  string_split_regex(lower(path || '?' || query), '[/\-._?=&]+') AS toks,
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(string_split(x, '=')[1])) AS keys FROM g),
f AS (SELECT page_id, scheme, path, normalized,
  length(u) AS url_len, length(h) AS host_len, length(path) AS path_len, length(query) AS query_len,
  length(h) - length(replace(h, '.', '')) AS n_dots, len(list_filter(string_split(before, '.'), lambda x: x <> '' AND x <> 'www')) AS n_subdomains,
  round(len(regexp_extract_all(u, '\p{{Nd}}')) / greatest(1, length(u)), 6) AS digit_ratio,
  round(len(regexp_extract_all(u, '[^\p{{L}}\p{{N}}]')) / greatest(1, length(u)), 6) AS special_ratio,
  length(host) - length(replace(h, '-', '')) - (length(host) - length(h)) AS n_hyphens, length(u) - length(replace(u, '_', '')) AS n_underscores,
  length(path) - length(replace(path, '/', '')) AS n_slashes,
  (contains(string_split(u, '?')[1], '@') OR userinfo <> '')::BIGINT AS has_at, length(u) - length(replace(u, '%', '')) AS n_percent,
  regexp_matches(host, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|0x[0-9a-f]+|[0-9]{{8,10}})$')::BIGINT AS is_ip,
  coalesce(port NOT IN (80, 443), false)::BIGINT AS has_port, contains(host, 'xn--')::BIGINT AS is_punycode,
  (string_split(host, '.')[-1] IN {listed(refdata.SUSPICIOUS_TLDS)})::BIGINT AS suspicious_tld,
  len(list_filter({list(refdata.KEYWORDS)}, lambda k: contains(lower(u), k))) AS n_keywords,
  (registrable IN {listed(refdata.SHORTENERS)} OR host IN {listed(refdata.SHORTENERS)})::BIGINT AS is_shortener,
  (len(list_filter({list(refdata.FREE_HOSTING)}, lambda k: host = k OR ends_with(host, '.' || k))) > 0)::BIGINT AS free_hosting,
  round({_entropy("h")}, 6) AS host_entropy, round({_entropy("(path || query)")}, 6) AS path_entropy,
  coalesce(list_max(list_transform(regexp_extract_all(lower(u), '[0-9a-f]{{8,}}'), lambda x: length(x))), 0) AS hex_run,
  coalesce(list_max(list_transform(toks, lambda x: length(x))), 0) AS longest_token,
  (len(list_filter(toks, lambda t: length(t) >= 12 AND {_entropy("t")} > 3.5)) > 0)::BIGINT AS random_path,
  len(list_filter(keys, lambda k: k IN {listed(refdata.SUSPICIOUS_PARAMS)})) AS n_susp_params, len(keys) AS n_params,
  contains(path, '//')::BIGINT AS double_slash_path, length(string_split(host, '.')[-1]) AS tld_len,
  len(regexp_extract_all(host, '[0-9]')) AS n_host_digits, round(len(regexp_extract_all(lower(label), '[aeiou]')) / greatest(1, length(label)), 6) AS host_vowel_ratio,
  regexp_matches(lower(path), '[.][a-z0-9]{{2,4}}$')::BIGINT AS has_file_ext, regexp_matches(lower(path), '[.]({"|".join(refdata.EXECUTABLES)})$')::BIGINT AS exec_ext,
  len(regexp_extract_all(lower(path || query), '([a-z0-9-]+[.])+(com|net|org|in|co|io)\b')) AS n_embedded_domains, length(registrable) AS reg_len FROM f0)"""


@query(f"WITH {_FEATURES_SQL} SELECT * EXCLUDE (scheme, path, normalized) FROM f")
def url_lexical_features(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_pages(spark, sf).select("page_id", *U.lexical_features(parts()).values())


@query(
    f"WITH {PARSED_SQL}, "
    r"""m AS (SELECT page_id, '^' || substr(normalized, 1, 200) || '$' AS s FROM p),
n AS (SELECT page_id, substr(s, i, k) AS gram FROM m, range(3, 6) AS a(k), range(1, 204) AS b(i) WHERE i + k - 1 <= length(s))
SELECT page_id, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct FROM n GROUP BY page_id"""
)
def url_char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _gram_counts(spark, sf, 200)


def _gram_counts(spark: SparkSession, sf: str, limit: int | None) -> DataFrame:
    grams = U.char_ngrams(F.col("normalized"), limit=limit)
    return parsed_pages(spark, sf).select("page_id", F.size(grams).cast("long").alias("n_grams"), F.size(F.array_distinct(grams)).cast("long").alias("n_distinct"))


@query()
def url_char_ngrams_whole(spark: SparkSession, sf: str) -> DataFrame:
    """N-grams of whole links."""
    return _gram_counts(spark, sf, None)


_RULES_SQL = """
hits AS (SELECT page_id, normalized, list_filter([
  CASE WHEN scheme IN ('javascript', 'data') THEN {'id': 'script_url', 'w': 0.7::DOUBLE} END, CASE WHEN is_ip > 0 THEN {'id': 'ip_host', 'w': 0.35::DOUBLE} END,
  CASE WHEN has_at > 0 THEN {'id': 'userinfo', 'w': 0.4::DOUBLE} END, CASE WHEN is_punycode > 0 THEN {'id': 'punycode', 'w': 0.25::DOUBLE} END,
  CASE WHEN is_shortener > 0 THEN {'id': 'shortener', 'w': 0.15::DOUBLE} END, CASE WHEN free_hosting > 0 THEN {'id': 'free_hosting', 'w': 0.18::DOUBLE} END,
  CASE WHEN suspicious_tld > 0 THEN {'id': 'suspicious_tld', 'w': 0.12::DOUBLE} END, CASE WHEN n_subdomains >= 4 THEN {'id': 'deep_subdomains', 'w': 0.15::DOUBLE} END,
  CASE WHEN has_port > 0 THEN {'id': 'port', 'w': 0.12::DOUBLE} END, CASE WHEN exec_ext > 0 THEN {'id': 'executable', 'w': 0.45::DOUBLE} END,
  CASE WHEN n_keywords >= 2 THEN {'id': 'cred_keywords', 'w': 0.1::DOUBLE} END, CASE WHEN n_susp_params > 0 THEN {'id': 'redirect_param', 'w': 0.08::DOUBLE} END,
  CASE WHEN scheme = 'http' AND n_keywords > 0 THEN {'id': 'http_sensitive', 'w': 0.1::DOUBLE} END, CASE WHEN random_path > 0 THEN {'id': 'random_path', 'w': 0.06::DOUBLE} END
], lambda x: x IS NOT NULL) AS hits FROM f),
scored AS (SELECT page_id, normalized, array_to_string(list_transform(hits, lambda x: x.id), ',') AS rules,
  100 * (1 - coalesce(list_product(list_transform(hits, lambda x: 1.0::DOUBLE - x.w)), 1.0::DOUBLE)) AS score0 FROM hits)"""


def scored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, normalized, rules, score, decision) of each page's link."""
    pages = parsed_pages(spark, sf)
    features = pages.select("page_id", "scheme", "normalized", *U.lexical_features(parts()).values())
    hits = U.rule_hits(U.link_rules({"scheme": F.col("scheme")}, {n: F.col(n) for n in features.columns}))
    rated = features.select("page_id", "normalized", hits.alias("hits"))
    score = F.round(U.url_score(F.col("hits")), 6)
    return rated.select("page_id", "normalized", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("rules"), score.alias("score"), decision(score).alias("decision"))


_DECISION_SQL = "CASE WHEN {s} >= 85 THEN 'BLOCK' WHEN {s} >= 60 THEN 'QUARANTINE' WHEN {s} >= 30 THEN 'FLAG' ELSE 'ALLOW' END"


@query(f"WITH {_FEATURES_SQL}, {_RULES_SQL} SELECT page_id, rules, round(score0, 6) AS score, {_DECISION_SQL.format(s='round(score0, 6)')} AS decision FROM scored")
def url_rules_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pages(spark, sf).drop("normalized")


_KEY_SQL = "regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://(www[.])?', ''), '/+$', '')"


@query(f"SELECT {_KEY_SQL} AS dedup_key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def url_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(U.dedup_key(F.col("url")).alias("dedup_key")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_FEATURES_SQL}, {_RULES_SQL} SELECT sha256(normalized) AS url_hash, min(page_id) AS first_page, max(page_id) AS last_page, count(*) AS times_seen, "
    "round(max(score0), 6) AS risk FROM scored GROUP BY 1"
)
def url_sightings(spark: SparkSession, sf: str) -> DataFrame:
    seen = scored_pages(spark, sf).groupBy(F.sha2("normalized", 256).alias("url_hash"))
    return seen.agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("times_seen"), F.max("score").alias("risk"))


@query(
    f"WITH {PARSED_SQL}, "
    r"""a AS (SELECT page_id, scheme, host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM p)
SELECT page_id, CASE WHEN starts_with(href, '/') THEN scheme || '://' || host || href ELSE href END AS link, count(*) AS n FROM a GROUP BY 1, 2"""
)
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    anchors = parsed_pages(spark, sf).select("page_id", "scheme", "host", F.explode(P.anchor_targets(F.col("html"))).alias("href"))
    return anchors.groupBy("page_id", P.resolve(F.col("href"), F.col("scheme"), F.col("host")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', ' ', 'g'),
  '(?i)<(br|/?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header))[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
e AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
  '[ \t\n]+', ' ', 'g')) AS t FROM s)
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM e"""
)
def html_text_len(spark: SparkSession, sf: str) -> DataFrame:
    text = P.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_RANGES = ", ".join(f"({a}, {b})" for a, b in U.private_ranges())


@query(
    rf"""WITH i AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}\b')) AS ip FROM documents
  UNION SELECT '10.' || (page_id % 256) || '.0.1' FROM pages UNION SELECT '8.8.' || (page_id % 256) || '.' || (page_id % 300) FROM pages),
o AS (SELECT ip, list_transform(string_split(ip, '.'), lambda x: x::BIGINT) AS o FROM i),
n AS (SELECT ip, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS v FROM o WHERE list_max(o) <= 255),
b(lo, hi) AS (VALUES {_RANGES})
SELECT ip, EXISTS (SELECT 1 FROM b WHERE v BETWEEN lo AND hi) AS blocked FROM n"""
)
def ssrf_guard(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"), F.lit(1))).alias("ip"))
    page = F.col("page_id")
    pages = table(spark, sf, "pages")
    made = pages.select(F.concat(F.lit("10."), page % 256, F.lit(".0.1")).alias("ip")).union(pages.select(F.concat(F.lit("8.8."), page % 256, F.lit("."), page % 300)))
    return found.union(made).distinct().filter(U.ipv4_number(F.col("ip")).isNotNull()).select("ip", U.blocked_target(F.col("ip")).alias("blocked"))


@query(
    f"WITH {PARSED_SQL}, "
    rf"""q AS (SELECT *, query || CASE WHEN page_id % 3 = 0 THEN '&email=a@b.example' ELSE '' END AS query2 FROM p),
s AS (SELECT *, regexp_matches(query2, '{refdata.PII_PARAM}') AS personal,
  scheme || '://' || host || path || CASE WHEN query2 <> '' THEN '?' || query2 ELSE '' END AS normalized2 FROM q)
SELECT page_id, CASE WHEN personal THEN 'domain' ELSE 'url' END AS kind, CASE WHEN personal THEN host ELSE normalized2 END AS value FROM s"""
)
def shareable_indicator(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("page_id") % 3 == 0, "&email=a@b.example").otherwise("")
    pages = parsed_pages(spark, sf).withColumn("query", F.concat("query", more))
    shown = F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query"))).otherwise("")
    pages = pages.withColumn("normalized", F.concat("scheme", F.lit("://"), "host", "path", shown))
    kind, value = U.shareable(parts(), F.col("normalized"))
    return pages.select("page_id", kind.alias("kind"), value.alias("value"))


@query(
    f"WITH {PARSED_SQL}, h AS (SELECT host, list_sort(list(normalized)) AS urls FROM p GROUP BY host) "
    "SELECT host, len(urls) AS n_urls FROM h WHERE len(list_filter(urls, lambda u: starts_with(u, 'https://'))) > 0 AND len(list_filter(urls, lambda u: contains(u, '?'))) > 0"
)
def nested_host_filter(spark: SparkSession, sf: str) -> DataFrame:
    link = F.col("normalized")
    hosts = parsed_pages(spark, sf).groupBy("host").agg(F.count("normalized").alias("n_urls"), F.bool_or(link.startswith("https://")).alias("secure"), F.bool_or(link.contains("?")).alias("asks"))
    return hosts.filter("secure and asks").select("host", "n_urls")


@query(
    f"WITH {REGISTRABLE_SQL} SELECT page_id, registrable, CASE WHEN ('0x' || substr(md5(registrable), 1, 8))::BIGINT % 100 < 80 THEN 'train' "
    "WHEN ('0x' || substr(md5(registrable), 1, 8))::BIGINT % 100 < 90 THEN 'validation' ELSE 'test' END AS fold FROM g"
)
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    pages = parsed_pages(spark, sf).select("page_id", U.registrable(F.col("host")).alias("registrable"))
    return pages.withColumn("fold", group_fold(F.col("registrable")))


@query(
    f"WITH {REGISTRABLE_SQL}, c AS (SELECT host, any_value(registrable) AS registrable, count(*) AS n FROM g GROUP BY host), "
    "k AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS rank FROM c) "
    "SELECT registrable, min(rank) AS rank, count(*) AS n_hosts FROM k GROUP BY registrable HAVING min(rank) <= 50"
)
def rank_table(spark: SparkSession, sf: str) -> DataFrame:
    hosts = parsed_pages(spark, sf).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    first = hosts.orderBy(F.desc("n"), "host").limit(50)  # the report's length, so that the numbering sees no more
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "host")).cast("long"))
    best = ranked.groupBy(U.registrable(F.col("host")).alias("registrable")).agg(F.min("rank").alias("rank"))
    counts = hosts.groupBy(U.registrable(F.col("host")).alias("registrable")).agg(F.count(F.lit(1)).alias("n_hosts"))
    return counts.join(F.broadcast(best), "registrable").select("registrable", "rank", "n_hosts")


@query(
    r"""WITH h AS (SELECT 'hosts' AS source, '  *.' || upper(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || ' # seen on ' || page_id AS line FROM pages),
m AS (SELECT 'mail' AS source, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@([a-z0-9.-]+[.][a-z]{2,})', 1)) AS line FROM documents),
c AS (SELECT source, regexp_replace(trim(regexp_replace(lower(line), '#.*$', '')), '^[*][.]', '') AS domain FROM (SELECT * FROM h UNION ALL SELECT * FROM m))
SELECT source, domain, count(*) AS n FROM c WHERE contains(domain, '.') AND NOT contains(domain, ' ') AND NOT contains(domain, '/') GROUP BY 1, 2"""
)
def feed_clean(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    host = F.upper(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    lines = pages.select(F.lit("hosts").alias("source"), F.concat(F.lit("  *."), host, F.lit(" # seen on "), F.col("page_id").cast("string")).alias("line"))
    mails = table(spark, sf, "documents").select(F.lit("mail").alias("source"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))).alias("line"))
    cleaned = lines.unionByName(mails).select("source", clean_domain(F.col("line")).alias("domain"))
    return cleaned.filter(usable_domain(F.col("domain"))).groupBy("source", "domain").agg(F.count(F.lit(1)).alias("n"))
