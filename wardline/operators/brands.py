"""Brands: keywords in hosts, claims in texts, the guard that no trust can undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions.urls import has_suffix
from wardline.operators.intel import family

#: Keywords up to which they are sent to every task.
SENT_KEYWORDS = 100_000


def host_tokens(hosts: DataFrame) -> DataFrame:
    """(host, token): pieces of a host's labels and neighbouring pieces joined."""
    pieces = F.filter(F.split("host", r"[.\-_]"), lambda t: F.length(t) > 0)
    n = F.size(pieces)
    joined = F.when(n > 1, F.zip_with(F.slice(pieces, F.lit(1), n - 1), F.slice(pieces, F.lit(2), n - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return hosts.select("host", F.explode(F.array_distinct(F.concat(pieces, joined))).alias("token"))


def keyword_hits(hosts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(host, brand, keyword, kind): the longest keyword (brand, keyword) in each host, whole or at either end of a token.

    Prefixes and suffixes of tokens are exploded, so all three kinds are one equi-join.
    """
    tokens = host_tokens(hosts)
    n = F.length("token")
    ends = F.flatten(F.transform(F.sequence(F.lit(4), F.greatest(n - 1, F.lit(4))), lambda k: F.array(F.substring("token", F.lit(1), k), F.substring("token", n - k + 1, k))))
    exact = tokens.select("host", F.col("token").alias("keyword"), F.lit("exact").alias("kind"))
    affix = tokens.filter(n > 4).select("host", F.explode(F.array_distinct(ends)).alias("keyword"), F.lit("affix").alias("kind"))
    hits = exact.unionAll(affix).join(keywords.select("brand", "keyword").distinct(), "keyword")
    first = F.min(F.struct((-F.length("keyword")).alias("l"), (F.col("kind") != "exact").alias("e"), "brand", "keyword", "kind"))
    return hits.groupBy("host").agg(first.alias("m")).select("host", "m.brand", "m.keyword", "m.kind")


def keyword_typos(hosts: DataFrame, keywords: DataFrame, least: int = 6) -> DataFrame:
    """(host, brand, keyword, token): pieces of hosts that are one edit (a letter more, less, other, or two swapped) from a keyword of ``least`` letters or more.

    Both sides meet on spellings with a letter left out; pieces that are a keyword themselves are ``keyword_hits``.
    """
    from wardline.operators.lookalike import by_typo

    tokens = host_tokens(hosts).filter(F.length("token") >= least - 1)
    known = keywords.filter(F.length("keyword") >= least).select("brand", "keyword").distinct()
    pairs = by_typo(tokens.select(F.col("token").alias("name")).distinct(), known.select(F.col("keyword").alias("name")).distinct())
    met = tokens.join(pairs.select(F.col("name").alias("token"), F.col("target").alias("keyword")), "token").join(known, "keyword")
    return met.select("host", "brand", "keyword", "token").distinct()


def claims(texts: DataFrame, keywords: DataFrame, key: str = "id", most: int | None = 5, words: int = 4) -> DataFrame:
    """(key, brand, at): brands that a text names, the first ``most`` by place.

    Each place of a text holds its token and the next ones, ``words`` in all; it meets the keywords that begin with its
    token, and the rest is compared. Up to SENT_KEYWORDS keywords are sent to the texts, so that no run is shuffled; more are joined by key.
    """
    spell = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    after = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(words)]
    spelt = texts.select(key, spell("text").alias("w")).select(key, F.posexplode(F.arrays_zip(*after)).alias("at", "__run")).withColumn("__first", F.col("__run.w0"))
    k = spell("keyword")
    known = keywords.select("brand", F.array_join(k, " ").alias("keyword"), F.get(k, F.lit(0)).alias("__first"), F.size(k).alias("__n")).filter(F.col("__n").between(1, words)).drop("__n").distinct()
    if known.limit(SENT_KEYWORDS + 1).count() <= SENT_KEYWORDS:
        known = F.broadcast(known)
    met = spelt.join(known, "__first").filter(F.concat_ws(" ", *[F.col(f"__run.w{k}") for k in range(words)], F.lit("")).startswith(F.concat("keyword", F.lit(" "))))
    found = met.groupBy(key, "brand").agg(F.min("at").alias("at"))
    if most is None:
        return found
    return found.selectExpr("*", f"row_number() over (partition by {key} order by at, brand) as r").filter(F.col("r") <= most).drop("r")


def guard(claimed: DataFrame, links: DataFrame, senders: DataFrame, key: str = "id") -> DataFrame:
    """(key, family, hosts): messages that claim a brand and link elsewhere.

    ``claimed`` is (key, brand), ``links`` (key, host, official) with the official brand of
    the host or null, ``senders`` (key, official, failed). A message from the brand's own
    authenticated domain is exempt; hosts where anybody publishes are never official.
    """
    families = claimed.select(key, family(F.col("brand")).alias("family")).distinct()
    own = senders.select(key, family(F.col("official")).alias("sender_family"), F.coalesce("failed", F.lit(False)).alias("failed"))
    open_ = families.join(own, key, "left").filter(F.col("failed") | ~F.coalesce(F.col("sender_family") == F.col("family"), F.lit(False)))
    public = has_suffix(F.col("host"), refdata.FREE_HOSTING) | F.col("host").isin("docs.google.com", "drive.google.com")
    rated = open_.join(links.filter("host is not null"), key).filter(F.col("official").isNull() | (family(F.col("official")) != F.col("family")) | public)
    return rated.groupBy(key, "family").agg(F.slice(F.array_sort(F.collect_set("host")), 1, 4).alias("hosts"))
