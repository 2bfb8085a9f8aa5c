"""Indicator matching and official domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import ips
from wardline.functions.urls import parse, registrable


def suffixes(host: Column) -> Column:
    """All label suffixes of a host, longest first."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def active(iocs: DataFrame, source: str | None = None) -> DataFrame:
    """Indicators that are active, of one source or all."""
    on = iocs.filter(F.coalesce("active", F.lit(False)))
    return on if source is None else on.filter(F.col("source") == source)


def match_values(values: DataFrame, iocs: DataFrame, kinds: tuple[str, ...] = ("ip", "hash")) -> DataFrame:
    """(…, source, risk, confidence) of the values (ioc_type, value) that are listed as they stand: addresses and file hashes."""
    wanted = F.col("ioc_type").isin(*kinds)
    listed = iocs.filter(wanted).groupBy("ioc_type", F.lower("value").alias("value")).agg(F.min("source").alias("source"))
    met = values.filter(wanted).withColumn("value", F.lower("value")).join(listed, ["ioc_type", "value"])
    return met.withColumns({"risk": F.lit(95.0), "confidence": F.lit(0.95)})


def match_iocs(links: DataFrame, iocs: DataFrame, shared: DataFrame, from_urls: bool = False) -> DataFrame:
    """(…, match, risk, confidence) of links (url, host, registrable): by URL, else host, else registrable domain.

    ``iocs`` is (ioc_type, value), ``shared`` (host): services that anybody uses, whose domains
    never match. Exact matches have risk 95, domain matches 70. All joins are on equal keys. With
    ``from_urls`` the registrable domains of listed URLs are listed domains too.
    """
    urls = iocs.filter("ioc_type = 'url'").select(F.col("value").alias("url")).distinct().withColumn("__url", F.lit(True))
    domains = iocs.filter("ioc_type = 'domain'").select("value")
    if from_urls:
        hosts = iocs.filter("ioc_type = 'url'").select(parse(F.col("value"))["host"].alias("host")).filter("host is not null")
        domains = domains.unionAll(hosts.select(registrable(F.col("host"))))
    domains = domains.distinct()
    usable = domains.join(shared.select(F.col("host").alias("value")).distinct(), "value", "left_anti").withColumn("__hit", F.lit(True))
    by_host = usable.withColumnsRenamed({"value": "host", "__hit": "__host"})
    by_reg = usable.withColumnsRenamed({"value": "registrable", "__hit": "__reg"})
    joined = links.join(urls, "url", "left").join(by_host, "host", "left").join(by_reg, "registrable", "left")
    match = F.when(F.col("__url"), "url").when(F.col("__host"), "host").when(F.col("__reg"), "registrable").otherwise("none")
    risk = F.when(match == "url", 95.0).when(match == "none", 0.0).otherwise(70.0)
    confidence = F.when(match == "url", 0.95).when(match == "none", 0.3).otherwise(0.7)
    return joined.withColumn("match", match).withColumn("risk", risk).withColumn("confidence", confidence).drop("__url", "__host", "__reg")


def official_root(hosts: DataFrame, roots: DataFrame, host: str = "host", root: str = "root") -> DataFrame:
    """(host, root): the longest official root that a host is or ends with; hosts without one are left out."""
    tails = hosts.select(host).distinct().select(host, F.posexplode(suffixes(F.col(host))).alias("at", root))
    return tails.join(roots.select(root).distinct(), root).groupBy(host).agg(F.min_by(root, "at").alias(root))


def family(name: Column) -> Column:
    """First word of a brand's name in lower case: brands of one family are not rivals."""
    return F.lower(F.regexp_extract(F.trim(name), r"^([^\s/]+)", 1))


def candidates(messages: DataFrame, links: DataFrame, key: str = "id", most: int | None = None) -> DataFrame:
    """(key, ioc_type, value) of what to look up for messages (key, sender_domain, text, attachments (sha256)) and their links (key, url, host, trusted).

    Links, their hosts, the sender's domain, addresses in the text and attachments' hashes, each once and in this
    order; trusted links and their hosts are left out. ``most`` keeps the first ones of a message.
    """
    own = links.filter(~F.coalesce("trusted", F.lit(False)))
    kinds = [
        own.select(key, F.lit(0).alias("at"), F.lit("url").alias("ioc_type"), F.col("url").alias("value")), own.select(key, F.lit(1).alias("at"), F.lit("domain").alias("ioc_type"), F.col("host").alias("value")),
        messages.select(key, F.lit(2).alias("at"), F.lit("domain").alias("ioc_type"), F.lower("sender_domain").alias("value")), messages.select(key, F.lit(3).alias("at"), F.lit("ip").alias("ioc_type"), F.explode(ips(F.col("text"))).alias("value")),
        messages.select(key, F.lit(4).alias("at"), F.lit("hash").alias("ioc_type"), F.explode("attachments").alias("a")).select(key, "at", "ioc_type", F.lower("a.sha256").alias("value")),
    ]
    each = reduce(DataFrame.unionByName, kinds).filter("value is not null and value <> ''").groupBy(key, "ioc_type", "value").agg(F.min("at").alias("at"))
    if most is not None:
        each = each.selectExpr("*", f"row_number() over (partition by {key} order by at, value) as __r").filter(F.col("__r") <= most).drop("__r")
    return each.drop("at")
