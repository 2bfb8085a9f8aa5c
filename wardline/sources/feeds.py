"""Indicator feeds: line lists, CSV, JSON and host lists, cleaned and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_domain(line: Column) -> Column:
    """A line of a host list in lower case, without comment and leading wildcard."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), "#.*$", "")), r"^[*][.]", "")


def usable_domain(domain: Column) -> Column:
    return domain.contains(".") & ~domain.contains(" ") & ~domain.contains("/")


def _iocs(df: DataFrame, kind: str, source: str) -> DataFrame:
    return df.filter("value <> ''").distinct().select(F.lit(kind).alias("ioc_type"), "value", F.lit(source).alias("source"))


def read_line_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(ioc_type, value, source) of the lines that start with http; compressed files too."""
    return _iocs(spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value").startswith("http")), "url", source)


def read_json_feed(spark: SparkSession, path: str, source: str, field: str = "url") -> DataFrame:
    """The same from a file of JSON records."""
    return _iocs(spark.read.json(path).select(F.col(field).cast("string").alias("value")).filter("value is not null"), "url", source)


def read_csv_feed(spark: SparkSession, path: str, source: str, url_column: int = 2, status_column: int = 3, status: str = "online") -> DataFrame:
    """The same from CSV with # comments, of the rows with the given status."""
    rows = spark.read.option("comment", "#").csv(path)
    names = rows.columns
    return _iocs(rows.filter(F.col(names[status_column]) == status).select(F.col(names[url_column]).alias("value")), "url", source)


def read_domain_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The same from a host list, compressed or not."""
    rows = spark.read.text(path).select(clean_domain(F.col("value")).alias("value"))
    return _iocs(rows.filter(usable_domain(F.col("value"))), "domain", source)


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    """(registrable, rank) of a CSV of rank and domain: the best rank of each registrable domain."""
    from wardline.functions.urls import registrable

    rows = spark.read.schema("rank long, domain string").csv(path).filter("domain is not null")
    return rows.groupBy(registrable(F.lower("domain")).alias("registrable")).agg(F.min("rank").alias("rank"))


def read_suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, kind) of a public suffix file: exact, wildcard or exception rules."""
    rows = spark.read.text(path).select(F.trim("value").alias("rule")).filter("rule <> '' and not startswith(rule, '//')")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("exact")
    return rows.select(F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("suffix"), kind.alias("kind"))


def read_confusables(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) code points of a confusables file, single sources only."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", "#.*$", ""), ";").alias("f")).filter(F.size("f") >= 2)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    hexed = rows.select(bare(F.col("f")[0]).alias("source"), bare(F.col("f")[1]).alias("target"))
    return hexed.filter(~F.col("source").contains(" ") & (F.col("source") != ""))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, category, domain) of a JSON knowledge base, one row for each official domain."""
    return spark.read.option("multiLine", True).json(path).select("id", "name", "category", F.explode("domains").alias("domain"))


def merge_iocs(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all indicators, new ones by source): rows of ``incoming`` that ``existing`` lacks are appended."""
    key = ["ioc_type", "value", "source"]
    new = incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True), new.groupBy("source").agg(F.count(F.lit(1)).alias("n_new"))


def without_removed(feed: DataFrame, removed: DataFrame) -> DataFrame:
    """A feed read again, without the indicators (ioc_type, value) that analysts have removed before: the list is remembered, the feed isn't."""
    return feed.join(removed.select("ioc_type", "value").distinct(), ["ioc_type", "value"], "left_anti")
