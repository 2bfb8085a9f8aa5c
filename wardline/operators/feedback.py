"""Analysts' verdicts, sightings, demo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = {"confirmed_phishing": "confirmed", "false_positive": "false_positive", "unsure": "unsure"}


def with_status(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    """Detections (id, …) with the status of their latest verdict (detection_id, label, at)."""
    last = feedback.filter(F.col("label").isin(*STATUS)).groupBy("detection_id").agg(F.max_by("label", "at").alias("label"))
    named = F.lit(None).cast("string")
    for label, status in STATUS.items():
        named = F.when(F.col("label") == label, status).otherwise(named)
    joined = detections.join(last.withColumnRenamed("detection_id", "id"), "id", "left")
    old = F.col("status") if "status" in detections.columns else F.lit("new")
    return joined.withColumn("status", F.coalesce(named, old)).drop("label")


def confirmed_iocs(links: DataFrame, feedback: DataFrame) -> DataFrame:
    """(ioc_type, value, source) of the untrusted links (detection_id, url, host, registrable, trusted) of confirmed detections.

    A host becomes an indicator only if it is not itself the registrable domain, which innocent pages may share.
    """
    last = feedback.groupBy("detection_id").agg(F.max_by("label", "at").alias("label")).filter("label = 'confirmed_phishing'")
    bad = links.filter(~F.coalesce("trusted", F.lit(False))).join(last, "detection_id", "left_semi")
    urls = bad.select(F.lit("url").alias("ioc_type"), F.col("url").alias("value"))
    hosts = bad.filter("host <> registrable").select(F.lit("domain").alias("ioc_type"), F.col("host").alias("value"))
    return urls.unionAll(hosts).distinct().withColumn("source", F.lit("analyst"))


def merge_sightings(known: DataFrame, new: DataFrame) -> DataFrame:
    """(url_hash, first_seen, last_seen, times_seen, risk) of known and new sightings together."""
    return known.unionByName(new).groupBy("url_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"), F.max("risk").alias("risk"))


def without_demo(rows: DataFrame) -> DataFrame:
    """Rows that are no demonstration data."""
    return rows.filter(~F.coalesce("demo", F.lit(False)))


def blocked_iocs(detections: DataFrame, links: DataFrame) -> DataFrame:
    """(ioc_type, value, source) of the untrusted links (detection_id, url, host, registrable, trusted) of blocked detections (id, decision).

    What a block feeds into the local list; hosts that are registrable domains of their own stay out, as with confirmed verdicts.
    """
    blocked = detections.filter("decision = 'BLOCK'").select(F.col("id").alias("detection_id")).distinct()
    bad = links.filter(~F.coalesce("trusted", F.lit(False))).join(blocked, "detection_id", "left_semi")
    urls = bad.select(F.lit("url").alias("ioc_type"), F.col("url").alias("value"))
    hosts = bad.filter("host <> registrable").select(F.lit("domain").alias("ioc_type"), F.col("host").alias("value"))
    return urls.unionAll(hosts).distinct().withColumn("source", F.lit("blocked"))
