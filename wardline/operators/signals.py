"""What findings and evidence amount to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence of each kind of finding about a host.
CONFIDENCES = {"homoglyph": 0.95, "substitution": 0.9, "typosquat": 0.85, "permutation": 0.8, "subdomain": 0.85, "keyword_exact": 0.75, "keyword_affix": 0.6, "keyword_typo": 0.6}
#: A brand's name under another top-level domain: less sure where that is a country's.
SWAPPED, SWAPPED_COUNTRY = 0.85, 0.5


def confidence(kind: Column, suffix: Column | None = None) -> Column:
    """Confidence of a finding; ``suffix`` is the public suffix of a name that only differs in it."""
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCES.items():
        out = F.when(kind == name, value).otherwise(out)
    if suffix is not None:
        country = F.length(F.element_at(F.split(suffix, r"\."), -1)) == 2
        out = F.when(kind == "tld_swap", F.when(country, SWAPPED_COUNTRY).otherwise(SWAPPED)).otherwise(out)
    return out


def best_finding(findings: DataFrame, key: str = "host") -> DataFrame:
    """(key, kind, target, confidence): the surest finding of each host; ties go by kind, then target."""
    order = F.struct((-F.col("confidence")).alias("c"), "kind", "target")
    best = findings.groupBy(key).agg(F.min(order).alias("m"))
    return best.select(key, "m.kind", "m.target", (-F.col("m.c")).alias("confidence"))


def evidence_families(rows: dict[str, Column]) -> Column:
    """How many of the conditions hold: kinds of evidence that agree, null counting as not."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in rows.values()], F.lit(0))


def prototype_intents(sentences: DataFrame, prototypes: DataFrame, key: str = "id", least: float = 0.55, discount: float = 0.85, length: int = 15, first: int = 40) -> DataFrame:
    """(key, intent, similarity, weight): intents whose prototypes a sentence means, by the largest cosine.

    ``sentences`` is (key, at, n_chars, embedding): those of more than ``length`` characters among the first ``first``
    count. ``prototypes`` (intent, weight, embedding) are a written list, sent to each task as one array.
    """
    from wardline.operators.campaigns import cosine

    listed = prototypes.agg(F.collect_list(F.struct("intent", "weight", "embedding")).alias("all"))
    used = sentences.filter((F.col("n_chars") > length) & (F.col("at") < first)).select(key, "embedding")
    each = used.join(F.broadcast(listed)).select(key, F.explode(F.transform("all", lambda p: F.struct(p["intent"].alias("intent"), p["weight"].alias("weight"), cosine(F.col("embedding"), p["embedding"]).alias("s")))).alias("p"))
    met = each.filter(F.col("p.s") >= least).groupBy(key, F.col("p.intent").alias("intent")).agg(F.max("p.s").alias("similarity"), F.max("p.weight").alias("w"))
    return met.select(key, "intent", F.round("similarity", 6).alias("similarity"), F.round(F.col("w") * discount, 6).alias("weight"))


def substring_suppressed(terms: Column, most: int = 5) -> Column:
    """The first ``most`` of an array of (term, …), best first, of which none holds another or is held by one before it."""
    start = F.filter(terms, lambda t: F.lit(False))
    clash = lambda kept, t: F.exists(kept, lambda k: k["term"].contains(t["term"]) | t["term"].contains(k["term"]))
    return F.aggregate(terms, start, lambda kept, t: F.when((F.size(kept) < most) & ~clash(kept, t), F.concat(kept, F.array(t))).otherwise(kept))


def run_rollup(checks: DataFrame) -> DataFrame:
    """(file, n, passed, failed, skipped, seconds) of test or check outcomes (file, outcome, seconds)."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    return checks.groupBy("file").agg(F.count(F.lit(1)).alias("n"), of("passed").alias("passed"), of("failed").alias("failed"), of("skipped").alias("skipped"), F.round(F.sum("seconds"), 6).alias("seconds"))


def feed_evaluation(listed: DataFrame, clean: DataFrame, at: float = 0.5) -> DataFrame:
    """(n_listed, n_clean, recall, false_positive_rate) of scores (score) of fresh listed links and of known good ones."""
    share = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.avg(F.when(F.col("score") >= at, 1.0).otherwise(0.0)).alias(name))
    one = share(listed, "listed").crossJoin(share(clean, "clean"))  # one row beside one row
    return one.select("n_listed", "n_clean", F.round("listed", 6).alias("recall"), F.round("clean", 6).alias("false_positive_rate"))


def detection_summary(detections: DataFrame) -> DataFrame:
    """(id, ts, decision, risk, reason, channel) of detections (id, ts, decision, risk, reasons, message (channel, …))."""
    return detections.select("id", "ts", "decision", "risk", F.get("reasons", F.lit(0))["text"].alias("reason"), F.col("message.channel").alias("channel"))
