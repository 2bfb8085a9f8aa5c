"""One verdict for each message over all engines: language, links, threat intelligence, graph, brands, sender and tricks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import extract as E
from wardline.functions import scores as S
from wardline.functions import text as X
from wardline.functions import urls as U
from wardline.functions.tagstream import page_parts
from wardline.operators.intel import match_iocs
from wardline.operators.signals import evidence_families


@dataclass(frozen=True)
class Known:
    """What messages are held against; all tables are joined by key, so each may be of any size.

    ``iocs`` (ioc_type, value), ``shared`` (host) services that anybody uses, ``official`` (registrable), ``lookalikes``
    (registrable, confidence, kind), ``graph`` (registrable, score, quality).
    """

    iocs: DataFrame
    shared: DataFrame
    official: DataFrame
    lookalikes: DataFrame
    graph: DataFrame


#: Findings that count as strong by their kind, and confidence from which others do beside an alarming text.
STRONG_KINDS, STRONG_CONFIDENCE = ("homograph", "substitution", "subdomain_spoof"), 0.84
#: Characters from which a text is scored.
LEAST_CHARS = 12


def scored_links(messages: DataFrame, known: Known) -> DataFrame:
    """(id, url, registrable, rules, trusted, url_score, match, ti, graph, brand, strong) of each link of the messages (id, text, html)."""
    links = E.message_links(messages)
    p = U.parse(F.col("url"))
    links = links.select("*", *[c.alias(f"p_{n}") for n, c in p.items()])
    p = {n: F.col(f"p_{n}") for n in p}
    features = U.lexical_features(p)
    links = links.select("*", *[c.alias(f"f_{n}") for n, c in features.items()])
    features = {n: F.col(f"f_{n}") for n in features}
    official = known.official.select("registrable").distinct().withColumn("__official", F.lit(True))
    brands = known.lookalikes.groupBy("registrable").agg(F.max(F.struct("confidence", "kind")).alias("__b"))
    near = known.graph.filter("quality <> 'limited'").groupBy("registrable").agg(F.max("score").alias("graph"))
    rated = links.join(official, "registrable", "left").join(brands, "registrable", "left").join(near, "registrable", "left")
    rated = match_iocs(rated, known.iocs, known.shared)
    finding = F.when(F.col("__b").isNotNull(), F.struct(F.col("__b.kind").alias("kind"), F.col("__b.confidence").alias("confidence")))
    rules = E.all_link_rules(p, features, brand=finding, deceptive=F.col("deceptive"), wrapped=F.array_contains("sources", "unwrapped"))
    rated = rated.withColumn("hits", U.rule_hits(rules))
    user = E.user_content(F.col("p_host"))
    trusted = F.coalesce(E.trusted_link(F.col("__official"), F.lit(False), F.col("p_host"), F.col("hits")), F.lit(False))
    concrete = F.size(F.filter("hits", lambda h: ~(user & (h["id"] == "free_hosting")))) > 0
    score = F.round(U.url_score(F.col("hits"), None, user & ~concrete, trusted, concrete), 1)
    found = F.when(F.col("match") != "none", F.col("risk") * F.col("confidence"))
    return rated.select(
        "id", "url", "registrable", F.transform("hits", lambda h: h["id"]).alias("rules"), trusted.alias("trusted"), score.alias("url_score"), "match", found.alias("ti"), "graph",
        (100 * F.col("__b.confidence")).alias("brand"), F.col("__b.kind").isin(*STRONG_KINDS).alias("strong"), (F.col("__b.confidence") >= STRONG_CONFIDENCE).alias("sure"),
    )


def _one_each(messages: DataFrame) -> DataFrame:
    """(id, text, html, meta): of the rows of one id the first. Ids are counted before; where none stands twice, texts and pages stay where they are."""
    if messages.groupBy("id").count().filter("count > 1").isEmpty():
        return messages.select("id", "text", "html", "meta")
    return messages.groupBy("id").agg(F.min(F.struct("text", "html", "meta")).alias("m")).select("id", "m.*")


def verdicts(messages: DataFrame, known: Known) -> DataFrame:
    """(id, nlp, url, ti, graph, brand, meta, families, final, decision, intents, n_links, evasion) of each message (id, text, html, meta).

    ``meta`` is the score of its sender and files (``sources.messages.sender_score``), or null. What a source can't tell is null and
    its weight goes to the others. Nulls in text and html are empty; rows of one id are one message whose text and page are those of the first.
    """
    one = _one_each(messages)
    parts = page_parts(F.col("html"))
    said = one.withColumn("page", parts).withColumn("said", F.concat_ws("\n", "text", "page.text"))
    clean, zero_width = X.strip_zero_width(F.coalesce("said", F.lit("")))
    said = said.withColumn("zero_width", zero_width).withColumn("hits", X.intent_hits(clean))
    enough = F.length(F.trim("said")) >= LEAST_CHARS
    told = said.select(
        "id", "meta", F.when(enough, F.round(100 * X.intent_score(F.col("hits")), 1)).alias("nlp"), F.array_sort(F.transform("hits", lambda h: h["id"])).alias("intents"),
        ((F.length("page.hidden") > 0) | (F.col("zero_width") > 0)).alias("evasion"), (F.col("page.passwords") > 0).alias("asks_password"),
    )
    links = scored_links(one, known).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_links"), F.max("url_score").alias("url"), F.max("ti").alias("ti"), F.max("graph").alias("graph"), F.max("brand").alias("brand"), F.bool_or("strong").alias("strong"), F.bool_or("sure").alias("sure"),
        F.bool_and("trusted").alias("trusted"), F.bool_or(F.size("rules") > 0).alias("ruled"), F.bool_or(F.col("match") == "url").alias("listed"),
    )
    all_ = told.join(links, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    c = F.col
    all_ = all_.withColumn("brand", F.when(c("n_links") > 0, F.coalesce("brand", F.lit(0.0))))
    families = evidence_families({
        "text": (c("nlp") >= 40) & (F.size("intents") > 0), "link": (c("url") >= 50) & c("ruled"), "brand": c("brand") >= 60, "sender": c("meta") >= 40, "intel": c("ti") >= 50, "graph": c("graph") >= 40,
    })
    all_ = all_.withColumn("families", families)
    fused = S.fuse({n: c(n) for n in ("nlp", "url", "ti", "graph", "brand", "meta")})
    strong = no("strong") | (no("sure") & F.coalesce(c("nlp") >= 60, F.lit(False)))
    final = S.override(fused, c("nlp"), c("meta"), no("listed"), strong, no("trusted"), no("evasion"), c("families"), F.lit(False), F.lit(False))
    out = all_.withColumn("final", F.round(final, 1))
    return out.select("id", "nlp", "url", "ti", "graph", "brand", "meta", "families", "final", S.decision(c("final")).alias("decision"), "intents", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), no("evasion").alias("evasion"))


def verdict_writer(known: Known, path: str):
    """A foreachBatch function that writes the verdicts of each micro-batch: a message needs no other one, so a batch is a stream's own plan.

    A micro-batch that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        verdicts(batch, known).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
