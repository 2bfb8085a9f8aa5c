"""Campaigns: centroids, matching, assignment, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.graph import HUB, khop, neighbour_counts

#: Parts of a campaign's similarity.
SEMANTIC, INFRASTRUCTURE, BRAND, TIME = 0.5, 0.3, 0.1, 0.1
#: Similarity from which a message joins, and risk from which it founds a campaign.
JOIN_AT, FOUND_AT = 0.55, 60.0
#: Campaigns up to which their centroids are broadcast to every message; a stated set, checked.
MAX_CAMPAIGNS = 10_000


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, position, value): mean of each element; sums are partial, so a large campaign is a row a task and element."""
    parts = rows.select(by, F.posexplode(vector).alias("at", "v"))
    return parts.groupBy(by, (F.col("at") + 1).alias("position")).agg(F.avg(F.col("v").cast("double")).alias("value"))


def centroid_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centre): the same as arrays."""
    cells = centroids(rows, by, vector).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("cells"))
    return cells.select(by, F.col("cells.value").alias("centre"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, negative ones as 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def best_campaign(rows: DataFrame, campaigns: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, best, similarity): the nearest of a stated set of campaigns, ties going to the later label.

    Up to MAX_CAMPAIGNS are sent to the messages as one array a task; more are sent in as many blocks
    as it takes, and each message is read once.
    """
    passes = -(-campaigns.count() // MAX_CAMPAIGNS)
    block = F.pmod(F.xxhash64(label), F.lit(max(1, passes)))
    score = lambda c: F.struct(F.round(cosine(F.col(vector), c["centre"]), 6).alias("similarity"), c["label"].alias("best"))
    scored = rows.select(key, vector)
    for k in range(max(1, passes)):  # one pass for each block of campaigns, the best so far beside the message
        together = campaigns.filter(block == k).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre")).alias("all"))
        best = F.array_max(F.transform("all", score))
        scored = scored.join(F.broadcast(together)).withColumn("m", best if k == 0 else F.greatest("m", best)).drop("all")
    return scored.select(key, F.col("m.best").alias("best"), F.col("m.similarity").alias("similarity"))


def set_overlap(rows: DataFrame, nodes: DataFrame, by: str, node: str) -> DataFrame:
    """(by, n_shared, infra): members of each set that ``nodes`` holds too; two make a full overlap."""
    marked = rows.join(nodes.select(node).distinct().withColumn("__in", F.lit(1)), node, "left")
    return marked.groupBy(by).agg(F.count("__in").alias("n_shared")).withColumn("infra", F.least(F.lit(1.0), F.col("n_shared") / 2.0))


def similarity(semantic: Column, infra: Column, brand: Column, recent: Column, renormalise_missing: bool = False) -> Column:
    """Weighted similarity of message and campaign.

    Without embeddings the semantic part is 0 and nothing reaches JOIN_AT;
    ``renormalise_missing`` spreads its weight over the other parts instead.
    """
    rest = INFRASTRUCTURE * infra + BRAND * brand + TIME * recent
    if renormalise_missing:
        return F.when(semantic.isNull(), rest / (INFRASTRUCTURE + BRAND + TIME)).otherwise(SEMANTIC * semantic + rest)
    return SEMANTIC * F.coalesce(semantic, F.lit(0.0)) + rest


def brand_overlap(rows: DataFrame, campaigns: DataFrame, key: str = "id", label: str = "campaign") -> DataFrame:
    """(key, campaign): messages and campaigns, each (…, brand), that name a brand in common."""
    return rows.select(key, "brand").distinct().join(campaigns.select(label, "brand").distinct(), "brand").select(key, label).distinct()


def infrastructure(edges: DataFrame, seeds: DataFrame, depth: int = 5, limit: int = 1500, hub: int = HUB) -> DataFrame:
    """(id, hops) of what a campaign's messages (id) rest on: nodes within ``depth`` steps that are no hubs, the nearest ``limit``."""
    near = khop(edges, seeds, depth, hub)
    hubs = neighbour_counts(edges).filter(F.col("neighbours") > hub).select("id")
    return near.join(hubs, "id", "left_anti").orderBy("hops", "id").limit(limit)


def statistics(edges: DataFrame, seeds: DataFrame, depth: int = 5, hub: int = HUB) -> DataFrame:
    """(type, n): how many nodes of each type lie within ``depth`` steps of a campaign's messages (id)."""
    return khop(edges, seeds, depth, hub).groupBy(F.substring_index("id", ":", 1).alias("type")).agg(F.count_distinct("id").alias("n"))


def number_campaigns(founders: DataFrame, year: int, existing: int, time: str, tie: str) -> DataFrame:
    """Founders with ids that go on after the existing ones; founders are few beside messages."""
    k = F.row_number().over(Window.orderBy(time, tie)) + existing
    return founders.withColumn("campaign", F.format_string("CAMPAIGN-%d-%04d", F.lit(year), k))


def online(messages: DataFrame, key: str = "channel", join_at: float = JOIN_AT, found_at: float = FOUND_AT) -> DataFrame:
    """(key, id, ts, campaign, how, similarity) of messages (key, id, ts, vector, risk), taken one by one in time order (ties: by id).

    A message may join what another one of its batch has founded. Each key is walked through by itself, with the
    latest campaigns as its only state, so a key with very many messages is streamed. ``streaming.stateful.campaign_events`` is the stream.
    """
    from wardline.operators.folds import fold, micros, online_campaigns

    kind, ident = messages.schema[key].dataType.simpleString(), messages.schema["id"].dataType.simpleString()
    timed = messages.select(key, "id", "ts", "vector", "risk", micros(F.col("ts")).alias("us"))
    step = online_campaigns(join_at, found_at, (key, "id", "ts"))
    return fold(timed, [key], ["us", "id"], step, f"{key} {kind}, id {ident}, ts timestamp, campaign {ident}, how string, similarity double")


def assign(matched: Column, similarity_: Column, risk: Column) -> Column:
    """joined, founded or none for each message against the campaigns before its batch.

    All messages of a batch see the same campaigns; one-by-one arrival could let a
    message join a campaign that the batch itself founds.
    """
    return F.when(matched.isNotNull() & (similarity_ >= JOIN_AT), "joined").when(risk >= FOUND_AT, "founded").otherwise("none")
