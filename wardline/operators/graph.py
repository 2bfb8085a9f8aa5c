"""A property graph as two tables: merges, neighbourhoods, specificity, paths, shared infrastructure, scores.

Nodes are (id, type, risk, malicious, ...), edges (src, dst, rel, ...); ids are type:key.
Loops are bounded by their depth and cut lineage by writing each step once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import refdata
from wardline.spread import parts_of, spread_join
from wardline.steps import Scratch

#: Neighbours from which a node is a hub: reached, but not walked through.
HUB = 150
#: Edges of which a task makes a forest at once.
CHUNK = 1_000_000
#: Types of nodes up to which they are listed.
TYPES = 1000


def merge_nodes(rows: DataFrame, latest: tuple[str, ...] = ()) -> DataFrame:
    """Nodes by id: greatest risk, malicious if any was, first and last time seen, and the last value seen of the properties ``latest``."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_seen"))).alias(c) for c in latest]
    return rows.groupBy("id").agg(F.max("risk").alias("risk"), F.bool_or("malicious").alias("malicious"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *last)


def merge_edges(rows: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    """Edges by ends and relation: counts add up, greatest confidence, first and last time seen, and the first value seen of the properties ``first``."""
    early = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("first_seen"))).alias(c) for c in first]
    return rows.groupBy("src", "dst", "rel").agg(
        F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *early
    )


def marked(nodes: DataFrame, bad: DataFrame) -> DataFrame:
    """Nodes with those of ``bad`` (id) marked malicious at risk 95 or more: a confirmed verdict."""
    on = nodes.join(bad.select("id").distinct().withColumn("__on", F.lit(True)), "id", "left")
    return on.withColumn("risk", F.when(F.col("__on"), F.greatest("risk", F.lit(95.0))).otherwise(F.col("risk"))).withColumn("malicious", F.col("malicious") | F.coalesce("__on", F.lit(False))).drop("__on")


def recent_nodes(nodes: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    """The ``limit`` nodes of a type seen last; ties go by id."""
    return nodes.filter(F.substring_index("id", ":", 1) == kind).orderBy(F.desc("last_seen"), "id").limit(limit)


def pruned_paths(paths: DataFrame, shared: DataFrame, most: int = 8, parts: int | None = None) -> DataFrame:
    """(seed, bad, hops, spec, rank): paths that shared infrastructure (a, b) doesn't explain already, the best ``most`` of each seed; ``parts`` tasks do it."""
    parts = parts or parts_of(paths)
    known = shared.select(F.col("a").alias("seed"), F.col("b").alias("bad")).repartition(parts, "seed", "bad")
    left = paths.join(known, ["seed", "bad"], "left_anti").repartition(parts, "seed")
    order = Window.partitionBy("seed").orderBy("hops", F.desc("spec"), "bad")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def feed_graph(iocs: DataFrame, official: DataFrame, brands: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of listed links (url, host, registrable, source, ts), without official hosts (host).

    A link is hosted on its domain and listed by its feed; ``brands`` (host, brand) makes a domain imitate a
    brand. Domains of platforms lead to their platform. ``limit`` keeps the latest links.
    """
    rows = iocs.join(official.select("host").distinct(), "host", "left_anti")
    if limit is not None:
        rows = rows.orderBy(F.desc("ts"), "url").limit(limit)
    url, domain = F.concat(F.lit("url:"), F.substring(F.sha2("url", 256), 1, 20)), F.concat(F.lit("domain:"), "host")
    platform = F.get(F.filter(F.array(*map(F.lit, refdata.FREE_HOSTING)), lambda p: F.col("host").endswith(F.concat(F.lit("."), p))), F.lit(0))
    made = [
        rows.select(url.alias("src"), domain.alias("dst"), F.lit("HOSTED_ON").alias("rel"), "ts"), rows.select(url.alias("src"), F.concat(F.lit("feed:"), "source").alias("dst"), F.lit("LISTED_BY").alias("rel"), "ts"),
        rows.join(brands.select("host", "brand").distinct(), "host").select(domain.alias("src"), F.concat(F.lit("brand:"), "brand").alias("dst"), F.lit("IMITATES").alias("rel"), "ts"),
        rows.filter(platform.isNotNull()).select(domain.alias("src"), F.concat(F.lit("platform:"), platform).alias("dst"), F.lit("ON_PLATFORM").alias("rel"), "ts"),
    ]
    both = reduce(DataFrame.unionByName, made)
    edges = merge_edges(both.select("src", "dst", "rel", F.lit(1).cast("long").alias("count"), F.lit(0.9).alias("confidence"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")))
    bad = F.col("id").startswith("url:")
    ends = both.selectExpr("explode(array(src, dst)) as id", "ts")
    return merge_nodes(ends.select("id", F.when(bad, 90.0).otherwise(0.0).alias("risk"), bad.alias("malicious"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))), edges


def entity_edges(messages: DataFrame) -> DataFrame:
    """(src, dst, rel, …) of what messages (id, brands, campaign, ts) and their domains (host, ips, ns) lead to: brands, campaigns, addresses, name servers."""
    email = F.concat(F.lit("email:"), F.col("id").cast("string"))
    one = lambda src, kind, values, rel: messages.select(src.alias("src"), F.explode(values).alias("v"), "ts").select("src", F.concat(F.lit(f"{kind}:"), "v").alias("dst"), F.lit(rel).alias("rel"), "ts")
    host = F.concat(F.lit("domain:"), "host")
    made = [one(email, "brand", F.col("brands"), "CLAIMS"), one(email, "campaign", F.array("campaign"), "PART_OF"), one(host, "ip", F.col("ips"), "RESOLVES_TO"), one(host, "ns", F.col("ns"), "USES_NS")]
    rows = reduce(DataFrame.unionByName, made).filter("src is not null and dst is not null")
    return merge_edges(rows.select("src", "dst", "rel", F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("confidence"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")))


def reset_risk(nodes: DataFrame, cleared: DataFrame) -> DataFrame:
    """Nodes with the risk of ``cleared`` (id) set to 0: a verdict of false positive beats every earlier maximum."""
    off = cleared.select("id").distinct().withColumn("__off", F.lit(True))
    joined = nodes.join(off, "id", "left")
    return joined.withColumn("risk", F.when(F.col("__off"), 0.0).otherwise(F.col("risk"))).withColumn("malicious", F.when(F.col("__off"), False).otherwise(F.col("malicious"))).drop("__off")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, rel): each edge both ways."""
    return edges.selectExpr("src as a", "dst as b", "rel").unionAll(edges.selectExpr("dst as a", "src as b", "rel"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at a node, parallel ones counted."""
    return undirected(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(id, neighbours): distinct nodes beside a node."""
    return undirected(edges).select("a", "b").distinct().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))


def khop(edges: DataFrame, seeds: DataFrame, depth: int, hub: int = HUB, closed_types: tuple[str, ...] = ("feed",), limit: int | None = None) -> DataFrame:
    """(id, hops) of the nodes within ``depth`` steps of any seed (id).

    Hubs and nodes of a closed type are reached but not walked through, unless they are seeds. With a ``limit`` the
    nearest so many nodes are given, ties by id, and no layer is walked beyond the one in which it is reached.
    Each layer is a written table; layers are counted by their sums, never in one task.
    """
    scratch = Scratch(edges.sparkSession)
    kept = scratch.keep(edges.select("src", "dst", "rel"))
    both = undirected(kept).select("a", "b")
    seen = scratch.keep(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    front, total = seen.select("id"), seen.count() if limit is not None else 0
    for k in range(1, depth + 1):
        if limit is not None and total >= limit:
            break
        near = scratch.keep(both.join(front, both["a"] == front["id"]).select("a", "b").distinct())
        if k > 1:  # all neighbours of what is walked from are here, so hubs are counted among them
            near = near.join(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= hub), "a", "left_semi")
        new = near.select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        more = scratch.keep(new.withColumn("hops", F.lit(k)))
        seen, total = seen.unionAll(more), total + (more.count() if limit is not None else 0)
        front = more.select("id").filter(~F.substring_index("id", ":", 1).isin(*closed_types))
    if limit is None:
        return seen
    return seen.orderBy("hops", "id").limit(limit)


def two_hops(edges: DataFrame, kind: str, hub: int = HUB) -> DataFrame:
    """(id, near, hops): what lies within two steps of each node of a type; hubs are reached, not walked through, which bounds what a node leads to."""
    scratch = Scratch(edges.sparkSession)
    both = undirected(edges).select("a", "b")
    one = scratch.keep(both.filter(F.substring_index("a", ":", 1) == kind).select(F.col("a").alias("id"), F.col("b").alias("near")).distinct())
    types = [r[0] for r in one.select(F.substring_index("near", ":", 1).alias("t")).distinct().limit(TYPES + 1).collect()]
    if len(types) <= TYPES:  # a stated list, else all rows are looked at
        both = both.filter(F.substring_index("a", ":", 1).isin(*types))
    middle = one.select(F.col("near").alias("a")).distinct()
    counted = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    maybe = scratch.keep(counted.join(middle, "a", "left_semi"))  # parallel edges count here, so hubs are counted exactly below
    many = maybe.filter(F.col("n") > hub).select("a")
    few = both.join(many, "a", "left_semi").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= hub).select("a")
    walked = maybe.filter(F.col("n") <= hub).select("a").unionAll(few)
    first = one.join(walked, one["near"] == walked["a"], "left_semi")
    two = first.join(both, first["near"] == both["a"]).select("id", F.col("b").alias("near")).filter("near <> id")
    return one.withColumn("hops", F.lit(1)).unionAll(two.withColumn("hops", F.lit(2))).groupBy("id", "near").agg(F.min("hops").alias("hops"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def damping(degree: Column) -> Column:
    return F.when(degree > 4, 1 / F.log2(1 + degree)).otherwise(F.lit(1.0))


def specificity(kind: Column, key: Column, degree: Column, asn: Column | None = None) -> Column:
    """What sharing a node means: 1 if it is rare, near 0 if everybody has it."""
    shared = F.lit(False) if asn is None else F.coalesce(asn.isin(*refdata.SHARED_ASNS), F.lit(False))
    base = (
        F.when(kind == "ip", F.when(shared, 0.15).otherwise(0.9)).when(kind == "ns", 0.7).when(kind == "cert", 0.95)
        .when(kind == "asn", F.when(key.isin(*refdata.SHARED_ASNS), 0.02).otherwise(0.25)).otherwise(0.3)
    )
    return base * damping(degree)


def bad_paths(edges: DataFrame, spec: DataFrame, seeds: DataFrame, bad: DataFrame, depth: int = 3, least: float = 0.3) -> DataFrame:
    """(seed, bad, hops, spec): the best path from each seed to each bad node within ``depth`` steps.

    A path is worth the least specificity (id, spec) of its inner nodes, 1 without any;
    those below ``least`` are dropped on the way. Of several, the shortest, then the most specific one counts.
    """
    scratch = Scratch(edges.sparkSession)
    spec = scratch.keep(spec.select("id", "spec"))
    dull = spec.filter(~F.coalesce(F.least(F.col("spec"), F.lit(1.0)) >= least, F.lit(True))).select(F.col("id").alias("a"))
    barred = dull.join(seeds.select(F.col("id").alias("a")), "a", "left_anti")
    # what no path goes on from is left out once, before any step
    both = scratch.keep(undirected(edges).select("a", "b").join(barred, "a", "left_anti"))
    targets = bad.select("id").distinct().withColumn("__bad", F.lit(True))
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), F.lit(1.0).alias("spec"))
    seen = front.select("seed", "at")
    found = None
    for k in range(1, depth + 1):
        step = front.join(both, F.col("at") == F.col("a")).select("seed", F.col("b").alias("at"), "spec").groupBy("seed", "at").agg(F.max("spec").alias("spec"))
        step = scratch.keep(step.join(seen, ["seed", "at"], "left_anti"))
        seen = seen.unionAll(step.select("seed", "at"))
        hits = step.join(targets.withColumnRenamed("id", "at"), "at").select("seed", F.col("at").alias("bad"), F.lit(k).alias("hops"), "spec")
        found = hits if found is None else found.unionAll(hits)
        inner = spec.select(F.col("id").alias("at"), F.col("spec").alias("own"))
        front = step.join(inner, "at", "left").withColumn("spec", F.least("spec", F.coalesce("own", F.lit(1.0)))).filter(F.col("spec") >= least).select("seed", "at", "spec")
    best = Window.partitionBy("seed", "bad").orderBy("hops", F.desc("spec"))
    return found.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def bad_proximity(paths: DataFrame) -> DataFrame:
    """(seed, proximity) of paths (seed, hops, spec): specificity over distance, summed, halved and capped at 1."""
    return paths.groupBy("seed").agg(F.least(F.lit(1.0), F.sum(F.col("spec") / F.col("hops")) / 2).alias("proximity"))


def shared_infrastructure(edges: DataFrame, rels: tuple[str, ...], least: float = 0.3, base: float = 0.9) -> DataFrame:
    """(a, b, n, overlap): pairs of sources that share targets specific enough; overlap adds up and is capped.

    Targets are filtered by specificity before the join, which bounds their degree, so no
    hub makes all pairs of its sources.
    """
    parts = parts_of(edges)
    own = edges.filter(F.col("rel").isin(*rels)).select("src", "dst", "rel").repartition(parts, "dst", "rel").distinct()
    degree = own.groupBy("dst", "rel").agg(F.count(F.lit(1)).alias("degree"))
    rare = degree.withColumn("spec", base * damping(F.col("degree"))).filter(F.col("spec") >= least - 1e-9)
    kept = own.join(rare, ["dst", "rel"])
    a, b = kept.select(F.col("src").alias("a"), "dst", "rel", "spec"), kept.select(F.col("src").alias("b"), "dst", "rel")
    pairs = a.join(b, ["dst", "rel"]).filter("a < b").repartition(parts, "a", "b")
    once = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.sum("spec") / 1.5).alias("overlap"))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select(ends.alias("e"), "n", "overlap").select("e.a", "e.b", "n", "overlap")


def graph_score(components: dict[str, Column]) -> Column:
    """100 times the weighted sum of the parts."""
    total = F.lit(0.0)
    for name, weight in refdata.GRAPH_WEIGHTS:
        total = total + weight * components.get(name, F.lit(0.0))
    return total * 100


def _forest(pairs: DataFrame) -> DataFrame:
    """(id, root): for each run of CHUNK pairs (a, b, ha, hb) of a task its nodes with the one of their component in that run whose hash is least."""

    def roots(table: pa.Table) -> pa.RecordBatch:
        n = len(table)
        coded = pa.chunked_array([*table["a"].chunks, *table["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
        ids, codes = coded.dictionary, np.asarray(coded.indices)
        hashes = np.empty(len(ids), np.int64)
        hashes[codes[:n]], hashes[codes[n:]] = table["ha"].to_numpy(), table["hb"].to_numpy()
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        a, b = rank[codes[:n]], rank[codes[n:]]
        low = np.arange(len(ids))
        while True:
            x, y = low[a], low[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(order)), ids.take(pa.array(order[low]))], ["id", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= CHUNK:
                yield roots(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield roots(pa.Table.from_batches(held))

    return pairs.mapInArrow(run, "id string, root string")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node reaches.

    Each task first makes a forest of every CHUNK of its edges. A node with several roots keeps the least by hash, and
    its other roots are linked with that one: these links are the next, smaller graph, until there are none. Going back,
    each node gets the root of its root. A node is dealt once a round, with one row a chunk however many edges it has;
    joins on a component that holds a third of all nodes deal its rows over several tasks.
    """
    scratch = Scratch(edges.sparkSession)
    text = lambda c: F.col(c).cast("string")
    kind = edges.schema["src"].dataType
    pairs = edges.select(F.coalesce(text("src"), text("dst")).alias("a"), F.coalesce(text("dst"), text("src")).alias("b")).filter("a is not null")
    nothing = edges.filter("src is null or dst is null").select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast(kind).alias("component")).limit(1)
    levels, links = [], None
    while links is None or not links.isEmpty():
        hashed = lambda c: F.xxhash64(c, F.lit(len(levels)))
        local = _forest(pairs.select("a", "b", hashed("a").alias("ha"), hashed("b").alias("hb")))
        ranked = Window.partitionBy("id").orderBy("h", "root")
        kept = scratch.keep(local.withColumn("h", hashed("root")).withColumns({"low": F.first("root").over(ranked), "first": F.row_number().over(ranked) == 1}).drop("h"))
        levels.append(kept)
        links = scratch.keep(kept.filter("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
        pairs = links
    up = None
    for level in reversed(levels):
        own = level.filter("first").select("id", F.col("low").alias("root"))
        if up is not None:
            next_ = up.select(F.col("id").alias("root"), F.col("root").alias("__top"))
            own = spread_join(own, next_, ["root"], ["id"], "left").select("id", F.coalesce("__top", "root").alias("root"))
        up = scratch.keep(own)
    ids = up.withColumn("id", F.col("id").cast(kind))
    best = scratch.keep(ids.groupBy("root").agg(F.min("id").alias("component")))
    return spread_join(ids, best, ["root"], ["id"]).select("id", "component").unionAll(nothing)


def anchored_components(edges: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """Components that hold a node of an anchor type; others are what a removal has left over."""
    labels = components(edges)
    kept = labels.filter(F.substring_index("id", ":", 1).isin(*anchors)).select("component").distinct()
    return labels.join(kept, "component", "left_semi")


def message_graph(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of messages (id, sender, sender_domain, urls (url, host, registrable), attachments (sha256), ts, risk)."""
    m = messages.withColumn("email", F.concat(F.lit("email:"), F.col("id").cast("string")))
    base = ["ts", "risk"]
    sent = m.select("email", F.concat(F.lit("sender:"), "sender").alias("dst"), F.lit("SENT_BY").alias("rel"), *base)
    domain = m.select(F.concat(F.lit("sender:"), "sender").alias("email"), F.concat(F.lit("domain:"), "sender_domain").alias("dst"), F.lit("SENDER_DOMAIN").alias("rel"), *base)
    link = m.select("email", F.explode("urls").alias("u"), *base)
    url_id = F.concat(F.lit("url:"), F.substring(F.sha2("u.url", 256), 1, 20))
    contains = link.select("email", url_id.alias("dst"), F.lit("CONTAINS").alias("rel"), *base)
    hosted = link.select(url_id.alias("email"), F.concat(F.lit("domain:"), "u.host").alias("dst"), F.lit("HOSTED_ON").alias("rel"), *base)
    sub = link.filter("u.host <> u.registrable").select(F.concat(F.lit("domain:"), "u.host").alias("email"), F.concat(F.lit("domain:"), "u.registrable").alias("dst"), F.lit("SUBDOMAIN_OF").alias("rel"), *base)
    files = m.select("email", F.explode("attachments").alias("f"), *base).select("email", F.concat(F.lit("attachment:"), "f.sha256").alias("dst"), F.lit("HAS_ATTACHMENT").alias("rel"), *base)
    rows = sent
    for more in (domain, contains, hosted, sub, files):
        rows = rows.unionByName(more)
    rows = rows.filter("email is not null and dst is not null").withColumnRenamed("email", "src")
    edges = merge_edges(rows.select("src", "dst", "rel", F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("confidence"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")))
    ends = rows.selectExpr("explode(array(src, dst)) as id", "risk", "ts")
    risk = F.when(F.col("id").startswith("email:"), F.col("risk")).otherwise(0.0)
    return merge_nodes(ends.select("id", risk.alias("risk"), F.lit(False).alias("malicious"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))), edges
