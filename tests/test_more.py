"""Operators that only a few rows are needed for."""

import datetime as dt

from pyspark.sql import functions as F

from wardline import ml
from wardline.functions import obfuscation, scores
from wardline.operators import brands, campaigns, corpus, feedback, graph, lookalike
from wardline.sources import feeds, messages

T0 = dt.datetime(2024, 1, 1)


def test_entities_become_edges(spark):
    rows = spark.createDataFrame([(1, ["X"], "C-1", "h.example", ["192.0.2.1"], ["ns.example"], T0), (2, None, None, "h.example", None, ["ns.example"], T0)], "id int, brands array<string>, campaign string, host string, ips array<string>, ns array<string>, ts timestamp")
    got = {(r["src"], r["dst"], r["rel"]): r["count"] for r in graph.entity_edges(rows).collect()}
    assert got == {("email:1", "brand:X", "CLAIMS"): 1, ("email:1", "campaign:C-1", "PART_OF"): 1, ("domain:h.example", "ip:192.0.2.1", "RESOLVES_TO"): 1, ("domain:h.example", "ns:ns.example", "USES_NS"): 2}


def test_marks_and_first_properties(spark):
    nodes = spark.createDataFrame([("a", 10.0, False), ("b", 99.0, False)], "id string, risk double, malicious boolean")
    got = {r["id"]: (r["risk"], r["malicious"]) for r in graph.marked(nodes, nodes.filter("id = 'a'")).collect()}
    assert got == {"a": (95.0, True), "b": (99.0, False)}
    edges = spark.createDataFrame([("a", "b", "R", 1, 0.5, T0, T0, None), ("a", "b", "R", 1, 0.4, T0 + dt.timedelta(1), T0 + dt.timedelta(1), "second")], "src string, dst string, rel string, count long, confidence double, first_seen timestamp, last_seen timestamp, note string")
    r = graph.merge_edges(edges, first=("note",)).first()
    assert (r["count"], r["confidence"], r["note"]) == (2, 0.5, "second")
    assert graph.induced(edges, spark.createDataFrame([("a",)], "id string")).count() == 0 and graph.induced(edges, spark.createDataFrame([("a",), ("b",)], "id string")).count() == 2


def test_message_graph(spark):
    kind = "id int, sender string, sender_domain string, urls array<struct<url:string,host:string,registrable:string>>, attachments array<struct<sha256:string>>, ts timestamp, risk double"
    rows = spark.createDataFrame([(1, "a@b.example", "b.example", [("https://x.y.example/", "x.y.example", "y.example")], [("ff",)], T0, 50.0)], kind)
    nodes, edges = graph.message_graph(rows)
    assert {r["rel"] for r in edges.collect()} == {"SENT_BY", "SENDER_DOMAIN", "CONTAINS", "HOSTED_ON", "SUBDOMAIN_OF", "HAS_ATTACHMENT"}
    assert {r["id"]: r["risk"] for r in nodes.collect()}["email:1"] == 50.0


def test_campaign_blocks_and_assignment(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, 0.5]) for k in range(40)], "id int, v array<double>")
    known = spark.createDataFrame([(f"c{k}", [float(k), 1.0, 0.5]) for k in range(7)], "label string, centre array<double>")
    whole = {r["id"]: (r["best"], r["similarity"]) for r in campaigns.best_campaign(rows, known, "id", "v", "label").collect()}
    monkeypatch.setattr(campaigns, "MAX_CAMPAIGNS", 2)
    assert {r["id"]: (r["best"], r["similarity"]) for r in campaigns.best_campaign(rows, known, "id", "v", "label").collect()} == whole
    assert whole[8] == ("c1", 1.0)
    told = spark.createDataFrame([("c", 0.6, 10.0), ("c", 0.5, 70.0), (None, None, 10.0)], "m string, s double, risk double")
    assert [r[0] for r in told.select(campaigns.assign(F.col("m"), F.col("s"), F.col("risk"))).collect()] == ["joined", "founded", "none"]


def test_best_targets_and_guard(spark):
    pairs = spark.createDataFrame([("paypa1", "paypal", 1, 5), ("paypa1", "paypai", 1, 2), ("x", "y", 2, 1)], "name string, target string, distance int, priority int")
    got = {r["name"]: r["target"] for r in lookalike.best_target(pairs, [F.col("distance"), F.col("priority")]).collect()}
    assert got == {"paypa1": "paypai", "x": "y"}
    claimed = spark.createDataFrame([(1, "PayPal"), (2, "PayPal")], "id int, brand string")
    links = spark.createDataFrame([(1, "evil.example", None), (1, "www.paypal.com", "PayPal"), (2, "paypal.github.io", "PayPal")], "id int, host string, official string")
    senders = spark.createDataFrame([(1, None, False), (2, "PayPal", False)], "id int, official string, failed boolean")
    assert [(r["id"], r["hosts"]) for r in brands.guard(claimed, links, senders).collect()] == [(1, ["evil.example"])]


def test_feedback_and_corpora(spark):
    kind = "url_hash string, first_seen int, last_seen int, times_seen long, risk double"
    both = feedback.merge_sightings(spark.createDataFrame([("a", 2, 5, 3, 10.0)], kind), spark.createDataFrame([("a", 1, 9, 1, 40.0), ("b", 1, 1, 1, 0.0)], kind))
    assert {r["url_hash"]: tuple(r)[1:] for r in both.collect()} == {"a": (1, 9, 4, 40.0), "b": (1, 1, 1, 0.0)}
    assert feedback.without_demo(spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, demo boolean")).count() == 2
    rows = spark.createDataFrame([(1, "same", 1), (2, "same", 1), (3, "other", 0)], "id int, text string, label int")
    assert sorted(r["id"] for r in corpus.deduplicate(rows.withColumn("key", F.md5("text")), "key", "id").collect()) == [1, 3]
    joined = messages.with_enrichment(spark.createDataFrame([("h",), ("i",)], "host string"), spark.createDataFrame([("h", 3)], "host string, age_days int"))
    assert {r["host"]: r["age_days"] for r in joined.collect()} == {"h": 3, "i": None}


def test_small_functions(spark):
    one = spark.createDataFrame([("f r e e  m o n e y now", 0.5, 0.4)], "t string, m double, i double")
    assert one.select(obfuscation.join_spaced(F.col("t"))).first()[0] == "free  money now"
    assert one.select(F.round(scores.text_score(F.col("m"), F.col("i"), F.lit(True)), 6)).first()[0] == 0.65
    assert one.select(F.round(scores.text_score(F.col("m"), F.col("i"), F.lit(False)), 6)).first()[0] == 0.3
    assert spark.createDataFrame([("xn--pypal-4ve.com",)], "h string").select(obfuscation.to_unicode(F.col("h"))).first()[0].startswith("p")


def test_removed_indicators_stay_removed(spark):
    feed = spark.createDataFrame([("url", "a"), ("url", "b"), ("domain", "a")], "ioc_type string, value string")
    kept = feeds.without_removed(feed, spark.createDataFrame([("url", "a")], "ioc_type string, value string"))
    assert sorted(map(tuple, kept.collect())) == [("domain", "a"), ("url", "b")]


def test_blended_models(spark):
    a, b = spark.createDataFrame([(1, 0.2), (2, 0.8)], "id int, p double"), spark.createDataFrame([(1, 0.6), (2, None)], "id int, p double")
    assert {r["id"]: round(r["p"], 6) for r in ml.blend([a, b], "id", [3.0, 1.0]).collect()} == {1: 0.3, 2: 0.8}
