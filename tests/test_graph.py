"""Graph operators on small graphs."""

from pyspark.sql import functions as F

from wardline.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, rel string")


def test_hubs_are_reached_but_not_walked_through(spark):
    rows = [("domain:a", "ip:1", "R")] + [(f"domain:{k}", "ip:1", "R") for k in range(200)] + [("domain:a", "feed:x", "L"), ("feed:x", "domain:far", "L")]
    got = {r["id"]: r["hops"] for r in G.khop(edges(spark, rows), spark.createDataFrame([("domain:a",)], "id string"), 3).collect()}
    assert got == {"domain:a": 0, "ip:1": 1, "feed:x": 1}


def test_bad_path_keeps_the_weakest_link(spark):
    rows = [("domain:a", "ip:1", "R"), ("domain:bad", "ip:1", "R"), ("domain:a", "ip:2", "R"), ("domain:worse", "ip:2", "R")]
    spec = spark.createDataFrame([("ip:1", 0.9), ("ip:2", 0.1)], "id string, spec double")
    bad = spark.createDataFrame([("domain:bad",), ("domain:worse",)], "id string")
    got = G.bad_paths(edges(spark, rows), spec, spark.createDataFrame([("domain:a",)], "id string"), bad).collect()
    assert [(r["bad"], r["hops"], r["spec"]) for r in got] == [("domain:bad", 2, 0.9)]


def test_shared_networks_mean_little(spark):
    df = spark.createDataFrame([("ip", "x", "AS13335", 1), ("ip", "x", "AS64500", 1), ("asn", "AS13335", None, 1), ("cert", "x", None, 7)], "kind string, key string, asn string, degree int")
    got = [r[0] for r in df.select(G.specificity(F.col("kind"), F.col("key"), F.col("degree"), F.col("asn"))).collect()]
    assert got[:3] == [0.15, 0.9, 0.02] and abs(got[3] - 0.95 / 3) < 1e-9


def test_components_and_anchors(spark):
    rows = [("email:1", "url:1", "C"), ("url:1", "domain:1", "H"), ("domain:8", "ip:8", "R"), ("ip:8", "domain:9", "R"), ("ip:5", "ip:5", "S")]
    got = {r["id"]: r["component"] for r in G.components(edges(spark, rows)).collect()}
    assert got["email:1"] == got["url:1"] == got["domain:1"] == "domain:1" and got["ip:8"] == got["domain:9"] == "domain:8" and got["ip:5"] == "ip:5"
    assert {r["id"] for r in G.anchored_components(edges(spark, rows), ("email",)).collect()} == {"email:1", "url:1", "domain:1"}


def test_false_positive_beats_every_maximum(spark):
    nodes = spark.createDataFrame([("a", 95.0, True, None, None), ("a", 10.0, False, None, None), ("b", 50.0, False, None, None)], "id string, risk double, malicious boolean, first_seen timestamp, last_seen timestamp")
    merged = G.merge_nodes(nodes)
    assert {r["id"]: (r["risk"], r["malicious"]) for r in merged.collect()} == {"a": (95.0, True), "b": (50.0, False)}
    cleared = G.reset_risk(merged, spark.createDataFrame([("a",)], "id string"))
    assert {r["id"]: (r["risk"], r["malicious"]) for r in cleared.collect()} == {"a": (0.0, False), "b": (50.0, False)}


def test_messages_become_nodes_and_edges(spark):
    m = spark.sql(
        "select 1 id, 'x@a.com' sender, 'a.com' sender_domain, array(named_struct('url', 'http://w.b.com/', 'host', 'w.b.com', 'registrable', 'b.com')) urls, "
        "array(named_struct('sha256', 'ff')) attachments, timestamp'2024-01-01' ts, 80.0D risk"
    )
    nodes, e = G.message_graph(m)
    assert {r["rel"] for r in e.collect()} == {"SENT_BY", "SENDER_DOMAIN", "CONTAINS", "HOSTED_ON", "SUBDOMAIN_OF", "HAS_ATTACHMENT"}
    assert {r["id"]: r["risk"] for r in nodes.collect()}["email:1"] == 80.0
