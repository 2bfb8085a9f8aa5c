"""What shows on larger tables only: long links, many groups, keys that are everywhere."""

from __future__ import annotations

from compare import DATA, lines
from pyspark.sql import functions as F

from wardline import spread
from wardline.functions import obfuscation as O
from wardline.operators import brands as B
from wardline.operators import graph as G
from wardline.plans import catalogue


def test_long_hidden_links_are_whole(spark, duck, tmp_path):
    urls = [f"https://host.example/{'p' * k}" for k in (5, 36, 37, 60, 93, 94, 400)]
    spark.createDataFrame([(4 * k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = catalogue.ORACLES["base64_hidden_links"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("base64_hidden_links", "base64_hidden_links_whole"):
        got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert lines(got, ["page_id", "link"], ["page_id", "link"]) == lines(duck.execute(sql).fetchall(), ["page_id", "link"], ["page_id", "link"])


def test_a_hidden_link_ends_with_its_line(spark):
    text = F.concat(F.base64(F.lit(b"http://a.example/bcd")), F.lit("\nnext line"))
    assert spark.range(1).select(O.base64_links(text)).first()[0] == ["http://a.example/bcd"]


def test_components_over_many_small_forests(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 7)  # forests of seven edges: several rounds of links between roots
    path = [(f"n{k * 37 % 101}", f"n{(k + 1) * 37 % 101}", "R") for k in range(100)]
    rows = [*path, *[("hub", f"leaf{k}", "R") for k in range(200)], ("self", "self", "R"), ("leaf3", "leaf3", "R"), ("half", None, "R"), ("leaf5", "m", "R")]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(rows, "src string, dst string, rel string").repartition(5)).collect()}
    expected = {f"n{k}": "n0" for k in range(101)} | {f"leaf{k}": "hub" for k in range(200)} | {"hub": "hub", "m": "hub", "self": "self", "half": "half", None: None}
    assert got == expected


def test_claims_shuffle_no_runs(spark):
    texts = spark.createDataFrame([(1, "Buy ACME-Corp now, acme corp of x"), (2, "corp acme"), (3, None), (4, ""), (5, "a b c d e")], "id long, text string")
    keywords = spark.createDataFrame([("A", "acme corp"), ("C", "Corp!"), ("L", "a b c d"), ("M", "a b c d e"), ("B", "a"), ("B", "b"), ("N", "--")], "brand string, keyword string")
    df = B.claims(texts, keywords, most=None)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "A", 1), (1, "C", 2), (2, "C", 0), (5, "B", 0), (5, "L", 0)]
    assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_groups_are_dealt_over_as_many_tasks_as_rows_demand(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 10)
    rows = spark.range(300).select((F.col("id") % 6).alias("src"), F.floor(F.col("id") / 5).alias("dst"), F.lit("R").alias("rel"))
    assert spread.parts_of(rows) == 30
    shared = G.shared_infrastructure(rows, ("R",))
    assert shared.rdd.getNumPartitions() >= 30
    held = {}
    for r in rows.distinct().collect():
        held.setdefault(r["dst"], set()).add(r["src"])
    expected = {}
    for srcs in held.values():
        for a in srcs:
            for b in srcs - {a}:
                expected[a, b] = expected.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in shared.collect()} == expected


def test_walks_write_no_more_than_they_walk(spark):
    rows = [("customer:1", "order:1", "P"), ("order:1", "part:1", "H"), ("order:1", "part:1", "H")] + [("order:1", f"part:{k}", "H") for k in range(2, 61)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string")
    got = G.two_hops(edges, "customer", hub=61).collect()  # 62 edges, but 61 neighbours: no hub
    assert len(got) == 61 and G.two_hops(edges, "customer", hub=60).count() == 1
    df = G.khop(edges, spark.createDataFrame([("customer:1",)], "id string"), 2, hub=61)
    assert df.count() == 62
