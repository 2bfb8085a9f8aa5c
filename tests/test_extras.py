"""Obfuscation, brands, feedback, sinks."""

import json

from pyspark.sql import functions as F

from wardline.functions import obfuscation as O
from wardline.operators import brands as B
from wardline.operators import feedback as K
from wardline.sources import sinks


def test_letters(spark):
    df = spark.createDataFrame([("xn--bcher-kva.example", "w i n n e r today a b"), ("xn--!.x", "a b c d"), (None, None)], "h string, t string")
    got = df.select(O.to_unicode("h"), O.join_spaced("t"), O.mixed_script(F.col("h"))).collect()
    assert [r[0] for r in got] == ["bücher.example", "xn--!.x", None]
    assert [r[1] for r in got] == ["winner today a b", "a b c d", None]
    assert spark.createDataFrame([("pаypal.com",), ("paypal.com",)], "h string").select(O.mixed_script(F.col("h"))).collect() == [(True,), (False,)]


def test_defended_links(spark):
    df = spark.createDataFrame([("https://urldefense.com/v3/__https://evil.test/a__;!!x",)], "u string")
    assert df.select(O.unwrap(F.col("u"))).first()[0][-1] == "https://evil.test/a"


def test_guard(spark):
    claimed = spark.createDataFrame([(1, "Google Pay"), (2, "Google"), (3, "PayPal")], "id int, brand string")
    links = spark.createDataFrame([(1, "evil.test", None), (2, "google.com", "Google"), (3, "paypal.github.io", "PayPal"), (3, "paypal.com", "PayPal")], "id int, host string, official string")
    senders = spark.createDataFrame([(1, None, False), (2, None, False), (3, None, True)], "id int, official string, failed boolean")
    got = {r["id"]: r["hosts"] for r in B.guard(claimed, links, senders).collect()}
    assert got == {1: ["evil.test"], 3: ["paypal.github.io"]}
    own = spark.createDataFrame([(1, "Google", False)], "id int, official string, failed boolean")
    assert B.guard(claimed.filter("id = 1"), links, own).isEmpty()


def test_confirmed_indicators(spark):
    links = spark.createDataFrame([(1, "http://a.b.test/", "a.b.test", "b.test", False), (1, "http://c.test/", "c.test", "c.test", False), (1, "http://ok.test/", "ok.test", "ok.test", True), (2, "http://d.test/", "d.test", "d.test", False)], "detection_id int, url string, host string, registrable string, trusted boolean")
    votes = spark.createDataFrame([(1, "unsure", 1), (1, "confirmed_phishing", 2), (2, "confirmed_phishing", 1), (2, "false_positive", 2)], "detection_id int, label string, at int")
    got = {(r["ioc_type"], r["value"]) for r in K.confirmed_iocs(links, votes).collect()}
    assert got == {("url", "http://a.b.test/"), ("url", "http://c.test/"), ("domain", "a.b.test")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, None)], "id string, risk double, label string")
    assert sinks.snapshot({"nodes": df}, str(tmp_path / "s")).first()["rows"] == 1
    sinks.append_json_lines(df, str(tmp_path / "q"))
    sinks.append_json_lines(df, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2
    assert json.loads(sinks.graph_json(df).first()["json"]) == {"id": "a", "risk": 1.0}
