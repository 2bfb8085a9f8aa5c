"""Golden values of the scalar functions and the fusion."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import scores as S
from wardline.functions import text as X
from wardline.functions import urls as U
from wardline.operators import campaigns as C
from wardline.operators import intel as I
from wardline.operators import lookalike as L


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_registrable_domains(spark):
    hosts = ["a.b.c.example.co.uk", "foo.github.io", "x.y.web.app", "example.com", "github.io", "198.51.100.7", "localhost"]
    assert values(spark, U.registrable(F.col("x")), hosts) == ["example.co.uk", "foo.github.io", "y.web.app", "example.com", "github.io", "198.51.100.7", "localhost"]
    rules = spark.createDataFrame([(s,) for s in ("com", "co.uk", "github.io", "web.app", "app", "io", "uk")], "suffix string")
    got = U.registrable_join(spark.createDataFrame([(h,) for h in hosts], "host string"), rules)
    assert {r["host"]: r["registrable"] for r in got.collect()}["a.b.c.example.co.uk"] == "example.co.uk"


def test_parse_url(spark):
    p = {n: values(spark, c, ["HTTP://User@WWW.Example.COM:8080/a/b?x=1#frag", "example.org", "http://bad:99999/", None]) for n, c in U.parse(F.col("x")).items()}
    assert [p[n][0] for n in ("scheme", "userinfo", "host", "port", "path", "query", "fragment")] == ["http", "User", "www.example.com", 8080, "/a/b", "x=1", "frag"]
    assert p["normalized"][1] == "http://example.org/" and p["host"][2] is None and p["host"][3] is None


def test_features_of_an_address_with_port(spark):
    f = U.lexical_features(U.parse(F.col("x")))
    row = spark.createDataFrame([("http://198.51.100.7:8080/login.php?redirect=x",)], "x string").select(*f.values()).first()
    assert (row["is_ip"], row["has_port"], row["n_susp_params"], row["n_keywords"], row["has_file_ext"]) == (1, 1, 1, 1, 1)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz019.-", max_size=12), min_size=40, max_size=40))
def test_entropy_equals_its_definition(words):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    expect = [-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) if w else 0.0 for w in words]
    assert values(spark, U.entropy(F.col("x")), words) == pytest.approx(expect)


def test_blocked_targets(spark):
    hosts = ["127.0.0.1", "10.1.2.3", "192.168.0.9", "169.254.169.254", "0x7f000001", "2130706433", "localhost", "a.internal", "metadata.google.internal", "8.8.8.8", "example.com"]
    assert values(spark, U.blocked_target(F.col("x")), hosts) == [True] * 9 + [False] * 2


def test_personal_links_share_only_their_host(spark):
    p = U.parse(F.col("x"))
    kind, value = U.shareable(p, p["normalized"])
    got = spark.createDataFrame([("https://notes.example.net/open?mail=kim@post.example",), ("https://notes.example.net/b",), ("http://10.0.0.1/",)], "x string").select(kind.alias("k"), value.alias("v")).collect()
    assert [tuple(r) for r in got] == [("domain", "notes.example.net"), ("url", "https://notes.example.net/b"), (None, None)]


def test_skeletons(spark):
    assert values(spark, X.skeleton(F.col("x")), ["g00gle", "google", "goggle", "paypa1", "paypal", "rnicrosoft", "microsoft"]) == ["google", "google", "goggle", "paypal", "paypal", "microsoft", "microsoft"]


def test_lookalikes(spark):
    names = spark.createDataFrame([(n,) for n in ("googel", "gogle", "paypa1", "gitbuh", "netflix")], "name string")
    known = spark.createDataFrame([(n,) for n in ("google", "paypal", "github", "netflix")], "name string")
    assert {tuple(r)[:2] for r in L.by_typo(names, known).collect()} == {("googel", "google"), ("gogle", "google"), ("paypa1", "paypal")}
    assert {tuple(r) for r in L.by_skeleton(names, known).collect()} == {("paypa1", "paypal")}
    assert {tuple(r)[:2] for r in L.by_anagram(names, known).collect()} == {("googel", "google"), ("gitbuh", "github")}


def test_spoofed_subdomain_and_official_root(spark):
    hosts = spark.createDataFrame([("www.bank.com.evil.test",), ("bank.com",), ("a.bank.com",)], "host string")
    protected = spark.createDataFrame([("bank.com",)], "domain string")
    assert [tuple(r) for r in L.spoofed_subdomains(hosts, protected).collect()] == [("www.bank.com.evil.test", "bank.com", 2, 2)]
    roots = protected.withColumnRenamed("domain", "root")
    assert {r["host"] for r in I.official_root(hosts, roots).collect()} == {"bank.com", "a.bank.com"}


def test_shared_services_never_match_as_domains(spark):
    iocs = spark.createDataFrame([("domain", "github.io"), ("domain", "bad.github.io")], "ioc_type string, value string")
    links = spark.createDataFrame([("http://bad.github.io/", "bad.github.io", "bad.github.io"), ("http://good.github.io/", "good.github.io", "github.io")], "url string, host string, registrable string")
    shared = spark.createDataFrame([("github.io",)], "host string")
    assert {r["host"]: r["match"] for r in I.match_iocs(links, iocs, shared).collect()} == {"bad.github.io": "host", "good.github.io": "none"}


def test_text_repairs(spark):
    assert values(spark, X.refang(F.col("x")), ["hxxps://a[.]b(dot)c[/]d"]) == ["https://a.b.c/d"]
    assert values(spark, X.repair_mixed_words(F.col("x")), ["pаypal привет"]) == ["paypal привет"]
    assert values(spark, X.strip_zero_width(F.col("x"))[1], ["a​b", "ab", ""]) == [1, 0, 0]
    assert values(spark, X.attachment_kind(F.col("x")), ["a.pdf.exe", "a.exe", "a.zip", "readme", "exe"]) == ["double", "risky", "archive", "plain", "plain"]


def test_intents(spark):
    hits = values(spark, F.transform(X.intent_hits(F.col("x")), lambda h: h["id"]), ["Urgent: verify your account, dear customer", "hello", None])
    assert hits[0] == ["urgency", "credential_request", "generic_greeting"] and hits[1] == []


def ladder(spark, **kw):
    base = dict(nlp=None, url=None, ti=None, graph=None, brand=None, meta=None)
    flags = dict(hard_bad=False, strong_brand=False, trusted=False, evasion=False, families=2, verified=False, guard=False)
    lit = lambda v: F.lit(v).cast("double")
    scores = {n: lit(kw.get(n, v)) for n, v in base.items()}
    f = {n: F.lit(kw.get(n, v)) for n, v in flags.items()}
    fused = S.fuse(scores)
    final = S.override(fused, scores["nlp"], scores["meta"], f["hard_bad"], f["strong_brand"], f["trusted"], f["evasion"], f["families"], f["verified"], f["guard"])
    row = spark.range(1).select(final.alias("final"), S.decision(final).alias("decision")).first()
    return row["final"], row["decision"]


def test_fusion_ladder(spark):
    assert ladder(spark, nlp=90, url=90) == (pytest.approx(90.0, abs=0.01), "BLOCK")
    final, decision = ladder(spark, nlp=95, meta=0, families=0)
    assert final <= 40 and decision == "FLAG"
    assert ladder(spark, ti=95, hard_bad=True)[0] >= 92
    assert ladder(spark, nlp=40, strong_brand=True)[0] == 85
    assert ladder(spark, nlp=80, url=80, trusted=True)[0] == 45
    assert ladder(spark, nlp=50, url=50, verified=True)[0] == pytest.approx(30, abs=0.01)
    assert ladder(spark, nlp=1, guard=True, verified=True) == (35.0, "FLAG")
    assert ladder(spark)[1] == "ALLOW"


def test_decision_bounds_are_inclusive(spark):
    assert values(spark, S.decision(F.col("x")), [29.9, 30.0, 60.0, 85.0], "x double") == ["ALLOW", "FLAG", "QUARANTINE", "BLOCK"]


def test_campaign_similarity_without_embeddings(spark):
    one = F.lit(1.0)
    row = spark.range(1).select(C.similarity(F.lit(None).cast("double"), one, one, one).alias("a"), C.similarity(F.lit(None).cast("double"), one, one, one, True).alias("b")).first()
    assert row["a"] == pytest.approx(0.5) and row["b"] == pytest.approx(1.0)


def test_reflow_and_chrome(spark):
    lines = F.array(F.lit("12:30"), F.lit("Your parcel"), F.lit("is on hold"), F.lit("Reply"))
    assert spark.range(1).select(X.reflow(X.drop_chrome(lines))).first()[0] == "Your parcel is on hold"
