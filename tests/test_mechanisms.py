"""Phrases, pages, vectors, times, mail folders and verdicts against plain Python."""

import base64
import datetime as dt
import html.parser
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from compare import DATA
from pyspark.sql import functions as F

from wardline.functions import extract as E
from wardline.functions import lexicon, obfuscation, phrases, tagstream
from wardline.functions import text as X
from wardline.operators import analytics, campaigns, vectors, verdicts
from wardline.plans import mechanisms
from wardline.sources import mailbox

T0 = dt.datetime(2024, 1, 1)


def test_phrases_are_where_their_words_are():
    assert phrases.places("Kindly  VERIFY,\nyour account! 24 hours", ("verify your account", "0 hours", "count")) == [(8, 28, 0), (30, 38, 1)]
    assert phrases.places("vеrify y0ur acc0unt", ("verify your account",), folded=True) == [(0, 19, 0)]
    assert phrases.places("", ("a",)) == [] and phrases.places("a", ()) == [] and phrases.places("ab a", ("a",)) == [(3, 4, 0)]
    assert phrases.places("துண்டிக்கப்படும். x", ("துண்டிக்கப்படும்",)) == [(0, len("துண்டிக்கப்படும்"), 0)]


def test_lexicon_is_words_only():
    assert len(lexicon.INTENTS) == 20 and set(lexicon.WEIGHTS) == {n for n, _, _ in lexicon.INTENTS}
    assert all(phrases.spelled(p).strip() == p for _, _, several in lexicon.INTENTS for p in several)


def test_intents_of_three_languages(spark):
    texts = ["Dear customer your KYC is expired. Share OTP to our officer or account will be blocked today.", "உங்கள் மின் இணைப்பு இன்று துண்டிக்கப்படும். உடனடியாக அழைக்கவும்", "Hi team, lunch is at 1pm on Friday at the canteen. See you there.", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").select("id", X.intent_hits(F.col("text")).alias("h"), X.intent_spans(F.col("text")).alias("s")).orderBy("id").collect()
    assert {"identity_verification", "otp_request", "fear"} <= {h["id"] for h in rows[0]["h"]} and all(h["evidence"] for h in rows[0]["h"])
    assert {"utility_disconnection", "urgency"} <= {h["id"] for h in rows[1]["h"]} and rows[2]["h"] == [] and rows[3]["h"] is None
    assert all(texts[0][s["start"] : s["end"]].lower().split() == s["phrase"].split() for s in rows[0]["s"])


def test_spaced_letters():
    assert obfuscation.unspaced("get f-r-e-e-d o m today, a b c") == "get freedom today, a b c"
    assert obfuscation.unspaced("v.e.r.i.f.y now") == "verify now" and obfuscation.unspaced("a b c d") == "a b c d" and obfuscation.unspaced("xa b c d e") == "xa b c d e"
    assert obfuscation.unspaced("w o r d s word") == "words word"


class Reference(html.parser.HTMLParser):
    """Text of a page by the standard library's parser: what isn't hidden."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in tagstream.LINES:
            self.out.append("\n")
        if tag not in tagstream.VOID:
            own = {}
            for k, v in attrs:
                own.setdefault(k, v or "")
            self.stack.append((tag, tagstream.unseen(tag, own) or tag in tagstream.WITHOUT_TEXT))

    def handle_startendtag(self, tag, attrs):
        if tag in tagstream.LINES:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in tagstream.LINES:
            self.out.append("\n")
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.out.append(data)

    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.out).split("\n")) if x)


def test_pages_read_as_the_standard_library_does(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    pages += ["<p>a &amp; b &#8364; &nbsp;c<p>d", "<div style='Display : none'>x<div>y</div></div>z", "<ul><li>1<li>2</ul>t", "<a title='a>b'>in</a>", "text only", "<b>open", "<!-- c -->d<!doctype html>e", "<div hidden><p>n</p></div><p style=\"color:red\">s</p>"]
    for page in pages:
        p = Reference()
        p.feed(page)
        p.close()
        assert tagstream.read(page)["text"] == p.text()


def test_hidden_text_forms_and_fields(spark):
    page = "<p>Hi</p><div style='display:none'>cricket <b>weather</b></div><span style='font-size:0px'>tiny</span><form action=' /in '><input type=password><input name=u><input type=hidden value=h><button>Log &lt;in</button><input type=submit value=Go></form><script>if(a<b){}</script>"
    got = tagstream.read(page)
    assert got["text"] == "Hi\nLog <in" and got["hidden"].split() == ["cricket", "weather", "tiny"]
    assert (got["forms"], got["passwords"], got["fields"], got["buttons"], got["actions"]) == (1, 1, 2, ["Log <in", "Go"], ["/in"])
    assert tagstream.read(None)["text"] == "" and tagstream.read("<div")["text"] == "<div"
    rows = spark.createDataFrame([(page,), (None,)], "h string").select(tagstream.page_parts(F.col("h")).alias("p")).collect()
    assert [r["p"]["passwords"] for r in rows] == [1, 0]


def test_index_finds_nearly_all_nearest_centres(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    centres = mechanisms._groups(spark, DATA)
    exact = {r["vec_id"]: r["best"] for r in campaigns.best_campaign(rows, centres, "vec_id", "embedding", "campaign").collect()}
    got = {r["vec_id"]: r["best"] for r in vectors.indexed_best(rows, centres, "vec_id", "embedding", "campaign").collect()}
    assert set(got) == set(exact) and np.mean([got[k] == v for k, v in exact.items()]) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 64), (3, [1.0])], "vec_id int, embedding array<float>")
    assert len(vectors.indexed_best(odd, centres, "vec_id", "embedding", "campaign").collect()) == 3
    assert vectors.latest(spark.createDataFrame([(k, k % 5) for k in range(9)], "c int, t int"), "t", "c", 2).count() == 2


def test_near_in_time_counts_pairs(spark):
    rng = random.Random(2)
    own = [(k, rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(2000))) for k in range(80)]
    others = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(2000))) for _ in range(60)] + [("a", own[0][2] + dt.timedelta(days=7)), ("a", None)]
    got = vectors.near_in_time(spark.createDataFrame(own, "id int, k string, t timestamp"), spark.createDataFrame(others, "k string, t timestamp"), "k", "t", 7).collect()
    want = {i: sum(k is not None and k == ok and ot is not None and abs((ot - t).total_seconds()) <= 7 * 86400 for ok, ot in others) for i, k, t in own}
    assert {r["id"]: r["n_near"] for r in got} == want


def test_auc_of_many_distinct_scores(spark):
    rows = spark.range(200_000).select(F.rand(3).alias("score"), "id").select("score", (F.rand(5) < F.col("score")).cast("int").alias("label"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pdf = rows.toPandas()
        label = pdf["label"].to_numpy()[np.argsort(pdf["score"].to_numpy())]
        exact = (np.cumsum(1 - label) * label).sum() / (label.sum() * (len(label) - label.sum()))
        assert [round(analytics.roc_auc(rows, F.col("score"), F.col("label")).first()[0], 12) for _ in range(2)] == [round(exact, 12)] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_mail_comes_once(spark, tmp_path):
    box = tmp_path / "mail"
    box.mkdir()
    one = "From: a@x.example\nSubject: {}\n\nbody {}\n"
    (box / "1.eml").write_text(one.format("first", 1))
    (box / "2.mbox").write_text("From a@x Mon\n" + one.format("second", 2) + "\nFrom b@x Tue\n" + one.format("third", "3\n>From here"))
    (box / "notes.txt").write_text("no mail")
    assert sorted(r["subject"] for r in mailbox.read_mail(spark, str(box)).collect()) == ["first", "second", "third"]

    def run():
        stream = mailbox.read_mail(spark, str(box), stream=True).select("path", "subject", "text")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        q = spark.streams.active[-1]
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    (box / "4.eml").write_text(one.format("fourth", 4))
    run()  # starts again where it stopped
    got = [r["subject"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["first", "fourth", "second", "third"]
    assert mailbox.split_mbox(b"") == [] and mailbox.split_mbox(b"From x\na\n\nFrom y\n>From z\n") == [b"a\n\n", b"From z\n"]


@pytest.fixture(scope="module")
def known(spark):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    return verdicts.Known(
        table([("url", "https://listed.example.com/x")], "ioc_type string, value string"), table([], "host string"), table([("paypal.com",)], "registrable string"),
        table([("paypa1.com", 0.9, "substitution")], "registrable string, confidence double, kind string"), table([("dark.org", 80.0, "good"), ("thin.org", 90.0, "limited")], "registrable string, score double, quality string"),
    )


MESSAGES = [
    (1, "Hi team, lunch is at 1pm on Friday at the canteen.", None, None),
    (2, "URGENT: verify your account within 24 hours, share the OTP", '<a href="https://paypa1.com/login">log in</a>', None),
    (3, "see https://listed.example.com/x", None, None), (4, "go to https://www.paypal.com/signin", None, 0.0), (5, "read https://a.dark.org/ and https://thin.org/", None, None),
    (6, None, "<div style='display:none'>secret words here</div><p>Please verify your account right away, your card is blocked</p>", 50.0), (7, None, None, None), (8, "", "", None),
]


def test_one_verdict_over_all_engines(spark, tmp_path, known):
    rows = spark.createDataFrame(MESSAGES, "id long, text string, html string, meta double")
    got = {r["id"]: r for r in verdicts.verdicts(rows, known).collect()}
    assert got[1]["decision"] == "ALLOW" and got[1]["url"] is None and got[1]["families"] == 0
    assert got[2]["decision"] == "BLOCK" and got[2]["brand"] == 90.0 and {"urgency", "credential_request", "otp_request"} <= set(got[2]["intents"])
    assert got[3]["final"] >= 92 and got[3]["ti"] == pytest.approx(90.25)
    assert got[4]["decision"] == "ALLOW" and got[5]["graph"] == 80.0 and got[5]["n_links"] == 2
    assert got[6]["evasion"] and got[6]["families"] == 2 and got[7]["final"] == 0.0 and got[8]["nlp"] is None
    # a stream of micro-batches writes the same rows
    for k in range(2):
        rows.filter(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(verdicts.verdict_writer(known, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: (r["final"], r["decision"], r["families"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: (r["final"], r["decision"], r["families"]) for k, r in got.items()}
    assert verdicts.verdicts(rows.filter("false"), known).count() == 0


def test_texts_stay_where_they_are_unless_an_id_repeats(spark, known):
    rows = spark.createDataFrame(MESSAGES, "id long, text string, html string, meta double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(text" not in plan(verdicts.verdicts(rows, known))
    more = rows.unionAll(spark.createDataFrame([(3, "zzz see https://other.example.com/", None, 90.0), (None, "call b", None, None), (None, "call a now, please", None, 50.0)], rows.schema))
    got, alone = ({r["id"]: r for r in verdicts.verdicts(x, known).collect()} for x in (more, rows))
    assert "min(struct(text" in plan(verdicts.verdicts(more, known))
    assert got.pop(None)["meta"] == 50.0 and got == alone


def test_known_links_are_parsed_once(spark):
    have = mechanisms.known(spark, DATA)
    for df in (have.iocs, have.official, have.lookalikes, have.graph):
        assert all("pages.parquet" not in f for f in df.inputFiles()) and df.inputFiles()
    listed = spark.read.parquet(f"{DATA}/pages.parquet").filter("page_id % 7 = 0")
    assert have.iocs.count() == listed.count()


def test_like_pages_of_a_batch_are_read_once(monkeypatch):
    pages = ["<p>a</p>", None, "<form><input type=password></form>", "<p>a</p>", "", None, "<p>a</p>"]
    want = [tagstream.read(p) for p in pages]
    read, calls = tagstream.read, []
    monkeypatch.setattr(tagstream, "read", lambda p: calls.append(p) or read(p))
    assert tagstream.read_batch(pa.array(pages, pa.string())).to_pylist() == want and len(calls) == 4
    assert len(tagstream.read_batch(pa.array([], pa.string()))) == 0


def test_spelling_of_every_sign():
    word, number = regex.compile(r"[\p{L}\p{M}\p{N}]"), regex.compile(r"(?<![^ ])[0-9]+(?![^ ])")
    signs = phrases._spelling()
    assert all(signs[k] == (k + 32 if 65 <= k <= 90 else k if word.match(chr(k)) else 32) for k in range(0x110000))
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("aZ09 1\n_.-\u0b95\u0bcd\u00e9\u0301\u0661\u200b\u3000\U0001f600\U00020000") for _ in range(rng.randrange(14)))
        assert phrases.spelled(text) == f" {number.sub('0', regex.sub(r'[^\p{L}\p{M}\p{N}]+', ' ', text.translate(lower)).strip())} "


def test_texts_are_searched_only_for_what_they_may_hold(spark):
    hidden = base64.b64encode(b"https://hidden.example.com/a").decode()
    texts = ["HTTPS://A.example.com/x", "WwW.b.example.com/y.", "a@www.c.example.com d", "ftp://d.example.com", "http:/ /e www .f", hidden, base64.b64encode(b"HTTP://up.example.com/").decode(), "x" * 40, "", None, "m@n.example.org www.g.example.com", "one:// two"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    unguarded = F.regexp_extract_all(F.regexp_replace(F.coalesce("t", F.lit("")), E._MAIL, " "), F.lit(E._IN_TEXT), F.lit(1))
    found = lambda source: F.transform(F.filter(E.candidates(F.col("t"), F.lit(None).cast("string")), lambda c: c["source"] == source), lambda c: c["raw"])
    rows = {r["id"]: r for r in df.select("id", found("text").alias("got"), unguarded.alias("want"), found("base64").alias("b"), obfuscation.base64_links(F.col("t")).alias("n")).collect()}
    assert all(r["got"] == r["want"] for r in rows.values()) and [k for k, r in rows.items() if r["got"]] == [0, 1, 3, 10]
    assert rows[5]["b"] == ["https://hidden.example.com/a"] and rows[6]["b"] == ["HTTP://up.example.com/"] and rows[9]["n"] is None and rows[7]["n"] == []
    clean, n = X.strip_zero_width(F.col("t"))
    signs = spark.createDataFrame([(f"a{z}b{z}",) for z in X.ZERO_WIDTH] + [("ab",), ("é",), (None,)], "t string")
    assert [tuple(r) for r in signs.select(clean, n).collect()] == [("ab", 2)] * len(X.ZERO_WIDTH) + [("ab", 0), ("é", 0), (None, None)]
    plan = df.select(found("text"), found("base64"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(coalesce(t" in plan and "://" in plan and "aHR0c)" in plan


def test_lines_of_the_frame(spark):
    lines = ["12:45", " 9:05 PM", "87 %", "5G", "Reply all", "MONDAY", "Seen 10:20", "3 of 12", "→", "Messages and calls are end-to-end encrypted. Tap", "Reply to this at once", "pay 5 %", "at 12:45", ""]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").select("k", X.is_frame(F.col("x")).alias("f")).orderBy("k").collect()
    assert [r["f"] for r in got] == [True] * 10 + [False] * 4
