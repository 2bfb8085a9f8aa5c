"""Message sources and sender signals."""

from pyspark.sql import functions as F

from wardline.sources import messages as M

RAW = b"""From: "PayPal" <Service@PayPal-Secure.test>
To: a@b.example, C <c@d.example>
Reply-To: x@other.test
Return-Path: <bounce@paypal-secure.test>
Subject: Your account
Message-ID: <1@x>
Received: by a
Received: by b
Authentication-Results: mx; spf=softfail; DKIM=pass
Authentication-Results: mx2; dmarc=fail
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain; charset=utf-8

hello
--B
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

AAEC
--B--
"""


def test_raw_message(spark):
    df = M.parse_raw(spark.createDataFrame([("p", bytearray(RAW)), ("q", None), ("r", bytearray(b"\xff\xfe broken"))], "path string, content binary"))
    r = {x["path"]: x for x in df.collect()}
    m = r["p"]
    assert (m["sender"], m["sender_name"], m["sender_domain"], m["reply_to"], m["received_hops"]) == ("service@paypal-secure.test", "PayPal", "paypal-secure.test", "x@other.test", 2)
    assert m["recipients"] == ["a@b.example", "c@d.example"] and m["text"].strip() == "hello"
    assert (m["spf"], m["dkim"], m["dmarc"]) == ("softfail", "pass", "fail")
    assert m["attachments"][0]["size"] == 3 and m["attachments"][0]["filename"] == "invoice.pdf.exe"
    assert set(r) == {"p", "q", "r"}
    claimed = df.filter("path = 'p'").withColumn("name_brand", F.lit("PayPal"))
    signals = claimed.select(M.sender_signals(claimed).alias("s")).first()["s"]
    assert [s["id"] for s in signals] == ["display_name_spoof", "reply_to_mismatch", "dmarc_fail", "spf_fail", "double_extension"]
    score = df.filter("path = 'p'").select(M.sender_score(M.sender_signals(df))).first()[0]
    assert score == round(100 * (1 - 0.7 * 0.6 * 0.89 * 0.5), 1)
    trusted = claimed.withColumns({"official": F.lit("PayPal"), "dmarc": F.lit("pass"), "spf": F.lit("pass")})
    assert trusted.select(M.sender_trust(trusted)).first()[0] and not claimed.withColumn("official", F.lit("PayPal")).select(M.sender_trust(claimed.withColumn("official", F.lit("PayPal")))).first()[0]


def test_json_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"subject": "s", "sender": "A@B.example", "body": "", "html": "<p>Hi &amp; bye</p>"}\n')
    r = M.read_json(spark, str(tmp_path / "m.json")).first()
    assert (r["sender_domain"], r["text"], r["channel"]) == ("b.example", "Hi & bye", "email")


def test_provider_answers(spark):
    rows = [("virustotal", "a", 200, 5, 0, 60, 5, None, None), ("abuseipdb", "b", 200, None, None, None, None, 90, None), ("urlhaus", "c", 200, None, None, None, None, None, True), ("urlhaus", "d", 500, None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, "source string, indicator string, http_status int, malicious int, suspicious int, harmless int, undetected int, abuse_score int, listed boolean")
    assert {r["indicator"]: r["verdict"] for r in M.provider_verdicts(df).collect()} == {"a": "malicious", "b": "malicious", "c": "malicious", "d": "unavailable"}
