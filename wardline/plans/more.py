"""Queries of link extraction, senders, providers, suffixes, intents, findings, campaigns and graph views.

Where the supplied tables hold nothing of the kind, each of their rows is dealt one of a few written forms, or a form is
filled with what the row holds; the twins state what must come out of each form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import extract as E
from wardline.functions import screens
from wardline.functions import text as X
from wardline.functions import urls as U
from wardline.functions.obfuscation import script_features, to_ascii
from wardline.functions.scores import decision
from wardline.functions.splits import cross_splits
from wardline.operators import analytics as A
from wardline.operators import brands as B
from wardline.operators import campaigns as C
from wardline.operators import feedback as K
from wardline.operators import graph as G
from wardline.operators import intel as I
from wardline.operators import lookalike as L
from wardline.operators import signals as S
from wardline.plans.links import PARSED_SQL, parsed_pages
from wardline.plans.registry import query, table
from wardline.spread import parts_of
from wardline.sources import messages as M
from wardline.streaming import queries as Q


def _sql(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def stated(columns: str, rows: list[tuple]) -> str:
    """SQL of written rows: what a query must give."""
    names = ", ".join(columns.split())
    return f"SELECT {names} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


def dealt(spark: SparkSession, sf: str, name: str, key: str, forms: list[tuple], columns: str) -> DataFrame:
    """(id, columns): each row of a table with one of the written forms, by its key; the forms are a short list."""
    listed_ = spark.createDataFrame([(k, *f) for k, f in enumerate(forms)], f"__k int, {columns}")
    rows = table(spark, sf, name).select(F.expr(key).cast("long").alias("id"))
    return rows.withColumn("__k", F.pmod("id", F.lit(len(forms))).cast("int")).join(F.broadcast(listed_), "__k").drop("__k")


def dealt_sql(name: str, key: str, columns: str, forms: list[tuple]) -> str:
    """SQL of what must come out of each row's form; a form may stand for any number of rows (k, …)."""
    n = max(f[0] for f in forms) + 1 if forms else 1
    return f"SELECT id, {', '.join(columns.split())} FROM (SELECT ({key})::BIGINT AS id FROM {name}) JOIN ({stated('k ' + columns, forms)}) ON id % {n} = k"


_TURN, _TURN_SQL = "conv_id * 1000 + turn", "conv_id * 1000 + turn"

ADDRESSES = [
    ("localhost", True), ("[::1]", True), ("[::]", True), ("[fe80::1]", True), ("[fe80::1%25eth0]", True), ("[febf::9]", True), ("[fec0::1]", False), ("[fc00::1]", True), ("[fdff:ffff::]", True), ("[ff02::1]", True), ("[::ffff:10.0.0.1]", True),
    ("[::ffff:8.8.8.8]", False), ("[2001:4860:4860::8888]", False), ("[1:2:3:4:5:6:7:8]", False), ("[1:2:3]", True), ("[1::2::3]", True), ("10.1.2.3", True), ("8.8.8.8", False), ("0x7f000001", True), ("2130706433", True),
    ("999.1.1.1", True), ("printer.local", True), ("example.org", False), ("metadata", True), ("169.254.169.254", True), ("172.32.0.1", False), ("172.16.0.1", True),
]


_BLOCKS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({int.from_bytes(bytes(map(int, n.split('.'))))}, {int.from_bytes(bytes(map(int, n.split('.')))) + (1 << 32 - b) - 1})" for n, b in refdata.PRIVATE_BLOCKS) + ") AS t(low, high)"


@query(
    f"""WITH e AS (SELECT event_id, event_id % 5 AS form, [event_id * 7 % 256, user_id % 256, event_id % 256, event_id // 256 % 256] AS o FROM events),
i AS (SELECT *, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS n, array_to_string(o, '.') AS ip FROM e), b AS ({_BLOCKS_SQL}),
h AS (SELECT event_id, form, n, CASE form WHEN 0 THEN ip WHEN 1 THEN '[::ffff:' || ip || ']' WHEN 2 THEN n::VARCHAR WHEN 3 THEN 'h' || event_id || '.local' ELSE 'h' || event_id || '.example.org' END AS host FROM i)
SELECT event_id AS id, host, CASE form WHEN 2 THEN length(n::VARCHAR) >= 8 WHEN 3 THEN true WHEN 4 THEN false ELSE EXISTS (SELECT 1 FROM b WHERE n BETWEEN low AND high) END AS blocked FROM h
UNION ALL {dealt_sql("customer", "c_custkey", "host blocked", [(k, *x) for k, x in enumerate(ADDRESSES)])}"""
)
def ssrf_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses made of events' numbers, plain, mapped and as one number, private and public names, and written disguises, against the guard."""
    n, user = F.col("event_id"), F.col("user_id")
    parts = [n * 7 % 256, user % 256, n % 256, F.floor(n / 256) % 256]
    ip = F.concat_ws(".", *[p.cast("long").cast("string") for p in parts])
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    form, text = n % 5, n.cast("string")
    host = F.when(form == 0, ip).when(form == 1, F.concat(F.lit("[::ffff:"), ip, F.lit("]"))).when(form == 2, number.cast("long").cast("string")).when(form == 3, F.concat(F.lit("h"), text, F.lit(".local"))).otherwise(F.concat(F.lit("h"), text, F.lit(".example.org")))
    made = table(spark, sf, "events").select(n.alias("id"), host.alias("host"))
    written = dealt(spark, sf, "customer", "c_custkey", [(h,) for h, _ in ADDRESSES], "host string")
    return made.unionByName(written).select("id", "host", U.blocked_target(F.col("host")).alias("blocked"))


@query(
    """WITH r AS (SELECT event_id, ['virustotal', 'urlscan', 'abuseipdb', 'otx', 'safe_browsing', 'urlhaus'][(event_id % 6 + 1)::INT] AS source, CASE event_id % 23 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS http_status,
  event_id % 5 AS malicious, event_id % 3 AS suspicious, event_id % 71 AS harmless, event_id % 4 AS scans, (event_id % 8) // 4 AS malicious_scans, event_id % 101 AS abuse_score, event_id % 7 AS pulses, event_id % 2 = 0 AS listed FROM events),
s AS (SELECT *, malicious + suspicious + harmless AS total FROM r),
v AS (SELECT event_id, source, http_status,
  CASE source WHEN 'virustotal' THEN CASE WHEN malicious >= 3 THEN 'malicious' WHEN malicious + suspicious > 0 THEN 'suspicious' ELSE 'clean' END
    WHEN 'urlscan' THEN CASE WHEN malicious_scans > 0 THEN 'malicious' WHEN scans = 0 THEN 'unknown' ELSE 'clean' END
    WHEN 'abuseipdb' THEN CASE WHEN abuse_score >= 75 THEN 'malicious' WHEN abuse_score >= 25 THEN 'suspicious' ELSE 'clean' END
    WHEN 'otx' THEN CASE WHEN pulses >= 3 THEN 'malicious' WHEN pulses > 0 THEN 'suspicious' ELSE 'unknown' END ELSE CASE WHEN listed THEN 'malicious' ELSE 'unknown' END END AS verdict,
  CASE source WHEN 'virustotal' THEN least(100.0, 100.0 * (malicious + 0.5 * suspicious) / greatest(8.0, 0.25 * total)) WHEN 'urlscan' THEN CASE WHEN malicious_scans > 0 THEN 60.0 ELSE 0.0 END
    WHEN 'abuseipdb' THEN abuse_score WHEN 'otx' THEN least(100, 20 * pulses) WHEN 'safe_browsing' THEN CASE WHEN listed THEN 95 ELSE 0 END ELSE CASE WHEN listed THEN 90 ELSE 0 END END::DOUBLE AS risk,
  CASE source WHEN 'virustotal' THEN CASE WHEN total > 20 THEN 0.9 ELSE 0.6 END WHEN 'urlscan' THEN CASE WHEN scans > 0 THEN 0.7 ELSE 0.2 END WHEN 'safe_browsing' THEN CASE WHEN listed THEN 0.95 ELSE 0.3 END
    WHEN 'urlhaus' THEN CASE WHEN listed THEN 0.85 ELSE 0.3 END ELSE 0.6 END::DOUBLE AS confidence FROM s)
SELECT event_id::VARCHAR AS indicator, source, CASE WHEN http_status = 200 THEN verdict WHEN http_status = 404 AND source IN ('virustotal', 'otx') THEN 'unknown' ELSE 'unavailable' END AS verdict,
  round(CASE WHEN http_status = 200 THEN risk WHEN http_status = 404 AND source IN ('virustotal', 'otx') THEN 0.0 END, 1) AS risk,
  CASE WHEN http_status = 200 THEN confidence WHEN http_status = 404 AND source IN ('virustotal', 'otx') THEN 0.2 END::DOUBLE AS confidence FROM v"""
)
def provider_risks(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of six providers made from events."""
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.element_at(F.array(*map(F.lit, ("virustotal", "urlscan", "abuseipdb", "otx", "safe_browsing", "urlhaus"))), (n % 6 + 1).cast("int")).alias("source"), n.cast("string").alias("indicator"),
        F.when(n % 23 == 0, 404).when(n % 23 == 1, 500).otherwise(200).alias("http_status"), (n % 5).alias("malicious"), (n % 3).alias("suspicious"), (n % 71).alias("harmless"), F.lit(0).alias("undetected"),
        (n % 4).alias("scans"), F.floor((n % 8) / 4).alias("malicious_scans"), (n % 101).alias("abuse_score"), (n % 7).alias("pulses"), (n % 2 == 0).alias("listed"),
    )
    return M.provider_verdicts(rows)


@query(
    """WITH m AS (SELECT event_id AS id, ['fail', 'softfail', 'pass', 'permerror', 'none'][(event_id % 5 + 1)::INT] AS dmarc, ['pass', 'fail', 'softfail'][(event_id % 3 + 1)::INT] AS spf, ['permerror', 'pass'][(event_id % 2 + 1)::INT] AS dkim,
  event_id % 7 AS r, event_id % 11 AS p, event_id % 6 AS f, event_id % 4 AS n FROM events),
s AS (SELECT id, 'freemail_institution' AS signal, 0.45 AS w FROM m WHERE n = 0 UNION ALL SELECT id, 'brand_sender_mismatch', 0.15 FROM m WHERE n = 1 UNION ALL SELECT id, 'reply_to_mismatch', 0.3 FROM m WHERE r IN (1, 2)
  UNION ALL SELECT id, 'return_path_mismatch', 0.1 FROM m WHERE p = 1 UNION ALL SELECT id, 'dmarc_fail', CASE dmarc WHEN 'softfail' THEN 0.2 ELSE 0.4 END FROM m WHERE dmarc IN ('fail', 'softfail', 'permerror')
  UNION ALL SELECT id, 'spf_fail', CASE spf WHEN 'softfail' THEN 0.11 ELSE 0.22 END FROM m WHERE spf <> 'pass' UNION ALL SELECT id, 'dkim_fail', 0.2 FROM m WHERE dkim <> 'pass'
  UNION ALL SELECT id, 'double_extension', 0.5 FROM m WHERE f = 0 UNION ALL SELECT id, 'risky_attachment', 0.35 FROM m WHERE f IN (0, 2) UNION ALL SELECT id, 'html_attachment', 0.4 FROM m WHERE f = 1)
SELECT m.id, string_agg(signal, ',' ORDER BY signal) AS signals, round(100 * (1 - coalesce(product(1 - w::DOUBLE), 1.0)), 1) AS score FROM m LEFT JOIN s USING (id) GROUP BY m.id"""
)
def sender_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Senders made from events: every check, addresses of the same and of other domains, claims, attachments."""
    n = F.col("event_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    claim = F.array(F.struct(F.lit("Bank of X").alias("brand"), F.lit("bank").alias("category")))
    file = lambda *names: F.array(*[F.struct(F.lit(x).alias("filename")) for x in names])
    rows = table(spark, sf, "events").select(
        n.alias("id"), F.when(n % 4 == 0, "gmail.com").otherwise("mail.sender.co.uk").alias("sender_domain"), F.lit("x").alias("sender"), pick(["a@sender.co.uk", "b@elsewhere.com", "c@other.co.uk", "d@deep.sub.sender.co.uk", "", "none", "z@sender.co.uk"], 7).alias("reply0"),
        pick(["b@sender.co.uk", "b@bounce.example.com", "b@x.amazonses.com", *["b@sender.co.uk"] * 8], 11).alias("path0"), pick(["fail", "softfail", "pass", "permerror", "none"], 5).alias("dmarc"), pick(["pass", "fail", "softfail"], 3).alias("spf"), pick(["permerror", "pass"], 2).alias("dkim"),
        F.when(n % 6 == 0, file("a.pdf.exe", "b.docm")).when(n % 6 == 1, file("page.html", "notes.txt")).when(n % 6 == 2, file("x.iso")).otherwise(file("y.zip")).alias("attachments"), F.when(n % 4 <= 1, claim).otherwise(F.array().cast("array<struct<brand:string,category:string>>")).alias("claims"),
        F.when(n % 4 == 0, "Free").alias("official"),
    )
    # senders from free mailboxes answer from there, so that their addresses say nothing
    rows = rows.withColumn("reply_to", F.when((n_free := F.col("sender_domain") == "gmail.com") & ~F.col("reply0").isin("b@elsewhere.com", "c@other.co.uk"), "a@gmail.com").otherwise(F.col("reply0")))
    rows = rows.withColumn("return_path", F.when(n_free & ~F.col("path0").isin("b@bounce.example.com", "b@x.amazonses.com"), "b@gmail.com").otherwise(F.col("path0")))
    found = rows.select("id", M.sender_signals(rows).alias("s"))
    return found.select("id", F.nullif(F.array_join(F.array_sort(F.transform("s", lambda x: x["id"])), ","), F.lit("")).alias("signals"), M.sender_score(F.col("s")).alias("score"))


HEADERS = [(1, "AX-HDFCBK", "HDFC Bank"), (2, "VM-SBIINB", "SBI"), (3, "JD-AMAZON-T", None), (4, "ax-icicib", "ICICI"), (5, "+919876543210", None), (6, "AX-AMAZON", "Amazon"), (7, "AX-X", None)]


_TRUSTED = [(0, "HDFC Bank"), (1, "SBI"), (3, "ICICI"), (5, "Amazon")]


@query(f"SELECT id, brand FROM (SELECT event_id AS id FROM events) JOIN ({stated('k brand', _TRUSTED)}) ON id % 7 = k")
def registered_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text messages with registered headers, beside the brands that their texts claim; the third form claims another one."""
    sent = dealt(spark, sf, "events", "event_id", [(s, b if i != 2 else None) for i, s, b in HEADERS], "sender string, brand string")
    other = sent.filter(F.pmod("id", F.lit(7)) == 2).select("id", F.lit("HDFC Bank").alias("brand"))
    words = spark.createDataFrame([("HDFC Bank", "hdfc"), ("SBI", "sbi"), ("Amazon", "amazon"), ("ICICI", "icici")], "brand string, keyword string")
    second = sent.filter(F.pmod("id", F.lit(7)) == 1).select("id", F.lit("SBI").alias("brand"))
    claims = sent.filter("brand is not null").select("id", "brand").unionByName(other).unionByName(second)
    return M.header_trust(sent.select("id", "sender"), words, claims)


RULES = [("com", "exact"), ("net", "exact"), ("org", "exact"), ("example.com", "wildcard"), ("keep.example.com", "exception"), ("example.net", "exact"), ("co.uk", "exact")]


@query(
    f"""WITH {PARSED_SQL}, r AS ({stated("suffix kind", RULES)}), h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM (SELECT host FROM p UNION SELECT 'keep.' || 'example.com' UNION SELECT 'a.b.keep.example.com' UNION SELECT 'x.y.unlisted' UNION SELECT 'co.uk') WHERE host IS NOT NULL),
t AS (SELECT host, l, i, array_to_string(list_slice(l, i, 100), '.') AS suffix, len(l) - i + 1 AS k FROM h, range(1, 20) AS s(i) WHERE i <= len(l)),
m AS (SELECT host, CASE kind WHEN 'exception' THEN 1000 ELSE 0 END + k + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END AS score FROM t JOIN r USING (suffix) WHERE k + CASE kind WHEN 'wildcard' THEN 1 ELSE 0 END <= len(l)),
b AS (SELECT host, max(score) % 1000 AS public FROM m GROUP BY host)
SELECT h.host, array_to_string(list_slice(l, greatest(1, len(l) - coalesce(public, 1)), 100), '.') AS registrable FROM h LEFT JOIN b USING (host)"""
)
def public_suffix_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Registrable domains by exact, wildcard and exception rules."""
    more = spark.createDataFrame([("keep.example.com",), ("a.b.keep.example.com",), ("x.y.unlisted",), ("co.uk",)], "host string")
    hosts = parsed_pages(spark, sf).select("host").filter("host is not null").union(more).distinct()
    return U.registrable_join(hosts, spark.createDataFrame(RULES, "suffix string, kind string"))


@query("SELECT DISTINCT translate(w, 'apyo', 'ару0') || 'ⅿ' AS name, w || 'rn' AS skeleton FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)")
def confusable_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark in look-alike letters, through a table of confusable characters, one of which stands for two letters."""
    points = [("0440", "0070"), ("0430", "0061"), ("0443", "0079"), ("0030", "006F"), ("217F", "0072 006E")]
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return X.skeletons(words.select(F.concat(F.translate("w", "apyo", "ару0"), F.lit("ⅿ")).alias("name")), spark.createDataFrame(points, "source string, target string"))


PAGES = [
    (1, "Pay at https://pay.example.com/x?a=1. Or mail me@example.com, or www.shop.example.org/a).", "<a href='https://evil.example.net/l'>https://www.bank.com/login</a>"),
    (2, None, '<A HREF="https://ok.example.com/?a=1&amp;b=2">see <b>more</b></A><form action=https://post.example.com/in><input formaction="https://alt.example.com/"></form><meta http-equiv="refresh" content="0; url=https://go.example.com/">'),
    (3, "aHR0cHM6Ly9oaWRkZW4uZXhhbXBsZS5jb20vcGF0aA== here", '<a class="btn big" href="https://l.facebook.com/l.php?u=https%3A%2F%2Finner.example.com%2F">Open</a><a href="mailto:x@y.z">m</a><a href="#top">t</a><a href="javascript:alert(1)">j</a>'),
    (4, None, None), (5, "", "<a>no target</a>"), (6, "same https://dup.example.com/ and https://dup.example.com/", "<a href=https://dup.example.com/>dup.example.com</a>"),
]
LINKS = [
    (1, "http://www.shop.example.org/a", "example.org", "text", False), (1, "https://evil.example.net/l", "example.net", "href", True), (1, "https://pay.example.com/x?a=1", "example.com", "text", False),
    (2, "https://alt.example.com/", "example.com", "button", False), (2, "https://go.example.com/", "example.com", "redirect", False), (2, "https://ok.example.com/?a=1&b=2", "example.com", "href", False), (2, "https://post.example.com/in", "example.com", "form", False),
    (3, "https://hidden.example.com/path", "example.com", "base64", False), (3, "https://inner.example.com/", "example.com", "unwrapped", False), (3, "https://l.facebook.com/l.php?u=https://inner.example.com/", "facebook.com", "button", False), (3, "javascript:alert(1", None, "href", False),
    (6, "https://dup.example.com/", "example.com", "href,text", False),
]


@query(dealt_sql("documents", "doc_id", "url registrable sources deceptive", [(i - 1, *x) for i, *x in LINKS]))
def message_link_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as messages of six written forms, their links with all their sources."""
    found = E.message_links(dealt(spark, sf, "documents", "doc_id", [p[1:] for p in PAGES], "text string, html string"))
    return found.select("id", "url", "registrable", F.array_join("sources", ",").alias("sources"), "deceptive")


RATED = [  # url, model, official, established, names a brand, lies, rules, trusted, score
    ("https://www.paypal.com/signin", 0.9, True, False, False, False, "", True, 2.0),
    ("https://user@www.paypal.com/", None, True, False, False, False, "userinfo", False, 40.0),
    ("https://someone.github.io/wells", 0.8, False, True, True, False, "free_hosting,brand_on_user_content", False, round(100 * (1 - 0.82 * 0.38 * (1 - 0.8 * 0.8)), 1)),
    ("https://someone.github.io/page", 0.9, False, True, False, False, "free_hosting", False, round(100 * (1 - 0.82 * (1 - 0.45 * 0.9)), 1)),
    ("https://plain.example.org/", 0.5, False, False, False, False, "", False, round(100 * 0.45 * 0.5, 1)),
    ("https://known.example.org/", 0.5, False, True, False, True, "deceptive_link_text", False, round(100 * (1 - 0.45 * (1 - 0.8 * 0.5)), 1)),
    ("http://198.51.100.7:8080/setup.exe", None, False, False, False, False, "ip_host,port,executable", False, round(100 * (1 - 0.65 * 0.88 * 0.55), 1)),
]


@query(dealt_sql("pages", "page_id", "url rules trusted score", [(k, r[0], *r[6:]) for k, r in enumerate(RATED)]))
def link_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """All link rules with model, trust and user content, over written links dealt to pages."""
    rows = dealt(spark, sf, "pages", "page_id", [r[:6] for r in RATED], "url string, model double, official boolean, established boolean, names boolean, lies boolean")
    p = U.parse(F.col("url"))
    rows = rows.select("*", *[c.alias(f"p_{n}") for n, c in p.items()])
    p = {n: F.col(f"p_{n}") for n in p}
    rows = rows.select("*", *U.lexical_features(p).values())
    features = {n: F.col(n) for n in rows.columns if not n.startswith("p_")}
    hits = U.rule_hits(E.all_link_rules(p, features, named_brand=F.col("names"), deceptive=F.col("lies")))
    rows = rows.withColumn("hits", hits)
    user = E.user_content(F.col("p_host"))
    trusted = E.trusted_link(F.col("official"), F.col("established"), F.col("p_host"), F.col("hits"))
    concrete = F.size(F.filter("hits", lambda h: ~(user & (h["id"] == "free_hosting")))) > 0
    score = U.url_score(F.col("hits"), F.col("model"), user & ~concrete, trusted, concrete)
    return rows.select("id", "url", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("rules"), trusted.alias("trusted"), F.round(score, 1).alias("score"))


INTENT_TEXTS = [
    (1, "URGENT: act now, your account has been suspended", "account_suspension,fear,urgency"), (2, "Please verify your account within 24 hours", "credential_request,urgency"), (3, "Share the OTP with me", "otp_request"),
    (4, "Enter your UPI pin to receive cashback", "upi_collect"), (5, "install AnyDesk", "remote_access"), (6, "Dear Customer, complete KYC", "generic_greeting,identity_verification"),
    (7, "Congratulations! You won a cash prize, claim your reward", "reward_bait"), (8, "Your parcel is on hold, pay the customs fee", "delivery_scam,payment_request"), (9, "part time job, earn 5000 per day", "job_scam"),
    (10, "Your electricity will be disconnected tonight", "fear,utility_disconnection"), (11, "I am in a meeting, buy gift cards and keep this confidential", "executive_impersonation,secrecy"), (12, "Cyber crime police: arrest warrant", "authority_impersonation"),
    (13, "तुरंत ओटीपी भेजें", "otp_request,urgency"), (14, "உடனடியாக பணம் அனுப்ப", "payment_request,urgency"), (15, "overdue invoice: new bank details", "invoice_fraud"), (16, "See the attached invoice", "attachment_lure"),
    (17, "Reset your password", "password_reset"), (18, "The weather is nice", ""), (19, None, ""), (20, "", ""),
]


@query(dealt_sql("conversations", _TURN_SQL, "intents", [(i - 1, x) for i, _, x in INTENT_TEXTS]))
def intents_of_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty intents in three languages, over turns of conversations that say one of twenty written things."""
    rows = dealt(spark, sf, "conversations", _TURN, [(t,) for _, t, _ in INTENT_TEXTS], "text string")
    hits = F.coalesce(X.intent_hits(F.col("text")), F.array().cast("array<struct<id:string,weight:double,evidence:array<string>>>"))
    return rows.select("id", F.array_join(F.array_sort(F.transform(hits, lambda h: h["id"])), ",").alias("intents"))


CONTACTS = [
    (1, "Pay swiggy@icici or me.you@okaxis, mail a@icici.com", "me.you@okaxis,swiggy@icici", "", ""), (2, "Call +91 98765 43210 or 9876543211, toll free 1800 123 4567, not 12345678901", "", "18001234567,9876543210,9876543211", ""),
    (3, "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 and 1BoatSLRHtKNngkdXEeobR76b53LETtpyT, not 1BoatSLRHtKNngkdXEeobR76b53LETtpyT0", "", "", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT,bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"), (4, "nothing", "", "", ""),
]


@query(
    """WITH e AS (SELECT event_id AS id, 'u' || user_id || '@okaxis' AS payment, '9' || lpad((event_id * 7919 % 1000000000)::VARCHAR, 9, '0') AS mobile, '1800' || lpad((event_id % 10000000)::VARCHAR, 7, '0') AS free FROM events)
SELECT id, payment, free || ',' || mobile AS phones, '' AS wallets FROM e UNION ALL """
    + dealt_sql("customer", "c_custkey + 1000000000", "payment phones wallets", [(i - 1, *x) for i, _, *x in CONTACTS])
)
def contact_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Payment addresses and national numbers made of events' numbers, in words; wallets and what is none in written texts."""
    n = F.col("event_id")
    mobile = F.concat(F.lit("9"), F.lpad((n * 7919 % 1_000_000_000).cast("string"), 9, "0"))
    free = F.concat(F.lit("1800"), F.lpad((n % 10_000_000).cast("string"), 7, "0"))
    said = F.concat(F.lit("Pay u"), F.col("user_id").cast("string"), F.lit("@okaxis, call +91 "), F.substring(mobile, 1, 5), F.lit(" "), F.substring(mobile, 6, 5), F.lit(" or 1800-"), F.substring(free, 5, 3), F.lit("-"), F.substring(free, 8, 4), F.lit("."))
    rows = table(spark, sf, "events").select(n.alias("id"), said.alias("text"))
    rows = rows.unionByName(dealt(spark, sf, "customer", "c_custkey + 1000000000", [(t,) for _, t, *_ in CONTACTS], "text string"))
    join = lambda c: F.array_join(c, ",")
    return rows.select("id", join(X.payment_ids(F.col("text"))).alias("payment"), join(X.national_phones(F.col("text"))).alias("phones"), join(X.wallets(F.col("text"))).alias("wallets"))


DEFANGED = [
    ("hxxp://evil[.]com", "http://evil.com"), ("hxxps[://]evil(dot)com/x", "https://evil.com/x"), ("h**p://a[ . ]b", "http://a.b"), ("https(:)//a{.}b[/]c", "https://a.b/c"), ("a [dot] b (.) c", "a.b.c"), ("[:]8080", ":8080"), ("plain. text", "plain. text"),
]


@query("SELECT page_id AS id, url AS refanged FROM pages UNION ALL " + dealt_sql("documents", "doc_id + 1000000000", "refanged", [((k + 6) % 7, r) for k, (_, r) in enumerate(DEFANGED)]))
def refanged_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages written harmless, and other ways to write so, undone."""
    harmless = F.replace(F.regexp_replace("url", "^http", "hxxp"), F.lit("."), F.lit("[.]"))
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("id"), harmless.alias("text"))
    forms = dealt(spark, sf, "documents", "doc_id + 1000000000", [(DEFANGED[(k + 1) % 7][0],) for k in range(7)], "text string")
    return rows.unionByName(forms).select("id", X.refang(F.col("text")).alias("refanged"))


_NAMES = "nm AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,12}')) AS name FROM benchmark)"


@query(f"WITH {_NAMES} SELECT a.name, b.name AS target, damerau_levenshtein(a.name, b.name)::INT AS distance FROM nm a JOIN nm b ON a.name <> b.name AND damerau_levenshtein(a.name, b.name) <= CASE WHEN length(b.name) >= 8 THEN 2 ELSE 1 END")
def lookalike_two_typos(spark: SparkSession, sf: str) -> DataFrame:
    """Names up to two edits from each other."""
    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,12})"), F.lit(1))).alias("name")).distinct()
    return L.by_typos(names, names)


@query(
    r"""WITH k AS (SELECT item_id AS brand, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 3, 3 + item_id % 4), ' ') AS keyword FROM benchmark),
d AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents)
SELECT DISTINCT id, brand FROM d JOIN k ON contains(t, ' ' || keyword || ' ') WHERE keyword <> ''"""
)
def brand_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of one to four words of the benchmark as brands, claimed by documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    n = (F.col("item_id") % 4 + 1).cast("int")
    known = table(spark, sf, "benchmark").select(F.col("item_id").alias("brand"), F.array_join(F.slice(words, F.lit(3), n), " ").alias("keyword"))
    return B.claims(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), known, most=None).select("id", "brand")


@query(
    """WITH i AS (SELECT CASE event_id % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash' ELSE 'url' END AS ioc_type, (user_id % 50)::VARCHAR AS value, 'feed' || (event_id % 2) AS source, event_type <> 'click' AS active FROM events),
a AS (SELECT ioc_type, value, min(source) AS source FROM i WHERE active AND ioc_type <> 'url' GROUP BY 1, 2)
SELECT e.event_id, a.ioc_type, a.source FROM events e JOIN a ON a.value = (e.event_id % 90)::VARCHAR AND a.ioc_type = CASE WHEN e.event_id % 2 = 0 THEN 'ip' ELSE 'hash' END"""
)
def ioc_values(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses and hashes made from events against active indicators made from events."""
    events = table(spark, sf, "events")
    n = F.col("event_id")
    iocs = events.select(F.when(n % 3 == 0, "ip").when(n % 3 == 1, "hash").otherwise("url").alias("ioc_type"), (F.col("user_id") % 50).cast("string").alias("value"), F.concat(F.lit("feed"), (n % 2).cast("string")).alias("source"), (F.col("event_type") != "click").alias("active"))
    seen = events.select("event_id", F.when(n % 2 == 0, "ip").otherwise("hash").alias("ioc_type"), (n % 90).cast("string").alias("value"))
    return I.match_values(seen, I.active(iocs)).select("event_id", "ioc_type", "source")


@query("SELECT ioc_type, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'ip' ELSE 'url' END AS ioc_type, event_type <> 'click' AS active, 'feed' || (event_id % 2) AS source FROM events) WHERE active AND source = 'feed1' GROUP BY 1")
def ioc_active(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    iocs = table(spark, sf, "events").select(F.when(n % 3 == 0, "ip").otherwise("url").alias("ioc_type"), (F.col("event_type") != "click").alias("active"), F.concat(F.lit("feed"), (n % 2).cast("string")).alias("source"))
    return I.active(iocs, "feed1").groupBy("ioc_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PARSED_SQL}, q AS (SELECT page_id, normalized, host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS reg FROM p), listed AS (SELECT DISTINCT normalized FROM q WHERE page_id % 9 = 0), d AS (SELECT DISTINCT reg FROM q WHERE page_id % 9 = 0)
SELECT page_id, CASE WHEN normalized IN (SELECT normalized FROM listed) THEN 'url' WHEN host IN (SELECT reg FROM d) THEN 'host' WHEN reg IN (SELECT reg FROM d) THEN 'registrable' ELSE 'none' END AS match FROM q"""
)
def ioc_listed_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth page's link as an indicator, whose domain counts too."""
    links = parsed_pages(spark, sf).select("page_id", F.col("normalized").alias("url"), "host", U.registrable(F.col("host")).alias("registrable"))
    iocs = links.filter("page_id % 9 = 0").select(F.lit("url").alias("ioc_type"), F.col("url").alias("value"))
    return I.match_iocs(links, iocs, spark.createDataFrame([], "host string"), from_urls=True).select("page_id", "match")


@query("SELECT event_id AS id, ts, event_type AS decision, value AS risk, CASE WHEN event_id % 3 > 0 THEN 'reason ' || (event_id % 3) END AS reason, CASE WHEN event_id % 2 = 0 THEN 'sms' ELSE 'email' END AS channel FROM events")
def detection_summaries(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    reason = F.when(n % 3 > 0, F.array(F.struct(F.concat(F.lit("reason "), (n % 3).cast("string")).alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    rows = table(spark, sf, "events").select(n.alias("id"), "ts", F.col("event_type").alias("decision"), F.col("value").alias("risk"), reason.alias("reasons"), F.struct(F.when(n % 2 == 0, "sms").otherwise("email").alias("channel")).alias("message"))
    return S.detection_summary(rows)


@query(
    """SELECT l_orderkey AS k, l_linenumber AS line, (l_quantity > 25)::INT + (l_discount >= 0.05)::INT + (l_tax > 0.04)::INT + (l_returnflag = 'R')::INT + (l_linestatus = 'O')::INT + (l_extendedprice > 30000)::INT AS families FROM lineitem"""
)
def evidence_family_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Six conditions on line items as kinds of evidence."""
    c = F.col
    families = {"text": c("l_quantity") > 25, "link": c("l_discount") >= 0.05, "intel": c("l_tax") > 0.04, "graph": c("l_returnflag") == "R", "brand": c("l_linestatus") == "O", "sender": c("l_extendedprice") > 30000}
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("line"), S.evidence_families(families).alias("families"))


@query("SELECT c_mktsegment AS file, count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS passed, count(*) FILTER (c_custkey % 3 = 1) AS failed, count(*) FILTER (c_custkey % 3 = 2) AS skipped, round(sum(c_acctbal), 6) AS seconds FROM customer GROUP BY 1")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey") % 3
    return S.run_rollup(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("file"), F.when(n == 0, "passed").when(n == 1, "failed").otherwise("skipped").alias("outcome"), F.col("c_acctbal").alias("seconds")))


@query("SELECT count(*) FILTER (event_id % 4 = 0) AS n_listed, count(*) FILTER (event_id % 4 = 1) AS n_clean, round(avg((value >= 50)::INT) FILTER (event_id % 4 = 0), 6) AS recall, round(avg((value >= 50)::INT) FILTER (event_id % 4 = 1), 6) AS false_positive_rate FROM events")
def fresh_feed_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Values of events as scores: one quarter stands for fresh listed links, one for known good ones."""
    score = lambda k: table(spark, sf, "events").filter(F.col("event_id") % 4 == k).select((F.col("value") / 100).alias("score"))
    return S.feed_evaluation(score(0), score(1))


@query(
    """WITH RECURSIVE e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a FROM u GROUP BY a HAVING count(DISTINCT b) > 20), s AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_totalprice > (SELECT 0.97 * max(o_totalprice) FROM orders)),
w(id, hops) AS (SELECT id, 0 FROM s UNION SELECT u.b, hops + 1 FROM w JOIN u ON u.a = w.id WHERE hops < 5 AND (hops = 0 OR w.id NOT IN (SELECT a FROM c)))
SELECT split_part(id, ':', 1) AS type, count(DISTINCT id) AS n FROM w GROUP BY 1"""
)
def campaign_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of each type within five steps of the dearest orders."""
    edges, seeds = _orders(spark, sf)
    return C.statistics(edges, seeds, hub=20)


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = orders.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst"), F.lit("ORDERED").alias("rel")).union(
        customers.select(node("customer", "c_custkey"), node("nation", "c_nationkey"), F.lit("LIVES_IN"))
    )
    most = orders.agg(F.max("o_totalprice")).first()[0] or 0.0
    return edges, orders.filter(F.col("o_totalprice") > 0.97 * most).select(node("order", "o_orderkey").alias("id"))


@query(
    """WITH RECURSIVE e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a FROM u GROUP BY a HAVING count(DISTINCT b) > 20), s AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_totalprice > (SELECT 0.97 * max(o_totalprice) FROM orders)),
w(id, hops) AS (SELECT id, 0 FROM s UNION SELECT u.b, hops + 1 FROM w JOIN u ON u.a = w.id WHERE hops < 5 AND (hops = 0 OR w.id NOT IN (SELECT a FROM c)))
SELECT id, min(hops) AS hops FROM w WHERE id NOT IN (SELECT a FROM c) GROUP BY id ORDER BY hops, id LIMIT 1500"""
)
def campaign_infrastructure(spark: SparkSession, sf: str) -> DataFrame:
    """What the dearest orders rest on, without hubs."""
    edges, seeds = _orders(spark, sf)
    return C.infrastructure(edges, seeds, hub=20)


@query("SELECT DISTINCT s_suppkey AS id, c_mktsegment AS campaign FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def campaign_brand_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as brands that suppliers and segments share."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("brand"))
    return C.brand_overlap(rows, table(spark, sf, "customer").select(F.col("c_mktsegment").alias("campaign"), F.col("c_nationkey").alias("brand")))


@query("SELECT id, last_seen FROM (SELECT 'customer:' || o_custkey AS id, max(o_orderdate) AS last_seen FROM orders GROUP BY 1) ORDER BY last_seen DESC, id LIMIT 40")
def graph_recent_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by their last order, beside nations that stay out."""
    rows = table(spark, sf, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderdate").alias("last_seen"))
    nodes = rows.unionByName(rows.select(F.lit("nation:1").alias("id"), "last_seen")).groupBy("id").agg(F.max("last_seen").alias("last_seen"))
    return G.recent_nodes(nodes, "customer", 40)


@query(
    """WITH p AS (SELECT l_suppkey AS seed, l_partkey AS bad, min(l_linenumber) AS hops, max(l_discount) AS spec FROM lineitem GROUP BY 1, 2), s AS (SELECT DISTINCT l_suppkey AS seed, l_partkey AS bad FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT p.*, row_number() OVER (PARTITION BY seed ORDER BY hops, spec DESC, bad) AS rank FROM p ANTI JOIN s USING (seed, bad)) SELECT seed, bad, hops, spec, rank FROM r WHERE rank <= 8"""
)
def graph_pruned_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts as ends of paths; returned ones are explained already."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("bad"), "l_linenumber", "l_discount", "l_returnflag")
    parts = parts_of(lines)
    paths = lines.repartition(parts, "seed", "bad").groupBy("seed", "bad").agg(F.min("l_linenumber").alias("hops"), F.max("l_discount").alias("spec"))
    return G.pruned_paths(paths, lines.filter("l_returnflag = 'R'").select(F.col("seed").alias("a"), F.col("bad").alias("b")), parts=parts)


@query(
    f"""WITH {PARSED_SQL}, i AS (SELECT normalized AS url, host, 'feed' || (page_id % 2) AS source FROM p WHERE page_id % 5 <> 0 AND host NOT IN (SELECT host FROM p WHERE page_id % 5 = 0)),
e AS (SELECT url AS a, host AS b, 'HOSTED_ON' AS rel FROM i UNION ALL SELECT url, source, 'LISTED_BY' FROM i UNION ALL SELECT host, 'b' || length(host), 'IMITATES' FROM i WHERE length(host) % 2 = 0)
SELECT rel, count(DISTINCT (a, b)) AS n_edges, count(*) AS n_seen FROM e GROUP BY rel"""
)
def graph_of_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages as feeds; every fifth page's host is official, hosts of even length imitate a brand."""
    p = parsed_pages(spark, sf)
    listed = p.filter("page_id % 5 <> 0").select(F.col("normalized").alias("url"), "host", F.concat(F.lit("feed"), (F.col("page_id") % 2).cast("string")).alias("source"), F.timestamp_seconds("page_id").alias("ts"))
    brands = p.filter(F.length("host") % 2 == 0).select("host", F.concat(F.lit("b"), F.length("host").cast("string")).alias("brand"))
    _, edges = G.feed_graph(listed, p.filter("page_id % 5 = 0").select("host"), brands)
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("count").alias("n_seen"))


@query(
    """SELECT o_custkey AS id, max(o_totalprice) AS risk, arg_max(o_orderpriority, o_orderdate) FILTER (o_orderkey % 3 > 0) AS label, min(o_orderdate) AS first_seen FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate) AS r, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) GROUP BY o_custkey HAVING max(n) = 1"""
)
def graph_last_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the last label that an order gave them; those with two orders at one time are left out, as either may be the last."""
    orders = table(spark, sf, "orders")
    one = orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(F.max("n").alias("n")).filter("n = 1")
    rows = orders.join(one, "o_custkey", "left_semi").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("risk"), F.lit(False).alias("malicious"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("label"))
    return G.merge_nodes(rows, latest=("label",)).select("id", "risk", "label", "first_seen")


FINDINGS = [("a.com", "homoglyph", "x", "com"), ("a.com", "keyword_affix", "y", "com"), ("b.in", "tld_swap", "x", "in"), ("c.xyz", "tld_swap", "x", "xyz"), ("d.org", "typosquat", "z", "org"), ("d.org", "subdomain", "z", "org")]


_SURE = [("a.com", "homoglyph", "x", 0.95), ("b.in", "tld_swap", "x", 0.5), ("c.xyz", "tld_swap", "x", 0.85), ("d.org", "subdomain", "z", 0.85)]


@query(f"SELECT c_custkey || '.' || host AS host, kind, target, confidence FROM customer, ({stated('host kind target confidence', _SURE)})")
def finding_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """The surest finding of each host; every customer has four hosts with six findings."""
    found = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "kind", "target", "suffix"), f, strict=True)]) for f in FINDINGS])
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(found).alias("f")).select(F.concat(F.col("c_custkey").cast("string"), F.lit("."), "f.host").alias("host"), "f.kind", "f.target", "f.suffix")
    return S.best_finding(rows.withColumn("confidence", S.confidence(F.col("kind"), F.col("suffix"))))


@query(
    """WITH p AS (SELECT label AS intent, 0.1 * (label + 1) AS weight, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 2),
s AS (SELECT vec_id // 5 AS id, embedding AS e FROM embeddings WHERE vec_id % 5 < 4 AND vec_id % 3 > 0),
m AS (SELECT id, intent, max(greatest(0, list_cosine_similarity(s.e::DOUBLE[], p.e::DOUBLE[]))) AS x, max(weight) AS w FROM s, p GROUP BY 1, 2) SELECT id, intent, round(x, 6) AS similarity, round(w * 0.85, 6) AS weight FROM m WHERE x >= 0.55"""
)
def prototype_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as sentences of messages of five, the first two of each label as prototypes of an intent."""
    vectors = table(spark, sf, "embeddings")
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    listed = vectors.withColumn("r", order).filter("r <= 2").select(F.col("label").alias("intent"), (0.1 * (F.col("label") + 1)).alias("weight"), "embedding")
    said = vectors.select(F.floor(F.col("vec_id") / 5).alias("id"), (F.col("vec_id") % 5).alias("at"), F.when(F.col("vec_id") % 3 > 0, 20).otherwise(10).alias("n_chars"), "embedding")
    return S.prototype_intents(said, listed, first=4)


SCREENS = [
    (1, "AX-HDFCBK\nYour OTP is 482913. Valid within 10 minutes. Rs. 5,000", "sms", "AX-HDFCBK", None, "Your OTP is 482913. Valid within 10 minutes. Rs. 5,000", "Rs. 5,000", "482913", "within 10 minutes"),
    (2, "From: a@b.com\nSubject: Hello\nPay ₹200 before tonight", "email", "a@b.com", "Hello", "Pay ₹200 before tonight", "₹200", "", "before tonight"),
    (3, "Invoice due\nBilling <pay@x.com>\nSee below", "email", "Billing <pay@x.com>", "Invoice due", "See below", "", "", ""),
    (4, "Mum\nonline\nCall me", "whatsapp", "Mum", None, "Call me", "", "", ""), (5, "just words", "other", None, None, "just words", "", "", ""),
]


@query(dealt_sql("conversations", _TURN_SQL, "channel sender subject body amounts codes deadlines", [(s[0] - 1, *s[2:]) for s in SCREENS]))
def screen_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts and entities of transcripts: turns of conversations in five written forms."""
    rows = dealt(spark, sf, "conversations", _TURN, [(s[1],) for s in SCREENS], "text string")
    found = screens.entities(F.col("text"))
    return rows.select("id", screens.layout(F.col("text")).alias("m"), *[F.array_join(found[k], ",").alias(k) for k in ("amounts", "codes", "deadlines")]).select("id", "m.*", "amounts", "codes", "deadlines")


BROKEN = [("htlps : //bank. com/a", "https://bank.com/a"), ("https:/one.example.com/x", "https://one.example.com/x"), ("see https://a.com/path-\nmore here", "see https://a.com/path-more here"), ("www.shop .in today", "www.shop.in today"), ("no link. com", "no link. com")]


@query("SELECT page_id AS id, regexp_replace(url, '^http://', 'https://') AS repaired FROM pages UNION ALL " + dealt_sql("documents", "doc_id + 1000000000", "repaired", [(k, r) for k, (_, r) in enumerate(BROKEN)]))
def screen_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links that recognition broke: those of pages with slips in their scheme, and other slips."""
    slip = F.concat(F.lit("htlps : / / "), F.regexp_replace("url", "^https?://", ""))
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("id"), slip.alias("text")).unionByName(dealt(spark, sf, "documents", "doc_id + 1000000000", [(t,) for t, _ in BROKEN], "text string"))
    return rows.select("id", screens.repair_links(F.col("text")).alias("repaired"))


WARNED = [("a text that is long enough to read", 40, [], "low_confidence,no_link"), ("go to https://a.example.com/ at once", 90, [], ""), ("f r e e x", 95, ["X"], "too_short,no_link,spaced_letters,brand_without_sender")]


@query(dealt_sql("conversations", _TURN_SQL, "warnings", [(k, w[3]) for k, w in enumerate(WARNED)]))
def screen_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What is told with transcripts of three written forms."""
    rows = dealt(spark, sf, "conversations", _TURN, [w[:3] for w in WARNED], "text string, confidence int, brands array<string>")
    return rows.select("id", F.array_join(screens.warnings(F.col("text"), F.col("confidence"), F.col("brands")), ",").alias("warnings"))


@query(
    """WITH v AS (SELECT user_id AS id, event_id AS phase, value AS risk, event_type AS decision FROM events)
SELECT id, max(phase) AS phase, arg_max(risk, phase) AS risk, arg_max(decision, phase) AS decision, arg_max(decision, phase) <> arg_min(decision, phase) AS revised FROM v GROUP BY id"""
)
def verdict_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as phases of one verdict."""
    return Q.latest_verdicts(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("phase"), F.col("value").alias("risk"), F.col("event_type").alias("decision")))


@query(
    """WITH c AS (SELECT user_id % 40 AS host, ts AS fetched_at, max(value) AS age FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, arg_max(c.age, c.fetched_at) AS age FROM events e LEFT JOIN c ON c.host = e.user_id % 40 AND c.fetched_at <= e.ts AND c.fetched_at > e.ts - INTERVAL 6 HOUR GROUP BY e.event_id"""
)
def enrichment_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as look-ups that stay good for six hours."""
    events = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("host"), "value", "event_type")
    cache = events.filter("event_type = 'click'").groupBy("host", F.col("ts").alias("fetched_at")).agg(F.max("value").alias("age"))
    return Q.cached_lookup(events.select("event_id", "ts", "host"), cache, "host").select("event_id", "age")


TERMS = [([("paypal", 0.9), ("pay", 0.8), ("verify", 0.5), ("verify-now", 0.4)], "paypal,verify"), ([("ab", 1.0), ("abc", 0.5)], "ab"), ([], "")]


@query(dealt_sql("documents", "doc_id", "kept", [(k, t[1]) for k, t in enumerate(TERMS)]))
def suppressed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of documents, best first, without those that overlap a better one."""
    rows = dealt(spark, sf, "documents", "doc_id", [(t[0],) for t in TERMS], "terms array<struct<term:string,weight:double>>")
    return rows.select("id", F.array_join(F.transform(S.substring_suppressed(F.col("terms")), lambda t: t["term"]), ",").alias("kept"))


@query(
    """WITH s AS (SELECT DISTINCT source AS train_on FROM documents), p AS (SELECT a.train_on, b.train_on AS test_on FROM s a, s b WHERE a.train_on <> b.train_on)
SELECT train_on, test_on, 'train' AS part, count(*) AS n FROM documents JOIN p ON source = train_on GROUP BY 1, 2 UNION ALL SELECT train_on, test_on, 'test', count(*) FROM documents JOIN p ON source = test_on GROUP BY 1, 2"""
)
def cross_source_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of documents as training and as test set of every other one."""
    return cross_splits(table(spark, sf, "documents").select("doc_id", "source")).groupBy("train_on", "test_on", "part").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT l_suppkey AS seed, l_linenumber AS hops, l_discount AS spec FROM lineitem WHERE l_returnflag = 'R') SELECT seed, round(least(1.0, sum(spec / hops) / 2), 6) AS proximity FROM p GROUP BY seed")
def graph_bad_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items as paths of a supplier."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("seed"), F.col("l_linenumber").alias("hops"), F.col("l_discount").alias("spec"))
    return G.bad_proximity(lines).select("seed", F.round("proximity", 6).alias("proximity"))


@query("SELECT event_id, CASE WHEN value >= 85 THEN 'block_and_list' WHEN value >= 60 THEN 'hold_for_review' WHEN value >= 30 THEN 'deliver_with_banner' ELSE 'deliver' END AS action FROM events")
def decision_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What follows each decision; all four of them."""
    actions = F.create_map(*[F.lit(x) for pair in refdata.PLAYBOOK for x in pair])
    return table(spark, sf, "events").select("event_id", actions[decision(F.col("value"))].alias("action"))


@query(
    "SELECT event_type, round(count(*) FILTER (value >= 60 AND user_id % 3 = 0) / nullif(count(*) FILTER (user_id % 3 = 0), 0), 6) AS caught, round(count(*) FILTER (value >= 60 AND user_id % 3 = 1) / nullif(count(*) FILTER (user_id % 3 = 1), 0), 6) AS alarms FROM events GROUP BY 1"
)
def rates_of_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Two rates over their own rows: a third of the users as bad ones, a third as good ones."""
    on, user = F.col("value") >= 60, F.col("user_id") % 3
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(A.rate(on, user == 0), 6).alias("caught"), F.round(A.rate(on, user == 1), 6).alias("alarms"))


@query("SELECT name, kind, CASE kind WHEN 'hyphenation' THEN length(name) - 1 ELSE 4 END::BIGINT AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,12}')) AS name FROM benchmark), (SELECT unnest(['hyphenation', 'tld_swap']) AS kind)")
def attack_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many forged spellings with a hyphen, and under other top-level domains, words of the benchmark have; unit tests hold the other kinds."""
    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,12})"), F.lit(1))).alias("name")).distinct()
    return L.wider_attacks(names).filter(F.col("kind").isin("hyphenation", "tld_swap")).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


HOSTS = [("bücher.example", "xn--bcher-kva.example", 1, 0), ("plain.example", "plain.example", 0, 0), ("раypal.com", "xn--ypal-43d9g.com", 1, 1), ("почта.рф", "xn--80a1acny.xn--p1ai", 1, 0)]


@query(dealt_sql("pages", "page_id", "host ascii has_unicode mixed_script", [(k, *h) for k, h in enumerate(HOSTS)]))
def host_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts as the wire has them, and what their letters give away; each page has one of four."""
    rows = dealt(spark, sf, "pages", "page_id", [(h[0],) for h in HOSTS], "host string")
    return rows.select("id", "host", to_ascii(F.col("host")).alias("ascii"), *[c.alias(n) for n, c in script_features(F.col("host")).items()])


@query("SELECT user_id, props, count(*) AS n FROM events GROUP BY user_id, props HAVING min(ts) >= (SELECT max(ts) - INTERVAL 20 DAY FROM events) ORDER BY n DESC, user_id, props LIMIT 20")
def new_values_report(spark: SparkSession, sf: str) -> DataFrame:
    """What users have only done in the last twenty days, the twenty most frequent ones."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts").alias("t")).select((F.col("t") - F.expr("interval 20 days")).alias("since"))
    return A.new_values(events.join(F.broadcast(last)), ["user_id", "props"], F.col("ts") >= F.col("since"), 20)  # one row beside the events


@query(
    """WITH p AS (SELECT l_suppkey AS id, least(1.0, count(*) FILTER (l_returnflag = 'R') / 200.0) AS a, avg(l_discount) AS b, avg((l_linestatus = 'O')::INT) AS c, max(l_tax) AS d, max(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) AS e,
  avg((l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 90 DAY FROM lineitem))::INT) AS f, least(1.0, count(DISTINCT l_partkey) / 1000.0) AS g FROM lineitem GROUP BY 1)
SELECT id, round(100 * (0.25 * a + 0.20 * b + 0.15 * c + 0.15 * d + 0.10 * e + 0.10 * f + 0.05 * g), 4) AS score FROM p"""
)
def graph_score_of_all_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All seven parts of the graph score, from shares, maxima and recent line items of each supplier; a certificate's overlap is a maximum."""
    lines = table(spark, sf, "lineitem")
    last = F.broadcast(lines.agg(F.max("l_shipdate").alias("last")))  # one row
    c = F.col
    returned = c("l_returnflag") == "R"
    parts = {
        "malicious_neighbors": F.least(F.lit(1.0), F.count_if(returned) / 200.0), "infrastructure_overlap": F.avg("l_discount"), "suspicious_domain_cluster": F.avg((c("l_linestatus") == "O").cast("int")), "ip_reputation": F.max("l_tax"),
        "certificate_overlap": F.max(F.when(returned, c("l_discount")).otherwise(0.0)), "temporal_proximity": F.avg((c("l_shipdate") >= c("last") - F.expr("interval 90 days")).cast("int")), "campaign_similarity": F.least(F.lit(1.0), F.count_distinct("l_partkey") / 1000.0),
    }
    rows = lines.join(last).groupBy(c("l_suppkey").alias("id")).agg(*[v.alias(k) for k, v in parts.items()])
    return rows.select("id", F.round(G.graph_score({k: c(k) for k in parts}), 4).alias("score"))


LOOKED_UP = [(0, "url", "https://a.example/x"), (0, "domain", "a.example"), (0, "domain", "s.example"), (0, "ip", "192.0.2.7"), (0, "hash", "ff00"), (1, "domain", "t.example")]


@query(dealt_sql("customer", "c_custkey", "ioc_type value", LOOKED_UP))
def message_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What is looked up for customers' messages of two written forms; the second one's link is trusted."""
    sent = dealt(spark, sf, "customer", "c_custkey", [("S.example", "from 192.0.2.7", [("FF00",)]), ("t.example", None, None)], "sender_domain string, text string, attachments array<struct<sha256:string>>")
    forms = [("https://a.example/x", "a.example", False), ("https://b.example/", "b.example", True)]
    links = dealt(spark, sf, "customer", "c_custkey", forms, "url string, host string, trusted boolean")
    again = links.filter(F.pmod("id", F.lit(2)) == 0).withColumn("trusted", F.lit(None).cast("boolean"))
    return I.candidates(sent, links.unionByName(again))


@query(
    """WITH l AS (SELECT o_orderkey AS id, 'https://h' || o_custkey || '.x.example/' || o_orderkey AS url, 'h' || o_custkey || '.x.example' AS host, o_orderkey % 3 = 0 AS trusted FROM orders WHERE o_totalprice >= 250000)
SELECT 'url' AS ioc_type, url AS value FROM l WHERE NOT trusted UNION SELECT 'domain', host FROM l WHERE NOT trusted"""
)
def blocked_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as detections, dear ones blocked, with a link each, every third trusted."""
    orders = table(spark, sf, "orders")
    found = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") >= 250000, "BLOCK").otherwise("FLAG").alias("decision"))
    host = F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit(".x.example"))
    links = orders.select(F.col("o_orderkey").alias("detection_id"), F.concat(F.lit("https://"), host, F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"), host.alias("host"), F.lit("x.example").alias("registrable"), (F.col("o_orderkey") % 3 == 0).alias("trusted"))
    return K.blocked_iocs(found, links).select("ioc_type", "value")
