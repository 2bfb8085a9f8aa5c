"""Messages: raw RFC 822 files, JSON records, enrichment and provider responses as tables."""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator
from email.utils import getaddresses, parseaddr
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.pages import html_to_text
from wardline.functions.scores import noisy_or
from wardline.functions.text import attachment_kind, auth_result
from wardline.functions.urls import registrable

MESSAGE = (
    "path string, message_id string, sender string, sender_name string, sender_domain string, recipients array<string>, reply_to string, return_path string, subject string, text string, html string, "
    "auth string, received_spf string, received_hops int, attachments array<struct<filename:string,content_type:string,size:long,sha256:string>>"
)


def _message(raw: bytes) -> dict:
    """Headers, bodies and attachments of one message; broken ones give what can be read."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    name, address = parseaddr(str(m.get("From", "")))
    bodies: dict[str, list[str]] = {"plain": [], "html": []}
    files = []
    for part in m.walk():
        if part.is_multipart():
            continue
        data = part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            files.append({"filename": part.get_filename() or "", "content_type": part.get_content_type(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        elif part.get_content_maintype() == "text" and part.get_content_subtype() in bodies:
            charset = part.get_content_charset() or "utf-8"
            try:
                bodies[part.get_content_subtype()].append(data.decode(charset, "replace"))
            except LookupError:
                bodies[part.get_content_subtype()].append(data.decode("utf-8", "replace"))
    results = [str(h) for k in ("Authentication-Results", "ARC-Authentication-Results") for h in m.get_all(k, [])]
    return {
        "message_id": str(m.get("Message-ID", "")), "sender": address.lower(), "sender_name": name, "sender_domain": address.rpartition("@")[2].lower(),
        "recipients": [a.lower() for _, a in getaddresses([str(h) for h in m.get_all("To", [])])], "reply_to": parseaddr(str(m.get("Reply-To", "")))[1].lower(),
        "return_path": parseaddr(str(m.get("Return-Path", "")))[1].lower(), "subject": str(m.get("Subject", "")), "text": "\n".join(bodies["plain"]), "html": "\n".join(bodies["html"]),
        "auth": "; ".join(results), "received_spf": str(m.get("Received-SPF", "")), "received_hops": len(m.get_all("Received", [])), "attachments": files,
    }


def parse_raw(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Messages of (path, content) rows; MIME has no built-in, so batches go through the standard library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p, **_message(bytes(c or b""))} for p, c in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in MESSAGE.split(", ")])

    parsed = rows.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, MESSAGE)
    return with_auth(parsed)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of .eml files."""
    return parse_raw(spark.read.format("binaryFile").load(path))


def with_auth(messages: DataFrame) -> DataFrame:
    """Adds spf, dkim, dmarc; SPF falls back on Received-SPF."""
    spf = F.coalesce(auth_result(F.col("auth"), "spf"), F.nullif(F.lower(F.regexp_extract("received_spf", r"^\s*(\S+)", 1)), F.lit("")))
    return messages.withColumns({"spf": spf, "dkim": auth_result(F.col("auth"), "dkim"), "dmarc": auth_result(F.col("auth"), "dmarc")})


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON records (subject, sender, body, html, reply_to, channel), with the body of HTML-only ones made text."""
    rows = spark.read.schema("subject string, sender string, body string, html string, reply_to string, channel string").json(path)
    body = F.when(F.coalesce("body", F.lit("")) == "", html_to_text(F.coalesce("html", F.lit("")))).otherwise(F.col("body"))
    return rows.select("subject", F.lower("sender").alias("sender"), F.lower(F.substring_index("sender", "@", -1)).alias("sender_domain"), body.alias("text"), "html", F.lower("reply_to").alias("reply_to"), F.coalesce("channel", F.lit("email")).alias("channel"))


# Mail services open to anybody.
FREE_MAIL = (
    "gmail.com", "yahoo.com", "yahoo.co.in", "outlook.com", "hotmail.com", "live.com", "aol.com", "icloud.com", "proton.me", "protonmail.com",
    "rediffmail.com", "zoho.com", "yandex.com", "mail.ru", "gmx.com", "gmx.net", "mail.com", "tutanota.com",
)
# Services that send for others; their bounce addresses say nothing.
BULK_SENDERS = ("amazonses.com", "sendgrid.net", "mailgun.org", "mcsv.net", "bounces.google.com", "salesforce.com", "mktomail.com", "sparkpostmail.com")
# Kinds of institutions that don't write from free mailboxes or private numbers.
INSTITUTIONS = ("bank", "gov", "payments")
# Form of registered sender headers of text messages.
SENDER_HEADER = r"^[A-Z]{2}-[A-Z0-9]{3,8}(?:-[A-Z])?$"
# Weights of the signals.
SIGNAL_WEIGHTS = {
    "display_name_spoof": 0.55, "freemail_institution": 0.45, "brand_sender_mismatch": 0.15, "reply_to_mismatch": 0.3, "return_path_mismatch": 0.1, "dmarc_fail": 0.4, "spf_fail": 0.22, "dkim_fail": 0.2,
    "double_extension": 0.5, "html_attachment": 0.4, "risky_attachment": 0.35, "sms_personal_number": 0.45, "html_heavy": 0.06, "evasion": 0.35, "evasion_meta_refresh": 0.15,
}


def domain_of(address: Column) -> Column:
    """What follows the last @ of an address; null without one."""
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1)))


def sender_signals(m: DataFrame) -> Column:
    """Array of (id, weight) of what speaks against the sender of each message.

    Needs sender, sender_domain, reply_to, return_path, spf, dkim, dmarc, attachments. Used where there:
    ``claims`` (array of (brand, category) that the text names), ``name_brand`` (the brand that the display name
    spells), ``official`` (the brand whose domain it is), ``lookalike`` (confidence of the sender domain's best
    finding), channel, html_text_ratio, tricks (ids). All failures count, one for each attachment.
    """
    has = lambda c: c in m.columns
    weights = SIGNAL_WEIGHTS
    no = F.lit(False)
    claims = F.col("claims") if has("claims") else F.array().cast("array<struct<brand:string,category:string>>")
    official = F.col("official") if has("official") else F.lit(None).cast("string")
    finding = F.col("lookalike") if has("lookalike") else F.lit(None).cast("double")
    named = F.size(claims) > 0
    kind = lambda kinds: F.exists(claims, lambda c: reduce(lambda a, b: a | b, [c["category"].startswith(k) for k in kinds]))
    own = lambda d: registrable(d)
    from_domain = F.col("sender_domain").isNotNull() & (F.col("sender_domain") != "")
    other = lambda c: from_domain & (own(domain_of(F.col(c))) != own(F.col("sender_domain")))
    bulk = reduce(lambda a, b: a | b, [domain_of(F.col("return_path")).endswith(b) for b in BULK_SENDERS])
    signal = lambda name, on, weight=None: F.when(F.coalesce(on, no), F.struct(F.lit(name).alias("id"), (F.lit(weights.get(name, 0.0)) if weight is None else weight).alias("weight")))
    single = [
        signal("sender_lookalike", finding.isNotNull(), finding),
        signal("display_name_spoof", F.col("name_brand").isNotNull() & official.isNull() if has("name_brand") else no),
        signal("freemail_institution", F.col("sender_domain").isin(*FREE_MAIL) & kind(INSTITUTIONS)),
        signal("brand_sender_mismatch", from_domain & named & official.isNull() & finding.isNull()),
        signal("reply_to_mismatch", other("reply_to")), signal("return_path_mismatch", other("return_path") & ~bulk),
    ]
    for check in ("dmarc", "spf", "dkim"):
        w = weights[f"{check}_fail"]
        single.append(signal(f"{check}_fail", F.col(check).isin("fail", "softfail", "permerror"), F.when(F.col(check) == "softfail", w / 2).otherwise(w)))
    if has("channel"):
        number = F.regexp_replace("sender", " ", "").rlike(r"^\+?[0-9]{10,13}$")
        single.append(signal("sms_personal_number", (F.col("channel") == "sms") & number & kind((*INSTITUTIONS, "telecom"))))
    if has("html_text_ratio"):
        single.append(signal("html_heavy", F.col("html_text_ratio") > 40))
    found = F.array(*single)

    def file(a: Column) -> Column:
        ending, sort = F.lower(F.substring_index(a["filename"], ".", -1)), attachment_kind(a["filename"])
        return F.coalesce(signal("double_extension", sort == "double"), signal("html_attachment", (sort == "risky") & ending.isin("html", "htm", "shtml", "svg")), signal("risky_attachment", sort == "risky"))

    found = F.concat(found, F.transform(F.coalesce("attachments", F.array().cast(m.schema["attachments"].dataType)), file))
    if has("tricks"):
        trick = lambda t: F.struct(F.concat(F.lit("evasion_"), t).alias("id"), F.when(t == "meta_refresh", weights["evasion_meta_refresh"]).otherwise(weights["evasion"]).alias("weight"))
        found = F.concat(found, F.transform(F.coalesce("tricks", F.array().cast("array<string>")), trick))
    return F.filter(found, lambda h: h.isNotNull())


def sender_score(signals: Column) -> Column:
    """Signals as one score of 0 to 100."""
    return F.round(100 * noisy_or(F.transform(signals, lambda s: s["weight"])), 1)


def sender_trust(m: DataFrame) -> Column:
    """Whether a mail comes from a brand's own domain (``official``) that isn't a free mail service and fails no check."""
    failed = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin("fail", "softfail", "permerror"), F.lit(False)) for c in ("spf", "dkim", "dmarc")])
    return F.col("official").isNotNull() & ~F.coalesce(F.col("sender_domain").isin(*FREE_MAIL), F.lit(False)) & ~failed


def header_trust(messages: DataFrame, keywords: DataFrame, claims: DataFrame, key: str = "id") -> DataFrame:
    """(key, brand): text messages whose registered header belongs to a brand, and to one that the text claims if it claims any.

    ``messages`` is (key, sender), ``keywords`` (brand, keyword), ``claims`` (key, brand). A brand owns headers
    that hold the first three letters of a keyword; those are cut out of the header, so the join is on equal keys.
    """
    header = F.get(F.split(F.upper("sender"), "-"), F.lit(1))
    own = messages.filter(F.upper("sender").rlike(SENDER_HEADER)).select(key, header.alias("h"))
    threes = F.transform(F.sequence(F.lit(1), F.length("h") - 2), lambda i: F.substring(F.col("h"), i, F.lit(3)))
    starts = keywords.filter(F.length("keyword") >= 3).select(F.upper(F.substring("keyword", 1, 3)).alias("three"), "brand").distinct()
    owners = own.select(key, F.explode(F.array_distinct(threes)).alias("three")).join(starts, "three").select(key, "brand").distinct()
    said = owners.join(claims.select(key, "brand").distinct().withColumn("__said", F.lit(1)), [key, "brand"], "left")
    loud = claims.select(key).distinct().withColumn("__any", F.lit(1))
    kept = said.join(loud, key, "left").filter(F.col("__any").isNull() | F.col("__said").isNotNull())
    return kept.groupBy(key).agg(F.min("brand").alias("brand"))


def with_enrichment(links: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Links with what is known of their host (age_days, cert_age_days, asn, …); looked up elsewhere, joined here."""
    return links.join(enrichment, "host", "left")


# Risk, verdict and confidence of each provider's answer, over flat fields of its public API.
PROVIDERS = {
    "virustotal": (
        "least(100.0, 100.0 * (malicious + 0.5 * suspicious) / greatest(8.0, (malicious + suspicious + harmless + undetected) * 0.25))",
        "case when malicious >= 3 then 'malicious' when malicious + suspicious >= 1 then 'suspicious' else 'clean' end",
        "case when malicious + suspicious + harmless + undetected > 20 then 0.9 else 0.6 end",
    ),
    "urlscan": (
        "case when malicious_scans > 0 then least(100.0, 40.0 + 20.0 * malicious_scans) else 0.0 end",
        "case when malicious_scans > 0 then 'malicious' when scans = 0 then 'unknown' else 'clean' end",
        "case when scans > 0 then 0.7 else 0.2 end",
    ),
    "abuseipdb": ("cast(abuse_score as double)", "case when abuse_score >= 75 then 'malicious' when abuse_score >= 25 then 'suspicious' else 'clean' end", "0.6"),
    "otx": ("least(100.0, 20.0 * pulses)", "case when pulses >= 3 then 'malicious' when pulses > 0 then 'suspicious' else 'unknown' end", "0.6"),
    "safe_browsing": ("case when listed then 95.0 else 0.0 end", "case when listed then 'malicious' else 'unknown' end", "case when listed then 0.95 else 0.3 end"),
    "urlhaus": ("case when listed then 90.0 else 0.0 end", "case when listed then 'malicious' else 'unknown' end", "case when listed then 0.85 else 0.3 end"),
}
#: Providers for which 404 is an answer: they know nothing of the indicator.
_NOT_FOUND = ("virustotal", "otx")


def provider_verdicts(responses: DataFrame) -> DataFrame:
    """(source, indicator, verdict, risk, confidence) of recorded provider answers with flat fields.

    Other answers than 200 are unavailable, with null risk and confidence; 404 of a provider
    that says so for what it doesn't know is unknown, with confidence 0.2.
    """
    fields = {"listed": "boolean"} | dict.fromkeys(("malicious", "suspicious", "harmless", "undetected", "scans", "malicious_scans", "abuse_score", "pulses"), "int")
    responses = responses.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in responses.columns})
    ok, absent = F.col("http_status") == 200, (F.col("http_status") == 404) & F.col("source").isin(*_NOT_FOUND)
    out = [F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("double")]
    for source, rules in PROVIDERS.items():
        out = [F.when(F.col("source") == source, F.expr(r)).otherwise(c) for r, c in zip(rules, out, strict=True)]
    risk, verdict, confidence = out
    return responses.select(
        "source", "indicator", F.when(ok, F.coalesce(verdict, F.lit("unavailable"))).when(absent, "unknown").otherwise("unavailable").alias("verdict"),
        F.round(F.when(ok, risk).when(absent, 0.0), 1).alias("risk"), F.when(ok, confidence).when(absent, 0.2).cast("double").alias("confidence"),
    )
