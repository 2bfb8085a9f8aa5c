"""Text expressions: de-obfuscation, tokens, indicators, intents, attachments, all built-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import phrases
from wardline.functions.phrases import LOOKS_FROM, LOOKS_PAIRS, LOOKS_TO
from wardline.functions.scores import noisy_or

# Characters that take no room.
ZERO_WIDTH = "​‌‍⁠﻿­"
#: Look-alike letters of other scripts, without the digits and signs that follow them in the list.
CONFUSABLE_FROM, CONFUSABLE_TO = LOOKS_FROM[:-8], LOOKS_TO[:-8]


def strip_zero_width(text: Column) -> tuple[Column, Column]:
    """The text without characters that take no room, and how many there were; a text is gone through by signs only if it holds one."""
    clean = F.when(reduce(lambda a, b: a | b, [text.contains(z) for z in ZERO_WIDTH]), F.translate(text, ZERO_WIDTH, "")).otherwise(text)
    return clean, (F.length(text) - F.length(clean)).cast("long")


# How a link is written harmless; each sign may stand in brackets, a scheme may be spelt with stand-ins.
BRACKETS = (("[", "]"), ("(", ")"), ("{", "}"))
SCHEMES = (("hxxps", "https"), ("hxxp", "http"), ("h**ps", "https"), ("h**p", "http"))
SPELT_SIGNS = ((".", "."), ("dot", "."), (":", ":"), ("/", "/"), ("://", "://"))


def refang(text: Column) -> Column:
    """Links that were written to be harmless, made links again.

    Signs that stand alone in brackets (BRACKETS, SPELT_SIGNS, with spaces inside; around a dot one space outside too)
    lose them, wherever they stand; then schemes written with stand-ins (SCHEMES) before a colon get their letters back.
    """
    quoted = lambda x: "".join("\\" + c if not c.isalnum() else c for c in x)
    out = text
    for sign, plain in SPELT_SIGNS:
        inside = "|".join(f"{quoted(a)} *{quoted(sign)} *{quoted(b)}" for a, b in BRACKETS)
        out = F.regexp_replace(out, f"(?i) ?(?:{inside}) ?" if plain == "." else f"(?i)(?:{inside})", plain)
    for spelt, plain in SCHEMES:
        out = F.regexp_replace(out, f"(?i)\\b{quoted(spelt)}(?=:)", plain)
    return out


def repair_mixed_words(text: Column) -> Column:
    """Look-alike letters inside words that also hold Latin ones, made Latin; other words stay."""
    fixed = F.transform(
        F.split(text, " "), lambda w: F.when(w.rlike(r"[A-Za-z]") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.translate(w, CONFUSABLE_FROM, CONFUSABLE_TO)).otherwise(w)
    )
    return F.array_join(fixed, " ")


def skeleton(name: Column) -> Column:
    """What a name looks like: digits and look-alike letters as the letters they imitate."""
    plain = F.translate(F.lower(name), LOOKS_FROM, LOOKS_TO)
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LOOKS_PAIRS, plain)


def skeletons(names: DataFrame, confusables: DataFrame, column: str = "name") -> DataFrame:
    """Adds ``skeleton``: each character as the one that a confusables file (source, target: code points in hex) gives for it, in lower case.

    Characters are joined with the table, which Unicode bounds, so a file of any size of names is one shuffle.
    """
    text = lambda hexes: F.array_join(F.transform(F.split(hexes, " +"), lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")), "")
    table = confusables.select(F.lower(text(F.col("source"))).alias("c"), F.lower(text(F.col("target"))).alias("__t")).dropDuplicates(["c"])
    own = names.select(column).distinct().select(column, F.posexplode(F.filter(F.split(F.lower(column), ""), lambda x: x != "")).alias("at", "c"))
    like = own.join(F.broadcast(table), "c", "left").withColumn("__t", F.coalesce("__t", "c"))
    made = like.groupBy(column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "__t"))), lambda x: x["__t"]), "").alias("skeleton"))
    return names.join(made, column, "left")


def tokens(text: Column) -> Column:
    """Word tokens of 2 to 24 letters; links, addresses, amounts and numbers become marks."""
    steps = (
        (r"(?:https?://|www\.)[^ \t\n\r]+", " zzurl "),
        (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", " zzemail "),
        (r"(?:₹|rs\.?|inr|\$|usd|£|€) ?[0-9][0-9,]*(?:\.[0-9]+)?", " zzmoney "),
        (r"[0-9]+", " zznum "),
    )
    low = reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, F.lower(text))
    found = F.regexp_extract_all(low, F.lit(r"([a-z\x{0900}-\x{097F}\x{0B80}-\x{0BFF}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t).between(2, 24))


def bigrams(words: Column) -> Column:
    """Adjacent pairs."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def _sorted_distinct(found: Column, most: int | None) -> Column:
    values = F.array_sort(F.array_distinct(found))
    return values if most is None else F.slice(values, 1, most)


def emails(text: Column, most: int | None = None) -> Column:
    """Sorted distinct addresses; the first ``most`` for display."""
    return _sorted_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"), F.lit(1)), most)


def phones(text: Column, most: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\+[0-9]{1,3}[ -]?\(?[0-9]{3,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{2,4})"), F.lit(1))
    return _sorted_distinct(F.transform(found, lambda p: F.regexp_replace(p, "[ ()-]", "")), most)


def ips(text: Column, most: int | None = None) -> Column:
    return _sorted_distinct(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"), F.lit(1)), most)


#: Bitcoin addresses: bech32 after bc1, in one case and without 1, b, i, o; base58 after 1 or 3, without 0, O, I, l.
_BECH32, _BASE58 = "023456789ac-hj-np-z", "1-9A-HJ-NP-Za-km-z"


def wallets(text: Column, most: int | None = None) -> Column:
    """Sorted distinct Bitcoin addresses by their formats: 42 to 62 characters of bech32, 26 to 35 of base58."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9])(bc1[{_BECH32}]{{39,59}}|[13][{_BASE58}]{{25,34}})(?![A-Za-z0-9])"), F.lit(1))
    return _sorted_distinct(found, most)


# Providers of payment addresses.
UPI_PROVIDERS = (
    "okaxis", "okhdfcbank", "oksbi", "okicici", "ybl", "ibl", "axl", "paytm", "apl", "upi", "sbi", "icici", "hdfcbank", "axisbank", "kotak", "yesbank", "idfcbank", "federal", "indus", "rbl",
    "jupiteraxis", "fam", "freecharge", "airtel", "jio", "pnb", "boi", "cnrb", "unionbank", "iob", "indianbank",
)


def payment_ids(text: Column, most: int | None = None) -> Column:
    """Sorted distinct payment addresses, name@provider; an address that goes on with a dot is a mail address."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9._-])([a-z0-9._-]{{2,64}}@(?:{'|'.join(UPI_PROVIDERS)}))(?![a-z0-9-]|\.[a-z0-9])"), F.lit(1))
    return _sorted_distinct(found, most)


# The numbering plan of India. Mobile numbers have ten digits, the first from 6 to 9; toll-free and
# shared-cost series begin with these four digits and go on with six or seven.
COUNTRY, MOBILE_FIRST, FREE_SERIES = "91", "6789", ("1800", "1900")


def national_phones(text: Column, most: int | None = None) -> Column:
    """Sorted distinct Indian mobile numbers without the country's code, and toll-free ones, digits only.

    Runs of digits, in which single spaces and hyphens may stand, are taken whole and then read by the numbering
    plan, so a longer number never gives part of itself.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9](?:[ -]?[0-9])+)"), F.lit(1))
    digits = F.transform(runs, lambda r: F.translate(r, " -", ""))
    bare = F.transform(digits, lambda d: F.when((F.length(d) == 12) & d.startswith(COUNTRY), F.substring(d, 3, 10)).otherwise(d))
    mobile = lambda d: (F.length(d) == 10) & F.substring(d, 1, 1).isin(*MOBILE_FIRST)
    free = lambda d: F.length(d).between(10, 11) & F.substring(d, 1, 4).isin(*FREE_SERIES)
    return _sorted_distinct(F.filter(bare, lambda d: mobile(d) | free(d)), most)


def text_key(text: Column, limit: int | None = None) -> Column:
    """md5 of the text with everything but letters and digits squeezed; the prior system's key takes the first 2,000 characters as ``limit``."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
    return F.md5(plain if limit is None else F.substring(plain, 1, limit))


def channel(text: Column) -> Column:
    return F.when(F.length(text) <= 320, "sms").otherwise("email")


def intent_hits(text: Column, intents=refdata.INTENTS, most: int = 3) -> Column:
    """Array of (id, weight, evidence) of the intents that a text shows; evidence keeps the first ``most`` phrases."""
    return phrases.hits(text, tuple(intents), most)


def intent_spans(text: Column, intents=refdata.INTENTS) -> Column:
    """Array of (name, phrase, start, end): where each intent's phrases stand, in code points."""
    return phrases.spans(text, tuple((name, found) for name, _, found in intents))


def intent_score(hits: Column) -> Column:
    return noisy_or(F.transform(hits, lambda h: h["weight"]))


def auth_result(header: Column, mechanism: str) -> Column:
    """Result of one mechanism in an Authentication-Results header; null if it isn't there."""
    found = F.lower(F.regexp_extract(header, rf"(?i)\b{mechanism} *= *([a-z]+)", 1))
    return F.when(found != "", found)


def attachment_kind(name: Column) -> Column:
    """risky, archive, double (a harmless ending before a risky one) or plain, by a file's name."""
    parts = F.split(F.lower(name), r"\.")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    risky = (F.size(parts) >= 2) & last.isin(*refdata.RISKY_ENDINGS)
    double = risky & (F.size(parts) >= 3) & before.rlike("^[a-z0-9]{2,4}$")
    return F.when(double, "double").when(risky, "risky").when((F.size(parts) >= 2) & last.isin(*refdata.ARCHIVE_ENDINGS), "archive").otherwise("plain")


#: A line that is a text message's sender: a registered header, a short code or a phone number.
SENDERS = r"^(?:[A-Z]{2}-[A-Z0-9]{3,8}(?:-[A-Z])?|[0-9]{5,6}|\+?[0-9][0-9 -]{8,14}[0-9])$"

#: What the frame of a screenshot writes on lines of its own: words of buttons, folders and dates (whole lines, any case),
#: and beginnings of notices. Times, charge, counters, networks and single signs are read by shape.
FRAME_WORDS = (
    "reply", "reply all", "forward", "delete", "archive", "report spam", "mark as read", "translate message", "unsubscribe", "view in browser", "show details", "hide details", "view details",
    "type a message", "text message", "send message", "tap to load preview", "tap for more info", "learn more", "add to contacts", "block", "report", "mute", "accept", "back", "edit", "done", "cancel", "close",
    "more", "menu", "share", "copy", "search", "settings", "inbox", "sent", "drafts", "spam", "starred", "important", "all mail", "unread", "to me", "today", "yesterday", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday", "4g", "5g", "lte", "volte", "wifi", "wi-fi", "airtel", "jio", "vi", "bsnl", "verizon", "t-mobile", "vodafone", "delivered", "read", "seen", "unknown sender",
)
FRAME_NOTICES = ("messages and calls are end-to-end encrypted", "sender is not in your contact")
FRAME_SHAPES = (
    r"[0-9]{1,2}:[0-9]{2}(?: ?[ap]m)?",  # the clock
    r"[0-9]{1,3} ?%",  # the charge
    r"(?:delivered|read|sent|seen) [0-9]{1,2}:[0-9]{2}.*",  # a receipt
    r"[0-9]+ (?:of [0-9]+|unread messages?)",  # counters
    r"[^\p{L}\p{N}]",  # an arrow, a dot, a bar
)


def is_frame(line: Column) -> Column:
    """Whether a line of a transcript belongs to the screenshot's frame."""
    plain = F.trim(F.lower(F.regexp_replace(line, r"[\s]+", " ")))
    tests = [plain.isin(*FRAME_WORDS), plain.rlike("^(?:" + "|".join(FRAME_SHAPES) + ")$"), *[plain.startswith(n) for n in FRAME_NOTICES]]
    return reduce(lambda a, b: a | b, tests)


def drop_chrome(lines: Column) -> Column:
    """Lines of a transcript without those of the frame."""
    return F.filter(lines, lambda x: ~is_frame(x))


def reflow(lines: Column) -> Column:
    """Visual line breaks undone: a line that starts in lower case continues the one before."""
    return F.aggregate(lines, F.lit(""), lambda t, x: F.when(t == "", x).when(F.trim(x).rlike(r"^[a-z]"), F.concat(t, F.lit(" "), F.trim(x))).otherwise(F.concat(t, F.lit("\n"), x)))
