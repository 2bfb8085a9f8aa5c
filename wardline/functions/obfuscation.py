"""Hidden links and letters: redirect wrappers, base64, punycode, spaced letters, mixed scripts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Hosts that wrap links, and the parameter that holds the target.
WRAPPERS = (
    ("safelinks.protection.outlook.com", "url"), ("www.google.com", "q"), ("google.com", "q"), ("l.facebook.com", "u"), ("lm.facebook.com", "u"),
    ("urldefense.proofpoint.com", "u"), ("l.instagram.com", "u"), ("t.umblr.com", "z"), ("away.vk.com", "to"),
    ("www.youtube.com", "q"), ("slack-redir.net", "url"), ("click.linksynergy.com", "murl"), ("out.reddit.com", "url"),
)
#: Wrappers inside wrappers that are opened.
DEPTH = 5


def unwrap_once(url: Column) -> Column:
    """The target of a wrapped link; null where nothing is wrapped."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    target = F.lit(None).cast("string")
    for wrapper, key in reversed(WRAPPERS):
        inside = F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){key}=([^&]*)", 1))
        target = F.when((host == wrapper) | host.endswith(f".{wrapper}"), inside).otherwise(target)
    defended = F.regexp_extract(url, r"__(https?:.+?)__;", 1)
    target = F.when(host.rlike(r"(?:^|\.)urldefense\.com$"), defended).otherwise(target)
    return F.when(target.rlike("^https?://"), target)


def unwrap(url: Column, depth: int = DEPTH) -> Column:
    """Array of the link and what unwrapping reveals, outermost first."""
    start = F.array(url)

    def step(chain: Column, _: Column) -> Column:
        inner = unwrap_once(F.element_at(chain, -1))
        return F.when(inner.isNotNull(), F.concat(chain, F.array(inner))).otherwise(chain)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)


def base64_links(text: Column) -> Column:
    """Links hidden as base64: runs of its alphabet that decode to a link; lines of 76 signs, as mails and ``F.base64`` break them, are one run.

    Only a text that holds a link's first signs is cut into runs.
    """
    runs = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9+/_-]{76}\r?\n)+[A-Za-z0-9+/_-]+=*|[A-Za-z0-9+/_-]{17,}=*)"), F.lit(1))
    runs = F.when(~text.contains("aHR0c") & ~text.contains("SFRUU"), F.array().cast("array<string>")).otherwise(runs)
    found = F.filter(runs, lambda r: r.startswith("aHR0c") | r.startswith("SFRUU"))  # http and HTTP

    def decoded(x: Column) -> Column:
        plain = F.rtrim(F.translate(x, "-_\r\n", "+/"), F.lit("="))  # line breaks have no counterpart and go
        padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))
        return F.regexp_extract(F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"), r"^([hH][tT][tT][pP][sS]?://[\x21-\x7E]+)", 1)

    return F.filter(F.transform(found, decoded), lambda u: u.isNotNull() & (u != ""))


def script_count(word: Column) -> Column:
    """How many of the scripts Latin, Cyrillic, Greek, Armenian, Devanagari, Tamil occur."""
    scripts = ("Latin", "Cyrillic", "Greek", "Armenian", "Devanagari", "Tamil")
    return reduce(lambda a, b: a + b, [F.coalesce(word.rlike(rf"\p{{Is{s}}}").cast("int"), F.lit(0)) for s in scripts])


def mixed_script(host: Column) -> Column:
    """Whether any label mixes scripts."""
    return F.exists(F.split(host, r"\."), lambda x: script_count(x) > 1)


@pandas_udf(StringType())
def to_unicode(host: pd.Series) -> pd.Series:
    """Host with punycode labels as they display; broken labels stay. No built-in decodes punycode."""

    def label(x: str) -> str:
        try:
            return x[4:].encode("ascii").decode("punycode") if x.lower().startswith("xn--") else x
        except UnicodeError:
            return x

    return host.map(lambda h: None if h is None else ".".join(label(x) for x in h.split(".")))


@pandas_udf(StringType())
def to_ascii(host: pd.Series) -> pd.Series:
    """Host with each label that needs it as punycode; labels that have no such form stay. No built-in encodes punycode."""

    def label(x: str) -> str:
        try:
            return x if x.isascii() else x.encode("idna").decode("ascii")
        except UnicodeError:
            return x

    return host.map(lambda h: None if h is None else ".".join(label(x) for x in h.split(".")))


def script_features(host: Column) -> dict[str, Column]:
    """has_unicode and mixed_script of a host as it displays."""
    return {"has_unicode": F.coalesce(host.rlike(r"[^\x00-\x7F]"), F.lit(False)).cast("long"), "mixed_script": F.coalesce(mixed_script(host), F.lit(False)).cast("long")}


#: Signs that are put between letters; letters from which a spaced word is joined, and which one of a text's must have.
SPACERS, LEAST_LETTERS, LONG_LETTERS = " -_.*", 4, 5


def spaced_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words written letter by letter, such as f-r-e-e-d: alternating letters (ASCII) and single spacers.

    A scan over the text: from a letter that no letter or digit precedes it goes on as long as a spacer and a
    letter follow, and gives the last letter back if that one begins a word of its own.
    """
    out, i, n = [], 0, len(text)
    letter = lambda k: k < n and text[k].isascii() and text[k].isalpha()
    while i < n:
        end = i + 1
        if letter(i) and not (i and text[i - 1].isalnum()):
            while end < n and text[end] in SPACERS and letter(end + 1):
                end += 2
            while end > i + 1 and end < n and text[end].isalnum():
                end -= 2
            if end - i >= 2 * LEAST_LETTERS - 1:
                out.append((i, end))
        i = end
    return out


def unspaced(text: str) -> str:
    """The text with its spaced words joined, if one of them is long."""
    found = spaced_words(text)
    if not any(b - a >= 2 * LONG_LETTERS - 1 for a, b in found):
        return text
    pieces, at = [], 0
    for a, b in found:
        pieces += [text[at:a], text[a:b:2]]
        at = b
    return "".join([*pieces, text[at:]])


@pandas_udf(StringType())
def join_spaced(text: pd.Series) -> pd.Series:
    """Spaced-out letters joined (``unspaced``); no built-in scans so. Texts without a spacer between two letters stay as they are."""
    return text.map(lambda t: t if t is None else unspaced(t))


def offline_check(p: dict[str, Column]) -> Column:
    """FLAG for what needs no reputation data: address literals, punycode, user names; else null."""
    bad = p["host"].rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^\[") | p["host"].rlike(r"(?:^|\.)xn--") | (p["userinfo"] != "")
    return F.when(bad, "FLAG")
