"""Transcripts of screenshots: broken links mended, layouts read, entities and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import SENDERS

# Top-level domains that a link's broken end is known by.
ENDINGS = ("com", "net", "org", "in", "co", "info", "xyz", "top", "io", "app", "link", "site", "online")
#: What recognition takes t and s for in a scheme, and a colon for.
_T, _S, _COLON = "tl1i|", "s5$", ":;"


def repair_links(text: Column) -> Column:
    """Links as they were before recognition broke them: slips in the scheme, spaces around dots, links over two lines.

    In turn: a scheme with look-alike signs, up to one space between its signs and one slash at least, is written as
    it should be (without an s where none was read but the letter is, with one where the letter was misread); a link that ends in a sign that links don't end in
    is joined with the next line; a space beside the dot before one of ENDINGS goes.
    """
    slashes = " ?/ ?(?:/ ?)?"
    misread = rf"(?i)\bh[{_T}]{{2}}[{_T}]?p[{_S}]?[ ]?[{_COLON}]{slashes}"
    plain = rf"(?i)\bhttp[ ]?[{_COLON}]{slashes}"
    out = F.regexp_replace(text, rf"(?:{plain})", "http://")
    out = F.regexp_replace(out, rf"(?!(?i:http://)){misread}", "https://")
    out = F.regexp_replace(out, r"(?i)(\bhttps?://\S*[-/=?&_.])\s*\n\s*(?=\S)", "$1")
    begun = r"(?i)(\bhttps?://|\bwww\.)((?:[a-z0-9-]+\.)*[a-z0-9-]+)"
    return F.regexp_replace(out, rf"{begun}(?: \. ?|\. )(?=(?:{'|'.join(ENDINGS)})\b)", "$1$2.")


def layout(text: Column) -> Column:
    """(channel, sender, subject, body) of a transcript without frame lines.

    Mail has lines such as From: or Subject:, or a name before an address in angle brackets.
    A registered header or a phone number alone in the first line is a text message; a contact
    line with a presence mark is a chat. Anything else is a body of channel other.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.get(lines, F.lit(0))
    field = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*:\s*(.+)$", 1)), F.lit(""))
    labelled = text.rlike(r"(?im)^\s*(?:from|subject)\s*:")
    angled = F.get(F.filter(lines, lambda x: x.rlike(r"^[^<>]*<[^<>@\s]+@[^<>\s]+>$")), F.lit(0))
    sms = head.rlike(SENDERS)
    chat = F.get(lines, F.lit(1)).rlike(r"(?i)^(?:online|typing|last seen\b.*|business account)")
    rest = lambda n: F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")
    mail_body = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?i)^(?:from|to|cc|date|subject|sent)\s*:")), "\n")
    at = F.array_position(lines, angled).cast("int")
    kinds = [
        (labelled, "email", field("from"), field("subject"), mail_body),
        (angled.isNotNull(), "email", angled, F.when(at > 1, head), F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")),
        (F.coalesce(chat, F.lit(False)), "whatsapp", head, F.lit(None), rest(2)),
        (F.coalesce(sms, F.lit(False)), "sms", head, F.lit(None), rest(1)),
    ]
    named = lambda c, s, t, b: F.struct(F.lit(c).alias("channel"), s.cast("string").alias("sender"), t.cast("string").alias("subject"), b.alias("body"))
    out = named("other", F.lit(None), F.lit(None), F.array_join(lines, "\n"))
    for on, channel, sender, subject, body in reversed(kinds):
        out = F.when(on, named(channel, sender, subject, body)).otherwise(out)
    return out


def entities(text: Column) -> dict[str, Column]:
    """Amounts, codes, deadlines and registered headers that a message names, sorted and distinct."""
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1))))
    return {
        "amounts": found(r"(?i)((?:₹|\brs\.?|\binr|\$|€|£) ?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"), "codes": found(r"(?i)\b(?:otp|code|pin)\b[^0-9\n]{0,20}\b([0-9]{4,8})\b"),
        "deadlines": found(r"(?i)\b((?:within [0-9]+ (?:hours?|minutes?|days?))|(?:by|before) (?:today|tonight|tomorrow|[0-9]{1,2} ?(?:am|pm)))\b"), "headers": found(r"\b([A-Z]{2}-[A-Z0-9]{3,8}(?:-[A-Z])?)\b"),
    }


def warnings(text: Column, confidence: Column, brands: Column | None = None) -> Column:
    """What to tell with a transcript: low_confidence, too_short, no_link, spaced_letters, brand_without_sender."""
    body = F.coalesce(text, F.lit(""))
    rules = [
        ("low_confidence", confidence < 60), ("too_short", F.length(body) < 20), ("no_link", ~body.rlike(r"(?i)https?://|www\.")),
        ("spaced_letters", body.rlike(r"(?<![A-Za-z])[A-Za-z](?: [A-Za-z]){3,}(?![A-Za-z])")), ("brand_without_sender", F.size(brands) > 0 if brands is not None else F.lit(False)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in rules]), lambda w: w.isNotNull())
