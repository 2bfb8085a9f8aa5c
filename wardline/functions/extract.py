"""Links of messages and pages, with where each was found and whether its text lies about its target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import urls as U
from wardline.functions.obfuscation import base64_links, unwrap

#: A link in running text: with a scheme, or a host that starts with www.
_IN_TEXT = r"(?i)((?:https?|ftp)://[^\s<>\"'`{}|\\^]+|(?<![a-z0-9@./-])www\.[a-z0-9-]+\.[^\s<>\"'`{}|\\^]+)"
_MAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
#: What an attribute may be quoted by.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, however it is quoted; empty without it."""
    pattern = rf"(?is)\s{name}\s*=\s*{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def _decoded(value: Column) -> Column:
    """An attribute's value with the references that links hold."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), value)


def _found(values: Column, source: str, shown=None) -> Column:
    kind = "array<struct<raw:string,source:string,shown:string>>"
    return F.transform(values, lambda v: F.struct((v if shown is None else shown(v)[0]).alias("raw"), F.lit(source).alias("source"), (F.lit(None).cast("string") if shown is None else shown(v)[1]).alias("shown"))).cast(kind)


def candidates(text: Column, html: Column) -> Column:
    """Array of (raw, source, shown): targets of anchors (href, or button where it looks like one), buttons, forms and refreshes, links in text, links hidden as base64.

    A text without ``://`` and ``www.`` is not searched for links, one without ``@`` not for addresses.
    """
    html, text = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    plain = lambda a: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"(?is)^<a\b[^>]*>", ""), r"(?s)<[^>]*>", " "), r"\s+", " "))
    anchors = tags(r"(?is)<a\b[^>]*>.*?</a\s*>")
    is_button = lambda a: a.rlike(r"""(?is)^<a\b[^>]*\s(?:role\s*=\s*["']?button|class\s*=\s*["'][^"']*\b(?:btn|button)\b)""")
    target = lambda a: (_decoded(U.bound(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), lambda tag: _attribute(tag, "href"))), plain(a))
    of_anchors = U.bound(anchors, lambda several: F.concat(_found(F.filter(several, lambda a: ~is_button(a)), "href", target), _found(F.filter(several, is_button), "button", target)))
    clicks = F.transform(tags(r"(?is)<(?:button|input)\b[^>]*>"), lambda t: _decoded(F.concat(_attribute(t, "formaction"), F.regexp_extract(t, r"(?is)location(?:\.href)?\s*=\s*[\x27\"]?([^\x27\"\s;>]+)", 1))))
    forms = F.transform(tags(r"(?is)<form\b[^>]*>"), lambda t: _decoded(_attribute(t, "action")))
    refresh = F.transform(F.filter(tags(r"(?is)<meta\b[^>]*>"), lambda t: t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh")), lambda t: _decoded(F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*[\x27\"]?([^\x27\"\s]+)", 1)))
    said = F.regexp_extract_all(F.when(text.contains("@"), F.regexp_replace(text, _MAIL, " ")).otherwise(text), F.lit(_IN_TEXT), F.lit(1))
    said = F.when(text.contains("://") | text.rlike(r"(?i)www\."), said).otherwise(F.array().cast("array<string>"))
    return F.concat(of_anchors, _found(clicks, "button"), _found(forms, "form"), _found(refresh, "redirect"), _found(said, "text"), _found(base64_links(text), "base64"))


def message_links(messages: DataFrame, key: str = "id", most: int | None = None) -> DataFrame:
    """(key, url, host, registrable, sources, shown, deceptive) of messages (key, text, html): each link once.

    ``sources`` says where a link was found, sorted; what a wrapper hides is a link of source
    unwrapped. ``deceptive`` is true where the text of a link names another registrable domain.
    Mail, phone and page-internal targets are left out; ``most`` keeps the first ones of a message.
    """
    each = messages.select(key, F.posexplode(candidates(F.col("text"), F.col("html"))).alias("at", "c")).select(key, "at", "c.*")
    raw = F.regexp_replace(F.trim("raw"), r"[.,;:!?'\")\]}>]+$", "")
    raw = F.when(F.lower(raw).contains("%3a%2f%2f"), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)
    each = each.withColumn("raw", raw).filter((F.col("raw") != "") & ~F.col("raw").rlike(r"(?i)^(?:mailto:|tel:|cid:|#|/|\?)"))
    opened = each.select(key, "at", "source", "shown", F.posexplode(F.when(F.col("raw").rlike("(?i)^(?:javascript|data):"), F.array(F.substring("raw", 1, 80))).otherwise(unwrap(F.col("raw")))).alias("depth", "u"))
    p = U.parse(F.col("u"))
    script = F.col("u").rlike("(?i)^(?:javascript|data):")
    links = opened.select(
        key, "at", "depth", F.when(F.col("depth") > 0, "unwrapped").otherwise(F.col("source")).alias("source"), F.when(F.col("depth") == 0, F.col("shown")).alias("shown"),
        F.when(script, F.col("u")).otherwise(p["normalized"]).alias("url"), F.when(~script, p["host"]).alias("host"),
    ).filter("url is not null")
    said = F.lower(F.regexp_extract("shown", r"(?i)(?:https?://|www\.|^\s*)((?:[a-z0-9-]+\.)+[a-z]{2,})", 1))
    links = links.withColumn("registrable", U.registrable(F.col("host"))).withColumn("lies", (said != "") & (U.registrable(said) != F.col("registrable")))
    first = F.struct("at", "depth")
    out = links.groupBy(key, "url").agg(
        F.first("host").alias("host"), F.first("registrable").alias("registrable"), F.array_sort(F.collect_set("source")).alias("sources"), F.min_by(F.nullif("shown", F.lit("")), F.when(F.col("shown") != "", first)).alias("shown"),
        F.coalesce(F.bool_or("lies"), F.lit(False)).alias("deceptive"), F.min(first).alias("__first"),
    )
    if most is not None:
        out = out.selectExpr("*", f"row_number() over (partition by {key} order by __first) as __r").filter(F.col("__r") <= most).drop("__r")
    return out.drop("__first")


#: Rules that take a link's reputation away whatever else holds.
UNTRUSTED = ("userinfo", "executable", "deceptive_link_text")


def all_link_rules(p: dict[str, Column], f: dict[str, Column], brand: Column | None = None, mixed: Column | None = None, named_brand: Column | None = None, deceptive: Column | None = None, wrapped: Column | None = None) -> list[tuple[str, float | Column, Column]]:
    """All rules: those of the features, and those that need more.

    ``brand`` is the best finding (kind, confidence) of the host, ``mixed`` whether a label mixes scripts, ``named_brand``
    whether a free host's page names a brand of another family, ``deceptive`` and ``wrapped`` are of the extraction.
    """
    rules: list[tuple[str, float | Column, Column]] = list(U.link_rules(p, f))
    extra = [("mixed_script", 0.45, mixed), ("brand_on_user_content", 0.62, None if named_brand is None else (f["free_hosting"] > 0) & named_brand), ("deceptive_link_text", 0.55, deceptive), ("wrapped", 0.04, wrapped)]
    rules += [(i, w, F.coalesce(c, F.lit(False))) for i, w, c in extra if c is not None]
    if brand is not None:
        rules.insert(1, ("brand", brand["confidence"], brand.isNotNull()))
    return rules


def user_content(host: Column) -> Column:
    """Whether a host is somebody's page on a platform where anybody can publish, and not the platform's own."""
    from wardline import refdata

    own = reduce(lambda a, b: a | b, [(host == r) | (host == f"www.{r}") for r in refdata.FREE_HOSTING])
    return U.has_suffix(host, refdata.FREE_HOSTING) & ~own


def trusted_link(official: Column, established: Column, host: Column, rules: Column) -> Column:
    """Official or established, not user content, and none of UNTRUSTED: only hard rules can flag such a link."""
    known = F.coalesce(official, F.lit(False)) | F.coalesce(established, F.lit(False))
    return known & ~user_content(host) & ~F.exists(rules, lambda r: r["id"].isin(*UNTRUSTED))
