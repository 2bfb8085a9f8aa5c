"""HTML expressions: links and plain text by regular expressions, all built-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that end a line of text.
_BLOCKS = r"(?i)<(br|/?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header))[^>]*>"
#: Elements whose content is not text.
_HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->"
#: Character references of the shipped subset; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def anchor_targets(html: Column) -> Column:
    """Targets of the anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def anchors(html: Column) -> Column:
    """(href, text) of the anchors whose text holds no markup."""
    pattern = F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))


def resolve(href: Column, scheme: Column, host: Column) -> Column:
    """A target that starts at the root, made absolute."""
    return F.when(href.startswith("/"), F.concat(scheme, F.lit("://"), host, href)).otherwise(href)


def deceptive(href_host: Column, text: Column) -> Column:
    """Whether a link's text names another host than its target."""
    shown = F.lower(F.regexp_extract(F.trim(text), r"^(?:https?://)?((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?:[/:?#].*)?$", 1))
    return (shown != "") & (shown != href_host) & ~href_host.endswith(F.concat(F.lit("."), shown))


def html_to_text(html: Column) -> Column:
    """Text without hidden elements and markup, references decoded, white space squeezed."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), _BLOCKS, "\n"), "<[^>]*>", "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.trim(F.regexp_replace(text, r"[ \t\n]+", " "))
