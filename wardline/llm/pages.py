"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import words as W
from wardline.llm.scratch import Scratch

# Elements by their part in a page.
SKIPPED = frozenset("script style noscript template iframe svg canvas audio video title select textarea datalist button annotation annotation-xml".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE = frozenset("header address label".split())  # boilerplate where no article is around
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("body article main section div td center blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MARKS = frozenset(
    "nav navbar navigation menu menus sidebar side-bar rail widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe subscription signup login search searchbox breadcrumb breadcrumbs pagination pager share sharing social related recommended popular "
    "trending comment comments disqus replies respond reply footer foot masthead topbar toolbar header popup modal overlay skip-link copyright disclaimer toc tags tag-list".split()
)

# names that say so inside an article as well; others there may belong to the text, as header-note does
STRONG = frozenset(
    "nav navbar navigation menu menus sidebar side-bar ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter "
    "subscribe subscription breadcrumb breadcrumbs pagination pager share sharing social related comment comments disqus popup modal".split()
)
PHRASES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre td th caption figcaption span b i em strong a code summary".split())  # text-level: only a whole name tells

# what readers say below an article: the whole name is enough anywhere
COMMENTS = frozenset(
    "comment comments commentlist comment-list comments-list comment-section comments-section comments-area comment-thread comment-body commentary-list disqus disqus_thread replies reply-list responses "
    "respond reader-comments user-comments discussion-thread".split()
)
# with one of these a strong name says so inside an article as well: ad-slot, share-buttons; social-science and lunch-menu don't
COMPANIONS = frozenset(
    "area banner bar block box bottom btn button buttons card code column container content count footer form frame group header holder icon icons inline inner item items label left link links list main menu "
    "mobile module network overlay page panel popup post posts primary right row secondary section side site slot small stories strip text title tools top unit units widget wrap wrapper zone".split()
)
STATES = frozenset("has have no not with without is hide".split())  # pieces of names that tell what an element has beside it
LEFT_OPEN = {"article": frozenset("nav menu header".split()), "main": frozenset("nav menu header aside footer".split())}  # what can't hold such an element ends before it

_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
_TAG = re.compile(r"""(?s:(?P<comment>""" + _COMMENT + r"""))|(<(?:[/!?]|(?=[a-zA-Z]))(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<(?:[/!?]|(?=[a-zA-Z]))[^>]*(?:>|$))""")
# elements that end at their own end tag and nowhere else, whatever is in them
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in SKIPPED}
# what ends an open drawing, list of options or button as an end tag would
_BREAKS = {
    "svg": re.compile(r"<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|hr|i|img|li|menu|nobr|ol|p|pre|ruby|s|small|span|strike|strong|sub|sup|table|tt|u|ul|var)(?=[\s/>])", re.I),
    "select": re.compile(r"<(?:select|input|textarea)(?=[\s/>])", re.I),
    "button": re.compile(r"<(?:button|article|main|/form|/div|/p)(?=[\s/>])", re.I),
}
_INTEGRATION = re.compile(r"<(?:foreignobject|desc|title)(?=[\s/>])", re.I)  # parts of a drawing that hold blocks
_UNENDED = frozenset("script style noscript iframe title textarea".split())  # hide the rest of the page without an end tag
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
# one attribute after another: a name, and a value that may be quoted; what is in a value is no name
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/][^\s=<>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _attributes(tag: str) -> dict[str, str]:
    """Values by lower-cased name; of equal names the first counts, as in a browser."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, _NAME.match(tag).end()):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def _general(name: str, attributes: dict[str, str]) -> str:
    """Tag and classes without what changes from page to page: numbers and long codes."""
    classes = [c for c in re.split(r"\s+", attributes.get("class", "").lower()) if c and not re.search(r"\d{3,}|[0-9a-f]{8,}", c)]
    return name + "".join(f".{re.sub(r'[0-9]+', '#', c)}" for c in sorted(set(classes)))


def _named(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id says that an element isn't the article; states such as has-sidebar say nothing.

    The whole name tells anywhere. Its first or last piece tells of elements that hold
    others; inside an article only if it is a strong one and the other piece is a companion. A header or a list of tags in
    an article is the article's own.
    """
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for token in value.lower().split():
            pieces = [p for p in re.split(r"[-_:]+", token) if p]
            if not pieces or STATES.intersection(pieces):
                continue
            if token in MARKS and not (in_article and token in ("header", "tags")):
                return True
            if name in PHRASES:
                continue
            if not in_article and not MARKS.isdisjoint((pieces[0], pieces[-1])):
                return True
            if in_article and not STRONG.isdisjoint((pieces[0], pieces[-1])) and all(p in STRONG or p in COMPANIONS or p.isdigit() for p in pieces):
                return True
    return False


def _comments(attributes: dict[str, str]) -> bool:
    """Whether a class or id names reader comments."""
    return any(token in COMMENTS for value in (attributes.get("class", ""), attributes.get("id", "")) for token in value.lower().split())


def _raw_end(name: str, page: str, at: int) -> int | None:
    """Where the content of a raw element ends; None if nothing ends it."""
    end = _RAW_END[name].search(page, at)
    if name in _BREAKS:
        m = _BREAKS[name].search(page, at, end.start() if end else len(page))
        if m and not (name == "svg" and _INTEGRATION.search(page, at, m.start())):
            return m.start()
    return end.end() if end else None


def _marked(name: str, attributes: dict[str, str], in_article: bool) -> str:
    """How an element is marked as not the article: "sure", "likely" (if its content agrees) or not at all."""
    if attributes:
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return "sure"
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            return "sure"
    if name == "form" or (name == "fieldset" and not in_article):
        return "likely"
    if name in BOILERPLATE or (name in OUTSIDE and not in_article):
        return "sure"
    if not attributes:
        return ""
    if attributes.get("role", "").lower() in ROLES:
        return "likely" if attributes["role"].lower() in ("form", "search") else "sure"
    if name in ("html", "body", "main") or (name == "article" and not in_article):
        return ""
    if _comments(attributes) and name not in PHRASES:
        return "sure"
    if name == "article":
        return ""
    return "likely" if _named(name, attributes, in_article) else ""


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(container path, text, characters in links) of each block of text outside boilerplate, in page order.

    A container path is the generalised names of the containers from the body inwards; a page without a body tag has one.
    Broken pages are read as far as they go: open elements end where the page ends.
    What is marked by its name alone stays if it holds all article and main elements of
    the page, or most of the text without links and no such element is outside of it.
    """
    page = page or ""
    stack: list[tuple[str, str | None, bool, int | None]] = []  # name, general name if a container, surely boilerplate, number among likely ones
    out: list[tuple[str, str, int, tuple[int, ...]]] = []
    likely: list[list[int]] = []  # articles and characters without links inside
    articles = 0
    text: list[str] = []
    linked, in_link, bad, article, at, unended = 0, 0, 0, 0, 0, set()

    def flush() -> None:
        nonlocal linked
        whole = " ".join(entities.unescape("".join(text)).split())
        if whole and not bad:
            inner = [s[1] for s in stack if s[1] and s[0] != "body"]
            within = tuple(s[3] for s in stack if s[3] is not None)
            for i in within:
                likely[i][1] += len(whole) - min(len(whole), linked)
            out.append(("/".join(["body", *inner]), whole, min(len(whole), linked), within))
        text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal bad, in_link, article
        while len(stack) > depth:
            name, _, boiler, _ = stack.pop()
            bad -= boiler
            in_link -= name == "a"
            article -= name in ("article", "main")

    while at < len(page):
        m = _TAG.search(page, at)
        between = page[at : m.start() if m else len(page)]
        if between:
            text.append(between)
            if in_link:
                linked += len(between.strip())
        if m is None:
            break
        at, part = m.end(), m[0]
        if m["comment"] is not None:
            text.append(" ")
            continue
        found = _NAME.match(part)
        if not found:
            continue
        name = found[1].lower()
        if part[1] == "/":
            if name in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # an end tag without its start inside the nearest container changes nothing
            if depth is not None and (name in CONTAINERS or name in BOILERPLATE or not any(s[1] for s in stack[depth + 1 :])):
                close(depth)
            continue
        if name in SKIPPED:
            if not part.endswith("/>"):
                end = None if name in unended else _raw_end(name, page, at)
                if end is not None:
                    at = end
                elif name in _UNENDED:
                    at = len(page)
                else:
                    unended.add(name)
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # what a block ends without an end tag
                if stack[i][0] == "p" or stack[i][0] in _IMPLIED.get(name, ()):
                    close(i)
                    break
                if stack[i][1] or stack[i][0] in BLOCKS:
                    break
        elif name == "br":
            text.append(" ")
        if name in VOID or name == "head" or part.endswith("/>"):
            continue
        if bad and name in LEFT_OPEN:
            depth = next((i for i, o in enumerate(stack) if o[0] in LEFT_OPEN[name]), None)
            if depth is not None:
                close(depth)
        attributes = _attributes(part) if " " in part or "\n" in part or "\t" in part else {}
        mark = _marked(name, attributes, article > 0)
        boiler = mark == "sure"
        general = _general(name, attributes) if name in CONTAINERS and not boiler else None
        stack.append((name, general, boiler, len(likely) if mark == "likely" else None))
        if mark == "likely":
            likely.append([0, 0])
        if name in ("article", "main") and not bad and not boiler and not _named(name, attributes, False):
            articles += 1
            for s in stack:
                if s[3] is not None:
                    likely[s[3]][0] += 1
        bad += boiler
        in_link += name == "a"
        article += name in ("article", "main")
    flush()
    total = sum(len(text) - linked for _, text, linked, _ in out)
    stays = [n == articles and (n > 0 or 2 * worth > total) for n, worth in likely]
    return [(path, text, linked) for path, text, linked, within in out if all(stays[i] for i in within)]


def page_votes(found: list[tuple[str, str, int]]) -> dict[str, float]:
    """Score of each container path of one page: its share of the page's text, links counting against it.

    Text counts for all containers around it. An article or main element adds a little,
    which decides between containers with the same text.
    """
    score: dict[str, float] = {}
    total = 0.0
    for path, text, linked in found:
        worth = max(0, len(text) - 2 * linked) * (1.0 if len(text) > 25 else 0.5)
        total += worth
        at = ""
        for name in path.split("/"):
            at = f"{at}/{name}" if at else name
            score[at] = score.get(at, 0.0) + worth
    return {p: s / total + 0.05 * (p.rsplit("/", 1)[-1].split(".")[0] in ("article", "main")) for p, s in score.items()} if total else {}


def choose(votes: dict[str, float], pages: float) -> str | None:
    """The deepest path whose mean score is close to the best one."""
    if not votes:
        return None
    close = [p for p, s in votes.items() if s / pages >= 0.8 * max(votes.values()) / pages]
    return max(close, key=lambda p: (p.count("/"), votes[p], p))


def _linky(found: list[tuple[str, str, int]]) -> bool:
    """Whether half of the text or more is in links."""
    return 2 * sum(linked for _, _, linked in found) >= sum(len(text) for _, text, _ in found)


def around(found: list[tuple[str, str, int]], path: str) -> list[str] | None:
    """Texts of the article whose core is the container path; None for a page that doesn't have it.

    Host votes find the core, which may be an inner part. The article is the outermost
    article or main element around it, or else the core. To that comes what stands beside
    it without being mostly links: text of the containers around it, sections and articles
    and, where neither article nor main tells the end, all of a wrapper inside the body.
    """
    names = path.split("/")
    tags = [n.split(".")[0] for n in names]
    top = next((i for i, t in enumerate(tags) if t in ("article", "main")), None)
    root = "/".join(names[: top + 1]) if top is not None else path
    if not any(p == root or p.startswith(root + "/") for p, _, _ in found):
        return None
    parent = root.rpartition("/")[0]
    outer = {"/".join(root.split("/")[:k]) for k in range(1, root.count("/") + 1)}
    siblings: dict[str, list[tuple[str, str, int]]] = {}
    for block in found:
        if parent and block[0].startswith(parent + "/"):
            siblings.setdefault(block[0][len(parent) + 1 :].split("/")[0], []).append(block)
    whole = top is None and parent not in ("", "body")
    beside = {n for n, inside in siblings.items() if (whole or n.split(".")[0] in ("section", "article", "main")) and not _linky(inside)}

    def kept(block: tuple[str, str, int]) -> bool:
        p = block[0]
        if p == root or p.startswith(root + "/"):
            return True
        if p in outer:
            return not _linky([block])
        return bool(parent) and p.startswith(parent + "/") and p[len(parent) + 1 :].split("/")[0] in beside

    return [b[1] for b in found if kept(b)]


def extract(page: str | None, path: str | None) -> str:
    """Text of the article around the container path; around the page's own best path where it has none there."""
    found = blocks(page)
    inside = around(found, path) if path else None
    if inside is None and found:
        own = choose(page_votes(found), 1.0)
        inside = around(found, own) if own else [t for _, t, _ in found]
    return "\n\n".join(inside or [])


def host_of(url) -> F.Column:
    """Host of a URL, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), F.lit("")))


#: Hosts up to which the chosen paths are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 50_000


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that wins the vote of each host's pages.

    Each page votes with its containers' scores; votes are summed by host and path, so
    a host with a third of all pages is a few rows for each task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 4 << 20, "html"):
            hosts, paths, scores = [], [], []
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                for path, s in page_votes(blocks(page.as_py())).items():
                    hosts.append(host), paths.append(path), scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, score double")
    total = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    best = total.groupBy("host").agg(F.max("score").alias("best"))
    depth = F.size(F.split("path", "/"))
    return total.join(best, "host").filter(F.col("score") >= 0.8 * F.col("best")).groupBy("host").agg(F.max(F.struct(depth.alias("depth"), "score", "path"))["path"].alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page of (page_id, url, html).

    Pages without a host vote among themselves. Null and empty pages give an empty
    text; pages without their host's container fall back on their own best one.
    Repeated rows give repeated results; other columns are left out.
    """
    winners = Scratch(pages.sparkSession).keep(host_paths(pages).withColumnRenamed("host", "__host").withColumnRenamed("path", "__path"))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = pages.select("page_id", "url", "html").join(winners, host_of(F.col("url")) == F.col("__host"), "left").select("page_id", "url", "html", F.col("__path").alias("path"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 4 << 20, "html"):
            texts = [extract(page.as_py(), path) for page, path in zip(b.column("html"), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, schema)
