"""HTML read as a stream of tags with a stack of open elements: what is seen, what is hidden, forms and fields."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Elements by what they do to text.
WITHOUT_TEXT = frozenset("script style template noscript head title object iframe svg".split())
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINES = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul option".split()
)
#: Declarations of a style that hide what is inside, as name and value without spaces.
UNSEEN = (("display", "none"), ("visibility", "hidden"), ("opacity", "0"), ("font-size", "0"), ("max-height", "0"), ("mso-hide", "all"))

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/!?][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/][^\s=<>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: A number without a unit worth anything: 0, 0px, 0.0em.
_NOTHING = re.compile(r"0(?:\.0*)?(?:px|em|rem|pt|%)?")


def attributes(source: str) -> dict[str, str]:
    """Values by lower-cased name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


def unseen(name: str, own: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    if "hidden" in own or (name == "input" and own.get("type", "").lower() == "hidden"):
        return True
    for declaration in own.get("style", "").lower().split(";"):
        key, _, value = declaration.partition(":")
        key, value = key.strip(), value.replace("!important", "").strip()
        if (key, value) in UNSEEN or (key in ("opacity", "font-size", "max-height") and _NOTHING.fullmatch(value)):
            return True
    return False


def read(page: str | None) -> dict:
    """(text, hidden, forms, passwords, fields, buttons, actions) of a page.

    ``text`` is what is seen: white space in a line is one space, blocks and breaks end lines, empty lines go. ``hidden``
    is the text inside elements that their style or attribute hides. Elements end with their end tag, with the end of an
    element around them, or with the page. Character references are all decoded. A null page is an empty one.
    """
    page = page or ""
    seen: list[str] = []
    away: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, hides, holds no text
    hides = mute = 0
    counts = {"forms": 0, "passwords": 0, "fields": 0}
    buttons: list[list[str]] = []
    actions: list[str] = []
    in_button = at = 0

    def text(raw: str) -> None:
        if raw and not mute:
            (away if hides else seen).append(unescape(raw))
            if in_button and not hides:
                buttons[-1].append(unescape(raw))

    while at < len(page):
        m = _TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in LINES:
            seen.append("\n")
            away.append("\n")
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                for gone, hid, muted in stack[depth:]:
                    hides, mute, in_button = hides - hid, mute - muted, in_button - (gone == "button")
                del stack[depth:]
            continue
        own = attributes(m[3]) if m[3].strip(" /\t\n") else {}
        counts["forms"] += name == "form"
        if name == "form" and own.get("action"):
            actions.append(own["action"].strip())
        if name == "input":
            kind = own.get("type", "text").lower()
            counts["passwords"] += kind == "password"
            counts["fields"] += kind not in ("hidden", "submit", "button", "image", "reset")
            if kind in ("submit", "button") and own.get("value"):
                buttons.append([own["value"]])
        counts["fields"] += name in ("textarea", "select")
        if name in VOID or m[3].endswith("/"):
            continue
        hid, muted = unseen(name, own), name in WITHOUT_TEXT
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "textarea" and not hid:
                text(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
        stack.append((name, hid, muted))
        hides, mute = hides + hid, mute + muted
        if name == "button":
            buttons.append([])
            in_button += 1
    lines = lambda parts: "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)
    named = [" ".join("".join(b).split()) for b in buttons]
    return {"text": lines(seen), "hidden": lines(away), **counts, "buttons": [b for b in named if b], "actions": actions}


SHAPE = pa.struct([("text", pa.string()), ("hidden", pa.string()), ("forms", pa.int32()), ("passwords", pa.int32()), ("fields", pa.int32()), ("buttons", pa.list_(pa.string())), ("actions", pa.list_(pa.string()))])


def read_batch(pages: pa.Array) -> pa.Array:
    """``read`` of each page of a batch, as structs; pages that are alike, as those of a mailing, are read once."""
    coded = pages.dictionary_encode(null_encoding="encode")
    return pa.array([read(x) for x in coded.dictionary.to_pylist()], SHAPE).take(coded.indices)


def page_parts(html: Column) -> Column:
    """A struct of what a page shows, hides and asks for: ``read`` of each page, since no built-in keeps a stack."""

    @arrow_udf("struct<text: string, hidden: string, forms: int, passwords: int, fields: int, buttons: array<string>, actions: array<string>>")
    def run(pages: pa.Array) -> pa.Array:
        return read_batch(pages)

    return run(html)
