"""Phrases in texts, all of them in one pass of an automaton, with their places."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: A word that is a number; its first digit is looked for before what stands around it.
_NUMBER = re.compile(r"[0-9](?<![^ ][0-9])[0-9]*(?![^ ])")
_ASCII = {k: chr(k).lower() if chr(k).isalnum() else " " for k in range(128)}

# Look-alike letters and digits, and what they look like; pairs of letters that look like one.
LOOKS_FROM, LOOKS_TO = "асеорхуіјѕԁԛԝӏοανικρτυ013457@$", "aceopxyijsdqwloavikptuoleastas"
LOOKS_PAIRS = (("rn", "m"), ("vv", "w"))
_LOOKS = str.maketrans(LOOKS_FROM, LOOKS_TO)

#: Phrases up to which an automaton is sent to the workers; more are joined instead (``operators.brands.claims``).
MOST_PHRASES = 200_000


def _folded(words: str) -> str:
    out = words.translate(_LOOKS)
    for pair, one in LOOKS_PAIRS:
        out = out.replace(pair, one)
    return out


@functools.cache
def _spelling() -> np.ndarray:
    """What each code point is spelled as: signs of words as themselves, A-Z in lower case, all others as a space."""
    every = np.arange(0x110000, dtype="<u4")
    out = np.full_like(every, 32)
    for m in _WORD.finditer("".join(map(chr, every.tolist()))):
        out[m.start() : m.end()] = every[m.start() : m.end()]
    out[65:91] += 32
    return out


def spelled(text: str, folded: bool = False) -> str:
    """The words of a text, A-Z in lower case, numbers as 0, one space between and around them; ``folded``: each word as what it looks like."""
    if text.isascii():
        signs = text.translate(_ASCII)
    else:
        signs = _spelling()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes().decode("utf-32-le")
    words = " ".join(signs.split())
    return f" {_folded(words) if folded else _NUMBER.sub('0', words)} "


@functools.cache
def automaton(phrases: tuple[str, ...], folded: bool = False):
    """An automaton whose values are (number of the phrase, its length with a space on either side)."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        key = spelled(p, folded)
        if key.strip():
            made.add_word(key, [*made.get(key, []), (k, len(key))])
    made.make_automaton()
    return made


def found(text: str, phrases: tuple[str, ...], folded: bool = False) -> Iterator[tuple[int, int, int]]:
    """(number of the phrase, first word, word after its last) of every place where a phrase's words stand, by end, then as the automaton tells."""
    machine = automaton(phrases, folded)
    if not len(machine):
        return
    words = spelled(text, folded)
    spaces = None
    for end, several in machine.iter(words):
        if spaces is None:
            spaces = [m.start() for m in re.finditer(" ", words)]
        for k, length in several:
            yield k, bisect_right(spaces, end - length + 1) - 1, bisect_right(spaces, end) - 1


def places(text: str, phrases: tuple[str, ...], folded: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, number of the phrase), in code points of the text itself, sorted."""
    hits = list(found(text, phrases, folded))
    if not hits:
        return []
    bounds = [m.span() for m in _WORD.finditer(text)]
    return sorted((bounds[a][0], bounds[b - 1][1], k) for k, a, b in hits)


def spans(text: Column, groups: tuple[tuple[str, tuple[str, ...]], ...], folded: bool = False) -> Column:
    """Array of (name, phrase, start, end) of all places where a phrase of a group (name, phrases) stands, sorted by start, end and phrase.

    Words are runs of letters, marks and digits; A-Z counts as a-z, a number as 0, and whatever is between words
    plays no part. ``folded`` compares words by what they look like. A null text gives null. One pass over a
    text, however many phrases there are; the automaton is made once a worker.
    """
    names = tuple(name for name, phrases in groups for _ in phrases)
    phrases = tuple(p for _, several in groups for p in several)
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases; join them by their words instead")
    kind = pa.struct([("name", pa.string()), ("phrase", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @arrow_udf("array<struct<name: string, phrase: string, start: int, end: int>>")
    def run(texts: pa.Array) -> pa.Array:
        out = [None if t is None else [(names[k], phrases[k], a, b) for a, b, k in places(t, phrases, folded)] for t in texts.to_pylist()]
        return pa.array([None if o is None else [dict(zip(("name", "phrase", "start", "end"), x, strict=True)) for x in o] for o in out], pa.list_(kind))

    return run(text)


def hits(text: Column, groups: tuple[tuple[str, float, tuple[str, ...]], ...], most: int = 3) -> Column:
    """Array of (id, weight, evidence) of the groups of which a phrase stands in a text, in their order; evidence is
    the first ``most`` different phrases by place. A null text gives null."""
    of = tuple(k for k, g in enumerate(groups) for _ in g[2])
    phrases = tuple(p for g in groups for p in g[2])
    kind = pa.struct([("id", pa.string()), ("weight", pa.float64()), ("evidence", pa.list_(pa.string()))])

    def one(text: str) -> list[dict]:
        by: dict[int, dict[str, None]] = {}
        for _, _, k in sorted((a, b, k) for k, a, b in found(text, phrases)):
            mine = by.setdefault(of[k], {})
            if len(mine) < most:
                mine.setdefault(phrases[k])
        return [{"id": groups[g][0], "weight": groups[g][1], "evidence": list(by[g])} for g in sorted(by)]

    @arrow_udf("array<struct<id: string, weight: double, evidence: array<string>>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.list_(kind))

    return run(text)


def exists(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase stands in a text."""
    return F.coalesce(F.size(spans(text, (("any", phrases),))) > 0, F.lit(False))
