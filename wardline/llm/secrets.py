"""Secret scans: base patterns, and strings that zstandard can't predict from what is around them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import words as W

# The base kinds and their patterns.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: What may be a secret, and what near it makes it one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT = re.compile(r"(?i:passw|passwd|pwd|secret|token|api[_-]?key|auth|credential|bearer|private[_ -]?key|access[_ -]?key|client[_ -]?id)")
#: Code points before a candidate in which the context word stands, and around it that prime the compressor.
CONTEXT_REACH, SURROUNDING = 48, 2000
#: Marginal compressed bytes for each character from which a candidate counts as unpredictable.
NOVELTY = 0.6

#: Parts of the alphabet that the compressor knows whatever the corpus.
ALPHABET = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
#: An identifier or word that may enter the dictionary: no digits, so no candidate ever does.
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_-][A-Za-z]+)+|[A-Za-z]{6,40}")
#: Rows that hold an identifier of the dictionary at least, and the dictionary's bytes at most: the most frequent ones.
LEAST_ROWS, DICTIONARY_BYTES = 3, 8192


#: Sieves of RE2 that pass every text in which a span can be.
_SIEVE = r"(?i)passw|passwd|pwd|secret|token|api[_-]?key|auth|credential|bearer|private[_ -]?key|access[_ -]?key|client[_ -]?id|akia"


def _size(compressor: zstandard.ZstdCompressor, data: bytes) -> int:
    return len(compressor.compress(data))


def identifiers(docs: DataFrame, text: str = "text") -> str:
    """The corpus's identifiers: those that most rows name beside something sensitive, the most frequent last, where the compressor finds them best.

    Rows are counted over all documents, in partial sums; what comes to the driver is bounded by DICTIONARY_BYTES.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 4 << 20, text):
            col = pc.fill_null(b.column(text).cast(pa.large_string()), "")
            count: Counter[str] = Counter()
            for v in col.filter(pc.match_substring_regex(col, _SIEVE)):
                count.update(set(IDENTIFIER.findall(v.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "rows"])

    words = docs.select(text).mapInArrow(run, "word string, rows long").groupBy("word").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= LEAST_ROWS)
    out, room = [], DICTIONARY_BYTES
    for r in words.orderBy(F.desc("rows"), "word").limit(DICTIONARY_BYTES // 7).collect():
        room -= len(r["word"]) + 1
        if room < 0:
            break
        out.append(r["word"])
    return " ".join([ALPHABET, *reversed(out)])


def novelty(text: str, start: int, end: int, known: str = ALPHABET) -> float:
    """Marginal compressed bytes of text[start:end] for each character, given what surrounds it.

    The compressor is primed with the identifiers and the text around the candidate, so
    a string made of known pieces costs little and a random one about a byte a character.
    """
    around = known + "\n" + text[end : end + SURROUNDING] + "\n" + text[max(0, start - SURROUNDING) : start]
    primed = zstandard.ZstdCompressor(
        level=9, dict_data=zstandard.ZstdCompressionDict(around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = text[start:end].encode("utf-8", "replace")
    return max(0, _size(primed, data) - _size(primed, b"")) / max(1, len(data))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, known: list[tuple[int, int, int]], words: str = ALPHABET) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, novelty) of unpredictable strings in sensitive context, outside known spans, which are sorted by start.

    Strings of letters alone or of digits alone are words and numbers, not candidates.
    """
    found, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(known) and known[k][0] < b:
            reach = max(reach, known[k][2])
            k += 1
        if a < reach or not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]):
            continue
        if CONTEXT.search(text, max(0, a - CONTEXT_REACH), a) and (x := novelty(text, a, b, words)) >= NOVELTY:
            found.append((a, 3, b, x))
    return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each text: (key, n_assign, n_access, n_hex, base_sha256, spans, n_novel, novelty).

    Spans are kind:start:end in code points, end exclusive, sorted by start, then kind.
    novelty is the largest one of the novel spans, 0 without any. Null and empty texts have no
    spans; repeated rows give repeated results.
    """
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "novelty"]
    types = [T.LongType()] * 3 + [T.StringType()] * 2 + [T.LongType(), T.DoubleType()]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0.0)

    words = identifiers(docs, text)

    def one(value: str) -> tuple:
        base = base_spans(value)
        novel = novel_spans(value, base, words)
        spans = sorted([*base, *(n[:3] for n in novel)])
        count = [sum(k == kind for _, kind, _ in base) for k in range(3)]
        most = max([n[3] for n in novel], default=0.0)
        return (*count, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(novel), float(most))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.batches(it, 4 << 20, text):
            col = pc.fill_null(b.column(text).cast(pa.large_string()), "")
            maybe = pc.or_(pc.match_substring_regex(col, _SIEVE), pc.match_substring_regex(col, "[0-9a-f]{24}"))
            rows = [one(v.as_py()) if m else nothing for v, m in zip(col, maybe.to_pylist(), strict=True)]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], [key, *names])

    schema = T.StructType([docs.schema[key], *(T.StructField(a, t) for a, t in zip(names, types, strict=True))])
    return docs.select(key, text).mapInArrow(run, schema)
