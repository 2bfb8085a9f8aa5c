"""Array kernels that turn a batch of texts into word hashes, starts and shingles.

The kernels work on the UTF-8 bytes of an Arrow string array, a bounded piece at a
time, so that no Python object is made per word. Word separators are ASCII bytes in
every tokenisation used here, and ASCII bytes never occur inside a multi-byte
character, so splitting bytes and splitting code points agree.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text handled at once; a single word longer than this still works.
PIECE_BYTES = 1 << 19

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2F  # 3 modulo 4: keeps differences of powers nearly free of factors of two


def byte_class(separators: bytes) -> np.ndarray:
    """Boolean table over byte values: True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

#: 1 for letters, digits and everything beyond ASCII, 2 for the signs between: runs of either kind are words.
SIGN_WORDS = np.where(np.isin(np.arange(256), [32, 9, 10, 11, 12, 13]), 0, 2).astype(np.uint8)
SIGN_WORDS[48:58] = SIGN_WORDS[65:91] = SIGN_WORDS[97:123] = SIGN_WORDS[128:] = 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix((np.arange(1, 257, dtype=np.uint64) * _MULT))
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        steps = np.full(size, _U(_BASE), dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of a batch of texts, in order; ``doc`` is non-decreasing."""

    hash: np.ndarray  # uint64
    doc: np.ndarray  # int64, index of the text in the batch
    start: np.ndarray  # int64, byte offset of the word in ``data``
    length: np.ndarray  # int64, bytes
    data: np.ndarray  # uint8, lower-cased bytes of all texts
    first: np.ndarray  # int64, n_texts + 1 bounds of each text's words

    def text(self, i: int) -> str:
        a = self.start[i]
        return self.data[a : a + self.length[i]].tobytes().decode("utf-8", "replace")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """Words of each text: maximal runs of bytes to which ``table`` gives one class, 0 (False) being none.

    ``lower`` turns A-Z to a-z first. Null and empty texts have no words. Equal
    words have equal hashes in every process; the hash covers the whole word.
    """
    raw, off = utf8(texts)
    n = len(raw)
    data = np.empty(n, np.uint8)
    hashes, starts, lengths = [], [], []
    at = 0
    bounds = off[1:-1]
    while at < n:
        end = min(n, at + PIECE_BYTES)
        # a piece ends before a word starts: at a text's end or at a separator
        while end < n:
            k = np.searchsorted(off, end, "right") - 1
            cut = off[k]
            inside = raw[max(at, cut) : end]
            sep = np.flatnonzero(table[_LOWER[inside] if lower else inside] == 0)
            if len(sep):
                end = max(at, cut) + int(sep[-1]) + 1
                break
            if cut > at:
                end = int(cut)
                break
            end = min(n, end + PIECE_BYTES)
        piece = raw[at:end]
        if lower:
            piece = _LOWER[piece]
        data[at:end] = piece
        kind = table[piece]
        is_word = kind > 0
        begin = is_word.copy()
        begin[1:] &= kind[1:] != kind[:-1]
        lo, hi = np.searchsorted(bounds, [at, end])
        inner = bounds[lo:hi] - at
        begin[inner] = is_word[inner]
        idx = np.flatnonzero(is_word)
        if len(idx):
            s = np.flatnonzero(begin)
            first = np.searchsorted(idx, s)
            length = np.diff(np.append(first, len(idx)))
            pos = np.arange(len(idx)) - np.repeat(first, length)
            value = _BYTE_VALUES[piece[idx]] * _power_table(int(length.max()))[pos]
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _MULT))
            starts.append(s + at)
            lengths.append(length)
        at = end
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    return Words(
        hash=np.concatenate(hashes) if hashes else empty.astype(np.uint64),
        doc=np.searchsorted(off, start, "right") - 1 if len(start) else empty,
        start=start,
        length=np.concatenate(lengths) if lengths else empty,
        data=data,
        first=np.searchsorted(start, off),
    )


def prefix_hash(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of the words ``at``, each at least so long; unlike any word's own hash."""
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total += _BYTE_VALUES[w.data[w.start[at] + k]] * _power_table(size)[k]
    return mix(total + np.full(1, size, np.uint64) * _MULT + _U(0x5BD1E995))


def hash_words(items: list[str], table: np.ndarray = SPACE_WORDS) -> np.ndarray:
    """Hashes of single words; each item must be one word of ``table``."""
    w = words(pa.array(items, pa.string()), table)
    if len(w.hash) != len(items):
        raise ValueError("each item must be exactly one word")
    return w.hash


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of several hash arrays of one length."""
    out = columns[0].copy()
    for c in columns[1:]:
        out *= _MULT
        out += c
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text index and word index of every run of ``size`` words in one text.

    A text with fewer words gives one shingle of its whole sequence, and none if it
    has no words.
    """
    n = len(w.hash)
    m = max(0, n - size + 1)
    whole = combine([w.hash[k : k + m] for k in range(size)]) if m else np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:m] == w.doc[size - 1 : size - 1 + m]) if m else np.zeros(0, np.int64)
    h, d, p = whole[at], w.doc[at], at
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = [combine([w.hash[i : i + 1] for i in range(w.first[k], w.first[k + 1])])[0] ^ _U(count[k]) for k in short]
        h = np.concatenate([h, np.array(extra, dtype=np.uint64)])
        d = np.concatenate([d, short])
        p = np.concatenate([p, w.first[short]])
        order = np.lexsort((p, d))
        h, d, p = h[order], d[order], p[order]
    return h, d, p


def distinct_by_doc(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, end to end, and n_docs + 1 bounds; ``d`` is sorted."""
    h, cut = h.copy(), np.searchsorted(d, np.arange(n_docs + 1))
    for k in np.flatnonzero(np.diff(cut) > 1):
        h[cut[k] : cut[k + 1]].sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Arrow list array of ``values`` cut at ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


@functools.cache
def _lean() -> None:
    """Have this worker give freed arrays back to the system at once, so that its size is what it holds."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 17)  # arrays from 128 KB up are maps of their own
    except (OSError, AttributeError):  # another C library than glibc
        return


def batches(it: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, column: str = "text", lean: bool = True) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` has at most ``max_bytes``, one row at least.

    ``lean`` is for kernels with large arrays; many passes over small ones are faster where the worker keeps their room.
    """
    if lean:
        _lean()
    for batch in it:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
