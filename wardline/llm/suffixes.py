"""Suffix arrays by induced sorting, and permuted common prefixes, over arrays of symbols.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost-smaller
ones (LMS) cut the text into substrings, which are sorted by induction and named; if names repeat, the
string of names is sorted in the same way. From the sorted LMS suffixes all others follow in two scans.
Over few symbols a scan takes a bucket at a time as an array; over many, as in the strings of names, suffix by suffix.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Symbols for each suffix below which a bucket is long enough to be scanned as an array.
WIDE = 1 / 64


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is by definition."""
    change = np.flatnonzero(s[1:] != s[:-1])
    return np.append(np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1)), True)


def _bounds(s: np.ndarray, symbols: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that ``lms`` induces, a bucket at a time."""
    bound = _bounds(s, symbols)
    out = np.empty(len(s), np.int64)
    own = s[lms]
    lms = lms[np.argsort(own, kind="stable")]
    cut = _bounds(own, symbols)

    def put(before: np.ndarray, keys: np.ndarray, cursor: np.ndarray, sign: int) -> None:
        """Hand each suffix, in scanning order, the next free place of its bucket."""
        order = np.argsort(keys, kind="stable")
        count = np.bincount(keys, minlength=symbols)
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        keys = keys[order]
        out[cursor[keys] + (rank if sign > 0 else -1 - rank)] = before[order]
        cursor += sign * count

    def push(items: np.ndarray, wanted: bool, cursor: np.ndarray, sign: int) -> None:
        before = items[items > 0] - 1
        before = before[small[before] == wanted]
        if len(before):
            put(before, s[before], cursor, sign)

    head = bound[:-1].copy()
    for c in range(symbols):
        at = bound[c]
        while at < head[c]:  # suffixes of one symbol's run come one after the other
            end = head[c]
            push(out[at:end], False, head, 1)
            at = end
        push(lms[cut[c] : cut[c + 1]], False, head, 1)
    tail = bound[1:].copy()
    for c in range(symbols - 1, -1, -1):
        at = bound[c + 1]
        while at > tail[c]:
            end = tail[c]
            push(out[end:at][::-1], True, tail, -1)
            at = end
        push(out[bound[c] : head[c]][::-1], True, tail, -1)
        if c == 0:
            out[0] = len(s) - 1
    return out


def _induce_singly(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The same, suffix by suffix. A free place holds 0, which has no predecessor and so induces nothing."""
    packed = lambda x: array("i", x.astype(np.int32).tobytes())  # noqa: E731 - no object for each number
    text, smaller, bound = packed(s), small.tobytes(), _bounds(s, symbols)
    out, tail, head = packed(np.zeros(len(s))), packed(bound[1:]), packed(bound[:-1])
    for i in packed(lms[::-1]):
        c = text[i]
        k = tail[c] - 1
        tail[c], out[k] = k, i
    for i in out:  # sees what the loop itself puts further on
        if i and not smaller[i - 1]:
            c = text[i - 1]
            k = head[c]
            out[k], head[c] = i - 1, k + 1
    tail = packed(bound[1:])
    for i in reversed(out):
        if i and smaller[i - 1]:
            c = text[i - 1]
            k = tail[c] - 1
            tail[c], out[k] = k, i - 1
    out[0] = len(s) - 1
    return np.frombuffer(out, np.int32).astype(np.int64)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of each LMS substring in text order, number of names); equal substrings share one."""
    length = np.zeros(len(s), np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        like = s[a[live] + k] == s[b[live] + k]
        same[live[~like]] = False
        k += 1
        live = live[like]
        live = live[length[a[live]] > k]
    name = np.zeros(len(s), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(len(order) - same.sum())


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; ``s`` ends with 0, which it holds nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _smaller(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    induce = _induce_buckets if symbols <= n * WIDE else _induce_singly
    order = induce(s, small, lms, symbols)
    order = order[is_lms[order]]
    names, k = _names(s, lms, order)
    if k < len(lms):
        order = lms[suffix_array(names, k)]
    return induce(s, small, order, symbols)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of ``s`` (16-bit symbols) the common prefix with the suffix before it in ``order``; 0 for the first.

    Where the symbols before both suffixes agree, the value is that of the place before less one; only elsewhere is it counted.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.uint64)
    four = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    counted = np.ones(n, bool)
    counted[1:] = (before[1:] <= 0) | (s[before[1:] - 1] != s[: n - 1])
    place = np.flatnonzero(counted)
    out = np.zeros(n, np.int64)
    live = place[before[place] >= 0]
    while len(live):
        a, b = live + out[live], before[live] + out[live]
        unlike = four[a] ^ four[b]
        more = np.where(unlike & np.uint64(0xFFFF), 0, np.where(unlike & np.uint64(0xFFFFFFFF), 1, np.where(unlike & np.uint64(0xFFFFFFFFFFFF), 2, 3)))
        whole = unlike == 0
        out[live] += np.where(whole, 4, more)
        live = live[whole]
    last = place[np.searchsorted(place, np.arange(n), "right") - 1]
    return np.maximum(0, out[last] - (np.arange(n) - last))
