"""Runs, repeated substrings and vector codes against brute force, and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, empty, odd, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import codes, runs, substrings, suffixes


def runs_by_trying(words):
    """All (start, length, period): every period, every stretch."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                best.setdefault((i, j - i + p), p)  # periods come in rising order
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in best.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text("ab", min_size=1, max_size=1), st.text("abc", min_size=1, max_size=1)), max_size=60), max_size=4), st.integers(1, 5), st.integers(1, 9))
def test_runs_are_those_found_by_trying(texts, period, times):
    texts = [[*t, *(t[:period] * times), *t[:2]] for t in texts]
    ids, first, _ = runs.interned(pa.array([" ".join(t) for t in texts], pa.string()))
    got = runs.find_runs(ids, first)
    assert [(k, (s, length, p)) for k, t in enumerate(texts) for s, length, p in sorted(runs_by_trying(t), key=lambda r: (r[0], r[2]))] == got


def test_long_repeats_are_linear():
    texts = ["a " * 30_000, "a b " * 20_000, " ".join(map(str, range(5000))) + " " + "x y z " * 9000]
    ids, first, _ = runs.interned(pa.array(texts, pa.string()))
    assert runs.find_runs(ids, first) == [(0, (0, 30_000, 1)), (1, (0, 40_000, 2)), (2, (5000, 27_000, 3))]


def test_words_are_stretches_without_ascii_white_space():
    texts = [None, "", " \t\n\v\f\r", "a\vb\fc d  e\n", "é é"]
    ids, first, flat = runs.interned(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [0, 0, 0, 4, 2] and flat.to_pylist() == ["a", "b", "c d", "e", "é", "é"] and ids[-1] == ids[-2]


def replayed(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or i is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def test_word_runs_of_documents(spark, tmp_path):
    from wardline.llm.queries import op11_word_runs

    rng = random.Random(5)
    rows = [(k, prose(k, rng.randrange(0, 90)), "en", "s", 1) for k in range(150)] + [r for r in odd_rows() if r[0] != 1]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    expect = []
    for i, text, *_ in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        words = replayed(i, words)
        found = runs_by_trying(words) if len(words) < 3000 else []
        found = sorted(found, key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        drop = {k for s, length, p in found for k in range(s + p, s + length)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expect.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in drop))))
    long = {r[0] for r in rows if r[1] and len(r[1].split()) >= 3000}
    got = [tuple(r) for r in op11_word_runs(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    assert sorted(map(str, (r for r in got if r[0] not in long))) == sorted(map(str, (r for r in expect if r[0] not in long)))


def test_collapse_of_odd_rows(spark):
    docs = odd(spark)
    rows = runs.collapse(docs).collect()
    assert len(rows) == docs.count() and all(r["collapsed"] is not None for r in rows)
    assert runs.collapse(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_suffixes_are_in_order(symbols, wide):
    suffixes.WIDE, old = (10.0, suffixes.WIDE) if wide else (0.0, suffixes.WIDE)
    try:
        s = np.array([*symbols, 0], np.uint16)
        order = suffixes.suffix_array(s, 5)
    finally:
        suffixes.WIDE = old
    whole = s.tolist()
    assert order.tolist() == sorted(range(len(s)), key=lambda k: whole[k:])
    prefix = suffixes.common_prefixes(s, order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        k = 0
        while whole[a + k] == whole[b + k]:
            k += 1
        assert prefix[b] == k


def kept_by_trying(rows):
    """Bytes that stay of each text: every window of 100 bytes looked up among all earlier ones; rows are in order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = hash(raw[k : k + 100]), raw[k : k + 100]
            if w in seen:
                covered[k : k + 100] = b"\1" * 100
            seen.add(w)
        out.append(bytes(c for c, x in zip(raw, covered, strict=True) if not x))
    return out


@pytest.mark.parametrize("sets", [1024, 2])
def test_repeats_are_those_found_by_trying(spark, monkeypatch, sets):
    """Shared passages, copies, near copies, low variety; with few different segments an anchor, its segments are halved."""
    monkeypatch.setattr(substrings, "SETS", sets)
    rng, passage, rows = random.Random(3), prose(91, 40), []
    for k in range(60):
        t = prose(k, rng.randrange(5, 30))
        t = f"{t} {passage} {prose(k + 500, 6)}" if k % 2 else t
        t = rows[-1][1] if k % 10 == 9 else t
        t = rows[-1][1].replace("word1", "wörd1", 1) if k % 11 == 10 else t
        rows.append((k, "z" * rng.randrange(40, 300) + t if k % 13 == 0 else t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    for (k, text), left in zip(rows, kept_by_trying(rows), strict=True):
        raw = text.encode()
        assert bytes(got[k]["kept"]) == left and got[k]["n_bytes"] == len(raw)
        assert len(left) == len(raw) - sum(s["end"] - s["start"] for s in got[k]["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(got[k]["spans"], got[k]["spans"][1:], strict=False))


def test_repeats_of_odd_rows(spark):
    docs = odd(spark)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    of = lambda k: sorted(len(r["kept"]) for r in got if r["doc_id"] == k)
    assert of(1)[0] == 0 and of(2) == [0] and of(3) == of(4) == [0] and of(7) == [1]  # copies go; of one sign repeated only the first byte is in no repeat
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_one_string_in_all_texts(spark):
    """Very many texts with one passage and one beginning: nothing grows with the square of their number."""
    passage = prose(7, 30)
    rows = [(k, f"{passage} {prose(k, 8)}") for k in range(800)]
    got = {r["doc_id"]: len(r["kept"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == len(rows[0][1]) and all(got[k] <= len(rows[k][1]) - len(passage) for k in range(1, 800))


def nearest_by_trying(points, entries):
    d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 70), st.integers(1, 5), st.integers(1, 40))
def test_exponion_search_finds_the_nearest(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (50, width))
    got = codes.nearest(points, codes.codebook(entries), rng.integers(0, k, 50))
    want = nearest_by_trying(points, entries)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_codes_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(2)
    whole = [(k, [float(x) for x in rng.normal(0, 0.3, 32)], int(k % 3)) for k in range(90)]
    bad = [(200, None, 1), (201, [float("nan")] * 32, 1), (202, [None] * 32, 1), (203, [0.5] * 7, 1), (204, [], 1), (205, [float("inf")] * 32, None)]
    rows = [*whole, *bad, whole[5], (None, [0.1] * 32, None)]
    got, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), keep=("label",), entries=8)
    kept = [*whole, whole[5], (None, [0.1] * 32, None)]
    points = np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 256).astype(np.int64).reshape(len(kept), 16, 2)
    start = np.concatenate([points[:6], points[5:6], points[6:7]])  # the repeated row counts twice
    books2 = [start[:, p] for p in range(16)]
    for _ in range(2):
        found = [nearest_by_trying(points[:, p], books2[p])[0] for p in range(16)]
        books2 = [np.stack([points[f == e, p].sum(0) // (f == e).sum() if (f == e).any() else b[e] for e in range(8)]) for p, (f, b) in enumerate(zip(found, books2, strict=True))]
    assert books.tolist() == np.stack(books2).tolist()
    final = [nearest_by_trying(points[:, p], books2[p]) for p in range(16)]
    want = sorted(str((r[0], r[2], [int(f[0][i]) for f in final], int(sum(f[1][i] for f in final)))) for i, r in enumerate(kept))
    out = got.collect()
    assert sorted(str((r["vec_id"], r["label"], list(r["code"]), r["error"])) for r in out) == want
    by = codes.error_by(got, "label").collect()
    for label in (0, 1, 2, None):
        assert {r["label_error"] for r in by if r["label"] == label} == {sum(r["error"] for r in out if r["label"] == label)}
    near = codes.decode(got, books).filter("vec_id = 3").first()["approximate"]
    assert len(near) == 32 and np.abs(np.array(near) - np.array(whole[3][1])).max() < 1.5


def test_codes_of_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [0.5] * 16)], "vec_id long, embedding array<double>").selectExpr("*", "1 as code", "2 as error", "3 as __point")
    got, books = codes.compress(one)
    assert [list(r["code"]) for r in got.collect()] == [[0] * 16] and books.shape == (16, 1, 1)
    got, books = codes.compress(one.filter("false"))
    assert got.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(one, entries=0)
