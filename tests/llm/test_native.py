"""Mixing, sharding and fingerprints: built-in functions only."""

import hashlib
import math
import unicodedata
from collections import Counter

import pytest
from fixtures import SCHEMA, empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from wardline.llm import fingerprint, mixing, sharding


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def poisson(u: float, mean: float) -> int:
    k, term = 0, math.exp(-mean)
    total = term
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def draw(*parts) -> float:
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_mix_is_the_inverse_poisson_of_each_key(spark):
    rows = [(k, prose(k, 5), "en", "big" if k < 200 else "small", 1) for k in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, {"big": 1, "small": 30}, total=1240, seed=3)
    assert no_python(out)
    got = Counter(r["doc_id"] for r in out.collect())
    for k, _, _, source, _ in rows:
        rate = 1240.0 * (1 if source == "big" else 30) / 31 / (200 if source == "big" else 40)
        parts = max(1, math.ceil(rate / mixing.PART_MEAN))
        assert got.get(k, 0) == sum(poisson(draw(3, k, i), rate / parts) for i in range(1, parts + 1))
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys)


def test_mix_of_odd_rows(spark):
    out = mixing.mix(odd(spark), total=60, seed=1)
    assert set(odd(spark).columns) == set(out.columns)
    rows = out.collect()
    assert {r["source"] for r in rows} <= {"a", None} and all(r["copy"] >= 1 for r in rows)
    twice = Counter((r["doc_id"], r["copy"]) for r in rows if r["doc_id"] == 1)
    assert all(n == 2 for n in twice.values())
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(odd(spark), {"nobody": 1.0}).count() == 0


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    count = Counter(table)
    assert len(table) == 1009 and set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 6)
    assert moved < 1009 * 0.15
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_table_equals_turns_played_one_by_one():
    names, size = ["x", "y", "z"], 101
    order = {}
    for n in names:
        offset, skip = sharding._digest(f"offset:{n}") % size, sharding._digest(f"skip:{n}") % (size - 1) + 1
        order[n] = [(offset + k * skip) % size for k in range(size)]
    owner = {}
    while len(owner) < size:
        for k, n in enumerate(names):
            free = next((s for s in order[n] if s not in owner), None)
            if free is not None and len(owner) < size:
                owner[free] = k
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]


def test_placement_of_odd_rows(spark):
    docs = odd(spark)
    out = sharding.place(docs, ["a", "b", "c"])
    assert no_python(out)
    rows = out.collect()
    table = sharding.lookup_table(["a", "b", "c"])
    assert len(rows) == docs.count() and all(r["shard"] == "abc"[table[r["slot"]]] for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(empty(spark), ["a"]).count() == 0


def test_shards_are_written_apart(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(50)], SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "out"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def folded(t):
    t = t or ""
    if all(ord(c) < 128 for c in t):
        return " ".join(t.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def expected_fingerprints(rows):
    import xxhash

    rows = [(i, t or "") for i, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        canon = [folded(x) for x in (t, edited, nxt)]
        first = xxhash.xxh64(canon[0].encode(), seed=42).hexdigest()
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), first, float(canon[0] == canon[1]), float(canon[0] == canon[2]))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = [(k * 37, t) for k, t in enumerate([prose(1, 30), "Straße  STRASSE", "strasse\tstrasse", "", None, "ﬁne Å", "fine å", "abcd", "ABCD", "é" * 8, "é" * 8, prose(2, 3000)])]
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert no_python(out)
    got = {r["key"]: r for r in out.collect()}
    for i, (n, sha, first, near_edited, near_next) in expected_fingerprints(rows).items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"][:16], r["near_edited"], r["near_next"]) == (n, sha, first, near_edited, near_next), i
    prints = {i: r["fingerprint"] for i, r in got.items()}
    assert prints[37] == prints[74] and prints[111] == prints[148] and prints[5 * 37] == prints[6 * 37] and prints[7 * 37] == prints[8 * 37] and prints[9 * 37] == prints[10 * 37]
    assert got[74]["group_id"] == 37 and got[74]["group_size"] == 2


def test_white_space_folds(spark):
    texts = ["a b", "a  b", " a b ", "a \n b", "a\n\n b\t", "\u3000a\u00a0 b\x85", "a\x1cb", "a\u2003\u2003b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprint.canonical(F.col("t"))).collect()
    assert {r[0] for r in got} == {"a b"}


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 1)
    monkeypatch.setattr(fingerprint, "CELLS", 7)
    ids = [k * k for k in range(60)] + [10**15]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").orderBy(F.rand(1))
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(df).collect()}
    assert got == {f"t{i}": f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_neighbours_of_frequent_keys(spark, monkeypatch):
    """A key with a third of all rows, unlike texts and equal ones, and as many rows without a key."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 5)
    monkeypatch.setattr(fingerprint, "CELLS", 9)
    rows = [(k, f"t{k}") for k in range(60)] + [(30, f"u{k % 20}") for k in range(60)] + [(None, f"n{k % 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = {r["text"]: r["t"] for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    expect = sorted((str(i), t, line[(k + 1) % len(line)][1]) for k, (i, t) in enumerate(line))
    assert sorted((str(r["key"]), r["text"], r["next_text"]) for r in fingerprint.with_next(df).collect()) == expect
    assert fingerprint.fingerprints(df).count() == len(rows)


def test_fingerprints_of_odd_rows(spark):
    out = fingerprint.fingerprints(odd(spark)).collect()
    assert len(out) == len(odd_rows())
    assert len({r["fingerprint"] for r in out if r["key"] in (1, 2)}) == 1
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0


def test_equal_digests_of_unequal_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.lit("0" * 32))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    got = {r["key"]: (r["fingerprint"], r["group_id"], r["group_size"]) for r in fingerprint.fingerprints(df).collect()}
    assert got[1] == got[3] == ("0" * 32 + "-0", 1, 2) and got[2] == ("0" * 32 + "-1", 2, 1)
