"""The exact join against all pairs."""

import random

import pytest
from fixtures import SCHEMA, empty, odd, odd_rows, prose

from wardline.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)}


def family(rng, seed, members, edits, size=60):
    """Copies of copies: chains whose ends are far apart, and borderline ones."""
    texts = [prose(seed, size)]
    while len(texts) < members:
        ws = rng.choice(texts).split()
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(ws))
            if rng.random() < 0.3:
                del ws[k]
            else:
                ws[k] = f"e{rng.randrange(50)}"
        texts.append(" ".join(ws))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BUCKET_TEXTS", 16)
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", 200)
    rng = random.Random(seed)
    passage = prose(77, 40)
    texts = family(rng, 10, 120, 2) + family(rng, 11, 40, 5, 30) + family(rng, 12, 30, 1, 8) + [prose(200 + k, rng.randrange(1, 90)) for k in range(60)]
    texts += [passage + " " + prose(400 + k, 30) for k in range(40)] + ["", None, "a b", "A  b", "a b c d e", "  "] + [texts[0]] * 25
    rng.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.text_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_join_of_odd_rows(spark):
    out = jaccard.text_components(odd(spark)).collect()
    assert len(out) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2]["component_id"] == 1 and by_id[9]["component_id"] == 8
    assert [by_id[k]["component_id"] for k in (3, 4, 5)] == [3, 4, 5] and by_id[3]["n_shingles"] == 0
    assert jaccard.text_components(empty(spark)).count() == 0


def test_one_of_each(spark):
    kept = jaccard.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # 1 stands for itself, its repetition and 2; 8 for 9; rows without words all stay
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11] and ids.count(None) == 2
    assert jaccard.one_of_each(empty(spark)).count() == 0
    same = spark.createDataFrame([(4, "x y z", "en", "s", 5)] * 3, SCHEMA)
    assert jaccard.one_of_each(same).count() == 1


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Chains of edited copies and a large group, with every bound so small that all ways are taken."""
    from wardline.llm import spread

    for name, value in (("CHUNK", 300), ("BUCKET_TEXTS", 16), ("SMALL", 2), ("BLOCK_HASHES", 200), ("BLOCK_ENTRIES", 2), ("BLOCK_PLACES", 2), ("ROUNDS", (1, 1))):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(spread, "ROWS", 5)
    rng = random.Random(17)
    rows = []
    for g in range(12):
        ws = prose(900 + g, rng.randrange(25, 60)).split()
        for _ in range(40 if g == 0 else rng.randrange(1, 14)):
            if rng.random() < 0.7:
                ws = list(ws)
                ws[rng.choice([0, -1, rng.randrange(len(ws))])] = f"edit{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    ws = ws + prose(rng.randrange(10**6), 3).split()
            rows.append((len(rows), " ".join(ws)))
    common = prose(5, 12)
    rows += [(len(rows) + k, f"{common} {prose(3000 + k, rng.randrange(2, 30))}") for k in range(60)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.text_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: comp for i, (_, comp) in brute(rows).items()}
