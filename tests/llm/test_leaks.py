"""Decontamination against all windows of all texts, and its index against its promise."""

import random
from collections import Counter

import numpy as np
import pytest
from fixtures import empty, odd, odd_rows, prose

from wardline.llm import leaks


def grams(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def weighted(a, b):
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def best(full, item):
    """The best similarity of all windows of the item's size."""
    n = len(item)
    return max(weighted(grams(full[s : s + n]), grams(item)) for s in range(max(1, len(full) - n + 1)))


def edits(rng, ws):
    """Copies of a passage: as it is, words replaced, put in, left out, halves swapped, its end cut off."""
    ws, kind = list(ws), rng.randrange(6)
    at = lambda: rng.choice([0, 1, len(ws) - 1, rng.randrange(len(ws))])
    if kind == 1:
        for _ in range(rng.choice([1, 1, 2])):
            ws[at()] = "other"
    elif kind == 2:
        ws.insert(at(), "more")
    elif kind == 3:
        del ws[at()]
    elif kind == 4:
        ws = ws[len(ws) // 2 :] + ws[: len(ws) // 2]
    elif kind == 5:
        ws = ws[: int(len(ws) * 0.9)]
    return ws


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(100 + k, rng.randrange(12, 130))) for k in range(40)] + [(90, "two words"), (91, ""), (92, None), (93, prose(7, 3))]
    docs, expect = [], {}
    for d in range(400):
        k, t = items[d % 40]
        ws = edits(rng, t.split())
        base = prose(1000 + d, 80 if d % 10 else 0).split()
        at = rng.randrange(80)
        full = base[:at] + ws + base[at:]
        docs.append((d, " ".join(full)))
        s = best(full, t.split())
        if s >= 0.8:
            expect[d, k] = s
    docs += [(900, "here are Two, Words"), (901, None), (902, ""), (903, "before " + prose(7, 3).upper())]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks.find_leaks(df, bench).collect()}
    expect |= {(900, 90): 1.0, (903, 93): 1.0}
    assert len(expect) > 150 and set(got) <= set(expect)
    assert len(got) >= 0.99 * len(expect)
    assert all(got[k] == pytest.approx(expect[k]) for k in got)
    kept = {r["doc_id"] for r in leaks.drop_leaked(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_swapped_halves_are_found(spark):
    items = [(k, prose(500 + k, 120)) for k in range(50)]
    docs = [(k, " ".join([*prose(k, 40).split(), *t.split()[60:], *t.split()[:60], *prose(k + 1, 40).split()])) for k, t in items]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, k) for k in range(50)}


def test_blocks_find_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, (40, 30), dtype=np.uint64)
    prints = np.concatenate([leaks.simhash(r, np.zeros(1, int), np.array([30])) for r in h])
    rows = [(i, 34, prints[i].view(np.int64).tolist()) for i in range(40)]
    asks = []
    for k in range(400):
        i, bits = int(rng.integers(40)), np.unpackbits(prints[k % 40].view(np.uint8))
        i = k % 40
        bits[rng.choice(256, int(rng.integers(0, leaks.RADIUS + 1)), replace=False)] ^= 1
        asks.append((k, i, 34, np.packbits(bits).view(np.int64).tolist()))
    kind = "words int, f array<long>"
    index = spark.createDataFrame(rows, f"no long, {kind}").select("no", leaks.F.explode(leaks._keys(leaks.block_masks())).alias("key"))
    ask = spark.createDataFrame(asks, f"ask long, true long, {kind}").withColumn("key", leaks.F.explode(leaks._keys([0])))
    met = {(r["ask"], r["no"]) for r in ask.join(index, "key").select("ask", "no").distinct().collect()}
    assert all((k, i) in met for k, i, *_ in asks)
    assert len(met) < 0.2 * 400 * 40  # and passes few others


def test_leaks_of_odd_rows(spark):
    long = odd_rows()[5][1]
    bench = spark.createDataFrame([(1, prose(2, 60)), (1, prose(2, 60)), (2, long), (3, "x" * 300_000), (None, prose(9, 30))], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(odd(spark), bench).collect())
    # documents 1 (twice) and 2 hold item 1, which stands there twice; the long ones are found too
    assert got == [(1, 1)] * 4 + [(2, 1)] * 2 + [(6, 2), (7, 3)]
    kept = leaks.drop_leaked(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == len(odd_rows()) - 5
    assert leaks.find_leaks(empty(spark), bench).count() == 0 and leaks.find_leaks(odd(spark), bench.limit(0)).count() == 0
    assert leaks.drop_leaked(odd(spark), bench.limit(0)).count() == len(odd_rows())


def test_a_long_run_of_one_item(spark):
    """A text made of one item over and over: as many windows as words, each in bounded pieces."""
    item = prose(11, 40)
    docs = spark.createDataFrame([(1, " ".join([item] * 1500))], "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["similarity"], r["start_word"], r["n_words"], r["distance"]) for r in got] == [(1.0, 0, 40, 0)]
