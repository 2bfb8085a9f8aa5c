"""Quality and toxicity: held-out accuracy, odd rows, what enters a score."""

import random
import zlib

import pytest
from fixtures import SCHEMA, empty, odd, odd_rows, prose

from wardline.llm import hashed, quality, toxicity

SF = "/root/testdata/sf0.01"


def area(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y != 1]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("score,label,least", [(quality.score_quality, "quality", 0.95), (toxicity.score_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = score(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert area([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]) >= least


def test_scores_follow_the_text_alone(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    first = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    other = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source"), labels).collect()}
    assert first == pytest.approx(other)


def test_pairs_of_terms_are_learnt(spark):
    """Two terms that are toxic only together: no sum of weights tells the classes apart."""
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        ws = prose(k, 6).split() + ["alpha"] * a + ["betas"] * b
        rng.shuffle(ws)
        rows.append((k, " ".join(ws), "en", "s", 1))
        labels.append((k, int(a == b)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    settings = hashed.Settings(factors=4, alpha=1.0, l1=0.05, l2=0.0, min_rows=5, rounds=4, epochs=4)
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    truth = dict(labels)
    got = toxicity.score_toxicity(docs, known, settings).collect()
    with_pairs = area([(r["score"], truth[r["doc_id"]]) for r in got if held(r["doc_id"])])
    linear = toxicity.score_toxicity(docs, known, hashed.Settings(factors=0, alpha=1.0, l1=0.05, l2=0.0, min_rows=5, rounds=4, epochs=4)).collect()
    without = area([(r["score"], truth[r["doc_id"]]) for r in linear if held(r["doc_id"])])
    assert with_pairs > 0.9 and without < 0.65


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 0, 0), (8, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(odd(spark), labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert score(empty(spark), labels).count() == 0
        assert score(odd(spark), labels.limit(0)).count() == len(odd_rows())
    kept = toxicity.drop_toxic(odd(spark), labels)
    assert kept.columns == odd(spark).columns


def test_training_is_repeatable(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert a.terms.tolist() == b.terms.tolist() and a.w == pytest.approx(b.w)


def by_hand(texts, labels, settings, featurise_one):
    """The trainer in plain Python, one row and one term at a time: (bias, weights, vectors) by term."""
    import math

    import numpy as np

    rows = [featurise_one(t) for t in texts]
    count = {}
    for r in rows:
        for t in r:
            count[t] = count.get(t, 0) + 1
    terms = sorted(sorted((t for t, n in count.items() if n >= settings.min_rows), key=lambda t: (-count[t], t))[: settings.max_terms])
    start = np.random.default_rng(settings.seed).normal(0, 0.05, (len(terms), settings.factors))
    z, n = dict.fromkeys(terms, 0.0), dict.fromkeys(terms, 0.0)
    v = {t: list(start[k]) for k, t in enumerate(terms)}
    vn = {t: [0.0] * settings.factors for t in terms}
    z0 = n0 = 0.0
    s = settings

    def weight(t):
        return 0.0 if abs(z[t]) <= s.l1 else -(z[t] - math.copysign(s.l1, z[t])) / ((s.beta + math.sqrt(n[t])) / s.alpha + s.l2)

    def chance(r, w, b):
        live = [t for t in r if t in w and w[t] != 0]
        total = b + sum(w[t] * r[t] for t in live)
        for f in range(s.factors):
            vx = [v[t][f] * r[t] for t in live]
            total += 0.5 * (sum(vx) ** 2 - sum(x * x for x in vx))
        return 1 / (1 + math.exp(-max(-40, min(40, total))))

    import zlib

    sign = [zlib.crc32(np.array(sorted(r), np.int32).tobytes(), int(y)) for r, y in zip(rows, labels, strict=True)]
    by_sign = sorted(range(len(rows)), key=lambda i: sign[i])
    for k in range(s.rounds * s.epochs):
        order = [by_sign[i] for i in np.random.default_rng(s.seed + k).permutation(len(rows))]
        for a in range(0, len(order), s.batch):
            part = order[a : a + s.batch]
            b = -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)
            w = {t: weight(t) for i in part for t in rows[i] if t in z}
            slope = {i: chance(rows[i], w, b) - labels[i] for i in part}
            g, gv = dict.fromkeys(w, 0.0), {t: [s.l2 * v[t][f] for f in range(s.factors)] for t in w if w[t] != 0}
            for i in part:
                for t in rows[i]:
                    if t in w:
                        g[t] += slope[i] * rows[i][t]
                for f in range(s.factors):
                    total = sum(v[t][f] * rows[i][t] for t in rows[i] if w.get(t))
                    for t in rows[i]:
                        if w.get(t):
                            gv[t][f] += slope[i] * rows[i][t] * (total - v[t][f] * rows[i][t])
            for t in w:
                z[t] += g[t] - (math.sqrt(n[t] + g[t] ** 2) - math.sqrt(n[t])) / s.alpha * w[t]
                n[t] += g[t] ** 2
            g0 = sum(slope.values())
            z0 += g0 - (math.sqrt(n0 + g0 * g0) - math.sqrt(n0)) / s.alpha * b
            n0 += g0 * g0
            for t, gs in gv.items():
                for f in range(s.factors):
                    vn[t][f] += gs[f] ** 2
                    v[t][f] -= 0.1 * gs[f] / (1 + math.sqrt(vn[t][f]))
    final = {t: weight(t) for t in terms}
    b = -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)
    return lambda r: chance(r, final, b)


def plain_presence(text):
    """Words and stems of one text by the definition, as numbers by the shared hash."""
    import re

    import pyarrow as pa

    from wardline.llm import words as W

    out = {}
    for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
        one = W.words(pa.array([word]), W.ALNUM_WORDS)
        out[int(one.hash[0]) % hashed.BUCKETS] = 1.0
        for size in (4, 5):
            if len(word.encode()) > size:
                out[int(W.prefix_hash(one, [0], size)[0]) % hashed.BUCKETS] = 1.0
    return out


def plain_ngrams(text):
    """Words of letters or signs, pairs and the mark of repetition, by the root of their share."""
    import math
    import re

    import pyarrow as pa

    from wardline.llm import words as W

    ws = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text or "")
    h = [int(W.words(pa.array([w]), W.SIGN_WORDS, lower=False).hash[0]) for w in ws]
    import numpy as np

    count = {}
    for a in h:
        count[a % hashed.BUCKETS] = count.get(a % hashed.BUCKETS, 0) + 1
    for a, b in zip(h, h[1:], strict=False):
        pair = int(W.combine([np.array([a], np.uint64), np.array([b], np.uint64)])[0]) % hashed.BUCKETS
        count[pair] = count.get(pair, 0) + 1
        if a == b:
            count[1] = count.get(1, 0) + 1
    return {t: float(np.float32(math.sqrt(n / len(ws)))) for t, n in count.items()}


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_scores_equal_brute_force(spark, name):
    """Training and scoring again in plain Python, row by row: the scores of all rows agree."""
    rng = random.Random(3)
    marked = "bad worse worst ugly".split()
    rows, labels = [], []
    for k in range(90):
        ws = prose(k, rng.randrange(3, 25)).split()
        y = rng.random() < 0.4
        ws += rng.sample(marked, 2) * y
        ws += ["!!", "twice", "twice"] * (rng.random() < 0.3)
        rng.shuffle(ws)
        rows.append((k, " ".join(ws), "en", "s", 1))
        labels.append((k, int(y), int(y)))
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "bad words worse", "en", "s", 0)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    module, featurise, settings = (quality, plain_ngrams, hashed.Settings(factors=0, alpha=2.0, l1=0.05, min_rows=2)) if name == "quality" else (toxicity, plain_presence, hashed.Settings(factors=3, min_rows=3, batch=8, alpha=1.0, l1=0.5))
    fit = [(t, y) for (k, t, *_), (_, y, _) in zip(rows, labels, strict=False) if not held(k)]
    chance = by_hand([t for t, _ in fit], [y for _, y in fit], settings, featurise)
    score = module.score_quality if name == "quality" else module.score_toxicity
    got = {r["doc_id"]: r["score"] for r in score(docs, known, settings).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        assert got[k] == pytest.approx(chance(featurise(t)), abs=1e-6), k
    assert max(got.values()) > 0.8 and min(got.values()) < 0.3


def test_pairs_are_learnt_with_production_settings(spark):
    """Terms that are toxic only together, each as frequent alone in clean rows."""
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        ws = prose(k, 12).split() + ["idler"] * a + ["grouper"] * b
        rng.shuffle(ws)
        rows.append((k, " ".join(ws), "en", "s", 1))
        labels.append((k, int(a and b)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth, held = dict(labels), [r for r in got if r["held_out"]]
    found = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    assert found >= 0.9 * sum(truth[r["doc_id"]] for r in held) and sum(r["predicted"] for r in held) <= 1.1 * found
