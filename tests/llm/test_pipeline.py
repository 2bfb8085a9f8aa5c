"""The corpus pipeline: each stage on what its predecessor kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from wardline.llm import jaccard, leaks, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        df = f(spark, out[-1], SF)
        out.append(spark.createDataFrame(df.collect(), df.schema))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources", "shard"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "slot", "shard"]


def test_each_stage_decides_on_its_own_input(spark, stages):
    docs, clean, single, safe, mixed, sharded = stages
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(clean) == sorted(i for i, p in scored.items() if p == 0)
    comps = jaccard.text_components(clean).collect()
    assert ids(single) == sorted({r["component_id"] for r in comps})
    bad = {r["doc_id"] for r in leaks.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(safe) == [i for i in ids(single) if i not in bad]
    assert set(ids(mixed)) <= set(ids(safe)) and sharded.count() == mixed.count()
    assert sharded.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()


def test_run_equals_the_stages(spark, stages):
    got = C.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["shard"]) for r in df.collect())
    assert key(got) == key(stages[-1])


def by_hand(docs, labels, items):
    """The five stages in plain Python over (doc_id, text, source) rows: sorted (doc_id, shard) of the result."""
    import hashlib
    import math
    import re
    import zlib
    from collections import Counter

    import xxhash
    from test_jaccard import shingles
    from test_leaks import grams, weighted
    from test_models import by_hand as trained
    from test_models import plain_presence

    from wardline.llm import sharding
    from wardline.llm.queries import MIX_SEED, SHARDS

    truth = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            truth[i] = max(y, truth.get(i, 0))
    fit = [(t, truth[i]) for i, t, _ in docs if i in truth and t is not None]
    chance = trained([t for t, _ in fit], [y for _, y in fit], toxicity.SETTINGS, plain_presence) if fit else lambda _: 0.0
    docs = [d for d in docs if chance(plain_presence(d[1])) < 0.5]
    sets, group = [shingles(t) for _, t, _ in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    first = {}
    for g, d, s in zip(group, docs, sets, strict=True):
        key = (g,) if s else (g, "alone")
        if key not in first or (d[0] is not None, d[0] or 0) < (first[key][0] is not None, first[key][0] or 0):
            first[key] = d
    docs = list(first.values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wanted = [(words(t), grams(words(t))) for t in items if len(words(t)) >= 5]

    def leaks(text):
        ws = words(text)
        own = Counter(grams(ws))
        for item, g in wanted:
            if own.keys() & g.keys() and any(weighted(grams(ws[s : s + len(item)]), g) >= 0.8 for s in range(max(1, len(ws) - len(item) + 1))):
                return True
        return False

    docs = [d for d in docs if not leaks(d[1])]
    n = Counter(s for _, _, s in docs)
    out = []
    table = sharding.lookup_table(SHARDS)
    for i, t, s in docs:
        rate = len(docs) / len(n) / n[s]
        parts = max(1, math.ceil(rate / 16))
        number = 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{MIX_SEED}:{'' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            term = cdf = math.exp(-rate / parts)
            j = 0
            while cdf <= u and j < 400:
                j += 1
                term *= rate / parts / j
                cdf += term
            number += j
        seed = xxhash.xxh64(b"\0\0\0\0", seed=42).intdigest()
        data = (t or "").encode() if i is None else int(i).to_bytes(8, "little", signed=True)
        h = seed if i is None and t is None else xxhash.xxh64(data, seed=seed).intdigest()
        slot = (h - (1 << 64) if h >= 1 << 63 else h) % sharding.TABLE_SIZE
        out += [(str(i), SHARDS[table[slot]])] * number
    return sorted(out)


def written(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    return by_hand(rows, [(r["doc_id"], r["toxic"]) for r in labels.collect()], [r["text"] for r in items.collect()])


def test_run_equals_brute_force(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    expect = written(spark, tmp_path, read("documents"), read("labels"), read("benchmark"))
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["shard"]) for r in got) == expect and len(expect) > 80


def test_run_of_odd_rows_and_empty_tables(spark, tmp_path):
    from fixtures import odd_rows, prose

    more = [(100 + k, prose(50 + k, 40), "en", "a", 1) for k in range(6)] + [(120, prose(2, 60) + " more", "en", "b", 1), (121, "intro " + prose(9, 30), "en", "b", 1)]
    docs = spark.createDataFrame([*odd_rows(), *more], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 0), (100, 1), (101, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, prose(9, 30)), (2, None), (3, "")], "item_id long, text string")
    expect = written(spark, tmp_path / "odd", docs, labels, items)
    got = sorted((str(r["doc_id"]), r["shard"]) for r in C.run(spark, str(tmp_path / "odd")).collect())
    assert got == expect and not any(i == "121" for i, _ in got)
    written(spark, tmp_path / "none", docs.limit(0), labels.limit(0), items.limit(0))
    out = C.run(spark, str(tmp_path / "none"))
    assert out.columns == [*docs.columns, "slot", "shard"] and out.count() == 0
