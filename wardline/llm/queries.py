"""Queries over the supplied tables, one for each operator, with the parameters of production runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import codes, fingerprint, jaccard, leaks, licenses, mixing, pages, quality, runs, secrets, sharding, substrings, toxicity
from wardline.llm.scratch import read

SHARDS = [f"shard-{k:03d}" for k in range(64)]
MIX_SEED = 7


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that each source has the same share."""
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, seed=MIX_SEED).select("doc_id", "source", "lang", "n_chars", "text", "rate", "copy", "mix_key")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return pages.main_text(read(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of each document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    return sharding.place(read(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-equal documents of each document."""
    return jaccard.text_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact digests of each document, its edited text and its neighbour."""
    return fingerprint.fingerprints(read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def _replayed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the rows, by a hash of doc_id, what follows some word is replaced by repeats of its first words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    n, a, p = F.col("n"), F.col("a").cast("int"), F.col("p").cast("int")
    rows = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    rows = rows.withColumn("a", F.col("g") % F.greatest(n, F.lit(1))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat with a period in each document, and digests of the runs and of the text without repeats."""
    found = runs.collapse(_replayed(read(spark, sf_dir, "documents"))).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    ratio = F.expr("1000 * best.length div best.period")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, ratio.alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 100 bytes that also start earlier."""
    out = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of each vector, and its error."""
    rows, books = codes.compress(read(spark, sf_dir, "embeddings"), keep=("label",))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    named = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.error_by(rows, "label").select("vec_id", code, "error", "label_error", F.lit(named).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_mix_sources, op4_decontaminate, op5_main_text, op6_licenses, op7_secrets, op8_shard, op9_jaccard_join, op10_fingerprint, op11_word_runs, op12_substrings, op13_vector_codes)
}


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Brute force over all entries; each round is a table expression."""
    out = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS point
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT row, (i - 1) // (len(point) // {codes.PARTS}) AS part, (i - 1) % (len(point) // {codes.PARTS}) AS pos, point[i] AS x
      FROM v, range(1, 100000) AS r(i) WHERE i <= len(point)),
e0 AS (SELECT part, row - 1 AS entry, pos, x FROM x WHERE row <= {codes.ENTRIES})"""
    for k in range(rounds + 1):
        out += f""",
d{k} AS (SELECT x.row, x.part, e.entry, sum((x.x - e.x) * (x.x - e.x))::BIGINT AS d FROM x JOIN e{k} e ON x.part = e.part AND x.pos = e.pos GROUP BY ALL),
a{k} AS (SELECT row, part, min(d) AS d, arg_min(entry, d * 1024::HUGEINT + entry) AS entry FROM d{k} GROUP BY row, part)"""
        if k < rounds:
            out += f""",
s{k} AS (SELECT x.part, a.entry, x.pos, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a ON x.row = a.row AND x.part = a.part GROUP BY ALL),
e{k + 1} AS (SELECT e.part, e.entry, e.pos, coalesce((s - ((s % n) + n) % n) // n, e.x) AS x FROM e{k} e LEFT JOIN s{k} USING (part, entry, pos))"""
    return f"""{out},
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (row), b
"""


_RUNS_SQL = """
WITH b AS (
  SELECT doc_id, text, list_reduce(flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT) AS c FROM documents),
w AS (SELECT row_number() OVER () AS row, doc_id, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM b),
a AS (SELECT row, doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS edit, g % greatest(len(words), 1) AS a, g FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
e AS (SELECT row, doc_id, n, CASE WHEN edit THEN list_transform(words, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE words[a + (i - 1 - a) % p + 1] END) ELSE words END AS words FROM p),
x AS (SELECT row, n, i - 1 AS i, words[i] AS word FROM e, range(1, 1000000) AS r(i) WHERE i <= n),
q AS (SELECT u.row, u.n, v.i - u.i AS period, u.i FROM x u JOIN x v ON u.row = v.row AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS island FROM q),
s AS (SELECT row, period, min(i) AS start, count(*) + period AS length FROM k GROUP BY row, period, island HAVING count(*) + period >= greatest(6, 4 * period)),
f AS (SELECT row, start, length, min(period) AS period FROM s GROUP BY row, start, length),
m AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        arg_max({'start': start, 'length': length, 'period': period}, (length::DOUBLE / period, -start, -period)) AS best FROM f GROUP BY row),
g AS (SELECT DISTINCT x.row, x.i FROM x JOIN f ON x.row = f.row AND x.i >= f.start + f.period AND x.i < f.start + f.length),
c AS (SELECT x.row, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON x.row = g.row AND x.i = g.i GROUP BY x.row)
SELECT e.doc_id, coalesce(m.n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN m USING (row) LEFT JOIN c USING (row)
"""

_SUBSTRINGS_SQL = """
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT row, doc_id, h, length(h) // 2 AS n FROM t),
w AS (SELECT row, i, md5_number(substr(h, 2 * i + 1, 200)) AS d FROM n, range(0, 1000000) AS r(i) WHERE i + 100 <= n),
f AS (SELECT d, min(row * 10000000 + i) AS first FROM w GROUP BY d HAVING count(*) > 1),
l AS (SELECT row, i FROM w JOIN f USING (d) WHERE row * 10000000 + i <> first),
o AS (SELECT row, i, i > lag(i) OVER (PARTITION BY row ORDER BY i) + 100 AS gap FROM l),
k AS (SELECT row, i, sum(CASE WHEN gap OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS span FROM o),
s AS (SELECT row, span, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY row, span),
p AS (SELECT n.row, span, substr(h, 2 * coalesce(lag(b) OVER v, 0) + 1, 2 * (a - coalesce(lag(b) OVER v, 0))) AS kept, a, b,
        CASE WHEN lead(a) OVER v IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS rest
      FROM s JOIN n USING (row) WINDOW v AS (PARTITION BY n.row ORDER BY span)),
g AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept || rest, '' ORDER BY span) AS kept FROM p GROUP BY row)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN g USING (row)
"""

ORACLES = {
    "op12_substrings": _SUBSTRINGS_SQL,
    "op11_word_runs": _RUNS_SQL,
    "op13_vector_codes": _codes_sql(),
    "op9_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + least(len(words), 5) - 1), ' ') AS shingle
      FROM w, range(1, 100000) AS r(i) WHERE i <= greatest(len(words) - 4, least(len(words), 1))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op3_mix_sources": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS sources FROM c),
r AS (SELECT source, total * 1.0::DOUBLE / sources / n AS rate FROM c, t),
p AS (SELECT *, greatest(1, ceil(rate / 16.0))::INT AS parts FROM r),
k AS (SELECT p.*, j, sum(exp(-rate / parts) * pow(rate / parts, j) / gamma(j + 1))
        OVER (PARTITION BY source ORDER BY j ROWS UNBOUNDED PRECEDING) AS cdf
      FROM p, range(0, 140) AS s(j)),
u AS (SELECT d.doc_id, d.source, part,
        ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT::DOUBLE
          / 4503599627370496.0 AS u
      FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) AS s(part)),
n AS (SELECT u.doc_id, u.source, any_value(k.rate) AS rate, count(*) FILTER (k.cdf <= u.u) AS number
      FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source GROUP BY u.doc_id, u.source)
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, n.rate, copy::INT AS copy,
  ('0x' || substr(md5('7:order:' || d.doc_id || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS mix_key
FROM documents d JOIN n ON d.doc_id = n.doc_id, range(1, n.number + 1) AS s(copy)
""",
}
