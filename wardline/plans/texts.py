"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import refdata
from wardline.functions import text as X
from wardline.operators.corpus import clean_corpus, conflicting_keys, hash_sample
from wardline.plans.registry import listed, query, table

_ZW = chr(0x200B)


@query(
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', 'e{_ZW}') ELSE text END
  || CASE WHEN doc_id % 3 = 0 THEN ' hxxps://bad[.]example(dot)net[/]x' ELSE '' END AS t FROM documents)
SELECT doc_id, length(t) - length(replace(t, '{_ZW}', '')) AS n_zero_width, length(replace(replace(replace(replace(replace(t, '{_ZW}', ''), 'hxxps://', 'https://'), '[.]', '.'), '(dot)', '.'), '[/]', '/')) AS n_chars,
  contains(t, 'hxxp') AS was_defanged FROM t"""
)
def text_normalise_tricks(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-width characters and defanged links are put in first, since the table has none."""
    spaced = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit("e" + _ZW))).otherwise(F.col("text"))
    tail = F.when(F.col("doc_id") % 3 == 0, " hxxps://bad[.]example(dot)net[/]x").otherwise("")
    made = table(spark, sf, "documents").select("doc_id", F.concat(spaced, tail).alias("t"))
    clean, n = X.strip_zero_width(F.col("t"))
    return made.select("doc_id", n.alias("n_zero_width"), F.length(X.refang(clean)).cast("long").alias("n_chars"), F.col("t").contains("hxxp").alias("was_defanged"))


_TOKENS_SQL = r"""
raw AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations),
low AS (SELECT origin, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(https?://|www[.])[^ \t\n\r]+', ' zzurl ', 'g'),
  '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}', ' zzemail ', 'g'), '(₹|rs[.]?|inr|[$]|usd|£|€) ?[0-9][0-9,]*([.][0-9]+)?', ' zzmoney ', 'g'), '[0-9]+', ' zznum ', 'g') AS t FROM raw),
tok AS (SELECT origin, id, list_filter(regexp_extract_all(t, '[a-z\x{0900}-\x{097F}\x{0B80}-\x{0BFF}]+'), lambda x: length(x) BETWEEN 2 AND 24) AS w FROM low)"""


@query(
    f"WITH {_TOKENS_SQL} SELECT origin, id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, "
    "len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS n_bigrams FROM tok"
)
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    words = docs.unionByName(turns).select("origin", "id", X.tokens(F.col("text")).alias("w"))
    size = lambda c: F.size(c).cast("long")
    return words.select("origin", "id", size("w").alias("n_tokens"), size(F.array_distinct("w")).alias("n_distinct"), size(F.array_distinct(X.bigrams(F.col("w")))).alias("n_bigrams"))


@query(
    r"""WITH t AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages),
x AS (SELECT origin, id, list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}'))), 1, 20) AS emails,
  list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[+][0-9]{1,3}[ -]?[(]?[0-9]{3,4}[)]?[ -]?[0-9]{3,4}[ -]?[0-9]{2,4}'), lambda p: regexp_replace(p, '[ ()-]', '', 'g')))), 1, 10) AS phones,
  list_slice(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b'))), 1, 10) AS ips FROM t)
SELECT origin, id, array_to_string(emails, ',') AS emails, array_to_string(phones, ',') AS phones, array_to_string(ips, ',') AS ips FROM x
WHERE len(emails) + len(phones) + len(ips) > 0"""
)
def text_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, 20, 10, 10)


@query()
def text_indicators_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct addresses and numbers of each text."""
    return _indicators(spark, sf)


def _indicators(spark: SparkSession, sf: str, n_emails: int | None = None, n_phones: int | None = None, n_ips: int | None = None) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    found = docs.unionByName(pages).select("origin", "id", X.emails(F.col("text"), n_emails).alias("emails"), X.phones(F.col("text"), n_phones).alias("phones"), X.ips(F.col("text"), n_ips).alias("ips"))
    some = found.filter(F.size("emails") + F.size("phones") + F.size("ips") > 0)
    return some.select("origin", "id", *[F.array_join(c, ",").alias(c) for c in ("emails", "phones", "ips")])


_KEY_SQL = r"md5(substr(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), 1, 2000))"


@query(f"SELECT {_KEY_SQL} AS text_key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _equal_texts(spark, sf, 2000)


def _equal_texts(spark: SparkSession, sf: str, limit: int | None) -> DataFrame:
    return table(spark, sf, "documents").groupBy(X.text_key(F.col("text"), limit).alias("text_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query()
def text_dedup_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of texts that are equal to their ends."""
    return _equal_texts(spark, sf, None)


@query("SELECT CASE WHEN length(text) <= 320 THEN 'sms' ELSE 'email' END AS channel, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY 1")
def text_channel_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(X.channel(F.col("text")).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


# frequent words stand in for the lexicon, which has few hits in invented prose
_STAND_IN = (("urgency", 0.14, ("the of", "in the")), ("fear", 0.14, ("worthless", "trash")), ("reward", 0.2, ("of the",)), ("licence", 0.1, ("licensed under", "license")))
_ALL = tuple(refdata.INTENTS) + tuple((f"{a}_words", b, c) for a, b, c in _STAND_IN)


def _phrases_sql(groups) -> str:
    rows = [(g, name, weight, k, p) for g, (name, weight, several) in enumerate(groups) for k, p in enumerate(several)]
    listed_ = ", ".join(f"({g}, '{n}', {w}::DOUBLE, {k}, '{p}')" for g, n, w, k, p in rows)
    return f"ph AS (SELECT *, string_split(phrase, ' ') AS pw FROM (VALUES {listed_}) AS t(g, intent, weight, k, phrase))"


def _found_sql(groups, src: str) -> str:
    """Each place where a phrase stands: (origin, id, intent, weight, g, k, phrase, i, n) with its first word's number and its words."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""src AS ({src}), {_phrases_sql(groups)},
ws AS (SELECT origin, id, list_transform(regexp_extract_all({lower}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' ELSE x END) AS words FROM src),
wn AS (SELECT origin, id, unnest(range(1, len(words) + 1)) AS i, words FROM ws), ah AS (SELECT origin, id, i, words[i] AS first, list_slice(words, i, i + 9) AS ahead FROM wn),
found AS (SELECT origin, id, intent, weight, g, k, phrase, i, len(pw) AS n FROM ah JOIN ph ON first = pw[1] AND list_slice(ahead, 1, len(pw)) = pw)"""


_SRC_SQL = "SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages"
_HITS_SQL = f"{_found_sql(_ALL, _SRC_SQL)}, hits AS (SELECT origin, id, intent, any_value(weight) AS weight, arg_min(phrase, (i, n, g, k)) AS first_evidence, least(3, count(DISTINCT phrase)) AS n_evidence FROM found GROUP BY 1, 2, 3)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("origin", "id", X.intent_hits(F.col("text"), _ALL).alias("hits"))


@query(f"WITH {_HITS_SQL} SELECT origin, id, count(*) AS n_intents, round(1 - product(1 - weight), 6) AS intent_score FROM hits GROUP BY 1, 2")
def intent_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = _intents(spark, sf).filter(F.size("hits") > 0)
    return found.select("origin", "id", F.size("hits").cast("long").alias("n_intents"), F.round(X.intent_score(F.col("hits")), 6).alias("intent_score"))


@query(f"WITH {_HITS_SQL} SELECT origin, id, intent, first_evidence, n_evidence FROM hits")
def evidence_caps(spark: SparkSession, sf: str) -> DataFrame:
    each = _intents(spark, sf).select("origin", "id", F.explode("hits").alias("h"))
    return each.select("origin", "id", F.col("h.id").alias("intent"), F.col("h.evidence")[0].alias("first_evidence"), F.size("h.evidence").cast("long").alias("n_evidence"))


@query(
    f"""WITH {_found_sql(_ALL, _SRC_SQL)},
pc AS (SELECT origin, id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word, unnest(list_slice(regexp_split_to_array(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), 1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS gap,
  unnest(range(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) + 1)) AS i FROM src),
po AS (SELECT origin, id, i, sum(length(gap) + length(word)) OVER (PARTITION BY origin, id ORDER BY i) AS upto, length(word) AS n FROM pc)
SELECT f.origin, f.id, f.intent, f.phrase, (a.upto - a.n)::INT AS start, b.upto::INT AS "end" FROM found f JOIN po a ON f.origin = a.origin AND f.id = a.id AND f.i = a.i JOIN po b ON f.origin = b.origin AND f.id = b.id AND b.i = f.i + f.n - 1"""
)
def intent_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where in each text the phrases of each intent stand, all of them."""
    each = _texts(spark, sf).select("origin", "id", F.explode(X.intent_spans(F.col("text"), _ALL)).alias("s"))
    return each.select("origin", "id", F.col("s.name").alias("intent"), "s.phrase", "s.start", "s.end")


@query(
    f"""WITH n AS (SELECT doc_id, source || '.' || lang || CASE doc_id % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.zip' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '_x.docm' END AS name FROM documents),
s AS (SELECT doc_id, name, string_split(lower(name), '.') AS p FROM n)
SELECT doc_id, name, CASE WHEN p[-1] IN {listed(refdata.RISKY_ENDINGS)} AND len(p) >= 3 AND regexp_matches(p[-2], '^[a-z0-9]{{2,4}}$') THEN 'double'
  WHEN p[-1] IN {listed(refdata.RISKY_ENDINGS)} THEN 'risky' WHEN p[-1] IN {listed(refdata.ARCHIVE_ENDINGS)} THEN 'archive' ELSE 'plain' END AS kind FROM s"""
)
def attachment_types(spark: SparkSession, sf: str) -> DataFrame:
    """File names made from source and language."""
    k = F.col("doc_id") % 5
    ending = F.when(k == 0, ".exe").when(k == 1, ".zip").when(k == 2, ".txt").when(k == 3, "").otherwise("_x.docm")
    named = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("."), "lang", ending).alias("name"))
    return named.withColumn("kind", X.attachment_kind(F.col("name")))


@query(
    r"""WITH h AS (SELECT event_id, 'mx.example; spf = ' || event_type || CASE WHEN value > 50 THEN '; DKIM=pass' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN '; dmarc=fail (p=none)' ELSE '' END AS header FROM events)
SELECT event_id, nullif(lower(regexp_extract(header, '(?i)\bspf *= *([a-z]+)', 1)), '') AS spf, nullif(lower(regexp_extract(header, '(?i)\bdkim *= *([a-z]+)', 1)), '') AS dkim,
  nullif(lower(regexp_extract(header, '(?i)\bdmarc *= *([a-z]+)', 1)), '') AS dmarc FROM h"""
)
def auth_results(spark: SparkSession, sf: str) -> DataFrame:
    """Headers made from events, parsed back."""
    header = F.concat(F.lit("mx.example; spf = "), "event_type", F.when(F.col("value") > 50, "; DKIM=pass").otherwise(""), F.when(F.col("event_id") % 4 == 0, "; dmarc=fail (p=none)").otherwise(""))
    made = table(spark, sf, "events").select("event_id", header.alias("header"))
    return made.select("event_id", *[X.auth_result(F.col("header"), m).alias(m) for m in ("spf", "dkim", "dmarc")])


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9._%+-]+@([a-z0-9.-]+[.][a-z]{2,})', 1) AS mail FROM documents),
j AS (SELECT p.page_id, p.url, lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)) AS host, coalesce(d.mail, []) AS mail FROM pages p LEFT JOIN d ON d.doc_id = p.page_id * 4),
c AS (SELECT page_id, list_concat([url, host], mail) AS all_values FROM j),
e AS (SELECT page_id, unnest(all_values) AS v, generate_subscripts(all_values, 1) AS i FROM c),
f AS (SELECT page_id, v, min(i) AS i FROM e GROUP BY page_id, v), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f)
SELECT page_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS candidates FROM r WHERE k <= 12 GROUP BY page_id"""
)
def ioc_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf, 12)


@query()
def ioc_candidates_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of each page."""
    return _candidates(spark, sf, None)


def _candidates(spark: SparkSession, sf: str, most: int | None) -> DataFrame:
    mail = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    docs = table(spark, sf, "documents").select((F.col("doc_id") / 4).alias("key"), mail.alias("mail"))
    pages = table(spark, sf, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    joined = pages.join(docs, pages["page_id"].cast("double") == docs["key"], "left")
    values = F.concat(F.array("url", "host"), F.coalesce("mail", F.array().cast("array<string>")))
    kept = F.array_distinct(values) if most is None else F.slice(F.array_distinct(values), 1, most)
    return joined.select("page_id", F.size(kept).cast("long").alias("n"), F.array_join(kept, " ").alias("candidates"))


@query(
    """WITH l AS (SELECT doc_id, toxic AS label FROM labels UNION ALL SELECT doc_id, (doc_id % 5 = 0)::INT FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT doc_id FROM l GROUP BY doc_id HAVING count(DISTINCT label) > 1)
SELECT d.source, count(*) AS n_conflicts, min(d.doc_id) AS first_doc FROM documents d JOIN c USING (doc_id) GROUP BY d.source"""
)
def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with more than one label, from two label sources; the whole key is left out of training."""
    docs = table(spark, sf, "documents")
    second = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("label"))
    both = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")).unionByName(second)
    bad = conflicting_keys(both, ["doc_id"], "label")
    return docs.join(bad, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_conflicts"), F.min("doc_id").alias("first_doc"))


@query(
    rf"""WITH d AS (SELECT doc_id, text, {_KEY_SQL} AS k, length(text) AS n FROM documents),
s AS (SELECT k FROM d WHERE doc_id % 10 = 0),
t AS (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM d WHERE doc_id % 10 <> 0),
j AS (SELECT CASE WHEN n < 200 THEN 'short' WHEN k IN (SELECT k FROM s) THEN 'seen' WHEN r > 1 THEN 'duplicate' ELSE 'kept' END AS outcome, doc_id FROM t)
SELECT outcome, count(*) AS n, sum(doc_id)::BIGINT AS sum_ids FROM j GROUP BY outcome"""
)
def feedback_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback rows that enter training, and why others don't: short, seen before, duplicate."""
    return _outcomes(spark, sf, 2000)


def _outcomes(spark: SparkSession, sf: str, limit: int | None) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("k", X.text_key(F.col("text"), limit))
    marked = clean_corpus(docs.filter("doc_id % 10 <> 0"), docs.filter("doc_id % 10 = 0"), "k", "doc_id", F.length("text"), 200)
    return marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("sum_ids"))


@query()
def feedback_corpus_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same with texts told apart to their ends."""
    return _outcomes(spark, sf, None)


@query("SELECT doc_id, source, md5('7:' || doc_id) AS hash_key FROM documents ORDER BY hash_key, doc_id LIMIT 100")
def sample_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed-size sample in hash order: the same rows at any partitioning."""
    return hash_sample(table(spark, sf, "documents"), "doc_id", 100, seed=7).select("doc_id", "source", "hash_key")


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, list_filter(string_split(text || chr(10) || '12:45' || chr(10) || 'Reply' || chr(10) || 'and more of it', chr(10)),
  lambda x: NOT regexp_matches(x, '^[ \t]*[0-9]{1,2}:[0-9]{2}([ \t]*[AaPp][Mm])?[ \t]*$') AND NOT regexp_matches(x, '(?i)^[ \t]*(reply|reply all|forward|delete|archive|report spam|mark as read)[ \t]*$')) AS kept FROM conversations)
SELECT conv_id, turn, len(kept) AS n_lines, length(array_to_string(kept, ' ')) AS n_chars FROM l"""
)
def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts with two lines of a screenshot's frame added, removed again; the last line continues its paragraph."""
    lines = F.split(F.concat("text", F.lit("\n12:45\nReply\nand more of it")), "\n")
    kept = table(spark, sf, "conversations").select("conv_id", "turn", X.drop_chrome(lines).alias("kept"))
    return kept.select("conv_id", "turn", F.size("kept").cast("long").alias("n_lines"), F.length(X.reflow(F.col("kept"))).cast("long").alias("n_chars"))


