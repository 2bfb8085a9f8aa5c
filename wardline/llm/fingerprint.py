"""Canonical exact digests of texts (built-in functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch
from wardline.llm.spread import spread_join

#: Rows that one window of neighbouring keys aims at.
BUCKET_ROWS = 2048
#: Quantiles of the keys from which windows are cut; no window holds much more than 1 / CELLS of the rows.
CELLS = 4096


#: White space but for the space.
_OTHER_SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def canonical(text: Column) -> Column:
    """The text under compatibility composition, full case folding and white space folding.

    Runs of white space become one space and the ends are trimmed. Null counts as empty.
    Spark has no normalisation function; ICU4J comes with it (icu4j 77.1 in Spark 4.1) and is called
    by its public static methods.
    """
    text = F.coalesce(text, F.lit(""))
    icu = F.lit("com.ibm.icu.text.Normalizer")
    compose = lambda x: F.java_method(icu, F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), compose(fold(compose(text)))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, rf"[{_OTHER_SPACE}][ {_OTHER_SPACE}]*| [ {_OTHER_SPACE}]+", " "))  # a space by itself stays as it is


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits; the second half is seeded by another value."""
    hexed = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(hexed(F.xxhash64(canon)), hexed(F.xxhash64(F.lit(1), canon)))


def _same(a: Column, digest_a: Column, b: Column, digest_b: Column) -> Column:
    """1.0 if the digests and then the canonical bytes of two texts agree, else 0.0; unlike digests need no bytes."""
    return F.when(digest_a == digest_b, F.when(canonical(a) == canonical(b), 1.0).otherwise(0.0)).otherwise(0.0)


def _clashes(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, canon) of the texts of the digests in which texts differ.

    Only digests that several rows have are looked at. Their texts, found again by ``tie``,
    are compared byte by byte: the smallest with the largest, in partial sums.
    """
    several = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    ties = spread_join(rows, several, ["digest"], ["key"], "left_semi").select("tie").distinct()
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).join(ties, "tie", "left_semi")
    canon = texts.select(canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    clash = canon.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("digest")
    return canon.join(clash, "digest", "left_semi").distinct()


def _order(docs: DataFrame) -> tuple[Column, Column, list[int], bool]:
    """(cell, bucket, keys that many rows have, whether many have none) of rows (key, tie).

    Cells are cut at quantiles of the keys, so each holds about 1 / CELLS of the rows; within a
    cell buckets are cut by interpolation. A key that fills cells of its own is cut by ``tie``,
    a hash and so evenly spread. Buckets never fall as (key, tie) grows; null keys come first.
    """
    row = docs.agg(F.count(F.lit(1)).alias("all"), F.count("key").alias("n"), F.percentile_approx("key", [k / CELLS for k in range(CELLS + 1)], 20 * CELLS).alias("cut")).first()
    many_null = row["all"] - row["n"] > BUCKET_ROWS
    cuts = sorted(set(row["cut"] or [0]))
    own = dict.fromkeys(cuts, 0)
    for c in row["cut"] or []:
        own[c] += 1
    inner = max(1, -(-row["all"] // (CELLS * BUCKET_ROWS)))
    ties = [max(1, (own[c] - 1) * inner) for c in cuts]
    longs = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")  # noqa: E731 - folded to one literal
    step = 64
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("key")))
    coarse = below(longs(cuts[::step]))
    cell = F.when(F.col("key").isNull(), -1).when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.slice(longs(cuts), (coarse - 1) * step + 1, F.lit(step))))
    at = F.greatest(cell, F.lit(1))
    low, high, pieces = F.get(longs(cuts), at - 1), F.get(longs([*cuts[1:], cuts[-1]]), at - 1), F.get(longs(ties), at - 1)
    spread = lambda n: F.least(n - 1, F.floor((F.col("tie") / float(1 << 64) + 0.5) * n))
    part = (F.col("key") - low).cast("double") / F.greatest(F.lit(1.0), (high - low).cast("double")) * inner
    inside = F.when(F.col("key").isNull(), spread(F.lit(max(1, (row["all"] - row["n"]) // BUCKET_ROWS)).cast("long")))
    inside = inside.when(F.col("key") == low, spread(pieces)).when(F.col("key") < low, F.lit(0)).otherwise(pieces + F.least(F.greatest(F.floor(part), F.lit(0)), F.lit(inner - 1)))
    return cell, cell.cast("long") * (1 << 40) + inside.cast("long"), [c for c in cuts if own[c] > 1], many_null


def _followed(docs: DataFrame, key: str, text: str, scratch: Scratch, columns: Callable[..., dict[str, Column]]) -> DataFrame:
    """(key, tie, n_chars, digest and ``columns``) of each row, made beside the next one by ascending key.

    ``columns`` gets text, digest, the next row's text and digest. After the last row comes the first. Rows of one
    key follow each other by ``tie``, a hash of their texts. Texts are folded and shuffled once, into windows of
    neighbouring rows. A window's last row meets the next one's first in a second step over one row of each.
    Repeated rows of a frequent key are one row with a number until then.
    """
    raw = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cell, bucket, hot, many_null = _order(raw)
    raw = raw.withColumn("tie", F.xxhash64("text"))
    frequent = (F.col("key").isin(hot) if hot else F.lit(False)) | (F.col("key").isNull() if many_null else F.lit(False))
    if hot or many_null:
        frequent = F.coalesce(frequent, F.lit(False))
        packed = raw.filter(frequent).groupBy("key", "tie", "text").agg(F.count(F.lit(1)).alias("copies"))
        raw = raw.filter(~frequent).withColumn("copies", F.lit(1).cast("long")).unionByName(packed)
    rows = raw.withColumn("digest", digest(canonical(F.col("text")))).withColumn("cell", cell.cast("int")).withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy(F.col("key").asc_nulls_first(), "tie")
    beside = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("digest").over(order).alias("next_digest"), (F.row_number().over(order) == 1).alias("first"))
    beside = beside.withColumn("last", F.col("next_text").isNull())
    if hot or many_null:
        beside = beside.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        inner = F.col("copy") < F.col("copies")
        beside = beside.withColumns({"next_text": F.when(inner, F.col("text")).otherwise(F.col("next_text")), "next_digest": F.when(inner, F.col("digest")).otherwise(F.col("next_digest")), "first": F.col("first") & (F.col("copy") == 1), "last": F.col("last") & ~inner})
    made = scratch.keep(_made(beside, columns).select("key", "tie", "n_chars", "digest", "cell", "bucket", "first", "last", F.when(F.col("first") | F.col("last"), F.col("text")).alias("text"), *columns("text", "digest", "text", "digest")))
    heads = made.filter("first").select("cell", "bucket", "text", "digest")
    # one row for each cell, so CELLS and two at most
    starts = sorted((r["cell"], r["low"]) for r in heads.groupBy("cell").agg(F.min("bucket").alias("low")).collect())
    after = [(c, starts[(k + 1) % len(starts)][1]) for k, (c, _) in enumerate(starts)]
    after = F.broadcast(docs.sparkSession.createDataFrame(after, "cell int, over long"))
    spine = heads.select("cell", "bucket", F.lead("bucket").over(Window.partitionBy("cell").orderBy("bucket")).alias("here")).join(after, "cell").select("bucket", F.coalesce("here", "over").alias("after"))
    heads = heads.select(F.col("bucket").alias("after"), F.col("text").alias("next_text"), F.col("digest").alias("next_digest"))
    names = ["key", "tie", "n_chars", "digest", *columns("text", "digest", "text", "digest")]
    ends = made.filter("last").select("key", "tie", "bucket", "text", "digest", "last").join(spine, "bucket").join(heads, "after").withColumn("last", F.lit(False))
    return made.filter("not last").select(*names).unionByName(_made(ends, columns).select(*names))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): each row beside the text of the next one by ascending key; after the last comes the first."""
    both = _followed(docs, key, text, Scratch(docs.sparkSession), lambda t, d, n, nd: {"own": F.col(t), "following": F.col(n)})
    return both.select("key", F.col("own").alias("text"), F.col("following").alias("next_text"))


def _made(rows: DataFrame, columns: Callable[..., dict[str, Column]]) -> DataFrame:
    tail = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.when(~F.col("last"), F.concat(F.substring("text", F.lit(1), F.length("text") - tail), F.substring("next_text", F.lit(1), tail))))
    rows = rows.withColumn("edited_digest", digest(canonical(F.col("edited"))))
    return rows.withColumns(columns("text", "digest", "next_text", "next_digest"))


def _likenesses(text: str, own: str, following: str, following_digest: str) -> dict[str, Column]:
    return {
        "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256),
        "edited_digest": F.col("edited_digest"),
        "near_edited": _same(F.col(text), F.col(own), F.col("edited"), F.col("edited_digest")),
        "near_next": _same(F.col(text), F.col(own), F.col(following), F.col(following_digest)),
    }


def _variants(clash: DataFrame) -> DataFrame:
    """(digest, canon, variant): the texts of each digest that several share, counted from 0."""
    return clash.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1)


def fingerprint_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, variant, canon, group_id, group_size): the groups of canonically equal texts.

    Rows are grouped by digest with partial sums, so a group of any size is a row for
    each task. Where texts of one digest differ byte by byte, its rows are grouped again
    by the text itself: variant counts from 0, and ``canon`` holds the text; elsewhere
    variant is 0 and canon is null. group_id is the smallest key of the group.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = scratch.keep(rows.select("key", F.xxhash64("text").alias("tie"), digest(canonical(F.col("text"))).alias("digest")))
    clash = scratch.keep(_clashes(docs, rows, key, text))
    sums = (F.min("key").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    out = rows.groupBy("digest").agg(*sums)
    if clash.isEmpty():
        return out.select("digest", F.lit(0).alias("variant"), F.lit(None).cast("string").alias("canon"), "group_id", "group_size")
    out = out.join(clash.select("digest").distinct(), "digest", "left_anti").select("digest", F.lit(0).alias("variant"), F.lit(None).cast("string").alias("canon"), "group_id", "group_size")
    again = docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("canon")).withColumn("digest", digest(F.col("canon"))).join(_variants(clash), ["digest", "canon"])
    return out.unionByName(again.groupBy("digest", "variant", "canon").agg(*sums))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, digest, group_id, group_size and the likenesses of ``op10``) for each row.

    Likeness is 1 where digest and canonical bytes agree, else 0: an exact digest knows
    no half measures. Null texts count as empty. Repeated rows give repeated results.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_followed(docs, key, text, scratch, _likenesses))
    clash = scratch.keep(_clashes(docs, rows, key, text))
    if not clash.isEmpty():  # as good as never: two texts with the same 128 bits
        rows = _marked(docs, rows, clash, key, text, scratch)
    groups = rows.groupBy("digest").agg(F.min("key").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    out = spread_join(rows, groups, ["digest"], ["key"])
    return scratch.last(out.select("key", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next", "group_id", "group_size"))


def _marked(docs: DataFrame, rows: DataFrame, clash: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a dash and the variant after the digests that unlike texts share, the edited texts' too."""
    variants = scratch.keep(_variants(clash))
    texts = lambda t, d: {"canon": F.when(F.col(d).isin([r["digest"] for r in variants.select("digest").distinct().collect()]), canonical(F.col(t)))}
    again = scratch.keep(_followed(docs, key, text, scratch, lambda t, d, n, nd: {**_likenesses(t, d, n, nd), "c_text": texts(t, d)["canon"], "c_edited": texts("edited", "edited_digest")["canon"]}))
    for side, canon in (("digest", "c_text"), ("edited_digest", "c_edited")):
        named = variants.select(F.col("digest").alias(side), F.col("canon").alias(canon), F.col("variant").alias("__v"))
        again = again.join(named, [side, canon], "left").withColumn(side, F.concat(F.col(side), F.coalesce(F.concat(F.lit("-"), F.col("__v")), F.lit("")))).drop("__v")
    return scratch.keep(again.select(*rows.columns))
