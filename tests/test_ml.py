"""Models train and separate what can be separated."""

from pyspark.sql import functions as F

from wardline import ml

SF = "/root/testdata/sf0.01"


def test_link_models(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://login-"), "id", F.lit(".bad.test/verify"))).otherwise(F.concat(F.lit("https://site"), "id", F.lit(".example.org/news"))).alias("normalized"), (F.col("id") % 2 == 0).cast("double").alias("label"))
    scored = ml.positive(ml.ngram_model(rows, buckets=1 << 12).transform(ml.balanced(rows).withColumn("grams", ml.U.char_ngrams(F.col("normalized")))))
    assert scored.filter("(p > 0.5) <> (label = 1)").count() == 0
    calibrated = ml.calibrate(scored)
    assert calibrated.boundaries.size > 0


def test_trees_and_clusters(spark):
    rows = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    for boosted in (True, False):
        model = ml.tree_model(rows, ["x", "y"], boosted, trees=3)
        assert model.transform(ml.balanced(rows)).filter("prediction <> label").count() == 0
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    centres = ml.clusters(vectors, k=4).collect()
    assert len(centres) == 4 and all(abs(sum(x * x for x in r["centre"]) - 1) < 1e-6 for r in centres)


def test_texts_and_explanations(spark):
    rows = spark.createDataFrame([(k, "verify your account now" if k % 2 else "lunch on friday then", float(k % 2)) for k in range(40)], "id int, text string, label double")
    model = ml.tfidf_model(rows, buckets=1 << 10)
    assert rows.select("label", model.margins(ml.word_features(F.col("text"))).alias("m")).filter("(m > 0) <> (label = 1)").count() == 0
    weights = spark.createDataFrame([("verify", 2.0), ("account", 1.0), ("lunch", -3.0)], "term string, weight double")
    got = {r["id"]: [x["term"] for x in r["reasons"]] for r in ml.contributions(rows, weights, "id", ml.word_features(F.col("text"))).collect()}
    assert got[1] == ["verify", "account"] and 0 not in got


def test_places_are_those_of_the_library(spark):
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(numFeatures=1 << 18)
    for term in ("a", "ab", "abc", "abcd", "verify_account", "தமிழ்", "", "zz" * 40):
        assert ml.bucket_of(term, 1 << 18) == tf.indexOf(term)


def test_explanations_sum_up_to_the_margin(spark):
    """On documents: sublinear weights as plain Python counts them, and reasons, rest and the fitted model's margin agree."""
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label")).limit(200)
    model = ml.tfidf_model(rows, buckets=1 << 12, iterations=5)
    words = rows.select("doc_id", ml.word_features(F.col("text")).alias("w"))
    told = words.select("doc_id", "w", model.explained(F.col("w")).alias("e"), ml.sublinear_vectors(F.col("w"), model.idf).alias("v")).collect()
    for r in told:
        tf = {}
        for t in r["w"]:
            tf[ml.bucket_of(t, 1 << 12)] = tf.get(ml.bucket_of(t, 1 << 12), 0) + 1
        raw = {k: (1 + math.log(n)) * (model.idf[k] + 1) for k, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        assert {int(k): round(x, 9) for k, x in zip(r["v"].indices, r["v"].values)} == {k: round(x / norm, 9) for k, x in raw.items()}
        margin = model.intercept + sum(model.coefficients.get(k, 0.0) * x / norm for k, x in raw.items())
        assert abs(r["e"]["margin"] - margin) < 1e-9 and abs(r["e"]["rest"] + sum(x["weight"] for x in r["e"]["reasons"]) - margin) < 1e-9
        terms = [x["term"] for x in r["e"]["reasons"]]
        assert len(terms) <= 8 and not any(a != b and a in b for a in terms for b in terms)
