"""Streams with state of their own end with what their batch twins, and rows taken one by one, give."""

import datetime as dt
import random

import numpy as np
from compare import DATA
from pyspark.sql import functions as F

from wardline.operators import campaigns, folds
from wardline.streaming import queries as Q
from wardline.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, query, name, files=3):
    """Rows written in time order into several files, each a micro-batch of the stream; the query is stopped and started again after the first."""
    rows = rows.orderBy("ts").toPandas()
    source, check = tmp_path / f"{name}-in", tmp_path / f"{name}-ck"
    schema = query.__defaults__[0]
    cut = np.array_split(rows, files)
    for part in cut:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = query(spark.readStream.schema(schema).parquet(str(source)))
        out = stream.writeStream.outputMode("append").option("checkpointLocation", str(check)).trigger(availableNow=True)
        out.format("parquet").start(str(tmp_path / f"{name}-out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_cached_stream_equals_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 40).alias("host"), "value", "event_type")
    cache = events.filter("event_type = 'click'").groupBy("host", F.col("ts").alias("fetched_at")).agg(F.max("value").alias("age"))
    expect = {r["event_id"]: r["age"] for r in Q.cached_lookup(events.select("event_id", "ts", "host"), cache, "host").collect()}
    rows = events.select("host", F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("value"))
    got = streamed(spark, tmp_path, rows, lambda s, schema=rows.schema: stateful.cached_stream(s, "host"), "cache", files=2)
    assert {r["id"]: r["value"] for r in got.collect()} == expect
    assert 0 < sum(v is not None for v in expect.values()) < len(expect)


def test_clock_cache_keeps_the_last_value(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, T0, 5.0), ("a", 2, T0, None), ("b", 3, T0, None)], "host string, id int, ts timestamp, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stateful.cached_by_clock(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "host")
    # a stream by the clock has always another batch to run, so it is stopped once the rows are through
    out = found.writeStream.outputMode("append").format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            out.awaitTermination(1)
            if spark.table("clock").count() == 3:
                break
    finally:
        out.stop()
    assert {r["id"]: r["value"] for r in spark.table("clock").collect()} == {1: 5.0, 2: 5.0, 3: None}


def one_by_one(rows, join_at, found_at):
    """(campaign, how) by id: every message against the means of all campaigns of its channel, in order."""
    state, out = {}, {}
    for channel, i, _, v, risk in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine, v = state.setdefault(channel, []), np.array(v, float)
        like = [round(max(0.0, float(np.mean(c[1], axis=0) @ v / np.linalg.norm(np.mean(c[1], axis=0)) / np.linalg.norm(v))), 9) for c in mine]
        if like and max(like) >= join_at:
            mine[like.index(max(like))][1].append(v)
            out[i] = (mine[like.index(max(like))][0], "joined")
        elif risk >= found_at:
            mine.append((i, [v]))
            out[i] = (i, "founded")
        else:
            out[i] = (None, "none")
    return out


def test_campaigns_one_by_one(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    rng = random.Random(4)
    rows = [(r["vec_id"] % 3, r["vec_id"], T0 + dt.timedelta(minutes=r["vec_id"] // 2), [float(x) for x in r["embedding"]], float(rng.randrange(100))) for r in vectors]
    schema = "channel long, id long, ts timestamp, vector array<double>, risk double"
    expect = one_by_one(rows, 0.3, 60.0)
    df = spark.createDataFrame(rows, schema)
    batch = {r["id"]: (r["campaign"], r["how"]) for r in campaigns.online(df, join_at=0.3).collect()}
    assert batch == expect and {h for _, h in expect.values()} == {"joined", "founded", "none"}
    got = streamed(spark, tmp_path, df, lambda s, schema=df.schema: stateful.campaign_events(s, join_at=0.3), "campaigns", files=2)
    assert {r["id"]: (r["campaign"], r["how"]) for r in got.collect()} == expect


def test_folds_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5), ("a", 1, 7), (None, 2, 6), ("a", 2, 7)], "k string, us long, n int")
    step = lambda s, r: ((s or 0) + r["n"], {"k": r["k"], "total": (s or 0) + r["n"]})
    assert sorted(map(str, folds.fold(rows, ["k"], ["us"], step, "k string, total int").collect())) == sorted(["Row(k=None, total=5)", "Row(k=None, total=11)", "Row(k='a', total=7)", "Row(k='a', total=14)"])
    assert folds.fold(rows.filter("false"), ["k"], ["us"], step, "k string, total int").count() == 0
    none = folds.online_campaigns(0.5, 60, ("id",))
    state, out = none(None, {"id": 1, "us": 0, "vector": None, "risk": 99.0})
    assert out["how"] == "none" and none(state, {"id": 2, "us": 0, "vector": [0.0, 0.0], "risk": 99.0})[1]["how"] == "none"


def test_a_key_remembers_so_many_campaigns():
    step, state = folds.online_campaigns(0.99, 0, ("id",), most=2), None
    for k in range(4):
        state, _ = step(state, {"id": k, "us": k, "vector": [1.0 if j == k else 0.0 for j in range(4)], "risk": 1.0})
    assert [c[0] for c in state] == [2, 3]
