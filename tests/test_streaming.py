"""Streams end with what their batch twins give."""

import datetime as dt

from pyspark.sql import functions as F

from wardline.streaming import queries as Q

T0 = dt.datetime(2024, 1, 1)


def replay(spark, tmp_path, rows, schema, query, mode="append", sink=None):
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = query(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    if sink:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    writer.format("memory").queryName("out").start().awaitTermination()
    return spark.table("out").collect()


def test_windowed_counts(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=20 * k), "FLAG" if k % 2 else "ALLOW", float(k)) for k in range(30)]
    schema = "ts timestamp, decision string, risk double"
    got = {tuple(r) for r in replay(spark, tmp_path, rows, schema, Q.decisions_by_window, "complete")}
    assert got == {tuple(r) for r in Q.decisions_by_window(spark.createDataFrame(rows, schema)).collect()}


def test_messages_once(spark, tmp_path):
    rows = [("a", T0), ("a", T0), ("b", T0)]
    assert sorted(r[0] for r in replay(spark, tmp_path, rows, "message_id string, ts timestamp", Q.distinct_messages)) == ["a", "b"]


def test_token_bucket(spark, tmp_path):
    rows = [("c", T0 + dt.timedelta(seconds=k)) for k in (0, 1, 2, 60)]
    got = replay(spark, tmp_path, rows, "client string, ts timestamp", lambda s: Q.rate_limited(s, per_minute=1, burst=2))
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["ts"])] == [True, True, False, True]


def test_circuit_breaker(spark, tmp_path):
    rows = [("p", T0 + dt.timedelta(seconds=k), True) for k in range(5)] + [("p", T0 + dt.timedelta(seconds=200), False), ("p", T0 + dt.timedelta(seconds=201), False)]
    got = replay(spark, tmp_path, rows, "provider string, ts timestamp, failed boolean", Q.breaker_events)
    assert [r["state"] for r in sorted(got, key=lambda r: r["ts"])] == ["closed"] * 4 + ["open", "half-open", "closed"]


def test_graph_upsert_is_repeatable(spark, tmp_path):
    schema = "src string, dst string, rel string, risk double, malicious boolean, confidence double, ts timestamp"
    batch = spark.createDataFrame([("a", "b", "R", 1.0, False, 0.5, T0), ("a", "b", "R", 9.0, True, 0.7, T0)], schema)
    write = Q.upsert_graph(str(tmp_path))
    for k in (0, 1, 1):
        write(batch, k)
    edge = Q.read_graph(spark, str(tmp_path), "edges").first()
    assert (edge["count"], edge["confidence"]) == (4, 0.7)
    assert Q.read_graph(spark, str(tmp_path), "nodes").filter(F.col("id") == "a").first()["risk"] == 9.0
    # other keys leave the folders of these as they are
    other = batch.withColumns({"src": F.lit("x"), "dst": F.lit("y")})
    for k in (2, 3, 4):
        write(other, k)
    counts = {(r["src"], r["dst"]): r["count"] for r in Q.read_graph(spark, str(tmp_path), "edges").collect()}
    assert set(counts.values()) == {4, 6} and len(list((tmp_path / "edges").glob("folder=*/version=*"))) == 4


def test_recent_events_keep_the_latest(spark, tmp_path):
    write = Q.recent_events(str(tmp_path), keep=3)
    for k in range(2):
        write(spark.createDataFrame([(5 * k + i, T0 + dt.timedelta(hours=5 * k + i)) for i in range(5)], "event_id int, ts timestamp"), k)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "1")).collect()) == [7, 8, 9]


def test_breaker_tries_again_after_its_cooldown(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    calls = [(0, True), (1, True), (2, True), (3, True), (10, True), (60, False), (130, True), (140, True), (260, False), (261, True)]
    rows = spark.createDataFrame([("p", at(s), f) for s, f in calls], "provider string, ts timestamp, failed boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = Q.breaker_events(stream).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = [r["state"] for r in spark.sql("select * from breaker order by ts").collect()]
    # refused calls at 10 and 60 change nothing; the try at 130 fails and opens it again; the one at 260 closes it
    assert got == ["closed"] * 4 + ["open", "open", "half-open", "open", "half-open", "closed"]


def test_feeds_are_refreshed(spark, tmp_path):
    path = str(tmp_path / "feeds")
    kind = "ioc_type string, value string"

    def broken(_):
        raise OSError("gone")

    readers = {"a": lambda s: s.createDataFrame([("url", "u1"), ("url", "u2"), ("url", "u1")], kind), "b": broken}
    for _ in range(2):
        Q.refresh_feeds(spark, readers, path, available_now=True).awaitTermination(60)
    assert sorted((r["value"], r["source"]) for r in spark.read.parquet(path).collect()) == [("u1", "a"), ("u2", "a")]


def test_verdicts_stream_in_two_phases(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 40.0, "FLAG"), (1, 2, 90.0, "BLOCK"), (2, 1, 5.0, "ALLOW")], "id int, phase int, risk double, decision string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = Q.latest_verdicts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("verdicts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    last = {r["id"]: (r["decision"], r["revised"]) for r in spark.sql("select * from verdicts").collect()}
    assert last == {1: ("BLOCK", True), 2: ("ALLOW", False)}


def test_messages_get_a_verdict_as_they_come(spark, tmp_path):
    rows = [(1, T0, "URGENT: verify your account, share the OTP"), (2, T0, "see you at lunch"), (3, T0, None)]
    schema = "id int, ts timestamp, text string"
    got = {r["id"]: (r["intents"], r["score"], r["decision"]) for r in replay(spark, tmp_path, rows, schema, Q.scored_messages)}
    assert got == {r["id"]: (r["intents"], r["score"], r["decision"]) for r in Q.scored_messages(spark.createDataFrame(rows, schema)).collect()}
    assert got[1][0] == ["credential_request", "otp_request", "urgency"] and got[1][1:] == (59.1, "FLAG") and got[2][2] == "ALLOW" and got[3][1] == 0.0
