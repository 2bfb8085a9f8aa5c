"""Queries over decisions, events and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scores import decision
from wardline.operators import analytics as A
from wardline.operators import campaigns as C
from wardline.operators import folds
from wardline.plans.registry import query, table
from wardline.streaming.queries import decisions_by_window

_DET = "det AS (SELECT event_id, ts, user_id, event_type, value, least(100.0, value) AS risk, {d} AS decision FROM events)".format(
    d="CASE WHEN least(100.0, value) >= 85 THEN 'BLOCK' WHEN least(100.0, value) >= 60 THEN 'QUARANTINE' WHEN least(100.0, value) >= 30 THEN 'FLAG' ELSE 'ALLOW' END"
)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as detections: the value is the risk, at most 100."""
    risk = F.least(F.lit(100.0), F.col("value"))
    return table(spark, sf, "events").withColumn("risk", risk).withColumn("decision", decision(F.col("risk")))


@query(f"WITH {_DET} SELECT event_id, risk, decision, event_type FROM det WHERE risk >= 60 AND decision = 'BLOCK' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 50")
def detections_filter_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = detections(spark, sf)
    now = found.agg(F.max("ts")).first()[0]
    kept = found.filter((F.col("risk") >= 60) & (F.col("decision") == "BLOCK") & (F.col("ts") >= F.lit(now) - F.expr("INTERVAL 7 DAYS")))
    return A.newest(kept, "ts", "event_id", 50).select("event_id", "risk", "decision", "event_type")


@query(
    f"""WITH {_DET}, b AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS z FROM events), s AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b)
SELECT strftime(hour, '%Y-%m-%d %H:00') AS hour, count(event_id) AS n, count(*) FILTER (decision = 'ALLOW') AS n_allow, count(*) FILTER (decision = 'FLAG') AS n_flag,
  count(*) FILTER (decision = 'QUARANTINE') AS n_quarantine, count(*) FILTER (decision = 'BLOCK') AS n_block FROM s LEFT JOIN det ON date_trunc('hour', ts) = hour GROUP BY 1"""
)
def decision_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return A.hourly_decisions(detections(spark, sf), "ts", "decision").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00"))


@query(f"WITH {_DET} SELECT decision, count(*) AS n, round(avg(value), 6) AS mean_value FROM det GROUP BY decision")
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(f"WITH {_DET}, s AS (SELECT i::INT AS bin FROM range(0, 10) AS r(i)) SELECT bin, count(event_id) AS n FROM s LEFT JOIN det ON least(9, floor(risk / 10)) = bin GROUP BY bin")
def risk_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(detections(spark, sf), F.col("risk"))


_CUT = "(SELECT max(ts) FROM events) - INTERVAL 7 DAY"


def _recent(spark: SparkSession, sf: str):
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return F.col("ts") >= F.lit(now) - F.expr("INTERVAL 7 DAYS")


@query(
    f"""WITH {_DET}, h AS (SELECT least(9, floor(risk / 10)) AS bin, count(*) FILTER (ts < {_CUT}) AS p, count(*) FILTER (ts >= {_CUT}) AS q FROM det GROUP BY 1),
f AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM range(0, 10) AS r(i) LEFT JOIN h ON h.bin = i), t AS (SELECT sum(p)::BIGINT AS n_old, sum(q)::BIGINT AS n_recent FROM f),
s AS (SELECT n_old, n_recent, greatest(p * 1.0::DOUBLE / n_old, 0.0001::DOUBLE) AS p, greatest(q * 1.0::DOUBLE / n_recent, 0.0001::DOUBLE) AS q FROM f, t)
SELECT n_old, n_recent, CASE WHEN n_old >= 20 AND n_recent >= 20 THEN round(sum((q - p) * ln(q / p)), 4) END AS psi FROM s GROUP BY 1, 2"""
)
def drift_psi(spark: SparkSession, sf: str) -> DataFrame:
    return A.psi(detections(spark, sf), F.col("risk"), _recent(spark, sf))


@query(
    f"""WITH e AS (SELECT user_id, props->>'$.k' AS k, ts FROM events)
SELECT user_id, k FROM e GROUP BY user_id, k HAVING min(ts) >= {_CUT}"""
)
def drift_new_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "ts")
    return A.new_values(rows, ["user_id", "k"], _recent(spark, sf))


@query(
    f"""WITH {_DET} SELECT event_type, round(count(*) FILTER (decision IN ('BLOCK', 'QUARANTINE') AND ts >= {_CUT}) * 1.0 / nullif(count(*) FILTER (ts >= {_CUT}), 0), 6) AS bad_rate,
  round(count(*) FILTER (risk < 30 AND user_id < 0) * 1.0 / nullif(count(*) FILTER (user_id < 0), 0), 6) AS false_rate FROM det GROUP BY event_type"""
)
def rates(spark: SparkSession, sf: str) -> DataFrame:
    """The second rate has no rows and so is null."""
    bad = A.rate(F.col("decision").isin("BLOCK", "QUARANTINE"), _recent(spark, sf))
    false = A.rate(F.col("risk") < 30, F.col("user_id") < 0)
    return detections(spark, sf).groupBy("event_type").agg(F.round(bad, 6).alias("bad_rate"), F.round(false, 6).alias("false_rate"))


@query(
    """WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, median(value) AS p50, max(value) FILTER (k = least(n - 1, floor(n * 0.95))) AS p95, max(value) FILTER (k = least(n - 1, floor(n * 0.99))) AS p99 FROM k GROUP BY event_type"""
)
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return A.latency_quantiles(table(spark, sf, "events"), "value", "event_type")


_SCORED = "s AS (SELECT l.toxic AS label, round(((d.doc_id * 7919) % 101) / 100.0, 2)::DOUBLE * 0.6 + l.toxic * 0.3 AS score FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with a made-up score that follows the label loosely."""
    docs = table(spark, sf, "documents").select("doc_id")
    made = F.round((F.col("doc_id") * 7919) % 101 / 100.0, 2) * 0.6 + F.col("toxic") * 0.3
    return table(spark, sf, "labels").join(docs, "doc_id").select(F.col("toxic").alias("label"), made.alias("score"))


@query(
    f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn,
  count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM s) SELECT *, tp * 1.0 / (tp + fp) AS precision, tp * 1.0 / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM c"""
)
def metrics_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return A.confusion(_scored(spark, sf), F.col("score"), F.col("label"))


@query(
    f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
t AS (SELECT sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 9) AS auc FROM t"""
)
def metrics_auc(spark: SparkSession, sf: str) -> DataFrame:
    return A.roc_auc(_scored(spark, sf), F.col("score"), F.col("label")).select(F.round("auc", 9).alias("auc"))


@query(
    f"""WITH {_SCORED}, g AS (SELECT score, sum(label)::BIGINT AS pos, count(*) AS n FROM s GROUP BY score),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * tp * 1.0 / n) / sum(pos), 9) AS ap FROM c"""
)
def metrics_ap(spark: SparkSession, sf: str) -> DataFrame:
    return A.average_precision(_scored(spark, sf), F.col("score"), F.col("label")).select(F.round("ap", 9).alias("ap"))


@query(
    """WITH t AS (SELECT 'event' AS kind, event_id AS id, ts AS happened FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders)
SELECT kind, id FROM t ORDER BY happened DESC, kind DESC, id DESC LIMIT 14"""
)
def timeline_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    orders = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return events.unionByName(orders).orderBy(F.desc("at"), F.desc("kind"), F.desc("id")).limit(14).select("kind", "id")


@query("SELECT event_type, event_id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 200")
def history_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return A.keep_last(table(spark, sf, "events"), ["event_type"], "ts", "event_id", 200).select("event_type", "event_id", "position")


@query(
    """SELECT event_type, event_id, (row_number() OVER w)::INT AS version, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'archived' END AS status FROM events WHERE value > 200
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""
)
def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "events").filter("value > 200")
    return A.versions(made, "event_type", "ts", "event_id").select("event_type", "event_id", "version", "status")


@query(
    """WITH f AS (SELECT *, (value < 40)::INT AS fail FROM events), i AS (SELECT *, sum(1 - fail) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT event_id, user_id, (sum(fail) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS failures,
  sum(fail) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 4 AS open FROM i"""
)
def circuit_breaker_twin(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return A.breaker_states(events, "user_id", "ts", "event_id", F.col("value") < 40).select("event_id", "user_id", "failures", "open")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT event_id, user_id, t, k, 3.0::DOUBLE - 1 AS tokens, true AS allowed FROM e WHERE k = 1
UNION ALL SELECT e.event_id, e.user_id, e.t, e.k, CASE WHEN least(3.0, b.tokens + (e.t - b.t) / 86400.0) < 1 THEN least(3.0, b.tokens + (e.t - b.t) / 86400.0) ELSE least(3.0, b.tokens + (e.t - b.t) / 86400.0) - 1 END,
  least(3.0, b.tokens + (e.t - b.t) / 86400.0) >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT user_id, count(*) AS n, count(*) FILTER (allowed) AS n_allowed FROM b GROUP BY user_id"""
)
def rate_limiter_twin(spark: SparkSession, sf: str) -> DataFrame:
    """Token bucket of 3, one a day, over each user's calls in order."""
    calls = table(spark, sf, "events").select("user_id", "event_id", folds.micros(F.col("ts")).alias("us"))
    told = folds.fold(calls, ["user_id"], ["us", "event_id"], folds.token_bucket(1 / 1440, 3, ("user_id",)), "user_id long, allowed boolean")
    return told.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("n_allowed"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value < 120 AS failed, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT event_id, user_id, us, k, 'closed' AS state, failed::INT AS failures, CASE WHEN failed AND 1 >= 3 THEN us ELSE 0 END AS opened FROM e WHERE k = 1
UNION ALL SELECT event_id, user_id, us, k, state, CASE WHEN state = 'open' THEN failures WHEN failed THEN failures + 1 ELSE 0 END AS failures,
  CASE WHEN state <> 'open' AND failed AND failures + 1 >= 3 THEN us ELSE opened END FROM (
  SELECT e.event_id, e.user_id, e.us, e.k, e.failed, b.failures, b.opened, CASE WHEN b.failures < 3 THEN 'closed' WHEN e.us - b.opened > 172800000000 THEN 'half-open' ELSE 'open' END AS state
  FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
SELECT event_id, user_id, state, failures FROM b"""
)
def circuit_breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    """Breakers of users, with a cooldown of two days and half-open tries: the stream's own step over a batch."""
    calls = table(spark, sf, "events").select("event_id", "user_id", folds.micros(F.col("ts")).alias("us"), (F.col("value") < 120).alias("failed"))
    step = folds.circuit_breaker(3, 172_800, ("event_id", "user_id"))
    return folds.fold(calls, ["user_id"], ["us", "event_id"], step, "event_id long, user_id long, state string, failures int")


@query()
def campaign_online(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as messages of eight channels that come in order of their numbers: campaigns joined and founded one by one."""
    n = F.col("vec_id")
    told = table(spark, sf, "embeddings").select((n % 8).cast("int").alias("channel"), n.alias("id"), F.timestamp_seconds(n).alias("ts"), F.col("embedding").alias("vector"), (F.pmod(F.xxhash64(n), F.lit(100))).cast("double").alias("risk"))
    return C.online(told).select("channel", "id", "campaign", "how", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DET} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, decision, count(*) AS n FROM det GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Batch twin of the windowed stream query."""
    return decisions_by_window(detections(spark, sf)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "decision", "n")


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user with gaps under six hours; an addition of this engine."""
    events = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return events.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query(
    """SELECT event_type, CASE WHEN count(*) FILTER (value >= 0) > 0 THEN true ELSE false END AS ok, count(*) AS lookups, count(*) FILTER (user_id % 2 = 0) AS cached,
  max(least(100.0, value) * ((event_id % 10) / 10.0)) AS worst, arg_max(event_id, (least(100.0, value) * ((event_id % 10) / 10.0), -event_id)) AS worst_id FROM events GROUP BY event_type"""
)
def source_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether any lookup succeeded, the worst by risk times confidence, lookups, cached ones."""
    weight = F.least(F.lit(100.0), F.col("value")) * ((F.col("event_id") % 10) / 10.0)
    rows = table(spark, sf, "events").groupBy("event_type")
    return rows.agg(
        F.bool_or(F.col("value") >= 0).alias("ok"), F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("user_id") % 2 == 0).alias("cached"), F.max(weight).alias("worst"),
        F.max_by("event_id", F.struct(weight, -F.col("event_id"))).alias("worst_id"),
    )


