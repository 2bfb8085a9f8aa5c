"""Streaming queries. Each works on a batch too, where its result is what the stream ends with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.scores import decision
from wardline.functions.text import intent_hits, intent_score
from wardline.operators.graph import merge_edges, merge_nodes
from wardline.streaming.stateful import breaker_events, cached_stream, campaign_events, rate_limited  # noqa: F401 - the streams with state of their own


def decisions_by_window(rows: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, decision, n) of tumbling windows; later rows than ``late`` are left out of a stream."""
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counted = rows.groupBy(F.window("ts", width).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "decision", "n")


def risk_last_day(rows: DataFrame, step: str = "1 hour") -> DataFrame:
    """(window_end, mean_risk, n) of a day that slides by ``step``."""
    rows = rows.withWatermark("ts", "2 hours") if rows.isStreaming else rows
    counted = rows.groupBy(F.window("ts", "24 hours", step).alias("w")).agg(F.avg("risk").alias("mean_risk"), F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.end").alias("window_end"), "mean_risk", "n")


def distinct_messages(rows: DataFrame, key: str = "message_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each message once. A stream forgets keys older than ``late``: its state is bounded, unlike a set of all ids."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


#: Folders that keys are dealt over: a micro-batch rewrites those it touches.
FOLDERS = 64


def upsert_graph(path: str, folders: int = FOLDERS):
    """A foreachBatch function that merges nodes and edges of each micro-batch into folders by a hash of their key.

    The batch is read once. Only folders that it touches are written, each as the version of the batch; the one
    before is kept, so a batch that runs again starts from what was there before it, and older ones are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        nodes = rows.selectExpr("explode(array(src, dst)) as id", "risk", "malicious", "ts as first_seen", "ts as last_seen")
        edges = rows.selectExpr("src", "dst", "rel", "1L as count", "confidence", "ts as first_seen", "ts as last_seen")
        for name, new, merge, key in (("nodes", nodes, merge_nodes, ["id"]), ("edges", edges, merge_edges, ["src", "dst", "rel"])):
            spot = F.pmod(F.xxhash64(*key), F.lit(folders)).cast("int")
            touched = sorted(r[0] for r in new.select(spot).distinct().collect())  # as many as there are folders, at most
            versions = _versions(spark, f"{path}/{name}")
            old = [f"{path}/{name}/folder={k}/version={max(v for v in versions[k] if v < batch_id)}" for k in touched if any(v < batch_id for v in versions.get(k, ()))]
            both = new.unionByName(spark.read.parquet(*old)) if old else new
            merged = merge(both).withColumn("folder", spot).repartition("folder")
            for k in touched:
                _delete(spark, f"{path}/{name}/folder={k}/version={batch_id}")
                for v in sorted(v for v in versions.get(k, ()) if v < batch_id)[:-1]:
                    _delete(spark, f"{path}/{name}/folder={k}/version={v}")
            merged.withColumn("version", F.lit(batch_id)).write.mode("append").partitionBy("folder", "version").parquet(f"{path}/{name}")
        rows.unpersist()

    return write


def read_graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The nodes or edges that ``upsert_graph`` has written, at each folder's last version."""
    last = [f"{path}/{name}/folder={k}/version={max(v)}" for k, v in sorted(_versions(spark, f"{path}/{name}").items())]
    return spark.read.parquet(*last)


def _listed(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    number = lambda names, kind: [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return {k: number(_listed(spark, f"{path}/folder={k}"), "version") for k in number(_listed(spark, path), "folder")}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def refresh_feeds(spark: SparkSession, readers: dict, path: str, minutes: int = 30, available_now: bool = False):
    """A started query that reads all feeds (name to a function of the session) every ``minutes``, five at least, and adds what is new to ``path``.

    A feed that can't be read leaves what its last refresh brought.
    """

    def write(_: DataFrame, batch_id: int) -> None:
        for name, reader in readers.items():
            try:
                new = reader(spark).withColumn("source", F.lit(name))
                kept = spark.read.parquet(path) if _listed(spark, path) else None
                rows = new if kept is None else new.join(kept, ["ioc_type", "value", "source"], "left_anti")
                rows.dropDuplicates(["ioc_type", "value", "source"]).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)
            except Exception as e:  # noqa: BLE001 - one broken feed must not stop the others
                print(f"feed {name}: {e}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(write)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime=f"{max(5, minutes)} minutes").start()


def scored_messages(rows: DataFrame) -> DataFrame:
    """(id, ts, intents, score, decision) of messages (id, ts, text): the fast verdict, row by row, so a stream needs no state for it."""
    hits = rows.withColumn("hits", intent_hits(F.col("text")))
    score = F.round(100 * intent_score(F.coalesce("hits", F.array().cast("array<struct<id:string,weight:double,evidence:array<string>>>"))), 1)
    return hits.select("id", "ts", F.array_sort(F.transform("hits", lambda h: h["id"])).alias("intents"), score.alias("score"), decision(score).alias("decision"))


def latest_verdicts(rows: DataFrame) -> DataFrame:
    """(id, phase, risk, decision, revised) of verdicts (id, phase, risk, decision): the last phase counts, ``revised`` if it changed the decision.

    On a stream in update mode a detection is sent again when its full verdict follows the fast one.
    """
    last, first = F.max_by(F.struct("risk", "decision"), "phase"), F.min_by("decision", "phase")
    out = rows.groupBy("id").agg(F.max("phase").alias("phase"), last.alias("v"), first.alias("fast"))
    return out.select("id", "phase", "v.risk", "v.decision", (F.col("v.decision") != F.col("fast")).alias("revised"))


def cached_lookup(rows: DataFrame, cache: DataFrame, key: str, hours: float = 6.0) -> DataFrame:
    """Rows (key, ts, …) with the latest cache entry (key, fetched_at, …) that was no older than ``hours`` when the row came; null otherwise.

    Rows and entries of a key are laid in time order side by side, in stretches of ``hours``: an entry stands in its own
    stretch and in the next one. So nothing is multiplied, and a key with very many rows is as many groups as it has stretches. Of
    entries fetched at one time the greatest counts. The batch twin of ``cached_stream``.
    """
    width = int(hours * 3_600_000_000)
    stretch = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / width)
    entry, row = F.struct(*cache.columns), F.struct(*rows.columns)
    none = lambda df, of: F.lit(None).cast(df.select(of.alias("x")).schema["x"].dataType)
    kept = cache.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col("fetched_at").alias("__t"), F.lit(0).alias("__kind"), entry.alias("__e"), none(rows, row).alias("__r"))
    kept = kept.withColumn("__s", F.explode(F.array(stretch(F.col("__t")), stretch(F.col("__t")) + 1)))
    asked = rows.select(F.col(key).alias("__k"), F.col("ts").alias("__t"), F.lit(1).alias("__kind"), none(cache, entry).alias("__e"), row.alias("__r")).withColumn("__s", stretch(F.col("__t")))
    order = Window.partitionBy("__k", "__s").orderBy("__t", "__kind", "__e").rowsBetween(Window.unboundedPreceding, 0)
    met = kept.unionByName(asked).withColumn("__last", F.last("__e", ignorenulls=True).over(order)).filter("__kind = 1")
    fresh = F.col("__last.fetched_at") > F.col("__t") - F.expr(f"interval {int(hours * 3600)} seconds")
    return met.select("__r.*", *[F.when(fresh, F.col(f"__last.{c}")).alias(c) for c in cache.columns if c != key])


def recent_events(path: str, keep: int = 200):
    """A foreachBatch function that leaves the latest ``keep`` events of all batches so far, versioned like the graph."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/{batch_id - 1}"))
        rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return write
