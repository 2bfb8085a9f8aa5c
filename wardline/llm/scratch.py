"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors must see; only a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: With it Spark removes a query's shuffle files once the query has ended; until then lost ones are made again as always.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = threading.Lock(), []


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Sets the option while any thread writes; the last one to end puts back what was there before."""
    with _lock:
        if not _writing:
            _writing.append(spark.conf.get(_CLEANUP, "false"))
        _writing.append(None)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writing.pop()
            if len(_writing) == 1:
                spark.conf.set(_CLEANUP, _writing.pop())


class Scratch:
    """Parquet tables of one run, each droppable once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wardline-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: executors lost later don't recompute it."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        with _clean_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wardline_path = path
        return out

    def last(self, df: DataFrame) -> DataFrame:
        """Like ``keep``, and the run's other tables are deleted: what stays is the result."""
        out = self.keep(df)
        self.root, old = out._wardline_path, self.root
        for k in range(1, self.made):
            self._delete(f"{old}/{k}")
        return out

    def _delete(self, path: str) -> None:
        try:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended, its folder is then its owner's to clear
            return

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or without any given the whole run's."""
        for path in [t._wardline_path for t in tables] or [self.root]:
            self._delete(path)


def bitmap(hashes: DataFrame, column: str, size: int) -> np.ndarray:
    """``size`` bits, a power of two, with those of the hashes set: size / 64 rows come to the driver at most."""
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = hashes.select(place.alias("place")).select(F.shiftright("place", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the md5 of the parts, joined by a colon; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
