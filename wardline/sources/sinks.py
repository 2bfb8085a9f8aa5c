"""Sinks: JSON lines, snapshots, metrics text, graph JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines, as the queue of later training."""
    rows.write.mode("append").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table and a manifest (table, rows, columns); returns the manifest."""
    if not tables:
        raise ValueError("no tables")
    lines = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        written = df.sparkSession.read.parquet(f"{path}/{name}")
        lines.append((name, written.count(), len(written.columns)))
    manifest = next(iter(tables.values())).sparkSession.createDataFrame(lines, "table string, rows long, columns int")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def metrics_text(counts: DataFrame, metric: str, label: str, value: str = "n") -> DataFrame:
    """(line): counts in the text form that metrics servers read."""
    return counts.select(F.format_string(f'{metric}{{{label}="%s"}} %s', F.col(label).cast("string"), F.col(value).cast("string")).alias("line")).orderBy("line")


def graph_json(nodes: DataFrame) -> DataFrame:
    """(id, json): nodes as JSON that names only the properties they have."""
    return nodes.select("id", F.to_json(F.struct(*nodes.columns), {"ignoreNullFields": "true"}).alias("json"))
