"""Sinks: reports, hits, datasets by split, and the texts of versions. All write from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(rows: DataFrame, path: str) -> None:
    """A JSON line per record, replacing an older report."""
    rows.write.mode("overwrite").json(path)


def append_hits(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder per split, replacing older ones."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_versions(versions: DataFrame, path: str) -> None:
    """versions (source, seq, label, text): a text file in a folder source=.../version=NN_label per version."""
    name = F.concat_ws("_", F.lpad(F.col("seq").cast("string"), 2, "0"), F.regexp_replace("label", "[^0-9A-Za-z-]+", "-"))
    rows = versions.select("source", name.alias("version"), F.col("text").alias("value"))
    rows.repartition("source", "version").write.mode("overwrite").partitionBy("source", "version").text(path)
