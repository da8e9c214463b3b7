"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of the warehouse, or in local mode one of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        local = sc.master == "local" or sc.master.startswith("local[")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexstrata-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once and read back: what follows uses them as often as it likes, its plan begins here, and a lost
    executor costs a reread. The table stays as long as the folder does."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
