"""Helpers shared by the text operators: tables in the shared folder, native word splitting, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master.startswith("local[") or sc.master == "local":
            at = "file://" + tempfile.mkdtemp(prefix="lexstrata-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and lineage stays short."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}_{tag}"

    def save(self, df: DataFrame, tag: str, drop_shuffles: bool = False) -> DataFrame:
        """drop_shuffles: what was shuffled for the table goes from the executors' disks once it is written."""
        path, setting = self.path(tag), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting)
        if drop_shuffles:
            self.spark.conf.set(setting, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body: without this, Catalyst may inline it into every lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def named(col: Column) -> Column:
    """A string that tells null from every value and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), col), F.lit("~"))


def documents(docs: DataFrame) -> DataFrame:
    """The columns of the documents table, missing ones as null, extra ones left out."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
