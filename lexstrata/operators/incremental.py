"""Versions kept up to date: a new amending text folds again only the articles it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.operators.replay import BASE, RECORD, RESULT, folded, original_articles, prepared
from lexstrata.sources.tables import SnapshotTable

#: RESULT, with what the fold starts from, and the run that folded the article last.
SCHEMA = f"{RESULT}, title string, base {BASE}, records array<{RECORD}>, run string"


def version_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """A row per article (source, key): its units and records, and the versions they fold to."""
    return SnapshotTable(spark, path, SCHEMA, ["source", "key"], buckets)


def _with_versions(rows: DataFrame, run: str) -> DataFrame:
    """rows (source, key, pos, title, base, records) folded, as rows of the table."""
    return folded(rows).join(rows.select("source", "key", "title", "base", "records"), ["source", "key"]).withColumn("run", F.lit(run))


def add_originals(table: SnapshotTable, units: DataFrame, run: str = "original") -> int:
    """The articles of original texts (units, doc_id being the source) as they are. An article that is there keeps its
    records and is folded again from its new text; a null source or key is left out."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        held = old.select("source", "key", F.col("records").alias("_records"), F.col("pos").alias("_pos"))
        rows = new.join(held, ["source", "key"], "left").select("source", "key", "pos", "title", "base", F.coalesce("_records", F.array().cast(f"array<{RECORD}>")).alias("records"))
        return table.replaced(old, _with_versions(rows, run).select(old.columns))

    return table.upsert(original_articles(units).where("source is not null and key is not null"), merge)


def merged(old: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """The rows of the articles that new (source, key, new_pos, records) names: old ones with the new records, folded again.

    A record is known by its seq, rec and article within a new text: given again, it replaces the older one and nothing
    else changes.
    """
    kept = F.filter(F.coalesce("records", F.array().cast(f"array<{RECORD}>")), lambda r: ~F.exists("_new", lambda n: (n["seq"] == r["seq"]) & (n["rec"] == r["rec"]) & (n["article"] == r["article"])))
    rows = new.withColumnRenamed("records", "_new").join(old.select("source", "key", "pos", "title", "base", "records"), ["source", "key"], "left")
    rows = rows.select("source", "key", F.coalesce("pos", "new_pos").alias("pos"), "title", "base", F.array_sort(F.concat(kept, "_new")).alias("records"))
    return _with_versions(rows, run)


def by_article(rows: DataFrame) -> DataFrame:
    """prepared rows as one row per article: source, key, new_pos, records, the last of equal records by its fields."""
    one = rows.groupBy("source", "key", F.col("record.seq").alias("_seq"), F.col("record.rec").alias("_rec"), F.col("record.article").alias("_article")).agg(F.min("new_pos").alias("new_pos"), F.max("record").alias("record"))
    return one.groupBy("source", "key").agg(F.min("new_pos").alias("new_pos"), F.array_sort(F.collect_list("record")).alias("records"))


def add_records(table: SnapshotTable, records: DataFrame, run: str, batch: tuple[str, int] | None = None) -> int:
    """The version of the table that holds new records (as for replay). Only the articles that they name are folded again,
    all of an article's records together, so a late record takes its place by seq; all become visible at once.

    A lettered article's stem counts where the table or the same records have it: records of earlier texts go first.
    Records given again change nothing; records without an article are left out, no records give the present version.
    """
    new = by_article(prepared(records, table.read().select("source", "key", "pos")))

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        return table.replaced(old, merged(old, changes, run).select(old.columns))

    return table.upsert(new, merge, batch)
