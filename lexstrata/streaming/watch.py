"""The daily watch on Structured Streaming: new links of index pages, their records verified, each address once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexstrata.operators.discover import amendment_links, links
from lexstrata.operators.extract import extract_amendments
from lexstrata.operators.structure import parse_units
from lexstrata.operators.verify import verify
from lexstrata.sources.tables import SnapshotTable

HIT = "source string, url string, label string, statuses array<string>, error string, at timestamp"
PAGE = "day date, repeat int, url string, html string, status int, at timestamp"


def status_map(rows: DataFrame) -> DataFrame:
    """rows with statuses as a map from status to count, and the number of records. Null statuses, alone or for all, count
    as none."""
    statuses = F.filter(F.coalesce("statuses", F.array().cast("array<string>")), lambda s: s.isNotNull())
    distinct = F.array_distinct(statuses)
    counts = F.map_from_arrays(distinct, F.transform(distinct, lambda s: F.size(F.filter(statuses, lambda x: x == s))))
    return rows.withColumn("record_count", F.size(statuses)).withColumn("statuses", counts)


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of hits from JSON files of a folder, each address once for ever.

    A hit with an error is not seen yet: it comes again when a later file brings it without one. The addresses seen are
    the stream's state; it grows by one entry per gazette document, kept on disk by a state store such as RocksDB.
    """
    hits = spark.readStream.schema(HIT).json(folder)
    return status_map(hits.where("error is null and url is not null").dropDuplicates(["url"]))


def run_watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Handles what is there and stops; a second run with the same checkpoint adds only what is new."""
    return watch(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_pages(pages: DataFrame, texts: DataFrame, names: DataFrame | Sequence[tuple[str, Sequence[str]]], consolidated: DataFrame) -> DataFrame:
    """Hits (source, url, label, title, statuses, error, at) of index pages (PAGE; 404 has none).

    texts: (url, text) of fetched documents; a link without one is a hit with an error. consolidated: (doc_id = source,
    text). Records are extracted and verified as everywhere else.
    """
    found = amendment_links(links(pages.where("status <=> 200")), names)
    label = F.concat(F.lit("RG-"), F.date_format("day", "d/M/yyyy"), F.when(F.col("repeat") > 0, F.concat(F.lit(" "), F.col("repeat").cast("string"), F.lit(". Mükerrer"))).otherwise(""))
    full = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).otherwise(F.concat(F.regexp_extract("url", "^(.*/)", 1), "href"))
    hits = found.select("source", full.alias("url"), label.alias("label"), "title", "at").dropDuplicates(["source", "url"]).join(texts, "url", "left")
    docs = hits.where("text is not null").select(F.concat_ws("|", "source", "url").alias("doc_id"), "text")
    records = extract_amendments(docs).withColumn("source", F.substring_index("doc_id", "|", 1)).withColumn("seq", F.col("article"))
    units = parse_units(consolidated)
    per = verify(records, units).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("article", "rec", "status"))).alias("x"))
    out = hits.withColumn("doc_id", F.concat_ws("|", "source", "url")).join(per, "doc_id", "left")
    return out.select("source", "url", "label", "title", F.coalesce(F.transform("x", lambda r: r["status"]), F.array().cast("array<string>")).alias("statuses"), F.when(F.col("text").isNull(), "no text").alias("error"), "at")


SEEN = "source string, url string, label string, title string, statuses map<string, int>, at timestamp, record_count int"


def seen_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """The hits that have been seen, one for each source and address."""
    return SnapshotTable(spark, path, SEEN, ["source", "url"], buckets)


def run_scan(spark: SparkSession, folder: str, scan: Callable[[DataFrame], DataFrame], seen: SnapshotTable, checkpoint: str) -> StreamingQuery:
    """Scans the index pages that come as JSON files in a folder; hits whose address has not been seen join the table.

    A batch reads the buckets of its own hits only, and becomes visible once: run again after a failure, or beside another
    run, it adds nothing twice. The first hit of an address stays. Hits with an error are not kept, and are tried again
    whenever their page comes.
    """

    def first_stay(old: DataFrame, new: DataFrame) -> DataFrame:
        first = new.groupBy("source", "url").agg(F.min(F.struct("at", "label", "title", "record_count")).alias("k"), F.min_by(F.struct("statuses"), F.struct("at", "label", "title", "record_count")).alias("s"))
        first = first.select("source", "url", "k.label", "k.title", "s.statuses", "k.at", "k.record_count")
        return old.unionByName(first.join(old.select("source", "url"), ["source", "url"], "left_anti").select(old.columns))

    def handle(batch: DataFrame, number: int) -> None:
        new = status_map(scan(batch).where("error is null and source is not null and url is not null")).drop("error").persist()
        try:
            seen.upsert(new, first_stay, batch=(checkpoint, number))
        finally:
            new.unpersist()

    pages = spark.readStream.schema(PAGE).json(folder)
    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def all_failed(pages: DataFrame) -> bool:
    """Whether there are pages and none could be had: neither there nor known to be absent."""
    row = pages.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(200, 404)).alias("ok")).first()
    return row.n > 0 and row.ok == 0


def counts_by_day(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """Hits per source and day, with late files accepted within the watermark."""
    hits = spark.readStream.schema(HIT).json(folder).withWatermark("at", late)
    return hits.groupBy(F.window("at", "1 day").alias("day"), "source").agg(F.count("*").alias("hits"))


def issues_to_scan(spark: SparkSession, first: str, last: str, repeats: int) -> DataFrame:
    """day, repeat: every day with its regular issue (0) and up to repeats repeated ones."""
    days = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS day", {"a": first, "b": last})
    return days.select("day", F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("repeat"))
