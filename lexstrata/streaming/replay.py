"""Continuous replay: the records of every article are state, and an article is folded again when one arrives.

The stream brings prepared records (replay.prepared, written as files). A record whose day has not come waits in the
state, with a timer on that day. What comes out is an article's whole row, folded from all records that count, so a late
one takes its place by seq and rewrites only its own article; a record given twice counts once.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from lexstrata.operators.replay import RECORD, RESULT, fold_article, original_articles
from lexstrata.sources.tables import SnapshotTable

PREPARED = f"source string, key string, new_pos double, record {RECORD}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IN = "source string, key string, new_pos double, seq bigint, rec int, article int, due bigint, said string"
_OUT = "source string, key string, result string"


def _parsed(said: str) -> dict:
    r = json.loads(said)
    for c in ("fikra", "bent", "alt_bent", "cumle", "unit", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after", "parsed_title", "parsed_head", "base_found", "date", "operation"):
        r.setdefault(c, None)
    r["parsed"] = [{c: u.get(c) for c in ("fikra", "bent", "alt_bent", "raw")} for u in r.get("parsed") or []]
    return r


class ArticleReplay(StatefulProcessor):
    """State of an article: its original text, and its records by seq, rec and place in their new text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "said string")
        self.records = handle.getMapState("records", "seq bigint, rec int, article int", "due bigint, said string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.base.update((initialState["base"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        place = None
        for batch in rows:
            for r in batch.itertuples(index=False):
                due = None if pd.isna(r.due) else int(r.due)
                self.records.updateValue((int(r.seq), int(r.rec), int(r.article)), (due, r.said))
                place = place if pd.isna(r.new_pos) or (place is not None and place <= r.new_pos) else float(r.new_pos)
                if due is not None and due > now:
                    self.handle.registerTimer(due)
        if not self.base.exists() and place is not None:
            self.base.update((json.dumps({"pos": place}),))
        yield self.folded(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.folded(key, max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def folded(self, key, now: int) -> pd.DataFrame:
        base = json.loads(self.base.get()[0]) if self.base.exists() else {}
        held = sorted((tuple(k), v[1]) for k, v in self.records.iterator() if v[0] is None or v[0] <= now)
        out = fold_article(base.get("title"), [{c: u.get(c) for c in ("fikra", "bent", "alt_bent", "raw")} for u in base.get("base") or []], [_parsed(said) for _, said in held])
        said = {"pos": base.get("pos"), "steps": out["steps"], "units": [{c: u.get(c) for c in ("since", "until", "fikra", "bent", "alt_bent", "raw")} for u in out["units"]], "titles": out["titles"]}
        return pd.DataFrame({"source": [key[0]], "key": [key[1]], "result": [json.dumps(said, ensure_ascii=False)]})

    def close(self) -> None:
        pass


def article_states(units: DataFrame) -> DataFrame:
    """source, key, base: the original articles as the state begins. Write them and read them back for replayed: the plan
    of a stream is made again for every batch, and the parse would stand in it."""
    return original_articles(units).where("source is not null and key is not null").select("source", "key", F.to_json(F.struct("pos", "title", "base")).alias("base"))


def replayed(stream: DataFrame, states: DataFrame, due: F.Column | None = None) -> DataFrame:
    """RESULT rows, one whenever an article changes, of a stream of PREPARED rows over the original articles
    (states, see article_states).

    due: when a record begins to count, by default the beginning of its date; null counts at once. An article without a
    record has no row: begin with incremental.add_originals. Null sources or keys are left out. The session needs PROVIDER.
    """
    at = F.unix_millis(due if due is not None else F.col("record.date").cast("timestamp"))
    rows = stream.where("source is not null and key is not null").select("source", "key", "new_pos", "record.seq", "record.rec", "record.article", at.alias("due"), F.to_json("record").alias("said"))
    out = rows.groupBy("source", "key").transformWithStateInPandas(ArticleReplay(), StructType.fromDDL(_OUT), "Update", "ProcessingTime", states.groupBy("source", "key"))
    kinds = RESULT.split(", ", 2)[2]
    return out.select("source", "key", F.from_json("result", kinds).alias("r")).select("source", "key", "r.*")


def run_replay(spark: SparkSession, folder: str, states: DataFrame, table: SnapshotTable, checkpoint: str, due: F.Column | None = None, every: str = "10 seconds") -> StreamingQuery:
    """Reads PREPARED files from a folder and keeps a table of RESULT rows (keys source and key) up to date, each batch once.

    It runs until it is stopped, for days that are still to come need a clock; catch_up handles what is there and stops.
    The same checkpoint goes on where it was left.
    """

    def keep(batch: DataFrame, number: int) -> None:
        # held for the passes that the change makes, else the state's operator would run for each of them
        last = batch.groupBy("source", "key").agg(F.max_by(F.struct(*batch.columns), F.size("steps")).alias("x")).select("x.*").persist()
        try:
            if not last.isEmpty():
                table.upsert(last, batch=(checkpoint, number))
        finally:
            last.unpersist()

    stream = spark.readStream.schema(PREPARED).parquet(folder)
    writer = replayed(stream, states, due).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()


def catch_up(spark: SparkSession, folder: str, states: DataFrame, table: SnapshotTable, checkpoint: str, due: F.Column | None = None) -> None:
    """Handles the files that are there, and the days that have come, and stops."""
    # with timers there is always a next batch; one without rows comes after all files, but for the first, which may be
    # the one that the last stop broke off
    query = run_replay(spark, folder, states, table, checkpoint, due, "1 second")
    try:
        while not any(p["numInputRows"] == 0 for p in query.recentProgress[1:]):
            if query.awaitTermination(1):
                break
    finally:
        query.stop()
