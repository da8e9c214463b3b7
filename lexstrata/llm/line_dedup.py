"""Line dedup by the spread of a line over distinct sites.

Each line's hash gathers a HyperLogLog sketch of the sites (the source column) that hold it; sketches merge by
aggregation. Lines whose estimate is near the threshold get an exact distinct count; the rest are decided by the
sketch. A line on at least min_sites sites is boilerplate: every occurrence but the first one in the corpus goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch, let, named

MIN_SITES = 5
LINE_ENDS = " \t\x0b\x0c\r"
#: Places a boilerplate line's occurrences are dealt over, so that no line meets all of its own in one task.
SALTS = 32


def _row_key() -> Column:
    """128 bits that tell rows apart; null differs from every text."""
    parts = [named(F.col(c).cast("string")) for c in ("doc_id", "source", "text")]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("row"), *parts).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, site, pos, h (128 bits) of every line with a word; only these columns, whatever else docs has."""
    rows = docs.select("doc_id", _row_key().alias("row"), named(F.col("source")).alias("site"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(LINE_ENDS))
    return rows.where(line != "").select("doc_id", "row", "site", "pos", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = 10) -> DataFrame:
    """(h, first): hashes of lines on min_sites sites or more, with the (doc_id, pos) where each is first."""
    scratch, lines = Scratch(docs.sparkSession), _lines(docs)
    slack = max(1.0, 4 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
    spread = scratch.save(spread.where(F.col("sites") >= min_sites - slack), "spread")
    near = spread.where(F.col("sites") <= min_sites + slack)
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("exact"))
    sure = spread.where(F.col("sites") > min_sites + slack)
    return sure.select("h", "first").unionByName(near.join(exact.where(F.col("exact") >= min_sites), "h", "left_semi").select("h", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = 10) -> DataFrame:
    """All columns of docs, text without boilerplate, and n_lines, n_removed.

    Lines are \\n-split and compared without ASCII white space at their ends; lines without a word are never removed
    nor counted. A null source is one site of its own. A null text is kept as null with 0 lines, an empty one as empty.
    Texts of any length are handled whole, a line at a time. Of equal lines the first by (doc_id, position) stays, null
    doc_ids first. Equal rows (same doc_id, source and text) are treated alike: if one holds the first occurrence, each
    keeps it. No rows give none. Columns of docs called n_lines or n_removed are replaced; any other name may occur.
    """
    salt = F.pmod(F.col("row.a"), F.lit(SALTS)).cast("int").alias("salt")
    common = boilerplate(docs, min_sites, lg_k).select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = _lines(docs).select("doc_id", "row", "pos", "h", salt).join(common, ["h", "salt"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    gone = hits.groupBy("row").agg(F.collect_set("pos").alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), _row_key().alias("row")).join(gone, "row", "left")
    n_lines = F.size(F.filter(F.split(F.coalesce("d.text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(LINE_ENDS)) != ""))
    left = let(F.split("d.text", "\n"), lambda every: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone")), lambda i: F.get(every, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(left)
    return held.select(*[text.alias("text") if c == "text" else F.col("d").getField(c).alias(c) for c in kept], n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, text, coalesce('=' || source, '~') AS site, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
n AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM n WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
k AS (SELECT n.*, b.line IS NOT NULL AND NOT (n.doc_id IS NOT DISTINCT FROM b.first.d AND n.pos = b.first.p) AS gone FROM n LEFT JOIN b ON n.line = b.line)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id
"""
