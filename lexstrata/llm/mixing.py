"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are range-sorted by that key: the leading
hex digits of the key are the range, so a source of any size spreads over up to 4096 ranges. Sums per range give
each range its offset, a window inside a range gives each document its offset, and the source's budget cuts there.
A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.llm.common import named, text_or_empty, words

SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(src, source_size) to (src, source_size, target): one row per source.

    Sources by code point, null last, take the weights in turn. Targets are the level w * least over all such that
    they sum to share * all sizes and none is above ceiling * its source's size.
    """
    by_name, everything = W.orderBy("src"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("k", F.row_number().over(by_name)).withColumn("w", weight).withColumn("cap", ceiling * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "src")
    t = t.withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("below")) / F.col("rest"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)
    return t.withColumn("at", first["level"]).select("src", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def mix_to_targets(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, range_digits: int = 3, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns named in carry.

    size counts words; taken is how many of them the mix takes, repeats counted: whole epochs, then a prefix of the
    hash order whose last document is cut at the exact budget. A null or empty text has size 0 and gives nothing; a
    null source is a source, sorted last; a null doc_id has the key of the empty string; equal rows tie and are
    interchangeable. No documents give no rows. Other columns are ignored.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", named(F.col("source")).alias("src"), F.size(words(text_or_empty())).cast("bigint").alias("size"), key.alias("key"), F.substring(key, 1, range_digits).alias("range"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    sums = rows.groupBy("src", "range").agg(F.sum("size").alias("in_range"))
    of_source = sums.groupBy("src").agg(F.sum("in_range").alias("source_size"))
    before = F.coalesce(F.sum("in_range").over(W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("before", before).join(source_targets(of_source, weights, share, ceiling), "src")
    inside = W.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(offsets.drop("in_range"), ["src", "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of documents: a row per epoch; a cut document ends after its last word taken."""
    cols = ["text", "lang", "source"]
    rows = mix_to_targets(docs, carry=cols, **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(spaced, 1, F.col("part")), "")
    text = F.when(F.col("part") < 0, F.col("text")).otherwise(head)
    out = rows.withColumn("part", F.explode(parts)).select("doc_id", text.alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, list_extract([3.0, 1.0, 2.0], (row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT src, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, src LIMIT 1) * w, cap)) AS target FROM l),
p AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
      (coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
      FROM d JOIN t ON d.src = t.src)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
