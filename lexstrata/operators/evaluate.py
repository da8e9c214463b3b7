"""Evaluation and dataset building over record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOCATION = ("madde_type", "madde", "fikra", "bent", "alt_bent")
BLOCK_OPERATIONS = ("BIRIM_DEGISTIR", "BIRIM_EKLE")


def text_key(columns: Sequence[str]) -> Column:
    """A key under which null and empty texts are one and white space does not count."""
    return F.concat_ws("\x1f", *[F.coalesce(F.trim(F.regexp_replace(F.translate(F.col(c).cast("string"), "“”", ""), r"\s+", " ")), F.lit("")) for c in columns])


#: What makes two records the same in an evaluation against a gold set: the place without its sentence, and the texts.
GOLD_KEY = ("amending_article", "operation", "unit", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after", *LOCATION)


def strict_prf(predicted: DataFrame, gold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """prf over GOLD_KEY, per group or over all (one row): equal records count as often as both sides have them."""
    if by:
        return prf(predicted, gold, by, GOLD_KEY)
    over = lambda df: df.withColumn("_all", F.lit(1))
    return prf(over(predicted), over(gold), ["_all"], GOLD_KEY).drop("_all")


def prf(predicted: DataFrame, gold: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Multiset precision, recall and F1 per group: by, tp, n_pred, n_gold, precision, recall, f1.

    Null and empty fields are one; groups that only one side has count with 0 on the other; a null group never meets
    another null one; no rows on both sides give none."""
    side = lambda df, n: df.select(*by, text_key(columns).alias("k")).groupBy(*by, "k").agg(F.count("*").alias(n))
    both = side(predicted, "p").join(side(gold, "g"), [*by, "k"], "full_outer").fillna(0, ["p", "g"])
    n = both.groupBy(*by).agg(F.sum(F.least("p", "g")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_gold", F.lit(1))
    return n.select("*", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 3).alias("f1"))


def missed_and_spurious(predicted: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    return gold.exceptAll(predicted), predicted.exceptAll(gold)


def quality_label(statuses: Column, text: Column) -> Column:
    """dogrulanmis, kismen, sorunlu; without records kayitsiz for closing articles, else supheli."""
    closing = text.rlike(r"(?i)(yürürlüğe girer|hükümlerini .* yürütür)")
    return (
        F.when(F.size(statuses) == 0, F.when(closing, "kayitsiz").otherwise("supheli"))
        .when(F.forall(statuses, lambda s: s == "uyumlu"), "dogrulanmis")
        .when(F.forall(statuses, lambda s: s.isin("uyumlu", "sonradan_degisti", "kontrol_edilemedi")), "kismen").otherwise("sorunlu")
    )


_RECORD_FIELDS = ("operation", "unit", "madde_type", "madde", "fikra", "bent", "alt_bent", "cumle", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after")


def build_examples(articles: DataFrame, verified: DataFrame) -> DataFrame:
    """Every amending article (doc_id, article, sentence, block) with its records and statuses, in order, and the quality
    of its label. Articles without records have empty arrays."""
    held = F.array_sort(F.collect_list(F.struct("rec", "status", F.struct(*_RECORD_FIELDS).alias("r"))))
    per = verified.groupBy("doc_id", "article").agg(held.alias("held"))
    out = articles.join(per, ["doc_id", "article"], "left").withColumn("statuses", F.coalesce(F.transform("held", lambda x: x["status"]), F.array().cast("array<string>")))
    kind = out.schema["held"].dataType.elementType["r"].dataType.simpleString()
    out = out.withColumn("records", F.coalesce(F.transform("held", lambda x: x["r"]), F.array().cast(f"array<{kind}>"))).drop("held")
    return out.withColumn("quality", quality_label(F.col("statuses"), F.col("sentence")))


def with_split(examples: DataFrame, splits: DataFrame) -> DataFrame:
    """examples with the split of their source; sources in none are in train. An own column split is replaced."""
    return examples.drop("split").join(splits.select("source", F.col("split").alias("_given")), "source", "left").withColumn("split", F.coalesce("_given", F.lit("train"))).drop("_given")


def split_stats(examples: DataFrame, by_source: bool = False) -> DataFrame:
    """split, quality, n: counts, with a row per split (quality null) and one over all (both null); by_source gives split,
    source, quality, n with totals per source, per split and over all. No examples give one row, n = 0, without by_source
    too."""
    return examples.rollup(*["split", *(["source"] if by_source else []), "quality"]).agg(F.count("*").alias("n"))


def keep_first(records: DataFrame, group: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Without the later ones of equal records of a group. Null and empty fields are one; no rows give none."""
    rank = F.row_number().over(W.partitionBy(*group, text_key(columns)).orderBy(order))
    rows = records.select(F.struct("*").alias("_row"), rank.alias("_rank")).where("_rank = 1")
    return rows.select("_row.*")


def hybrid(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """candidates (group, priority, ...): the rows of the first priority that has any, per group. Null groups have none."""
    best = candidates.groupBy(*group).agg(F.min("priority").alias("priority"))
    return candidates.join(best, [*group, "priority"], "left_semi")
