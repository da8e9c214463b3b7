"""Datasets for sequence models and their predictions: inputs, linear targets and back, prompts, repairs and metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexstrata.operators.evaluate import BLOCK_OPERATIONS, LOCATION, keep_first, prf
from lexstrata.operators.grammar import by_marker, outer_quotes
from lexstrata.operators.similarity import nearest
from lexstrata.operators.verify import excuse_later, relabel_known, summary, verify

EMPTY = "YOK"
PLACE = (*LOCATION, "cumle")
FIELDS = ("unit", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after")
#: The names of a record's fields in a target.
SHORT = {
    "madde_type": "tur", "madde": "madde", "fikra": "fikra", "bent": "bent", "alt_bent": "altbent", "cumle": "cumle",
    "unit": "birim", "old_text": "eski", "new_text": "yeni", "anchor_text": "capa", "anchor_position": "konum", "insert_after": "sonra",
}
RECORD = "struct<operation:string,unit:string,madde_type:string,madde:string,fikra:int,bent:string,alt_bent:int,cumle:string,old_text:string,new_text:string,anchor_text:string,anchor_position:string,insert_after:string>"
TRUSTED = ("dogrulanmis", "kismen", "kayitsiz")


def canonical(r: Column) -> Column:
    """A record struct with the fields of RECORD only, empty texts null and the kind of article normal by default."""
    text = lambda c: F.nullif(r[c].cast("string"), F.lit(""))
    return F.struct(*[(F.coalesce(text(c), F.lit("normal")) if c == "madde_type" else r[c].cast("int") if c in ("fikra", "alt_bent") else text(c)).alias(c) for c in ("operation", "unit", *PLACE, *FIELDS[1:])])


def linear(r: Column | dict) -> Column:
    """One record as 'OP | location | key=value ...'; block operations leave their text out, and a normal article its kind."""
    clean = lambda x: F.replace(F.replace(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("|"), F.lit("/")), F.lit(";;"), F.lit(";"))
    pair = lambda k, v: F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{SHORT[k]}="), clean(v.cast("string"))))
    place = F.concat_ws(" ", *[pair(k, F.nullif(r[k], F.lit("normal")) if k == "madde_type" else r[k]) for k in PLACE])
    value = lambda k: F.when(~r["operation"].isin(*BLOCK_OPERATIONS), r[k]) if k == "new_text" else r[k]
    return F.concat_ws(" | ", r["operation"], F.when(place == "", "-").otherwise(place), *[pair(k, value(k)) for k in FIELDS])


def linearize(records: Column) -> Column:
    """An array of record structs as text: records apart by ';;', YOK without any."""
    return F.when(F.size(records) > 0, F.array_join(F.transform(records, linear), " ;; ")).otherwise(EMPTY)


def delinearize(said: Column) -> Column:
    """The inverse: array<RECORD>. Parts without a known form are left out, numbers that are none are null."""
    parts = F.transform(F.split(F.coalesce(said, F.lit("")), r"\s*;;\s*"), lambda r: F.split(F.trim(r), r"\s*\|\s*"))
    good = F.filter(parts, lambda p: (F.size(p) >= 2) & p[0].rlike("^[A-Z]+_[A-Z]+$"))

    def record(p: Column) -> Column:
        pairs = F.concat(F.split(p[1], r" +(?=\w+=)"), F.slice(p, 3, F.greatest(F.size(p), F.lit(1))))
        entries = F.transform(F.filter(pairs, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.call_function("instr", x, F.lit("=")) + 1).alias("v")))
        of = lambda k: F.get(F.filter(entries, lambda e: e["k"] == SHORT[k]), F.lit(0))["v"]
        value = lambda k: of(k).try_cast("int") if k in ("fikra", "alt_bent") else F.coalesce(of(k), F.lit("normal")) if k == "madde_type" else of(k)
        return F.struct(p[0].alias("operation"), *[value(k).alias(k) for k in ("unit", *PLACE, *FIELDS[1:])])

    return F.transform(good, record)


@F.pandas_udf(ArrayType(StringType()))
def _quotes_of(block: pd.Series) -> pd.Series:
    return block.map(lambda b: outer_quotes(b or ""))


def model_input(examples: DataFrame) -> DataFrame:
    """examples (sentence, block) with quotes, the outermost quoted blocks, and input: the sentence, then the block with
    [ALINTIk] in their place. A null block is empty."""
    rows = examples.withColumn("quotes", _quotes_of(F.col("block")))
    def name(said: Column, k: Column) -> Column:
        quote = F.get("quotes", k - 1)
        at = F.call_function("instr", said, F.concat(F.lit("“"), quote))
        return F.when(at > 0, F.concat(F.substr(said, F.lit(1), at - 1), F.lit("[ALINTI"), k.cast("string"), F.lit("]"), F.substr(said, at + F.char_length(quote) + 2))).otherwise(said)

    named = F.aggregate(F.sequence(F.lit(1), F.size("quotes")), F.coalesce("block", F.lit("")), name)
    said = F.when(F.size("quotes") == 0, F.coalesce("block", F.lit(""))).otherwise(named)
    return rows.withColumn("input", F.trim(F.concat_ws(" ", "sentence", F.trim(F.regexp_replace(said, r"\s+", " ")))))


def seq2seq(examples: DataFrame) -> DataFrame:
    """id, source if given, doc_id, article, input, target, quotes, quality of labelled examples (records, sentence, block)."""
    rows = model_input(examples).withColumn("target", linearize(F.transform("records", canonical)))
    return rows.withColumn("id", F.concat_ws("/", "doc_id", F.concat(F.lit("madde"), F.col("article").cast("string")))).select("id", "doc_id", "article", *[c for c in ("source", "split") if c in rows.columns], "input", "target", "quotes", "quality")


def for_training(rows: DataFrame) -> DataFrame:
    """Rows of the train split only with trusted labels; other splits whole."""
    return rows.where((F.col("split") != "train") | F.col("quality").isin(*TRUSTED))


def longest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.max(F.length("input")).alias("longest_input"), F.max(F.length("target")).alias("longest_target"))


def model_key(r: Column) -> Column:
    """What makes two predicted records the same: place with cumle, unit, texts but for those of blocks; "" is null."""
    text = lambda c: F.coalesce(F.trim(F.regexp_replace(r[c].cast("string"), r"\s+", " ")), F.lit(""))
    return F.concat_ws("\x1f", text("operation"), *[text(c) for c in ("unit", *PLACE, "old_text", "anchor_text")], F.when(r["operation"].isin(*BLOCK_OPERATIONS), F.lit("")).otherwise(text("new_text")))


def predicted(predictions: DataFrame, prompts: DataFrame) -> DataFrame:
    """A row per predicted record of (id, prediction), the last of equal ids counting by seq: id, rec, r, quotes, input.

    Copies of a record within an id are dropped but for the first. Ids without a prediction have no rows.
    """
    last = predictions.groupBy("id").agg(F.max_by("prediction", "seq").alias("prediction"))
    rows = prompts.join(last, "id").select("id", "input", "quotes", F.posexplode(delinearize(F.col("prediction"))).alias("rec", "r"))
    return keep_first(rows.withColumn("key", model_key(F.col("r"))), ["id"], ["key"], "rec").drop("key")


def repaired(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Predicted records whose phrases are taken from the quoted ones of the input, and whose blocks from its quotes.

    A block text is the quote under its own marker where every block has one, its own quote where there are as many
    quotes as blocks, else all quotes together. One row per id is handled at a time: an article's records are few.
    """
    per = rows.groupBy("id", "input", "quotes").agg(F.array_sort(F.collect_list(F.struct("rec", "r"))).alias("rs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for said, quotes, rs in zip(*(b.column(c).to_pylist() for c in ("input", "quotes", "rs")), strict=True):
                short, quotes = [q.strip() for q in outer_quotes(said) if q.strip()], quotes or []
                blocks = [x["r"] for x in rs if x["r"]["operation"] in BLOCK_OPERATIONS]
                if blocks and quotes:
                    own = by_marker("\n".join(quotes), blocks) if len(blocks) > 1 else None
                    texts = own or (quotes if len(quotes) == len(blocks) else ["\n".join(quotes)] * len(blocks))
                    for r, t in zip(blocks, texts, strict=True):
                        r["new_text"] = t
                for x in rs:
                    for c in ("old_text", "new_text", "anchor_text"):
                        if x["r"][c] and short and not (c == "new_text" and x["r"]["operation"] in BLOCK_OPERATIONS):
                            x["r"][c] = nearest(x["r"][c], short, least)
                out.append(rs)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, b.schema.field("rs").type)], names=["id", "rs"])

    done = per.mapInArrow(run, f"id string, rs array<struct<rec:int,r:{RECORD}>>")
    return done.select("id", F.inline("rs"))


def silver_metrics(pred: DataFrame, gold: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: rows, exact, missing, tp, n_pred, n_gold, precision, recall, f1 over the trusted rows (id, quality) of labels.

    pred and gold: (id, r). exact counts ids whose records are the same, missing those without a prediction.
    """
    ids = labels.where(F.col("quality").isin(*TRUSTED)).select("id").distinct()
    side = lambda df: df.join(ids, "id", "left_semi").select("id", F.lit(1).alias("all"), model_key(F.col("r")).alias("k"))
    p, g = side(pred), side(gold)
    total = prf(p, g, ["all"], ["id", "k"])
    keys = lambda df, c: df.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias(c))
    none = F.array().cast("array<string>")
    by_id = ids.join(keys(p, "p"), "id", "left").join(keys(g, "g"), "id", "left")
    same = by_id.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("p", none) == F.coalesce("g", none)).alias("exact"), F.count_if(F.col("p").isNull()).alias("missing")).withColumn("all", F.lit(1))
    return same.join(total, "all", "left").drop("all")


def reverified(records: DataFrame, units: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Predicted records (as for verify) verified like extracted ones: statuses, later amendments, known issues; summary rows."""
    rows = excuse_later(verify(records, units))
    return summary(relabel_known(rows, issues) if issues is not None else rows)


def few_shot(pool: DataFrame, shots: int = 10) -> list[dict]:
    """Up to shots rows {id, input, target}: for each thing to show, in turn, the shortest unused row (ties by id) that
    shows it. At most ten rows come to the driver, each by an aggregate over the pool."""
    has = lambda c, v: F.exists("_r", lambda r: r[c] == v)
    kinds = ("IBARE_DEGISTIR", "IBARE_EKLE", "IBARE_KALDIR", "BIRIM_DEGISTIR", "BIRIM_EKLE", "BIRIM_KALDIR", "BASLIK_DEGISTIR")
    wanted = [F.size("_r") == 0, *[has("operation", k) for k in kinds], has("unit", "cumle"), F.size("_r") >= 3]
    rows, chosen = pool.withColumn("_r", delinearize(F.col("target"))), []
    for show in wanted[:shots]:
        top = rows.where(show & ~F.col("id").isin([c["id"] for c in chosen])).agg(F.min(F.struct(F.length("input").alias("n"), "id", "input", "target")).alias("x")).first()["x"]
        chosen += [{c: top[c] for c in ("id", "input", "target")}] if top else []
    return chosen


def prompts(rows: DataFrame, shots: Sequence[dict], instruction: str) -> DataFrame:
    """id, messages array<struct<role, content>>: the instruction, the shots as questions and answers, the row's input."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = [m for s in shots for m in (message("user", F.lit(s["input"])), message("assistant", F.lit(s["target"])))]
    return rows.select("id", F.array(message("system", F.lit(instruction)), *shown, message("user", F.col("input"))).alias("messages"))


def clean_output(said: Column) -> Column:
    """A model's answer without code fences and without lines that hold no record; YOK if that is all it says."""
    lines = F.transform(F.split(F.regexp_replace(said, r"```\w*", "\n"), r"\n|;;"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x.rlike(r"^[A-Z]+_[A-Z]+\s*\|"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ;; ")).otherwise(EMPTY)


def order_free(said: Column) -> Column:
    """A target with its records in sorted order, for comparison."""
    return F.array_join(F.array_sort(F.transform(F.split(said, ";;"), lambda x: F.trim(x))), " ;; ")
