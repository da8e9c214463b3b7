"""Replay of amendment records: every article folds its records, in order, into versions of its units."""

from __future__ import annotations

import datetime
import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lexstrata.functions.text import ALPHABET, collapse, diff_sentences, gazette_label, gazette_ref, is_tombstone, strip_apparatus, version_norm
from lexstrata.operators.fold import ARTICLE_UNITS, NO_TARGET, UNSUPPORTED, fold
from lexstrata.operators.similarity import ratios
from lexstrata.operators.structure import ARTICLE, full_texts, parse_units
from lexstrata.operators.verify import LEVELS, location_key
from lexstrata.sources.shared import written

STEP = "struct<step:int,seq:bigint,rec:int,date:date,operation:string,status:string>"
UNIT = "struct<since:int,until:int,fikra:int,bent:string,alt_bent:int,raw:string>"
RESULT = f"source string, key string, pos double, steps array<{STEP}>, units array<{UNIT}>, titles array<struct<since:int,title:string>>"
_PARSED = "array<struct<fikra:int,bent:string,alt_bent:int,raw:string>>"
_FIELDS = ("seq", "rec", "date", "operation", "unit", "fikra", "bent", "alt_bent", "cumle", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after")


def new_blocks(records: DataFrame) -> DataFrame:
    """block, article, n_key, parsed_title, parsed_head, parsed: the new texts of unit records, parsed, an article a row;
    block is the MD5 of the text, so that no line carries the text as its key.

    A text without an article's head is parsed as the body of one; n_key is then null.
    """
    texts = records.where(F.col("operation").isin("BIRIM_DEGISTIR", "BIRIM_EKLE") & F.col("new_text").isNotNull()).select(F.md5(F.col("new_text").cast("binary")).alias("block"), "new_text").dropDuplicates(["block"])
    headed = F.col("new_text").rlike("(?m)" + ARTICLE)
    docs = texts.select(F.col("block").alias("doc_id"), F.concat(F.lit("YENİ METİN\n"), F.when(headed, F.col("new_text")).otherwise(F.concat(F.lit("MADDE 0 – "), F.regexp_replace("new_text", r"^\s*([a-zçğıöşü]{1,3}\)|\d+\))", "\n$1")))).alias("text"))
    # an item or sub-item stands on a line of its own; a sub-item needs an open item, named as no real one is
    sub = F.col("text").rlike(r"(?m)^MADDE 0 – \n\d+\)")
    docs = docs.withColumn("text", F.when(sub, F.regexp_replace("text", r"MADDE 0 – \n", "MADDE 0 – \nzzz)\n")).otherwise(F.col("text")))
    units = parse_units(docs).where("not (bent <=> 'zzz' and alt_bent is null and text = '')")
    rows = F.array_sort(F.collect_list(F.struct("pos", "fikra", F.expr("nullif(bent, 'zzz')").alias("bent"), "alt_bent", "raw")))
    out = units.groupBy(F.col("doc_id").alias("block"), "article").agg(F.first("key").alias("n_key"), F.first("title").alias("parsed_title"), rows.alias("parsed"))
    own = F.col("n_key") != "0"
    parsed = F.transform(F.filter("parsed", lambda x: own | (x["raw"] != "")), lambda x: F.struct(x["fikra"], x["bent"], x["alt_bent"], x["raw"])).cast(_PARSED)
    return out.select("block", "article", F.when(own, F.col("n_key")).alias("n_key"), "parsed_title", own.alias("parsed_head"), parsed.alias("parsed"))


RECORD = f"struct<seq:bigint,rec:int,article:int,date:date,operation:string,unit:string,fikra:int,bent:string,alt_bent:int,cumle:string,old_text:string,new_text:string,anchor_text:string,anchor_position:string,insert_after:string,parsed_title:string,parsed_head:boolean,parsed:{_PARSED},base_found:boolean>"
BASE = "array<struct<pos:int,fikra:int,bent:string,alt_bent:int,raw:string>>"


def original_articles(units: DataFrame) -> DataFrame:
    """source, key, pos, title, base: a row per article key of the original texts (units, doc_id being the source), the
    first article of a key that repeats; base are its units in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), *LEVELS, "raw"))).alias("base")
    each = units.where("doc_id is not null and key is not null").groupBy("doc_id", "key", "article").agg(F.first("title", True).alias("title"), held)
    first = F.min_by(F.struct("article", "title", "base"), "article").alias("x")
    return each.groupBy(F.col("doc_id").alias("source"), "key").agg(first).select("source", "key", F.col("x.article").cast("double").alias("pos"), "x.title", "x.base")


def prepared(records: DataFrame, articles: DataFrame) -> DataFrame:
    """source, key, new_pos, record (RECORD): what the fold of each article needs of its records.

    articles (source, key, pos): those that are there. New texts are parsed, an article each; a record that adds several
    gives a row for each. base_found says whether the article that a lettered one follows is there or added; new_pos is
    where a new article goes. Records without an article have no row; lost_records has them.
    """
    adds = (F.col("operation") == "BIRIM_EKLE") & F.coalesce(F.col("unit").isin(*ARTICLE_UNITS), F.lit(False))
    r = records.select("source", *_FIELDS, location_key().alias("at_key"), adds.alias("adds"))
    blocks = written(new_blocks(records))
    r = r.join(blocks, F.md5(F.col("new_text").cast("binary")) == F.col("block"), "left").where("article is null or article = 1 or adds").withColumn("key", F.when(F.col("adds"), F.coalesce("n_key", "at_key")).otherwise(F.col("at_key"))).where("key is not null")
    stem = F.regexp_extract("key", r"^(\d+)/", 1)
    there = articles.select("source", F.col("key").alias("stem"), F.col("pos").alias("stem_pos")).unionByName(r.where("adds").select("source", F.col("key").alias("stem"), F.lit(None).cast("double").alias("stem_pos")))
    there = there.groupBy("source", "stem").agg(F.max("stem_pos").alias("stem_pos"))
    r = r.withColumn("stem", F.when(F.col("adds"), stem)).join(there.withColumn("held", F.lit(True)), ["source", "stem"], "left").withColumn("base_found", (F.coalesce("stem", F.lit("")) == "") | F.col("held").isNotNull())
    # lettered articles follow their stem, others the last article
    letter = F.call_function("instr", F.lit(ALPHABET), F.lower(F.translate(F.regexp_extract("key", "/(.)$", 1), "Iİ", "ıi")))
    place = F.when(F.col("adds"), F.coalesce(F.col("stem_pos") + (letter + 1) / 64, F.lit(1e9) + F.col("seq")))
    record = F.struct("seq", "rec", F.coalesce("article", F.lit(0)).alias("article"), *_FIELDS[2:], "parsed_title", "parsed_head", "parsed", "base_found")
    return r.select("source", "key", place.alias("new_pos"), record.cast(RECORD).alias("record"))


def fold_article(title: str | None, base: list[dict] | None, records: list[dict] | None) -> dict:
    """steps, units, titles of one article under its records in order, as in RESULT."""
    todo = records or []
    said, versions, titles = fold(title, base or [], [{**x, "parsed": [dict(u) for u in x["parsed"] or []]} for x in todo])
    steps = [{"step": k, "status": s, **{c: x[c] for c in ("seq", "rec", "date", "operation")}} for k, (s, x) in enumerate(zip(said, todo, strict=True), 1)]
    return {"steps": steps, "units": versions, "titles": titles}


def values(a: pa.Array) -> list:
    """a.to_pylist(), with nested values made of whole columns: arrow's own makes an object of each value on its way."""
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_list(a.type):
        held, ends = values(a.flatten()), [0]
        sizes = a.value_lengths().to_pylist()
        for n in sizes:
            ends.append(ends[-1] + (n or 0))
        return [None if n is None else held[ends[i] : ends[i + 1]] for i, n in enumerate(sizes)]
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        rows = [dict(zip(names, x, strict=True)) for x in zip(*map(values, a.flatten()), strict=True)]
        return rows if not a.null_count else [x if ok else None for x, ok in zip(rows, a.is_valid().to_pylist(), strict=True)]
    return a.to_pylist()


def folded(articles: DataFrame) -> DataFrame:
    """RESULT of articles (source, key, pos, title, base, records), each on its own."""
    unit = pa.struct([("since", pa.int32()), ("until", pa.int32()), ("fikra", pa.int32()), ("bent", pa.string()), ("alt_bent", pa.int32()), ("raw", pa.string())])
    step = pa.struct([("step", pa.int32()), ("seq", pa.int64()), ("rec", pa.int32()), ("date", pa.date32()), ("operation", pa.string()), ("status", pa.string())])
    kinds = pa.schema([("source", pa.string()), ("key", pa.string()), ("pos", pa.float64()), ("steps", pa.list_(step)), ("units", pa.list_(unit)), ("titles", pa.list_(pa.struct([("since", pa.int32()), ("title", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fold_article(*x) for x in zip(*(values(b.column(c)) for c in ("title", "base", "records")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source", "key", "pos")), *(pa.array([x[c] for x in out], kinds.field(c).type) for c in ("steps", "units", "titles"))], schema=kinds)

    return articles.select("source", "key", "pos", "title", "base", "records").mapInArrow(run, RESULT)


def replay(units: DataFrame, records: DataFrame) -> DataFrame:
    """source, key, pos, steps, units, titles: a row per article.

    units: as the structural parse of the original texts gives them, doc_id being the source. records: those of
    extraction with source, seq (order of the amending texts) and date. steps holds each record's outcome; units each
    state of each unit, alive from step since to before step until; titles likewise. Of an article key that repeats, the
    first article counts. New articles come after the article whose number theirs extends, or at the end.
    Records without an article are in no row; lost_records has them. An article's records are bounded by its amendments.
    Null texts of records are unsupported or not found, not errors; other columns are ignored.
    """
    base = written(original_articles(units))
    rows = prepared(records, base).groupBy("source", "key").agg(F.min("new_pos").alias("new_pos"), F.array_sort(F.collect_list("record")).alias("records"))
    both = base.join(rows, ["source", "key"], "full_outer").select("source", "key", F.coalesce("pos", "new_pos").alias("pos"), "title", "base", "records")
    return folded(both)


def lost_records(records: DataFrame) -> DataFrame:
    """source, seq, rec, operation, status of the records that name no article and add none."""
    adds = (F.col("operation") == "BIRIM_EKLE") & F.coalesce(F.col("unit").isin(*ARTICLE_UNITS), F.lit(False)) & F.coalesce(F.col("new_text").rlike("(?m)" + ARTICLE), F.lit(False))
    lost = records.where(location_key().isNull() & ~adds)
    return lost.select("source", "seq", "rec", "operation", F.when(F.col("operation").startswith("EK_"), UNSUPPORTED).otherwise(F.when(F.col("new_text").isNull() & (F.col("operation") == "BIRIM_EKLE"), UNSUPPORTED).otherwise(NO_TARGET)).alias("status"))


def _step_at(day: datetime.date | Column) -> Column:
    """The last step whose date is null or not after the day."""
    day = F.lit(day) if isinstance(day, datetime.date) else day
    return F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["date"].isNull() | (s["date"] <= day)), lambda s: s["step"])), F.lit(0))


def _alive(step: Column) -> Column:
    return F.filter("units", lambda u: (u["since"] <= step) & (u["until"].isNull() | (u["until"] > step)))


def as_of(versions: DataFrame, day: datetime.date | Column) -> DataFrame:
    """source, key, fikra, bent, alt_bent, text: the units that stood on a day, as the last record not after it left them."""
    return versions.withColumn("_step", _step_at(day)).select("source", "key", F.inline(_alive(F.col("_step")))).select("source", "key", *LEVELS, collapse(F.col("raw")).alias("text"))


#: Days of one bucket of the interval join.
BUCKET_DAYS = 512
_FIRST, _LAST = "0001-01-01", "9999-12-31"


def unit_intervals(versions: DataFrame) -> DataFrame:
    """source, key, fikra, bent, alt_bent, text, valid_from, valid_to: every state of every unit with the days on which
    as_of finds it, valid_to excluded; states that no day finds have no row.

    A record counts from its day on and takes those before it along, whatever their days; one without a day counts always.
    So a state begins on the earliest day among the records from its own on.
    """
    # the earliest day of each step and those after it, one array a row; steps count from 1
    days = F.transform(F.array_sort(F.transform("steps", lambda s: F.struct(s["step"].alias("step"), F.coalesce(s["date"], F.lit(_FIRST).cast("date")).alias("day")))), lambda s: s["day"])
    least = F.aggregate(F.reverse(days), F.array().cast("array<date>"), lambda a, d: F.concat(F.array(F.least(d, F.coalesce(F.get(a, F.lit(0)), d))), a))
    rows = versions.withColumn("_least", least).select("source", "key", "_least", F.inline("units"))
    at = lambda step: F.when(step == 0, F.lit(_FIRST).cast("date")).otherwise(F.get("_least", step - 1))
    rows = rows.select("source", "key", *LEVELS, collapse(F.col("raw")).alias("text"), at(F.col("since")).alias("valid_from"), F.when(F.col("until").isNotNull(), at(F.col("until"))).alias("valid_to"))
    return rows.where("valid_to is null or valid_from < valid_to")


def as_of_many(versions: DataFrame, asked: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """asked (source, day, and key where single articles are meant, with any other columns) with key, fikra, bent,
    alt_bent, text: the units that stood on each row's own day.

    An interval join: each interval goes to the buckets of days that it shares with the days asked for of its source (and
    article), each row asked to the one of its day, and days are compared within a bucket. So a table of any number of days
    takes one join, whose keys are as many as sources times buckets. Rows asked for what is not there, or with nulls, give
    no row; repeated ones give theirs each; no rows give none.
    """
    on = ["source", "key"] if "key" in asked.columns else ["source"]
    bucket = lambda c: F.floor(F.date_diff(c, F.lit(_FIRST).cast("date")) / bucket_days)
    rows = asked.where(" and ".join(f"{c} is not null" for c in [*on, "day"])).withColumn("_bucket", bucket(F.col("day")))
    span = rows.groupBy(*on).agg(F.min("day").alias("_low"), F.max("day").alias("_high"))
    held = unit_intervals(versions).join(span, on).where("valid_from <= _high and (valid_to is null or valid_to > _low)")
    low, high = F.greatest("valid_from", "_low"), F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(_LAST).cast("date")), F.col("_high"))
    held = held.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high)))).drop("_low", "_high")
    hit = rows.join(held, [*on, "_bucket"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    return hit.select(*asked.columns, *[c for c in ("key",) if c not in on], *LEVELS, "text")


def _order(u: Column) -> Column:
    """Paragraphs by number, then items by letter, then sub-items."""
    letter = F.call_function("instr", F.lit(ALPHABET), F.substring(u["bent"], 1, 1))
    return F.struct(F.coalesce(u["fikra"], F.lit(0)).alias("a"), F.coalesce(F.char_length(u["bent"]), F.lit(0)).alias("b"), F.coalesce(letter, F.lit(0)).alias("c"), F.coalesce(u["alt_bent"], F.lit(0)).alias("d"))


def articles_at(versions: DataFrame, day: datetime.date | Column | None = None) -> DataFrame:
    """source, key, pos, title, text of every article that stands on a day (null: after all records), as lines."""
    step = F.lit(2**31 - 1) if day is None else _step_at(day)
    rows = versions.withColumn("_step", step).withColumn("_alive", _alive(F.col("_step"))).where("size(_alive) > 0")
    mark = lambda u: F.when(u["alt_bent"].isNotNull(), F.concat(u["alt_bent"].cast("string"), F.lit(") "))).when(u["bent"].isNotNull(), F.concat(u["bent"], F.lit(") "))).when(u["fikra"].isNotNull(), F.concat(F.lit("("), u["fikra"].cast("string"), F.lit(") "))).otherwise("")
    body = F.array_join(F.transform(F.array_sort(F.transform("_alive", lambda u: F.struct(_order(u).alias("o"), F.concat(mark(u), u["raw"]).alias("line")))), lambda x: x["line"]), "\n")
    kind, num = F.regexp_extract("key", "^(gecici|ek):", 1), F.regexp_replace("key", "^(gecici|ek):", "")
    head = F.concat(F.when(kind == "gecici", "GEÇİCİ ").when(kind == "ek", "EK ").otherwise(""), F.lit("MADDE "), num, F.lit(" – "))
    named = F.element_at(F.filter("titles", lambda t: t["since"] <= F.col("_step")), -1)["title"]
    return rows.select("source", "key", "pos", named.alias("title"), F.concat(head, body).alias("text"))


def full_version(articles: DataFrame) -> DataFrame:
    """source, text: the articles of a version in their order. A regulation's text is bounded by what one law can hold."""
    line = F.concat(F.coalesce(F.concat("title", F.lit("\n")), F.lit("")), "text")
    return articles.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def apply_log(versions: DataFrame) -> DataFrame:
    """source, key, step, seq, rec, date, operation, status: a row per record."""
    return versions.select("source", "key", F.inline("steps"))


def chain(log: DataFrame) -> DataFrame:
    """source, seq, date, applied, failed array<struct<operation, status>>: a version per amending text."""
    bad = F.array_sort(F.collect_list(F.when(F.col("status") != "uygulandi", F.struct("rec", "operation", "status"))))
    return log.groupBy("source", "seq").agg(F.min("date").alias("date"), F.count_if(F.col("status") == "uygulandi").alias("applied"), F.transform(bad, lambda x: F.struct(x["operation"].alias("operation"), x["status"].alias("status"))).alias("failed"))


def amendment_dates(refs: DataFrame, amendments: DataFrame) -> DataFrame:
    """amendments (source, seq) with date and label: the i-th reference (source, ref) in order for the i-th amending text."""
    by = lambda *c: F.row_number().over(W.partitionBy("source").orderBy(*c))
    day = F.make_date(F.col("ref.year"), F.col("ref.month"), F.col("ref.day"))
    numbered = refs.select("source", "ref").distinct().withColumn("i", by("ref"))
    return amendments.withColumn("i", by("seq")).join(numbered, ["source", "i"], "left").withColumn("date", day).withColumn("label", gazette_label(F.col("ref"))).drop("i", "ref")


def original_dates(sources: DataFrame) -> DataFrame:
    """source, date: when each source (id, original_ref) was first published; null without a reference."""
    ref = gazette_ref(F.col("original_ref"))
    return sources.select(F.col("id").alias("source"), F.make_date(ref["year"], ref["month"], ref["day"]).alias("date"))


def chain_similarity(texts: DataFrame, consolidated: DataFrame) -> DataFrame:
    """source, similarity: whole texts (source, text) against the consolidated ones, whose footnotes, publication tables
    and annex links do not count; null where either is missing."""
    both = texts.alias("a").join(consolidated.alias("b"), "source", "full_outer").select("source", version_norm(F.col("a.text")).alias("x"), version_norm(strip_apparatus(F.col("b.text"))).alias("y"))
    return ratios(both, "x", "y").select("source", F.col("ratio").alias("similarity"))


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The SQL face of the exact ratio; null if either side is."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def official_articles(docs: DataFrame) -> DataFrame:
    """source, key, text: the articles of consolidated texts (doc_id, text), without what stands after the last of them."""
    own = docs.select("doc_id", strip_apparatus(F.col("text")).alias("text"))
    return full_texts(parse_units(own)).where("fikra is null").select(F.col("doc_id").alias("source"), "key", F.col("full").alias("text"))


def compare_articles(ours: DataFrame, official: DataFrame, same: float = 0.98, known: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Full outer join of (source, key, text): source, key, ours, official, bound, settled, ratio and durum, one of ayni,
    farkli, bizde_yok, resmide_yok, mulga_mezari.

    ratio is exact where it can reach same, and null where lengths or character counts say that it cannot (bound, settled:
    see similarity.ratios); with exact, it is exact wherever both texts are. known: (source, key) of repeals that the official
    text is known to lack or to keep; articles missing on our side that it lists are kaynak_tutarsizligi. Null texts are
    missing ones; a key given twice is compared with each of the other side; no rows give none.
    """
    x = ours.alias("x").join(official.alias("y"), ["source", "key"], "full_outer").select("source", "key", F.col("x.text").alias("ours"), F.col("y.text").alias("official"), version_norm(F.col("x.text")).alias("_a"), version_norm(F.col("y.text")).alias("_b"))
    x = ratios(x, "_a", "_b", None if exact else same).drop("_a", "_b")
    x = x.join(known.select("source", "key").distinct().withColumn("_known", F.lit(True)), ["source", "key"], "left") if known is not None else x.withColumn("_known", F.lit(None).cast("boolean"))
    gone = F.when(is_tombstone(F.col("official")), "mulga_mezari").when(F.col("_known"), "kaynak_tutarsizligi").otherwise("bizde_yok")
    outcome = F.when(F.col("ours").isNull(), gone).when(F.col("official").isNull(), "resmide_yok").when(F.col("ratio") >= same, "ayni").otherwise("farkli")
    return x.withColumn("durum", outcome).drop("_known")


def in_order(compared: DataFrame) -> DataFrame:
    """A comparison as it is read: by source, numbered articles first, then by the length of the key and the key."""
    return compared.orderBy("source", F.col("key").contains(":"), F.char_length("key"), "key")


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff(list(x), list(y), "official", "ours", n=1, lineterm="")) for x, y in zip(a, b, strict=True)])


def show_differences(compared: DataFrame) -> DataFrame:
    """source, key, diff: unified diffs of the sentences of articles that differ."""
    said = lambda c: diff_sentences(F.coalesce(F.col(c), F.lit("")))
    return compared.where("durum = 'farkli'").select("source", "key", unified_diff(said("official"), said("ours")).alias("diff"))
