"""Why a record no longer holds: later amendments that quote it, and the official text's own notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.functions.text import rg_digits, verify_norm
from lexstrata.operators.grams import contained
from lexstrata.sources.shared import written

KEY = ("source", "seq", "rec")


PLACE = ["source", "madde_type", "madde"]


def quote_links(records: DataFrame, least: int = 8) -> DataFrame:
    """source, madde_type, madde, new, quoted: the pairs of a record's new text and an old or anchor text of the same
    article of which one contains the other, as MD5s of the texts in lower case and without quotation marks.

    Each text of an article counts once however often it is said; the texts and the pairs are written once, so that what
    follows begins a plan of its own. See grams.contained for how pairs are found.
    """
    kind = F.coalesce("madde_type", F.lit("normal")).alias("madde_type")
    norm = lambda c: F.lower(verify_norm(F.col(c)))
    each = lambda *cs: records.where("source is not null and madde is not null").select("source", kind, "madde", F.explode(F.array(*map(norm, cs))).alias("text")).where(F.char_length("text") >= least).distinct().withColumn("id", F.md5(F.col("text").cast("binary")))
    new, quoted = written(each("new_text")), written(each("old_text", "anchor_text"))
    inside = contained(new, quoted, PLACE).select(*PLACE, F.col("long_id").alias("new"), F.col("short_id").alias("quoted"))
    around = contained(quoted, new, PLACE).select(*PLACE, F.col("short_id").alias("new"), F.col("long_id").alias("quoted"))
    return written(inside.union(around).distinct())


#: How often an article is quoted up to which each of its new texts is compared with every quote.
FEW = 256


def quote_evidence(records: DataFrame, least: int = 8) -> DataFrame:
    """source, seq, rec, later_seq, later_article, quoted: the first later record of the same article that quotes a record's new text.

    A null kind of article counts as normal. Texts shorter than least do not count; an old text goes before an anchor.
    Records without an article or a text have none; no records give none. Within an article of up to FEW quotes the new
    texts are compared with them as they stand, which deals out each text once; those of an article with more meet by
    their grams, so that no article is compared pair by pair. See _hits_by_links.
    """
    kind = F.coalesce("madde_type", F.lit("normal")).alias("madde_type")
    records = records.where("source is not null and madde is not null").withColumn("madde_type", kind)
    said = _quotes(records, least).where("seq is not null")
    many = written(said.groupBy(*PLACE).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*PLACE))
    hits = _hits_by_pairs(records.join(many, PLACE, "left_anti"), least)
    if not many.isEmpty():
        hits = hits.unionByName(_hits_by_links(records.join(many, PLACE, "left_semi"), least))
    first = hits.groupBy(*KEY).agg(F.min("next").alias("x"))
    return first.select(*KEY, "x.later_seq", "x.later_article", F.col("x.said").alias("quoted"))


def _norm(c: str) -> Column:
    return F.lower(verify_norm(F.col(c)))


def _quotes(records: DataFrame, least: int) -> DataFrame:
    """PLACE, seq, field (0 old text, 1 anchor), later_article, said: the texts that records quote."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), _norm(c).alias("said")) for i, c in enumerate(("old_text", "anchor_text"))])).alias("q")
    return records.select(*PLACE, "seq", F.col("amending_article").alias("later_article"), fields).where(F.char_length("q.said") >= least).select(*PLACE, "seq", "later_article", "q.*")


def _hits_by_pairs(records: DataFrame, least: int) -> DataFrame:
    """KEY, next: each later quote of a record's new text, all of an article compared with one another.

    The join is merged, as the size of stored texts says little of what they take in memory.
    """
    mine = records.select(*PLACE, "seq", F.col("rec").cast("int").alias("rec"), F.explode(F.array(_norm("new_text"))).alias("new")).where(F.char_length("new") >= least)
    said = _quotes(records, least).withColumnRenamed("seq", "later_seq")
    within = F.contains("new", F.col("said")) | F.contains("said", F.col("new"))
    pairs = mine.join(said.hint("merge"), PLACE).where((F.col("later_seq") > F.col("seq")) & within)
    return pairs.select(*KEY, F.struct("later_seq", "field", "later_article", "said").alias("next"))


def _hits_by_links(records: DataFrame, least: int) -> DataFrame:
    """KEY, next: of each quoted text that fits a record's new text its first later use.

    Texts are compared once for all records that say them.
    """
    of = lambda c: F.md5(c.cast("binary"))
    links = quote_links(records, least)
    mine = records.select(*KEY, "madde_type", "madde", of(_norm("new_text")).alias("new")).where("seq is not null").join(links.hint("merge"), [*PLACE, "new"])
    said = _quotes(records, least).groupBy(*PLACE, of(F.col("said")).alias("quoted"), "seq").agg(F.min(F.struct("field", "later_article", "said")).alias("x"))
    none = F.lit(None)
    rows = said.select(*PLACE, "quoted", "seq", F.struct(F.col("seq").alias("later_seq"), "x.field", "x.later_article", "x.said").alias("hit"), none.cast("int").alias("rec"), F.lit(False).alias("asks"))
    rows = rows.unionByName(mine.select(*PLACE, "quoted", "seq", none.cast(rows.schema["hit"].dataType).alias("hit"), F.col("rec").cast("int").alias("rec"), F.lit(True).alias("asks")))
    after = W.partitionBy(*PLACE, "quoted").orderBy("seq").rangeBetween(1, W.unboundedFollowing)
    return rows.withColumn("next", F.first("hit", True).over(after)).where("asks and next is not null").select(*KEY, "next")


def note_evidence(verified: DataFrame, labels: DataFrame, units: DataFrame) -> DataFrame:
    """source, seq, rec, label, unit: records overwritten later whose place bears a note of their own amending text.

    labels: (source, seq, label), 'RG-d/m/yyyy-number'. units: the parsed consolidated text, doc_id being the source. The
    article's own notes go first, then its paragraphs', then its items', each only where the record's place allows. The
    article is found by number alone.
    """
    r = verified.where("status = 'sonradan_degisti' and madde is not null").join(labels, ["source", "seq"]).withColumn("digits", rg_digits(F.col("label"))).where("digits <> ''")
    first = F.min("article").over(W.partitionBy("doc_id", "key"))
    u = units.withColumn("_first", first).where("article = _first").select(F.col("doc_id").alias("source"), F.col("key").alias("madde"), *[F.col(c).alias(f"u_{c}") for c in ("fikra", "bent", "alt_bent")], "pos", "notes", "article_notes")
    level = F.when(F.col("u_bent").isNotNull(), 2).when(F.col("u_fikra").isNotNull(), 1).otherwise(0)
    u = u.where("u_alt_bent is null").select("source", "madde", "u_fikra", "u_bent", "pos", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("article_notes").alias("n")), F.struct(level.alias("level"), F.col("notes").alias("n")))).alias("x"))
    u = u.select("source", "madde", "u_fikra", "u_bent", "pos", "x.level", F.transform("x.n", lambda n: rg_digits(n["source"])).alias("said")).where("size(said) > 0")
    fits = (F.col("level") == 0) | ((F.col("fikra").isNull() | (F.col("fikra") == F.col("u_fikra"))) & ((F.col("level") == 1) | F.col("bent").isNull() | (F.col("bent") == F.col("u_bent"))))
    hit = r.join(u, ["source", "madde"]).where(fits & F.exists("said", lambda s: F.contains(s, F.col("digits"))))
    name = F.concat_ws(" ", F.lit("madde"), "madde", F.when(F.col("level") > 0, F.concat(F.lit("fıkra "), F.col("u_fikra").cast("string"))), F.when(F.col("level") > 1, F.concat(F.lit("bent "), F.col("u_bent"))))
    return hit.groupBy(*KEY).agg(F.min(F.struct("level", "pos", name.alias("unit"), "label")).alias("x")).select(*KEY, "x.label", "x.unit")


def explained(quotes: DataFrame, notes: DataFrame) -> DataFrame:
    """source, seq, rec: what either kind of evidence explains."""
    return quotes.select(*KEY).union(notes.select(*KEY)).distinct()
