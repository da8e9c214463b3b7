"""Verification of amendment records against the consolidated text, excused by later amendments of the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.functions.text import oran, paragraph_blocks, pick_item, verify_norm
from lexstrata.operators.structure import ARTICLE, article_rows, parse_units

LEVELS = ("fikra", "bent", "alt_bent")
#: The statuses of the output contract.
STATUSES = ("uyumlu", "uyumsuz", "hedef_bulunamadi", "kontrol_edilemedi", "sonradan_degisti", "kaynak_tutarsizligi")
PROBE = 150
ARTICLES = ("madde", "maddeler", "gecici_madde", "ek_madde")


def location_key(madde_type: str = "madde_type", madde: str = "madde") -> Column:
    return F.when(F.col(madde_type) == "normal", F.col(madde)).otherwise(F.concat(madde_type, F.lit(":"), madde))


def _adds_articles() -> Column:
    return (F.col("operation") == "BIRIM_EKLE") & F.coalesce(F.col("unit").isin(*ARTICLES), F.lit(False))


def _replaces_article() -> Column:
    return (F.col("operation") == "BIRIM_DEGISTIR") & F.coalesce(F.col("unit") == "madde", F.lit(False))


def first_articles(units: DataFrame) -> DataFrame:
    """_source, _have (its key), _title, _whole, _parts: the first article of each key of the parsed consolidated texts."""
    first = F.min_by(F.struct(F.col("title").alias("_title"), F.col("whole").alias("_whole"), F.col("parts").alias("_parts")), "article").alias("x")
    return article_rows(units).groupBy(F.col("doc_id").alias("_source"), F.col("key").alias("_have")).agg(first).select("_source", "_have", "x.*")


def new_articles(records: DataFrame, have: DataFrame) -> DataFrame:
    """_of, _block (its MD5), _added, _head: for each new text of article records, parsed, the status of its articles as added
    ones (that of the first article missing or different in the consolidated text) and the text of its first article.

    have: first_articles of the consolidated texts. A new text without articles has no row.
    """
    texts = records.where((_adds_articles() | _replaces_article()) & F.col("new_text").isNotNull()).select("source", F.md5(F.col("new_text").cast("binary")).alias("block"), "new_text")
    docs = texts.select(F.col("block").alias("doc_id"), F.concat(F.lit("BAŞLIK\n"), F.col("new_text")).alias("text")).dropDuplicates(["doc_id"])
    parsed = article_rows(parse_units(docs)).select(F.col("doc_id").alias("block"), "article", "key", verify_norm(F.col("whole")).alias("said"))
    rows = texts.select("source", "block").distinct().join(parsed, "block").join(have.select(F.col("_source").alias("source"), F.col("_have").alias("key"), verify_norm(F.col("_whole")).alias("whole")), ["source", "key"], "left")
    bad = F.when(F.col("whole").isNull(), "hedef_bulunamadi").when(F.col("said") != F.col("whole"), "uyumsuz")
    out = rows.groupBy(F.col("source").alias("_of"), F.col("block").alias("_block"))
    return out.agg(F.coalesce(F.min_by(bad, F.when(bad.isNotNull(), F.col("article"))), F.lit("uyumlu")).alias("_added"), F.min_by("said", "article").alias("_head"))


def _target() -> Column:
    """The full text of the part a record names: all of the article without levels; an item without a paragraph is the
    first of that letter; a level that is not there gives null."""
    same = lambda u, c: u[c].eqNullSafe(F.col(c))
    hit = F.filter("_parts", lambda u: ((F.col("fikra").isNull() & F.col("bent").isNotNull()) | same(u, "fikra")) & same(u, "bent") & same(u, "alt_bent"))
    open_ = F.col("fikra").isNull() & F.col("bent").isNull() & F.col("alt_bent").isNull()
    return F.when(open_, F.col("_whole")).otherwise(F.get(hit, F.lit(0))["full"])


def _paragraphs() -> Column:
    """For a new text of several '(n)' lines: whether those paragraphs are there and all equal to theirs; null otherwise."""
    blocks = F.transform(paragraph_blocks(F.col("new_text")), lambda x: F.trim(x))
    own = lambda b: F.get(F.filter("_parts", lambda u: (u["fikra"] == F.regexp_extract(b, r"^\((\d+)\)", 1).cast("int")) & u["bent"].isNull()), F.lit(0))["full"]
    pairs = F.transform(blocks, lambda b: F.struct(verify_norm(F.regexp_replace(b, r"^\(\d+\)\s*", "")).alias("said"), own(b).alias("have")))
    found = F.when(F.exists(pairs, lambda p: p["have"].isNull()), "hedef_bulunamadi").when(F.forall(pairs, lambda p: p["said"] == verify_norm(p["have"])), "uyumlu").otherwise("uyumsuz")
    return F.when(F.size(blocks) > 1, found)


def verify(records: DataFrame, units: DataFrame) -> DataFrame:
    """records (source, seq, operation, unit, madde_type, madde, fikra, bent, alt_bent, cumle, old_text, new_text) with
    status added. units come from the structural parse of the consolidated texts, doc_id being the source.

    Where an article key repeats, its first article counts; an item without a paragraph is the first of that letter. A
    record without a place to check has no target. Null texts never verify; no records give no rows; a column called
    status is replaced, other columns stay, but for names that begin with an underscore.
    """
    records = records.drop("status")
    named = records.select(F.col("source").alias("doc_id"), location_key().alias("key")).distinct()
    # an article that no record names or adds needs no full text
    added = F.regexp_extract_all("new_text", F.lit("(?m)" + ARTICLE), F.lit(2))
    named = named.unionByName(records.where(_adds_articles() | _replaces_article()).select(F.col("source").alias("doc_id"), F.explode(added).alias("n")).select("doc_id", F.explode(F.array(F.col("n"), F.concat(F.lit("gecici:"), F.col("n")), F.concat(F.lit("ek:"), F.col("n")))).alias("key"))).distinct()
    have = first_articles(units.join(named, ["doc_id", "key"], "left_semi"))
    text_of = lambda c: F.coalesce(verify_norm(F.col(c)), F.lit(""))
    out = records.withColumn("_key", location_key()).join(have, [F.col("source") == F.col("_source"), F.col("_key") == F.col("_have")], "left")
    out = out.join(new_articles(records, have), [F.col("source") == F.col("_of"), F.md5(F.col("new_text").cast("binary")) == F.col("_block")], "left")
    out = out.withColumns({"_target": _target(), "_new": text_of("new_text"), "_old": text_of("old_text")})
    out = out.withColumns({"_text": verify_norm(F.col("_target")), "_probe": F.regexp_replace(F.substring("_new", 1, PROBE), r"[.,;: ]+$", "")})
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "uyumlu").otherwise("uyumsuz")
    found = lambda c, ok: F.when(F.col(c).isNull(), "hedef_bulunamadi").otherwise(verdict(ok))
    op, new, old, text, marker = F.col("operation"), F.col("_new"), F.col("_old"), F.col("_text"), r"(?U)^(?:\(\d+\)|\w{1,3}\))\s*"
    own = F.coalesce(F.col("alt_bent").cast("string"), F.col("bent"), F.col("fikra").cast("string"))
    bare = F.regexp_replace(verify_norm(pick_item(F.col("new_text"), own)), marker, "")
    fits = lambda u, c: F.coalesce(F.col(c).isNull() | (u[c] == F.col(c)), F.lit(False))
    repealed = F.exists("_parts", lambda u: fits(u, "fikra") & fits(u, "bent") & F.exists(u["notes"], lambda n: n["type"] == "Mülga"))
    paragraphs = F.when(op == "BIRIM_DEGISTIR", F.when(F.col("unit") == "fikra", _paragraphs()))
    status = (
        F.when((F.col("madde_type") == "ek_belge") | op.isin("EK_EKLE", "EK_DEGISTIR"), "kontrol_edilemedi")
        .when((op == "BASLIK_DEGISTIR") | ((op == "BIRIM_DEGISTIR") & (F.col("unit") == "baslik")), found("_whole", new == verify_norm(F.col("_title"))))
        .when(_adds_articles(), F.coalesce("_added", F.lit("kontrol_edilemedi")))
        .when(op == "BIRIM_EKLE", found("_whole", (F.col("_probe") != "") & F.contains(verify_norm(F.col("_whole")), F.col("_probe"))))
        .when(_replaces_article(), F.when(F.col("_target").isNull(), "hedef_bulunamadi").when(F.col("_head").isNull(), "kontrol_edilemedi").otherwise(verdict(F.col("_head") == text)))
        .when((op == "BIRIM_DEGISTIR") & F.col("cumle").isNotNull(), found("_target", (F.col("_probe") != "") & F.contains(text, F.regexp_replace(new, r"[.,;: ]+$", ""))))
        .when(paragraphs.isNotNull(), paragraphs)
        .when(op == "BIRIM_DEGISTIR", found("_target", bare == F.regexp_replace(text, marker, "")))
        .when(op.isin("IBARE_DEGISTIR", "IBARE_EKLE"), found("_target", (new != "") & F.contains(text, new)))
        .when(op == "IBARE_KALDIR", found("_target", (old != "") & ~F.contains(text, old)))
        .when(op == "BIRIM_KALDIR", verdict(F.col("_target").isNull() | (text == "") | repealed))
        .otherwise("kontrol_edilemedi")
    )
    return out.select(*records.columns, status.alias("status"))


def overlaps(a: str, b: str) -> Column:
    """Each level equal, or open on either side."""
    out = F.lit(True)
    for c in LEVELS:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out & (x.isNull() | y.isNull() | (x == y))
    return out


def effective_places(records: DataFrame) -> DataFrame:
    """records, with e_type and e_madde: their article, or, for added articles without one, the first of the new text."""
    found = F.regexp_extract("new_text", "(?m)" + ARTICLE, 2)
    kind = F.upper(F.translate(F.regexp_extract("new_text", "(?m)" + ARTICLE, 1), "iı", "İI"))
    adds = F.col("madde").isNull() & _adds_articles() & (F.coalesce(found, F.lit("")) != "")
    return records.withColumn("e_type", F.when(adds, F.when(kind == "GEÇİCİ", "gecici").when(kind == "EK", "ek").otherwise("normal")).otherwise(F.col("madde_type"))).withColumn("e_madde", F.when(adds, found).otherwise(F.col("madde")))


def open_forms(records: DataFrame) -> DataFrame:
    """records with mask and form: a row for each set of levels that a record's place says something on (eight at most),
    mask being the levels it names and form those of the set with their values.

    Two places overlap where every level that both name is equal: that is, where the form of one over the levels that both
    name is a form of the other.
    """
    named = [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(LEVELS)]
    rows = records.withColumn("mask", named[0] + named[1] + named[2])
    subsets = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    return rows.withColumn("_s", F.explode(subsets)).withColumn("form", _form(F.col("_s"))).drop("_s")


def _form(levels: Column) -> Column:
    """The values of some of a place's levels as one text: which they are, and each one's value."""
    own = [F.when(levels.bitwiseAND(F.lit(1 << i)) > 0, F.col(c).cast("string")) for i, c in enumerate(LEVELS)]
    return F.concat_ws("\x1f", levels.cast("string"), *own)


#: Amending texts of one bucket, within which later ones are counted row by row; and the records of one article up to which
#: each failing one is compared with every other.
SEQ_BUCKET, FEW = 256, 256


def later_counts(failing: DataFrame, records: DataFrame) -> DataFrame:
    """source, seq, rec, later_count of failing records: how many records of later amending texts (greater seq) have a
    place that overlaps theirs. Both come with source, e_type, e_madde, seq and the levels; rows without one are left out.

    Within an article of few records each failing one is compared with the others. Those of an article with more go by
    their open forms, so that no article is compared pair by pair; see _later_by_forms.
    """
    article = ["source", "e_type", "e_madde"]
    many = records.groupBy(*article).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*article)
    asks, others = failing.select(*article, "seq", "rec", *LEVELS), records.select(*article, "seq", *LEVELS)
    split = lambda rows, how: rows.join(many, article, how)
    few, beside = split(asks, "left_anti").dropna(subset=[*article, "seq"]).alias("a"), others.alias("b")
    overlapped = (F.col("a.seq") < F.col("b.seq")) & overlaps("a", "b")
    # a left join: a failing record that none overlaps counts 0
    pairs = few.join(beside, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in article], "left").select("a.source", "a.seq", "a.rec", F.when(overlapped, 1).otherwise(0).cast("bigint").alias("n"))
    found = pairs.unionByName(_later_by_forms(split(asks, "left_semi"), split(others, "left_semi")))
    return found.groupBy("source", "seq", "rec").agg(F.sum("n").alias("later_count"))


def _later_by_forms(failing: DataFrame, records: DataFrame) -> DataFrame:
    """source, seq, rec, n: parts of the later_count of failing records, to be summed.

    A record is counted under each of its open forms; a failing one asks, for each set of levels that others may name, for
    the form over the levels that both name. So all joins are on equal keys. Greater seq is a running sum within buckets of
    amending texts and one over the buckets, so that an article with very many records takes many tasks.
    """
    place = ["source", "e_type", "e_madde", "mask", "form"]
    counted = open_forms(records).groupBy(*place, "seq").agg(F.count("*").alias("n"))
    mine = F.when(F.col("fikra").isNotNull(), 1).otherwise(0) + F.when(F.col("bent").isNotNull(), 2).otherwise(0) + F.when(F.col("alt_bent").isNotNull(), 4).otherwise(0)
    asks = failing.select("source", "e_type", "e_madde", "seq", "rec", *LEVELS, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mask"))
    asks = asks.withColumn("form", _form(F.col("mine").bitwiseAND(F.col("mask"))))
    none = F.lit(None)
    rows = counted.select(*place, "seq", "n", none.cast("int").alias("rec"), F.lit(False).alias("asks")).unionByName(asks.select(*place, "seq", F.lit(0).cast("bigint").alias("n"), "rec", F.lit(True).alias("asks")))
    rows = rows.withColumn("bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    totals = rows.groupBy(*place, "bucket").agg(F.sum("n").alias("n"), F.bool_or("asks").alias("asked"))
    after = totals.withColumn("after", F.coalesce(F.sum("n").over(W.partitionBy(*place).orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("asked")
    within = W.partitionBy(*place, "bucket").orderBy(F.col("seq").desc()).rangeBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).where("asks").join(after.select(*place, "bucket", "after"), [*place, "bucket"])
    return found.select("source", "seq", "rec", (F.col("own") + F.col("after")).alias("n"))


def excuse_later(verified: DataFrame) -> DataFrame:
    """Failing records that later amending texts (greater seq) overwrite become sonradan_degisti; later_count says how
    many records of them do, else 0.

    Places overlap where each level is equal or open on either side; see later_counts. Records without an article neither
    excuse nor are excused. A column called later_count is replaced; no records give no rows.
    """
    verified = verified.drop("later_count")
    at = effective_places(verified).where("e_madde is not null and e_type is not null")
    hit = later_counts(at.where(F.col("status").isin("uyumsuz", "hedef_bulunamadi")), at)
    out = verified.join(hit, ["source", "seq", "rec"], "left").withColumn("later_count", F.coalesce("later_count", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("later_count") > 0, "sonradan_degisti").otherwise(F.col("status"))).select(*verified.columns, "later_count")


def passes(totals: DataFrame, least: float) -> bool:
    """Whether the overall rate of a summary reaches least; without anything to check it does not."""
    row = totals.where("source is null").select("oran").first()
    return bool(row and row.oran is not None and row.oran >= least)


def manifest_urls(manifest: DataFrame) -> DataFrame:
    """file, url: where each stored file came from, the last row of a file counting."""
    return manifest.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).agg(F.max_by("url", "fetched_at").alias("url"))


_ISSUE = ("amendment_url", "amending_article", "madde_type", "madde", "fikra", "bent", "alt_bent", "cumle")


def _fitting(verified: DataFrame, issues: DataFrame) -> DataFrame:
    """source, seq, rec, issue: the first fitting issue of each record."""
    fit = F.lit(True)
    for c in (c for c in _ISSUE if c in issues.columns and c in verified.columns):
        fit = fit & (F.col(f"i.{c}").isNull() | (F.col(f"i.{c}").cast("string") == F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("None"))))
    at = issues.select("*", F.col("place").alias("_place")) if "place" in issues.columns else issues.withColumn("_place", F.lit(0))
    hit = verified.alias("r").join(at.alias("i"), ["source", "operation"]).where(fit)
    return hit.groupBy("source", F.col("r.seq").alias("seq"), F.col("r.rec").alias("rec")).agg(F.min(F.struct("i._place", "i.id")).alias("x")).select("source", "seq", "rec", F.col("x.id").alias("issue"))


def relabel_known(verified: DataFrame, issues: DataFrame) -> DataFrame:
    """Failed records that a known issue fits become kaynak_tutarsizligi; issue holds its id (null elsewhere).

    issues: id, source, operation, amendment_url and amending_article where the records have them, the levels of the
    place, null where the issue does not list one, and place, its position in the list: the first fitting issue counts.
    """
    out = verified.drop("issue").join(_fitting(verified, issues), ["source", "seq", "rec"], "left")
    failed = F.col("status").isin("uyumsuz", "hedef_bulunamadi")
    out = out.withColumn("issue", F.when(failed, F.col("issue")))
    return out.withColumn("status", F.when(F.col("issue").isNotNull(), "kaynak_tutarsizligi").otherwise(F.col("status")))


def resolved_issues(verified: DataFrame, issues: DataFrame) -> DataFrame:
    """id of issues that fit only records that pass: the source has mended them."""
    hit = verified.join(_fitting(verified, issues), ["source", "seq", "rec"])
    failed = F.col("status").isin("uyumsuz", "hedef_bulunamadi", "kaynak_tutarsizligi")
    return hit.groupBy(F.col("issue").alias("id")).agg(F.bool_or(failed).alias("used")).where("not used").select("id")


def summary(verified: DataFrame) -> DataFrame:
    """Counts of the statuses and the rate, per source and over all (source null)."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    return verified.rollup("source").agg(F.count("*").alias("records"), *[c.alias(s) for s, c in n.items()], oran(*(n[s] for s in STATUSES[:3])).alias("oran"))
