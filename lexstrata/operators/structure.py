"""Structural parse of regulation texts: articles, paragraphs, items and sub-items by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.functions.text import annotations, collapse, drop_notes, gazette_ref, leading_notes, let, single_blanks, with_notes

#: The words that begin an article, with the kinds that may stand before them, and that end a section's line.
ARTICLE_WORD, KIND_WORDS, SECTION_WORDS, DASHES = "MADDE", {"GEÇİCİ": "gecici", "EK": "ek"}, ("BÖLÜM", "KISIM"), "–—-"


def _either_case(word: str) -> str:
    """A word in capitals, or with a capital first, as a pattern."""
    low = word[1:].translate(str.maketrans("Iİ", "ıi")).lower()
    return f"{word[0]}(?:{word[1:]}|{low})"


#: An article's head: kind (group 1), number with its letter (group 2) and a dash.
ARTICLE = rf"^(?:({'|'.join(map(_either_case, KIND_WORDS))})\s+)?{_either_case(ARTICLE_WORD)}\s+([0-9]+(?:/\p{{Lu}})?)\s*[{DASHES}]\s*"
SECTION = rf"^[A-ZÇĞİÖŞÜ ]+\s(?:{'|'.join(SECTION_WORDS)})$"


def _footnote(line: Column) -> Column:
    """struct<k, said> of a footnote's definition, else null: a number in brackets, a date that something is 'tarihli' by,
    the gazette's name, and 'maddesiyle' or a like word for the article that did it."""
    def of(x: Column) -> Column:
        words = F.split(x["said"], r"\s+")
        dated = F.try_to_date(F.get(words, F.lit(0)), "d/M/yyyy").isNotNull() & F.get(words, F.lit(1)).startswith("tarihli")
        gazette = F.contains(F.replace(x["said"], F.lit("Resmi"), F.lit("Resmî")), F.lit("Resmî Gazete"))
        by = F.exists(words, lambda w: w.startswith("madde") & F.exists(F.array(*map(F.lit, ("siyle", "sile", "leriyle", "lerile"))), lambda e: F.contains(w, e)))
        good = x["k"].rlike(r"^\d{1,3}$") & dated & gazette & by
        return F.when(F.coalesce(good, F.lit(False)), F.struct(x["k"].cast("int").alias("k"), x["said"].alias("said")))

    number = F.substring_index(F.substr(line, F.lit(2)), ")", 1)
    cut = let(number, lambda k: F.struct(k.alias("k"), F.ltrim(F.substr(line, F.char_length(k) + 3)).alias("said")))
    return F.when(line.startswith("(") & F.contains(line, F.lit("Gazete")), let(cut, of))


def _windows() -> tuple:
    doc = W.partitionBy("doc_id").orderBy("pos")
    return doc, doc.rowsBetween(W.unboundedPreceding, -1), doc.rowsBetween(W.unboundedPreceding, 0)


def is_head(line: Column) -> Column:
    """Whether a line begins an article; only lines that have the word are matched."""
    may = F.contains(line, F.lit(ARTICLE_WORD)) | F.contains(line, F.lit(ARTICLE_WORD.capitalize()))
    return may & line.rlike(ARTICLE)


#: How many lines the inner array of a document's lines takes before it is put away, so that adding one stays cheap.
RUN = 256


def _with_quotes(lines: Column) -> Column:
    """array<struct<line, quoted, head>> of a document's lines: whether each starts inside quotes, and whether it begins an
    article outside of them. One pass, with the depth, its least value and the straight quote as state."""
    kind = "array<struct<line:string,quoted:boolean,head:boolean>>"
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("low"), F.lit(False).alias("straight"), F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("run"))

    def count(line: Column, ch: str) -> Column:
        return F.when(F.contains(line, F.lit(ch)), F.char_length(line) - F.char_length(F.replace(line, F.lit(ch), F.lit("")))).otherwise(0)

    def step(a: Column, line: Column) -> Column:
        return let(F.struct(a.alias("a"), line.alias("line"), is_head(line).alias("art"), F.least(a["low"], a["s"]).alias("low")), moved)

    def moved(x: Column) -> Column:
        a, line = x["a"], x["line"]
        quoted = (a["s"] - x["low"] > 0) | (a["straight"] & ~x["art"])
        opens = line.startswith('"') & ~line.rlike('^".*"$')
        straight = F.when(opens, True).when(line.endswith('"') | x["art"], False).otherwise(a["straight"])
        own, full = F.array(F.struct(line.alias("line"), quoted.alias("quoted"), (~quoted & x["art"]).alias("head"))), F.size(a["run"]) == RUN
        done, run = F.when(full, F.concat(a["done"], F.array(a["run"]))).otherwise(a["done"]), F.when(full, own).otherwise(F.concat(a["run"], own))
        return F.struct((a["s"] + count(line, "“") - count(line, "”")).alias("s"), x["low"].alias("low"), straight.alias("straight"), done.alias("done"), run.alias("run"))

    return F.aggregate(lines, start, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["run"]))))


#: A quotation between curly marks that ends on its line and holds no mark.
ON_ITS_LINE = "“[^“”\"\n]*”"


def _lines(text: Column) -> Column:
    """array<struct<line, quoted, head>> of a text; one whose quotes all end on their line needs no state."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(False).alias("quoted"), is_head(x).alias("head")))
    marked = lambda x: F.contains(x, F.lit("“")) | F.contains(x, F.lit("”")) | F.contains(x, F.lit('"'))
    bare = F.when(F.contains(text, F.lit("“")), F.regexp_replace(text, ON_ITS_LINE, "")).otherwise(text)
    return F.when(let(bare, marked), _with_quotes(lines)).otherwise(plain)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts of each doc_id after one another, with single blanks."""
    # reading takes much time for few bytes: partitions put together by size would leave some cores without one
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartition(parts, "doc_id").withColumn("of", F.xxhash64("text"))
    each = W.partitionBy("doc_id").orderBy("of")
    # nulls go from the list: a filter on the text would compute it once more where it is itself an expression
    rows = rows.withColumns({"nth": F.row_number().over(each), "texts": F.collect_list("text").over(each.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}).where("nth = 1 and size(texts) > 0")
    # white space but line feeds as collapse has it, in the whole text at once
    return rows.select("doc_id", let(F.array_join(F.array_distinct("texts"), "\n"), lambda x: single_blanks(x)).alias("text"))


def line_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, lines array<struct<line, quoted, head>>: a document a row, with its lines that are not blank in order.

    Curly quotes nest. A straight quote opens at a line's start and closes at a line's end, or at an article's head. A
    null text has no lines. Texts of one doc_id follow one another in the order of their hashes, equal ones count once.
    """
    return _texts(docs).select("doc_id", _lines(F.col("text")).alias("lines"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, quoted, head: every line of line_arrays."""
    # of a column called lines Spark would ask whether it is empty, and so compute it twice
    rows = _texts(docs).select("doc_id", F.posexplode(_lines(F.col("text"))).alias("nth", "x"))
    return rows.select("doc_id", (F.col("nth") + 1).alias("pos"), "x.line", "x.quoted", "x.head")


def _classed(docs: DataFrame) -> DataFrame:
    """lines_of with section, footnote, and heading: the lines of the document's own title."""
    doc, before, _ = _windows()
    plain = ~F.col("quoted")
    rows = lines_of(docs).withColumns({"section": plain & F.col("line").rlike(SECTION), "footnote": plain & _footnote(F.col("line")).isNotNull(), "upper": ~F.contains("line", F.lit("a")) & ~F.contains("line", F.lit("e")) & (F.col("line") == F.upper(F.translate("line", "iı", "İI")))})
    begun = F.max(F.when(F.col("head") | F.col("section"), 1)).over(doc)
    other = F.max(F.when(~(F.col("upper") & plain) & ~F.col("head"), F.col("pos"))).over(before)
    first = F.first("pos").over(doc)
    return rows.withColumn("heading", plain & begun.isNull() & ((F.col("pos") == first) | (F.col("upper") & (other.isNull() | (other == first)))))


def document_titles(docs: DataFrame) -> DataFrame:
    """doc_id, title: the first line and the capital lines after it, up to the first article or section."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return _classed(docs).where("heading").groupBy("doc_id").agg(F.array_join(lines, " ").alias("title"))


def footnotes(docs: DataFrame) -> DataFrame:
    """doc_id, footnotes map<int, string>: the definitions; of a number that repeats, the last."""
    rows = _classed(docs).where("footnote").select("doc_id", "pos", _footnote(F.col("line")).alias("x")).select("doc_id", "pos", "x.k", "x.said")
    return rows.groupBy("doc_id", "k").agg(F.max_by("said", "pos").alias("said")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "said")))).alias("footnotes"))


def parse_units(docs: DataFrame) -> DataFrame:
    """doc_id, article, kind, num, key, title, section, section_title, fikra, bent, alt_bent, pos, text, raw, notes, article_notes.

    A row per unit. article numbers the articles of a document in order; fikra, bent and alt_bent are null above their
    level. raw keeps the lines and notes of the unit, text is one line without them; article_notes are those at its head. Quoted lines belong to the unit that
    is open. A section ends the article before it. A null or empty text has no units; several texts of
    one doc_id follow one another (see lines_of); other columns are ignored.
    """
    doc, *_ = _windows()
    after_section = F.coalesce(F.lag("section").over(doc), F.lit(False)) & ~F.col("head")
    bare = F.trim(drop_notes(F.col("line")))
    # only the line before a head may be its title
    fits = ~(F.col("head") | F.col("quoted") | F.col("section") | F.col("heading") | F.col("footnote")) & (F.char_length(bare) <= 250) & ~bare.rlike(r"[.,;:]$") & ~F.col("line").rlike(r"^(?:[\"“]|\(\d+\)|([a-zçğıöşü])\1{0,2}\)|\d+\))")
    rows = _classed(docs).withColumns({"names": after_section, "is_title": F.when(F.lead("head").over(doc), fits & ~after_section).otherwise(False)})
    rows = rows.withColumns({
        "title": F.when(F.col("head"), F.coalesce(F.when(F.lag("is_title").over(doc), F.trim(drop_notes(F.lag("line").over(doc)))), F.lit(""))), "article": F.sum(F.col("head").cast("int")).over(doc),
        "section_name": F.last(F.when(F.col("section"), F.col("line")), True).over(doc), "section_title": F.last(F.when(F.col("names"), F.col("line")).when(F.col("section"), ""), True).over(doc),
        "inside": F.coalesce(F.last(F.when(F.col("head"), True).when(F.col("section"), False), True).over(doc), F.lit(False))})
    rows = rows.where("inside and not is_title and not section and not footnote")

    body = F.when(F.col("head"), F.regexp_replace("line", ARTICLE, "")).otherwise(F.col("line"))
    rows = rows.withColumn("cut", leading_notes(body)).withColumn("moved", ~F.col("head") & (F.col("cut.lead") != "") & F.col("cut.rest").rlike(r"^\(\d+\)"))
    # notes at an article's head are the article's; those before a paragraph's number go behind it
    behind = F.regexp_replace("cut.rest", r"^(\(\d+\))", "$1 \u0001")
    rows = rows.withColumns({"lead": F.when(F.col("head"), F.col("cut.lead")).otherwise(""), "body": F.when(F.col("head"), F.col("cut.rest")).when(F.col("moved"), F.replace(behind, F.lit("\u0001"), F.trim("cut.lead"))).otherwise(F.col("line"))})
    body = F.when(F.col("head"), F.regexp_replace(F.regexp_replace("body", r"^\((\d+)\)\s*\((\d+)\)", ".($1)($2)"), r"^\((\d+)\)$", ".($1)")).otherwise(F.col("body"))
    rows = rows.withColumns({"lead": F.concat("lead", F.regexp_extract(body, r"^(\.\(\d+\))", 1)), "body": F.trim(F.regexp_replace(body, r"^\.\(\d+\)", ""))})
    mark = lambda regex: F.when(~F.col("quoted"), F.nullif(F.regexp_extract("body", regex, 1), F.lit("")))
    rows = rows.withColumns({"f": mark(r"^\((\d+)\)"), "b": mark(r"^(([a-zçğıöşü])\2{0,2})\)"), "n": mark(r"^(\d+)\)")})
    art = W.partitionBy("doc_id", "article").orderBy("pos")
    at_head = lambda c: F.last(F.when(F.col("head"), F.coalesce(c, F.lit(""))), True).over(art)
    item = F.max(F.when(F.col("b").isNotNull(), 1)).over(art)
    rows = rows.withColumns({"fikra": F.coalesce(F.last("f", True).over(art).cast("int"), F.when(item.isNotNull(), 1)), "head_line": at_head("line"), **{c: at_head(c) for c in ("title", "section_name", "section_title", "lead")}})
    rows = rows.withColumn("bent", F.last("b", True).over(W.partitionBy("doc_id", "article", "fikra").orderBy("pos")))
    rows = rows.withColumn("a", F.when(F.col("bent").isNotNull(), F.col("n")))
    rows = rows.withColumn("alt_bent", F.last("a", True).over(W.partitionBy("doc_id", "article", "fikra", "bent").orderBy("pos")).cast("int"))
    own = F.when(F.col("f").isNotNull(), F.regexp_replace("body", r"^\(\d+\)\s*", "")).when(F.col("b").isNotNull() | F.col("a").isNotNull(), F.regexp_replace("body", r"(?U)^\w+\)\s*", "")).otherwise(F.col("body"))

    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(own).alias("own")))), lambda x: x["own"]), "\n")
    tops = [F.first(c).alias(c) for c in ("head_line", "title", "section_name", "section_title", "lead")]
    units = rows.groupBy("doc_id", "article", "fikra", "bent", "alt_bent").agg(F.min("pos").alias("pos"), lines.alias("raw"), *tops)
    kind = F.upper(F.translate(F.regexp_extract("head_line", ARTICLE, 1), "iı", "İI"))
    kind = F.when(kind == "GEÇİCİ", "gecici").when(kind == "EK", "ek").otherwise("normal")
    num, given = F.regexp_extract("head_line", ARTICLE, 2), lambda c: F.nullif(c, F.lit(""))
    return units.withColumn("noted", with_notes(F.col("raw"))).select(
        "doc_id", "article", kind.alias("kind"), num.alias("num"), F.when(kind == "normal", num).otherwise(F.concat(kind, F.lit(":"), num)).alias("key"),
        given("title").alias("title"), given("section_name").alias("section"), given("section_title").alias("section_title"), "fikra", "bent", "alt_bent", "pos",
        collapse(F.col("noted.text")).alias("text"), "raw", "noted.notes", annotations(F.col("lead")).alias("article_notes"))


def annotation_refs(units: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, ref, sorted by ref within doc_id: the distinct gazette references of all notes but footnote marks, and of
    footnote definitions (notes: doc_id, footnotes), where a date and a number stand apart."""
    said = units.select("doc_id", F.explode(F.concat("notes", "article_notes")).alias("n")).where("n.type <> 'Dipnot'").select("doc_id", gazette_ref(F.col("n.source")).alias("ref"))
    line = F.regexp_replace("said", r"(\d{1,2}/\d{1,2}/\d{4})\s+tarihli\s+ve\s+(\d+)\s+(?:sayılı\s*)?", "$1-$2 ")
    each = F.regexp_extract_all(line, F.lit(r"\d{1,2}/\d{1,2}/\d{4}-\d+\s*(?:\(?\d*\.?\s*Mükerrer\)?)?"), F.lit(0))
    defined = notes.select("doc_id", F.explode("footnotes").alias("k", "said")).select("doc_id", F.explode(each).alias("r")).select("doc_id", gazette_ref(F.col("r")).alias("ref"))
    return said.unionByName(defined).where("ref is not null").distinct().sortWithinPartitions("doc_id", "ref")


def _marked() -> Column:
    alt = F.when(F.col("alt_bent").isNotNull(), F.concat(F.col("alt_bent").cast("string"), F.lit(")")))
    bent = F.when(F.col("bent").isNotNull(), F.concat("bent", F.lit(")")))
    fikra = F.when(F.col("fikra").isNotNull(), F.concat(F.lit("("), F.col("fikra").cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.coalesce(alt, bent, fikra), F.nullif("text", F.lit("")))


def article_rows(units: DataFrame) -> DataFrame:
    """doc_id, key, article, title, whole, parts: a row per article with its full text and parts, an array of (fikra, bent,
    alt_bent, full, notes) of its units in order. full is a unit's text with its descendants, markers for all but itself;
    the notes at the article's head go with every part. Where a key repeats, each article has its row.
    """
    held = F.array_sort(F.collect_list(F.struct("pos", "fikra", "bent", "alt_bent", "text", _marked().alias("marked"), "notes", "article_notes")))
    rows = units.groupBy("doc_id", "key", "article").agg(F.first("title", True).alias("title"), held.alias("held"))
    # a unit's descendants are the run after it; units that repeat a number stand apart and are looked for in all
    under = lambda u, v: (u["fikra"] == v["fikra"]) & (u["bent"].isNull() | ((u["bent"] == v["bent"]) & (u["alt_bent"].isNull() | (u["alt_bent"] == v["alt_bent"]))))
    joined = lambda first, rest: collapse(F.array_join(F.concat(first, F.transform(rest, lambda v: v["marked"])), " "))
    # a unit that shares its paragraph's number with none has no descendants
    shared = let(F.array_sort(F.transform("held", lambda v: v["fikra"])), lambda all_: F.filter(all_, lambda x, i: x == F.get(all_, i + 1)))
    alone = lambda u: u["fikra"].isNull() | ~F.array_contains(F.col("shared"), u["fikra"])
    rows = rows.withColumn("shared", shared)
    full = lambda u: F.when(u["alt_bent"].isNotNull() | alone(u), collapse(u["text"])).otherwise(joined(F.array(u["text"]), F.filter("held", lambda v: F.coalesce(under(u, v), F.lit(False)) & (v["pos"] != u["pos"]))))
    parts = F.transform("held", lambda u: F.struct(u["fikra"].alias("fikra"), u["bent"].alias("bent"), u["alt_bent"].alias("alt_bent"), full(u).alias("full"), F.concat(u["notes"], u["article_notes"]).alias("notes")))
    return rows.select("doc_id", "key", "article", "title", joined(F.array().cast("array<string>"), F.col("held")).alias("whole"), parts.alias("parts"))


def full_texts(units: DataFrame) -> DataFrame:
    """doc_id, key, article, fikra, bent, alt_bent, full: each article (all levels null) and each unit with its descendants."""
    rows = article_rows(units)
    own = F.array(F.struct(F.lit(None).cast("int").alias("fikra"), F.lit(None).cast("string").alias("bent"), F.lit(None).cast("int").alias("alt_bent"), F.col("whole").alias("full")))
    parts = F.transform(F.filter("parts", lambda u: u["fikra"].isNotNull()), lambda u: F.struct(u["fikra"].alias("fikra"), u["bent"].alias("bent"), u["alt_bent"].alias("alt_bent"), u["full"].alias("full")))
    return rows.select("doc_id", "key", "article", F.inline(F.concat(own, parts)))
