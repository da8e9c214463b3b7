"""Scalar text functions as native column expressions: Turkish case, normalisers, gazette references, markers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The Turkish lower-case alphabet, ordinal words, and canonical unit names with their prefixes.
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"
ONES = ["birinci", "ikinci", "üçüncü", "dördüncü", "beşinci", "altıncı", "yedinci", "sekizinci", "dokuzuncu"]
TENS = {10: ("onuncu", "on"), 20: ("yirminci", "yirmi"), 30: ("otuzuncu", "otuz")}
UNITS = [("alt bent", "alt_bent"), ("alt bend", "alt_bent"), ("geçici madde", "gecici_madde"), ("ek madde", "ek_madde"), ("madde", "madde"), ("fıkra", "fikra"), ("bent", "bent"), ("bend", "bent"), ("cümle", "cumle"), ("başlı", "baslik"), ("ibare", "ibare")]
ORDINALS = {w: i for i, w in enumerate(ONES, 1)} | {full: n for n, (full, _) in TENS.items()} | {f"{stem} {w}": n + i for n, (_, stem) in TENS.items() for i, w in enumerate(ONES, 1)}
#: What an amendment note says was done.
NOTE_HEADS = ("Değişik", "Ek", "Mülga", "İptal")
#: A footnote's number stands right after punctuation.
FOOTNOTE_MARK = r"(?<=[.,;:])\((\d{1,3})\)"


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def tr_lower_first(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return F.concat(F.lower(F.when(first == "I", "ı").when(first == "İ", "i").otherwise(first)), F.substr(c, F.lit(2)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


#: One of these stands in every text whose blanks are not single spaces, line feeds aside.
BLANKS = ("  ", "\t", "\x0b", "\f", "\r", "\xa0")


def single_blanks(c: Column, feeds: bool = False) -> Column:
    """A text with a single space for each run of white space, line feeds only if asked for. c stands in it several times:
    texts that have none of BLANKS stay as they are, which is found out without a pattern."""
    feed, odd = (r"\n", (*BLANKS, "\n")) if feeds else ("", BLANKS)
    one = F.regexp_replace(c, rf"[ \t{feed}\x0B\f\r\x{{A0}}]{{2,}}|[\t{feed}\x0B\f\r\x{{A0}}]", " ")
    return F.when(reduce(or_, [F.contains(c, F.lit(x)) for x in odd]), one).otherwise(c)


def gazette_norm(c: Column) -> Column:
    return collapse(tr_upper(c))


def verify_norm(c: Column) -> Column:
    """Quotes out, dashes alike, white space collapsed; null is empty."""
    return collapse(F.translate(F.coalesce(c, F.lit("")), "–—‐‑“”\"", "----"))


def plain_norm(c: Column) -> Column:
    return F.lower(collapse(c))


def _pieces(c: Column) -> Column:
    """A text cut before every opening and after every closing bracket: a bracket without brackets inside is one piece."""
    return F.filter(F.split(c, r"(?=\()|(?<=\))"), lambda p: p != "")


def let(value: Column, body) -> Column:
    """body of a value that is computed once: written out, it would stand in the plan as often as body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _note(piece: Column) -> Column:
    """struct<type, source> of a piece that is an amendment note, else null: in brackets, before the first colon words of
    which one of the first four says what was done and the few after it are in lower case, after it the source."""
    def of(x: Column) -> Column:
        good = F.forall(F.slice(x["said"], 1, x["at"]), lambda w: w.rlike(r"^\p{L}+$"))
        after = F.slice(x["said"], x["at"] + 2, F.greatest(F.size(x["said"]) - x["at"] - 1, F.lit(0)))
        good = good & let(after, lambda rest: (F.size(rest) <= 4) & F.forall(rest, lambda w: w.rlike(r"^\p{Ll}+$")))
        return F.when(x["at"].isNotNull() & good, F.struct(F.get(x["said"], x["at"]).alias("type"), x["source"].alias("source")))

    def placed(x: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(x["said"], i).isin(*NOTE_HEADS)))
        return let(F.struct(x["said"], x["source"], at.alias("at")), of)

    def cut(inside: Column) -> Column:
        said = F.filter(F.split(F.substring_index(inside, ":", 1), " "), lambda w: w != "")
        return F.struct(said.alias("said"), F.trim(F.substr(inside, F.call_function("instr", inside, F.lit(":")) + 1)).alias("source"))

    inside = F.regexp_replace(F.substr(piece, F.lit(2), F.char_length(piece) - 2), r"\s+", " ")
    is_one = piece.startswith("(") & piece.endswith(")") & F.contains(piece, F.lit(":"))
    return F.when(is_one, let(let(inside, cut), placed))


def _bracketed(c: Column) -> Column:
    """Whether a text may hold a note at all; most lines do not."""
    return F.contains(c, F.lit("(")) & F.contains(c, F.lit(":"))


def drop_notes(c: Column) -> Column:
    """A text with a space for each of its amendment notes."""
    kept = F.array_join(F.transform(_pieces(c), lambda p: F.when(_note(p).isNotNull(), F.lit(" ")).otherwise(p)), "")
    return F.when(_bracketed(c), kept).otherwise(c)


def leading_notes(c: Column) -> Column:
    """struct<lead, rest>: the amendment notes that a text begins with, and what follows them."""
    def cut(pieces: Column) -> Column:
        past = F.filter(F.transform(pieces, lambda p, i: F.when(_note(p).isNull() & (F.trim(p) != ""), i)), lambda i: i.isNotNull())
        return let(F.coalesce(F.get(past, F.lit(0)), F.size(pieces)), lambda n: F.struct(F.array_join(F.slice(pieces, 1, n), "").alias("lead"), F.ltrim(F.array_join(F.slice(pieces, n + 1, F.greatest(F.size(pieces) - n, F.lit(0))), "")).alias("rest")))

    return F.when(_bracketed(c) & F.ltrim(c).startswith("("), let(_pieces(c), cut)).otherwise(F.struct(F.lit("").alias("lead"), c.alias("rest")))


def version_norm(c: Column) -> Column:
    """Without amendment notes and without paragraph or footnote numbers."""
    return F.lower(collapse(F.regexp_replace(drop_notes(c), r"\(\d{1,2}\)", " ")))


def without_notes(c: Column) -> Column:
    return F.regexp_replace(drop_notes(c), FOOTNOTE_MARK, "")


def keyword_of(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"\([^)]*\)", "")), r"\s+(?:Yönetmeliği|Yönetmelik|Tebliği|Tebliğ)$", ""))


def gazette_ref(c: Column) -> Column:
    """struct<year, month, day, number, repeat> of the first d/m/yyyy-number; null without one."""
    ref = r"(\d{1,2})/(\d{1,2})/(\d{4})-(\d+)(?:\s*(?:\(?(\d+)\.\s*)?(Mükerrer))?"
    g = lambda i: F.regexp_extract(c, ref, i)
    repeat = F.when(g(5) != "", g(5).cast("int")).when(g(6) != "", 1).otherwise(0)
    return F.when(c.rlike(ref), F.struct(g(3).cast("int").alias("year"), g(2).cast("int").alias("month"), g(1).cast("int").alias("day"), g(4).alias("number"), repeat.alias("repeat")))


def gazette_label(ref: Column) -> Column:
    tail = F.when(ref["repeat"] > 0, F.concat(F.lit(" "), ref["repeat"].cast("string"), F.lit(". Mükerrer"))).otherwise("")
    return F.when(ref.isNotNull(), F.concat(F.concat_ws("/", ref["day"], ref["month"], ref["year"]), F.lit("-"), ref["number"], tail))


def index_path(ref: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.concat(ref["year"].cast("string"), two(ref["month"]), two(ref["day"]))
    return F.concat_ws("/", ref["year"].cast("string"), two(ref["month"]), F.concat(day, F.when(ref["repeat"] > 0, F.concat(F.lit("M"), ref["repeat"].cast("string"))).otherwise("")))


def day_of(c: Column) -> Column:
    return F.try_to_date(c, "d/M/yyyy")


def ordinal(c: Column) -> Column:
    """The number of an ordinal word from 1 to 39, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for p in sorted(ORDINALS.items()) for x in p]), collapse(F.lower(F.translate(c, "Iİ", "ıi"))))


#: Longest words first, for use in patterns.
ORDINAL = "|".join(sorted(ORDINALS, key=lambda w: (-len(w), w)))


def article_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+(?:/[A-ZÇĞİÖŞÜ])?)", 1), F.lit(""))


def unit_name(c: Column) -> Column:
    low, out = F.lower(F.translate(c, "Iİ", "ıi")), F.lit(None).cast("string")
    for prefix, name in reversed(UNITS):
        out = F.when(F.ltrim(low).startswith(prefix), name).otherwise(out)
    return out


def unit_name_of(noun: str) -> str | None:
    noun = " ".join(noun.split())
    return next((name for prefix, name in UNITS if noun.startswith(prefix)), None)


def clean_block(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^[“\"]|[”\"]$", ""), r"[ \t\x{A0}]+", " "))


def sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.:])\s+")


#: The phrases that open what is not the regulation's own text any more.
APPENDED = ("Eki için tıklayınız", "Yayımlandığı Resmî Gazete", "Yayımlandığı Resmi Gazete")


def strip_apparatus(c: Column) -> Column:
    """The text before the first rule of underscores at a line's start and before the annex link or publication table."""
    return F.regexp_replace(c, rf"(?mds)(?:^ *___|{'|'.join(APPENDED)}).*", "")


def letter_after(letter: str) -> str | None:
    """next_letter of one letter, for code that runs within a task."""
    at = ALPHABET.find(letter[0])
    return ALPHABET[at + 1] * len(letter) if 0 <= at < len(ALPHABET) - 1 else None


def next_letter(c: Column) -> Column:
    """The item letter after c (doubled letters move together); null after the last."""
    one = F.substring(c, 1, 1)
    at = F.call_function("instr", F.lit(ALPHABET), one)
    return F.when((at > 0) & (at < len(ALPHABET)), F.repeat(F.substr(F.lit(ALPHABET), at + 1, F.lit(1)), F.char_length(c)))


def is_tombstone(c: Column) -> Column:
    return c.rlike(r"(?s)^\s*(?:(?:GEÇİCİ|EK)\s+)?MADDE\s+\S+\s*[–-]\s*(?:\(\d+\)\s*)*(?:\(Mülga[^)]*\)\s*(?:\(\d+\)\s*)*)+$")


def annotations(c: Column) -> Column:
    """array<struct<type, source>> of the amendment notes of a text, then of its footnote marks (Dipnot, dipnot:k)."""
    notes = F.filter(F.transform(_pieces(c), _note), lambda x: x.isNotNull())
    notes = F.when(_bracketed(c), notes).otherwise(F.filter(F.array(F.lit(None).cast("struct<type:string,source:string>")), lambda x: x.isNotNull()))
    marks = F.transform(F.regexp_extract_all(c, F.lit(FOOTNOTE_MARK), F.lit(1)), lambda k: F.struct(F.lit("Dipnot").alias("type"), F.concat(F.lit("dipnot:"), k).alias("source")))
    return F.concat(notes, marks)


def with_notes(c: Column) -> Column:
    """struct<text, notes>: without_notes and annotations of a text, whose brackets are read once."""
    none = F.filter(F.array(F.lit(None).cast("struct<type:string,source:string>")), lambda x: x.isNotNull())
    marks = F.transform(F.regexp_extract_all(c, F.lit(FOOTNOTE_MARK), F.lit(1)), lambda k: F.struct(F.lit("Dipnot").alias("type"), F.concat(F.lit("dipnot:"), k).alias("source")))
    marks = F.when(F.contains(c, F.lit("(")), marks).otherwise(none)

    def of(x: Column) -> Column:
        kept = F.array_join(F.transform(x, lambda p: F.when(p["note"].isNotNull(), F.lit(" ")).otherwise(p["piece"])), "")
        notes = F.transform(F.filter(x, lambda p: p["note"].isNotNull()), lambda p: p["note"])
        return F.struct(F.regexp_replace(kept, FOOTNOTE_MARK, "").alias("text"), F.concat(notes, marks).alias("notes"))

    read = let(F.transform(_pieces(c), lambda p: F.struct(p.alias("piece"), _note(p).alias("note"))), of)
    plain = F.when(F.contains(c, F.lit("(")), F.regexp_replace(c, FOOTNOTE_MARK, "")).otherwise(c)
    return F.when(_bracketed(c), read).otherwise(F.struct(plain.alias("text"), marks.alias("notes")))


def rg_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9/]", "")


def paragraph_blocks(c: Column) -> Column:
    """array<string>: runs of lines from one '(n)' at a line's start to the next; what stands before the first goes."""
    return F.filter(F.split(c, r"(?m)\n?(?=^[ \t]*\(\d+\))"), lambda b: b.rlike(r"^[ \t]*\(\d+\)"))


def pick_item(c: Column, key: Column) -> Column:
    """Of a text with two item markers or more ('(n)', 'x)' or 'n)' at a line's start) the part under key; else the text."""
    parts = F.filter(F.split(c, r"(?m)\n?(?=^[ \t]*(?:\(\d+\)|[a-zçğıöşü]{1,3}\)|\d+\)))"), lambda b: b != "")
    marked = F.filter(parts, lambda b: b.rlike(r"^[ \t]*(?:\(\d+\)|[a-zçğıöşü]{1,3}\)|\d+\))"))
    mine = F.filter(marked, lambda b: F.regexp_extract(b, r"^[ \t]*\(?(\w+|[çğıöşü]+)\)", 1) == key)
    return F.when(F.size(marked) >= 2, F.coalesce(F.get(mine, F.lit(0)), c)).otherwise(c)


def _fields(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def _number(c: Column, least: int, most: int = 9) -> Column:
    """The digits that a field begins with, if they are so many; else null."""
    digits = F.regexp_extract(c, r"^\d+", 0)
    return F.when(F.char_length(digits).between(least, most), digits)


def _publication(fields: Column, at: Column) -> Column:
    """The gazette reference whose date is field at, its number the next one and its repeat after that; null if none is."""
    day, number = F.split(F.get(fields, at), "/"), _number(F.get(fields, at + 1), 4, 6)
    third, fourth = F.get(fields, at + 2), F.get(fields, at + 3)
    nth = F.regexp_extract(third, r"^(\d)\.?$", 1)
    repeat = F.when(third.startswith("Mükerrer"), 1).when(fourth.startswith("Mükerrer") & (nth != ""), nth.cast("int")).otherwise(0)
    part = lambda i: F.get(day, F.lit(i)).try_cast("int")
    good = (F.size(day) == 3) & part(0).isNotNull() & part(1).isNotNull() & part(2).between(1000, 9999) & number.isNotNull()
    return F.when(good, F.struct(part(2).alias("year"), part(1).alias("month"), part(0).alias("day"), number.alias("number"), F.coalesce(repeat, F.lit(0)).alias("repeat")))


#: What stands over both publication tables, and before it over that of the amendments.
TABLE, AMENDING = "Yayımlandığı Resmî Gazete", "Değişiklik Yapan"


def publication_table(c: Column) -> Column:
    """struct<first, amendments>: the first publication, and those of the amendments, whose rows count 1, 2, 3, ...

    A table is what follows its heading, read field by field wherever lines break. Reading of the amendments stops at the
    first row out of turn. Without a table, first is null and amendments empty.
    """
    kind = "struct<year:int,month:int,day:int,number:string,repeat:int>"
    plain = F.replace(F.replace(collapse(c), F.lit("Resmi"), F.lit("Resmî")), F.lit("Yayımlandıgı"), F.lit("Yayımlandığı"))
    fields_of = lambda later: lambda tables: F.coalesce(F.get(F.filter(tables, lambda x: x["later"] if later else ~x["later"]), F.lit(0))["f"], F.array().cast("array<string>"))

    def tables_of(parts: Column) -> Column:
        amends = lambda i: F.contains(F.substring_index(F.get(parts, i - 1), ".", -1), F.lit(AMENDING))
        return F.filter(F.transform(parts, lambda x, i: F.when(i > 0, F.struct(amends(i).alias("later"), _fields(x).alias("f")))), lambda x: x.isNotNull())

    def first_of(fields: Column) -> Column:
        return F.get(F.filter(F.transform(fields, lambda _, i: _publication(fields, i)), lambda x: x.isNotNull()), F.lit(0))

    def rows_of(fields: Column) -> Column:
        number = lambda x: F.regexp_extract(x, r"^(\d{1,3})\.$", 1).try_cast("int")
        rows = F.transform(fields, lambda x, i: F.when(x.endswith("."), F.struct(number(x).alias("n"), _publication(fields, i + 1).alias("ref"))))
        return F.filter(rows, lambda x: x["n"].isNotNull() & x["ref"].isNotNull())

    def in_turn(rows: Column) -> Column:
        bad = F.filter(F.transform(rows, lambda x, i: F.when(x["n"] != i + 1, i)), lambda i: i.isNotNull())
        return F.transform(F.slice(rows, 1, F.coalesce(F.get(bad, F.lit(0)), F.size(rows))), lambda x: x["ref"])

    def read(tables: Column) -> Column:
        later = let(let(let(tables, fields_of(True)), rows_of), in_turn)
        return F.struct(let(let(tables, fields_of(False)), first_of).cast(kind).alias("first"), F.coalesce(later, F.array()).cast(f"array<{kind}>").alias("amendments"))

    return let(let(F.split(plain, TABLE), tables_of), read)


def _issue_number(c: Column, least: int, most: int, alone: bool) -> Column:
    """The number between 'tarihli ve' and 'sayılı', or, where it may stand alone, after 'sayı'."""
    def of(fields: Column) -> Column:
        is_ = lambda i, w: F.coalesce(F.get(fields, i) == w, F.lit(False))
        dated = lambda i: is_(i - 2, "tarihli") & is_(i - 1, "ve") & F.coalesce(F.get(fields, i + 1).startswith("sayılı"), F.lit(False))
        fits = lambda i: dated(i) | is_(i - 1, "sayı") if alone else dated(i)
        return F.get(F.filter(F.transform(fields, lambda x, i: F.when(fits(i), _number(x, least, most))), lambda x: x.isNotNull()), F.lit(0))

    return let(_fields(F.lower(F.translate(F.replace(F.regexp_replace(c, "<[^>]*>", " "), F.lit(":"), F.lit(" ")), "Iİ", "ıi"))), of)


def issue_number_of_index(c: Column) -> Column:
    """The number of five digits or more in the head of an index page."""
    return _issue_number(c, 5, 99, True)


def issue_number_of_page(html: Column, head: int = 8000) -> Column:
    """The issue number that the first characters of a page, tags aside, give."""
    return _issue_number(F.substring(html, 1, head), 4, 6, False)


def diff_sentences(c: Column) -> Column:
    """Sentences for a side-by-side view: a paragraph mark opens a line, and so does a word that begins with a capital, a
    quote or a bracket after one that ends with . : or ;"""
    def joined(said: Column) -> Column:
        ends = lambda i: F.coalesce(F.right(F.get(said, i - 1), F.lit(1)).isin(".", ":", ";"), F.lit(False))
        opens = lambda w: F.left(w, F.lit(1)).isin('"', "“", "(") | (F.left(w, F.lit(1)) != F.lower(F.left(w, F.lit(1))))
        return F.array_join(F.transform(said, lambda w, i: F.concat(F.when(w.rlike(r"^\(\d{1,2}\)$") | (ends(i) & opens(w)), "\n").otherwise(" "), w)), "")

    lines = let(_fields(c), joined)
    return F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def tidy(c: Column) -> Column:
    c = F.regexp_replace(F.translate(c, " ​‌‍﻿­", " "), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n(?:[ \t]*\n){2,}", "\n\n"), r"^\s+|\s+$", ""))


def oran(good: Column, *others: Column) -> Column:
    """good / (good + others), null where nothing can be checked."""
    total = good
    for o in others:
        total = total + o
    return good / F.nullif(total, F.lit(0))


#: The names of F.expr bodies: tr_upper, norm_text, rg_ref, quality_label.
SQL_FUNCTIONS = {
    "tr_upper": "(x STRING) RETURNS STRING RETURN upper(translate(x, 'iı', 'İI'))",
    "norm_text": "(x STRING) RETURNS STRING RETURN lower(trim(regexp_replace(x, '[\\\\s\\\\x{A0}]+', ' ')))",
    "rg_ref": r"""(x STRING) RETURNS STRUCT<year: INT, month: INT, day: INT, number: STRING, repeat: INT> RETURN
      CASE WHEN regexp_like(x, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}-[0-9]+') THEN named_struct(
        'year', int(regexp_extract(x, '[0-9]{1,2}/[0-9]{1,2}/([0-9]{4})-[0-9]+', 1)), 'month', int(regexp_extract(x, '[0-9]{1,2}/([0-9]{1,2})/[0-9]{4}-[0-9]+', 1)),
        'day', int(regexp_extract(x, '([0-9]{1,2})/[0-9]{1,2}/[0-9]{4}-[0-9]+', 1)), 'number', regexp_extract(x, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}-([0-9]+)', 1),
        'repeat', CASE WHEN regexp_like(x, '-[0-9]+ *[(]?[0-9]+[.] *Mükerrer') THEN int(regexp_extract(x, '-[0-9]+ *[(]?([0-9]+)[.] *Mükerrer', 1))
                       WHEN regexp_like(x, '-[0-9]+ *[(]?Mükerrer') THEN 1 ELSE 0 END) END""",
    "quality_label": "(statuses ARRAY<STRING>, said STRING) RETURNS STRING RETURN CASE WHEN size(statuses) = 0 THEN CASE WHEN regexp_like(said, '(?i)(yürürlüğe girer|hükümlerini .* yürütür)') THEN 'kayitsiz' ELSE 'supheli' END WHEN forall(statuses, s -> s = 'uyumlu') THEN 'dogrulanmis' WHEN forall(statuses, s -> s IN ('uyumlu', 'sonradan_degisti', 'kontrol_edilemedi')) THEN 'kismen' ELSE 'sorunlu' END",
}


def register(spark: SparkSession) -> None:
    """The SQL face of these functions, as temporary functions of the session; seq_ratio is an Arrow function, parse_units
    a table function."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    from lexstrata.operators.replay import seq_ratio

    from lexstrata.operators import table_function

    spark.udf.register("seq_ratio", seq_ratio)
    table_function.register(spark)
