"""Personal data to format-preserving pseudonyms.

Numbers and dates are validated and then permuted by a keyed Feistel network over the values of their format: equal
values get equal pseudonyms in every document, different values different ones, and a pseudonym has the same format and
passes the same validation. Digits and separators stay as many and where they were. Addresses with @ get a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import let, text_or_empty

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<![\w.-])(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])"
ANY = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))
ROUNDS = 10
#: Years a date may have, and how often a permuted day that is no date is permuted again: 1 in 50 is none.
FIRST_YEAR, YEARS, WALKS = 1900, 200, 16
#: Serial numbers that are given out: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """struct<l, r>: (left, right) of Z_a x Z_b permuted; the round function is a keyed SHA-256."""

    def prf(k: Column, side: str, value: Column, modulus: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(tag), F.lit(side), k.cast("string"), a.cast("string"), b.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 15), 16, 10).cast("bigint"), modulus)

    def turn(s: Column, k: Column) -> Column:
        return let(F.pmod(s["l"] + prf(k, "l", s["r"], a), a), lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + prf(k, "r", x, b), b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A digit string to one of the same length; at most 18 digits."""
    n, power = F.char_length(digits), lambda k: F.element_at(F.array(*[F.lit(10**i) for i in range(10)]), k + 1)
    half = F.floor(n / 2).cast("int")
    cut = lambda h: feistel(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1), power(h), power(n - h), key, tag)
    return let(half, lambda h: let(cut(h), lambda s: F.concat(F.lpad(s["l"].cast("string"), h, F.lit("0")), F.lpad(s["r"].cast("string"), n - h, F.lit("0")))))


def luhn_total(payload: Column) -> Column:
    """Weighted digit sum of a number that lacks its check digit."""
    n = F.char_length(payload)

    def weigh(i: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, x: a + x)


def _payload(digits: Column) -> Column:
    return F.substr(digits, F.lit(1), F.char_length(digits) - 1)


def _check_digit(payload: Column) -> Column:
    return F.pmod(-luhn_total(payload), F.lit(10)).cast("string")


def fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by the digits given."""
    at = lambda i: F.char_length(F.regexp_replace(F.substr(template, F.lit(1), i), "[^0-9]", ""))
    char = lambda i: F.substr(template, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(template)), lambda i: F.when(char(i).rlike("[0-9]"), F.substr(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def _date_fields(m: Column) -> Column:
    """struct<d, m, y, first, months, days, form>: a date's numbers, the least day, how many months and days its form can
    show, and the form: ISO, day first, or, where that is no date, month first with a day above 12. Null if it is none."""
    three = lambda iso, x, y: F.when(m.contains("-"), F.regexp_extract(m, r"^(\d+)-(\d+)-(\d+)$", iso)).otherwise(F.regexp_extract(m, r"^(\d+)[/.](\d+)[/.](\d{4})$", x))
    a, b, y = three(3, 1, 1), three(2, 2, 2), three(1, 3, 3)
    there = lambda d, mo: F.try_make_timestamp(y.cast("int"), mo.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull()
    span = lambda x, most: F.when(F.char_length(x) == 1, 9).otherwise(most)
    known = y.cast("int").between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    fields = lambda d, mo, first, days, form: F.struct(d.cast("int").alias("d"), mo.cast("int").alias("m"), y.cast("int").alias("y"), F.lit(first).alias("first"), span(mo, 12).alias("months"), days.alias("days"), F.lit(form).alias("form"))
    day_first = F.when(m.contains("-"), fields(a, b, 1, F.lit(31), "iso")).otherwise(fields(a, b, 1, span(a, 31), "day"))
    return F.when(known & there(a, b), day_first).when(known & ~m.contains("-") & there(b, a), fields(b, a, 13, F.lit(19), "month"))


def _moved_date(m: Column, key: str) -> Column:
    """A date permuted among all dates that its form can show with as many digits."""

    def walk(f: Column) -> Column:
        tag = F.concat_ws(".", F.lit("date"), f["form"], f["days"].cast("string"), f["months"].cast("string"))
        side = f["days"] * f["months"]
        real = lambda s: F.try_make_timestamp((s["r"] + FIRST_YEAR).cast("int"), (s["l"] % f["months"] + 1).cast("int"), (F.floor(s["l"] / f["months"]) + f["first"]).cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull()
        start = F.struct(((f["d"] - f["first"]) * f["months"] + f["m"] - 1).cast("bigint").alias("l"), (f["y"] - FIRST_YEAR).cast("bigint").alias("r"), F.lit(False).alias("done"))
        again = lambda s: let(feistel(s["l"], s["r"], side, F.lit(YEARS), key, tag), lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), real(x).alias("done")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda s, _: F.when(s["done"], s).otherwise(again(s)))

    def shown(f: Column, s: Column) -> Column:
        pad = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
        d, mo = F.floor(s["l"] / f["months"]) + f["first"], s["l"] % f["months"] + 1
        year, wide = pad(s["r"] + FIRST_YEAR, 4), lambda n: F.when(n == 9, 1).otherwise(2)
        dd, mm = pad(d, F.when(f["first"] == 13, 2).otherwise(wide(f["days"]))), pad(mo, wide(f["months"]))
        return F.when(f["form"] == "iso", F.concat(year, mm, dd)).when(f["form"] == "day", F.concat(dd, mm, year)).otherwise(F.concat(mm, dd, year))

    return let(_date_fields(m), lambda f: let(walk(f), lambda s: F.when(s["done"], fill(m, shown(f, s))).otherwise(m)))


def _serial(digits: Column) -> Column:
    """struct<l, r>: a serial number as a place among those given out; null for one that is not."""
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, F.struct(((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1).cast("bigint").alias("l"), (serial - 1).cast("bigint").alias("r")))


def _moved_serial(digits: Column, key: str) -> Column:
    def shown(s: Column) -> Column:
        area = F.floor(s["l"] / GROUPS) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
        return F.concat(pad(area, 3), pad(s["l"] % GROUPS + 1, 2), pad(s["r"] + 1, 4))

    return let(_serial(digits), lambda s: let(feistel(s["l"], s["r"], F.lit(AREAS * GROUPS), F.lit(SERIALS), key, "ssn"), shown))


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its validation, else null.

    Octets are below 256; dates are in the calendar, from 1900 to 2099; serial numbers are among those given out; the ten
    digits of a phone number are not all the same; card numbers have the right check digit.
    """
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda x: x < 256), F.lit("ip")))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), F.when(_date_fields(m).isNotNull(), F.lit("date")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_serial(digits).isNotNull(), F.lit("ssn")))
        .when(m.rlike(r"^(\+\d{1,3}[ .-]?)?(\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}$"), F.when(~F.right(digits, F.lit(10)).rlike(r"^(\d)\1{9}$"), F.lit("phone")))
        .when(let(digits, lambda d: _check_digit(_payload(d)) == F.right(d, F.lit(1))), F.lit("card"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    email = let(hashed, lambda h: F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@"), F.lit("d"), F.substring(h, 13, 8), F.lit(".example")))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    side = F.lit(65536)
    ip = let(octets, lambda o: let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], side, side, key, "ip"), lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for v in (s["l"], s["r"]) for x in (F.floor(v / 256), v % 256)])))
    card = let(_payload(digits), lambda p: let(permute_digits(p, key, "card"), lambda x: F.concat(x, _check_digit(x))))
    again = lambda x: F.when(x.rlike(r"^(\d)\1{9}$"), permute_digits(x, key, "phone")).otherwise(x)
    tail = let(digits, lambda d: F.concat(F.substr(d, F.lit(1), F.char_length(d) - 10), let(permute_digits(F.right(d, F.lit(10)), key, "phone"), again)))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", _moved_date(m, key))
        .when(kind == "ssn", let(_moved_serial(digits, key), lambda d: fill(m, d)))
        .when(kind == "phone", let(tail, lambda d: fill(m, d))).when(kind == "card", let(card, lambda d: fill(m, d))).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """key: the secret of the permutations, the caller's to keep; without one there are no pseudonyms, but an error.

    doc_id, text with pseudonyms, spans array<struct<start, end, kind>> of what was replaced, in the old text.

    Matches are leftmost and do not overlap; those that fail validation stay. A null text stays null and an empty one
    empty, without spans. Rows repeat as they do in docs; a null doc_id is kept; other columns are ignored; no
    documents give no rows. Any text length: each match is handled once.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    t = docs.select("doc_id", F.col("text").alias("old"), text_or_empty().alias("t"))
    regex = F.lit(ANY)
    found = F.arrays_zip(F.split("t", ANY, -1).alias("gap"), F.regexp_extract_all("t", regex, F.lit(0)).alias("m"))
    marked = F.transform(found, lambda x: let(kind_of(x["m"]), lambda k: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), k.alias("kind"))))
    none = F.array().cast("array<struct<gap:string,m:string,kind:string>>")
    t = t.withColumn("found", F.when(F.col("t").rlike("[0-9@]"), marked).otherwise(none))

    def place(found: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.char_length(x["gap"])
            end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
            add = F.array(F.struct(start.alias("start"), end.alias("end"), x["kind"].alias("kind")))
            return F.struct(end.alias("at"), F.when(x["kind"].isNotNull(), F.concat(a["out"], add)).otherwise(a["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))
        return F.aggregate(found, zero, step, lambda a: a["out"])

    new = F.array_join(F.transform("found", lambda x: F.concat(x["gap"], F.coalesce(pseudonym(x["m"], x["kind"], key), F.lit("")))), "")
    hit = F.exists("found", lambda x: x["kind"].isNotNull())
    return t.select("doc_id", F.when(hit, new).otherwise(F.col("old")).alias("text"), place(F.col("found")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, joined.alias("spans"), "text")
