import hashlib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexstrata.llm import pii, url_filter
from lexstrata.llm.common import read

KEY = "pii-key-1"


def prf(tag, side, k, a, b, value, modulus):
    said = "|".join(map(str, (KEY, tag, side, k, a, b, value)))
    return int(hashlib.sha256(said.encode()).hexdigest()[:15], 16) % modulus


def feistel(left, right, a, b, tag):
    for k in range(1, pii.ROUNDS + 1):
        left = (left + prf(tag, "l", k, a, b, right, a)) % a
        right = (right + prf(tag, "r", k, a, b, left, b)) % b
    return left, right


def digits(d, tag):
    h = len(d) // 2
    left, right = feistel(int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h), tag)
    return f"{left:0{h}d}{right:0{len(d) - h}d}"



def check(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def is_date(y, mo, da):
    try:
        return date(y, mo, da).year in range(1900, 2100)
    except ValueError:
        return False


def moved_date(m):
    x = re.split("[-/.]", m)
    iso = "-" in m
    a, b, y = (x[2], x[1], x[0]) if iso else x
    if is_date(int(y), int(b), int(a)):
        da, mo, first, days, form = a, b, 1, 31 if iso or len(a) == 2 else 9, "iso" if iso else "day"
    elif not iso and is_date(int(y), int(a), int(b)):
        da, mo, first, days, form = b, a, 13, 19, "month"
    else:
        return m
    months = 9 if len(mo) == 1 else 12
    left, right = (int(da) - first) * months + int(mo) - 1, int(y) - 1900
    for _ in range(pii.WALKS):
        left, right = feistel(left, right, days * months, 200, f"date.{form}.{days}.{months}")
        out = (1900 + right, left % months + 1, left // months + first)
        if is_date(*out):
            da, mo = f"{out[2]:0{len(da)}d}", f"{out[1]:0{len(mo)}d}"
            new = {"iso": (str(out[0]), mo, da), "day": (da, mo, str(out[0])), "month": (mo, da, str(out[0]))}[form]
            return new[0] + m[len(x[0])] + new[1] + m[len(x[0])] + new[2] if iso else new[0] + re.findall("[/.]", m)[0] + new[1] + re.findall("[/.]", m)[1] + new[2]
    return m


def replace(m):
    d = re.sub(r"\D", "", m)
    refill = lambda new: re.sub(r"\d", lambda _, it=iter(new): next(it), m)
    if "@" in m:
        h = hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()
        return f"u{h[:12]}@d{h[12:20]}.example"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d?[/.]\d\d?[/.]\d{4}", m):
        return moved_date(m)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return m
        left, right = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        area = left // 99 + 1
        return refill(f"{area + (area >= 666):03d}{left % 99 + 1:02d}{right + 1:04d}")
    if re.fullmatch(r"(\+\d{1,3}[ .-]?)?(\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}", m):
        return m if len(set(d[-10:])) == 1 else refill(d[:-10] + digits(d[-10:], "phone"))
    if check(d[:-1]) == d[-1]:
        p = digits(d[:-1], "card")
        return refill(p + check(p))
    return m


ANY = re.compile(pii.ANY, re.A)


def test_against_plain_version(spark):
    rng = random.Random(2)
    card = lambda n: (p := "".join(rng.choice("0123456789") for _ in range(n - 1))) + check(p)
    made = []
    for i in range(400):
        c = card(rng.choice((13, 15, 16, 19)))
        y, mo, da = rng.randrange(1900, 2100), rng.randrange(1, 14), rng.randrange(1, 32)
        some = [c, c[:-1] + str((int(c[-1]) + 1) % 10), f"{y}-{mo:02d}-{da:02d}", f"{da}/{mo}/{y}", f"{da:02d}.{mo:02d}.{y}", f"{mo}/{da}/{y}", f"{mo:02d}/{da:02d}/{y}", "000-12-3456", "666-12-3456", "123-00-4567", "(555) 555-5555", f"+1 ({i % 1000:03d}) 555-{i:04d}", f"{i:03d}-{i % 90 + 10}-{i:04d}", "10.0.0." + str(i), f"a.b{i}@x-{i}.example.com.", f"x@{'a.' * 300}b", " ".join(re.findall(".{4}", card(16))), "3.14", "v1.2.3.4.5", "12345678901234567890"]
        rng.shuffle(some)
        made.append((i, rng.choice([" ", ", ", "\n", "é "]).join(some)))
    made += [(1000, None), (1001, ""), (None, "1.2.3.4"), (1002, "7" * 50_000), (1003, "1.2.3.4 " * 2000), (1003, "1.2.3.4 " * 2000)]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumn("spans", F.col("text"))
    docs = docs.unionByName(read(spark, "/root/testdata/sf0.001", "documents").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("x").alias("spans")))
    want = sorted(((r.doc_id, None if r.text is None else ANY.sub(lambda m: replace(m[0]), r.text)) for r in docs.collect()), key=str)
    got = pii.pseudonymise(docs, KEY).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    old = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert all(ANY.search(old[r.doc_id][s.start : s.end]) for s in r.spans)
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(docs, "")


def test_permutations_are_bijections(spark):
    n = spark.range(10_000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), KEY, "t").alias("x"))
    assert n.distinct().count() == 10_000 and n.where("length(x) <> 4").count() == 0
    for side, years in ((31 * 12, 200), (81, 200)):
        d = spark.range(side * years).select(pii.feistel(F.floor(F.col("id") / years), F.col("id") % years, F.lit(side), F.lit(years), KEY, "date").alias("s")).selectExpr(f"s.l * {years} + s.r AS x")
        assert d.distinct().count() == side * years and d.agg(F.min("x"), F.max("x")).first() == (0, side * years - 1)


def test_dates_and_serials_keep_their_form(spark):
    """Every date of a form goes to another of that form, none twice; serial numbers likewise."""
    days = [(y, mo, da) for y in (1999, 2000) for mo in range(1, 13) for da in range(1, 32) if is_date(y, mo, da)]
    forms = {"iso": "{0}-{1:02d}-{2:02d}", "short": "{2}/{1}/{0}", "long": "{2:02d}.{1:02d}.{0}", "month": "{1}/{2}/{0}"}
    rows = [(f, form.format(*d)) for f, form in forms.items() for d in days if f != "month" or d[2] > 12]
    rows += [("ssn", f"{a:03d}-{g:02d}-{n:04d}") for a in (1, 665, 667, 899) for g in (1, 99) for n in (1, 9999)]
    got = pii.pseudonymise(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), KEY).collect()
    new = {r.doc_id: r.text for r in got}
    shape = lambda t: re.sub(r"\d", "9", t)
    assert all(len(r.spans) == 1 and shape(r.text) == shape(rows[r.doc_id][1]) for r in got)
    assert len(set(new.values())) == len({t for _, t in rows})
    again = pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in new.items()], "doc_id long, text string"), KEY).collect()
    kind = {r.doc_id: r.spans[0].kind for r in got}
    assert all(len(r.spans) == 1 and r.spans[0].kind == kind[r.doc_id] for r in again)


def plain(url):
    m = re.search(r"://(?s:([^/?#]*)([^?#]*))", url or "") if url and "://" in url else None
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    if (host, path) == ("", ""):
        return host, path, None, "allow"
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    own = any(f".{x}." in "." + host for x in url_filter.OWN_HOSTS) or any(x in path for x in url_filter.OWN_PATHS) or path.endswith(tuple("." + x for x in url_filter.OWN_ENDINGS))
    return host, path, None, "block" if own else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.org", "http://example.org/", "http://a.example.org/es/x", "http://notexample.org/es/", "https://x.org/en/1", "https://example.org/en/12#a", "ftp://a.com/fr/b",
    "http://a.com/de/?q=/fr/", "http://com/de/x", "http://xcom/de/x", "http://ads.x.net/a", "http://x.net/a/login", "http://x.net/a.pdf", "http://x.net/a.pdf?b", "http://x.net/a.pdfs", "http://ü.net/é/tag/ü", "http://x.net?://y.org/",
    "http://org/", "http://.org/x", "http://a.org:80/", "//a.org/", "http://x.net/" + "a" * 5000 + "/cart/", "http://x.net/feed/*", "http://*.net/x", "http://x.net/a\n.zip",
]


def test_urls(spark):
    urls = URLS + [r.url for r in read(spark, "/root/testdata/sf0.001", "pages").collect()]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.org/", "h"), (0, None, "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id]), urls[r.page_id]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_long_urls_and_large_ids(spark):
    """A URL of a megabyte neither widens the block of the short ones nor is cut; ids beyond 2**53 survive beside nulls."""
    big = 2**53 + 1
    rows = [(big + i, f"http://x{i}.net/a") for i in range(4_095)] + [(None, "http://org/"), (7, "http://x.net/" + "é" * 500_000 + "/cart/x"), (8, "http://" + "a" * 1_000_000 + ".ads.net/")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string").coalesce(1)).collect()
    by = {r.page_id: r for r in got}
    assert set(by) == {i for i, _ in rows} and len(got) == len(rows)
    assert by[7].verdict == by[8].verdict == "block" and len(by[7].path) == 500_008 and by[big].verdict == "allow" and by[None].rule == "org/"


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_globs(seed):
    import numpy as np

    rng = random.Random(seed)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randrange(0, 7))) for _ in range(40)]
    rules = [url_filter.UrlRule("block", "*", g) for g in globs]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    codes = [[ord("."), url_filter.BORDER, *t.encode()] for t in texts]
    wide = np.zeros((len(codes), max(map(len, codes))), np.int16)
    for i, c in enumerate(codes):
        wide[i, : len(c)] = c
    fits = url_filter.Automaton(rules).fits(wide, np.array(list(map(len, codes))))
    for i, t in enumerate(texts):
        assert fits[i].tolist() == [bool(re.fullmatch(g.replace("*", ".*"), t)) for g in globs]
        assert url_filter.Automaton(rules).fits_one(np.array(codes[i])).tolist() == fits[i].tolist()
