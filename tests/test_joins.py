"""Interval joins, overlaps, evidence and bounds against plain loops."""

import datetime
import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import evidence, grams, replay, similarity, verify

PLACE = "source string, e_type string, e_madde string, seq long, rec int, fikra int, bent string, alt_bent int"


def places(r, n):
    out = []
    for k in range(n):
        fikra, bent, alt = r.choice([None, 1, 2]), r.choice([None, "a", "b"]), r.choice([None, 1, 2])
        out.append((r.choice(["s", "t"]), "normal", r.choice(["1", "1", "1", "2"]), r.randrange(0, 900), k, fikra, bent, alt))
    return out


def test_later_counts_equal_all_pairs(spark):
    r = random.Random(3)
    rows, failing = places(r, 260), places(random.Random(4), 70)
    want = {}
    for a in failing:
        n = sum(b[:3] == a[:3] and b[3] > a[3] and all(x is None or y is None or x == y for x, y in zip(a[5:], b[5:], strict=True)) for b in rows)
        want[a[0], a[3], a[4]] = n
    make = lambda x: spark.createDataFrame(x, PLACE)
    got = {(x.source, x.seq, x.rec): x.later_count for x in verify.later_counts(make(failing), make(rows)).collect()}
    assert {k: got.get(k, 0) for k in want} == want
    assert verify.later_counts(make(failing), make([])).where("later_count > 0").isEmpty() and verify.later_counts(make([]), make(rows)).isEmpty()


def test_overlap_joins_on_equal_keys_only(spark):
    rows = spark.createDataFrame(places(random.Random(5), 20), PLACE)
    plan = verify.later_counts(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all(x.count("[") == 2 for x in joins)  # keys of either side, no condition after them


def test_a_hot_article_takes_many_tasks(spark):
    rows = spark.range(60_000).selectExpr("'s' AS source", "'normal' AS e_type", "'1' AS e_madde", "id AS seq", "0 AS rec", "IF(id % 3 = 0, NULL, int(id % 5)) AS fikra", "CAST(NULL AS STRING) AS bent", "CAST(NULL AS INT) AS alt_bent")
    found = verify.later_counts(rows.where("seq % 4 = 0"), rows)
    assert found.count() == 15_000
    last = found.where("seq = 59996").first()
    assert last.later_count == sum(1 for i in range(59997, 60000) if i % 3 == 0 or 59996 % 3 == 0 or i % 5 == 59996 % 5)


def test_articles_of_few_and_of_many_records_count_alike(spark, monkeypatch):
    rows = [*places(random.Random(8), 120), (None, "normal", "1", 5, 900, 1, None, None)]
    make = lambda x: spark.createDataFrame(x, PLACE)
    found = []
    for few in (0, 20, 1000):  # all by their forms, some, none
        monkeypatch.setattr(verify, "FEW", few)
        got = verify.later_counts(make(rows[::2]), make(rows)).collect()
        found.append({(x.source, x.seq, x.rec): x.later_count for x in got})
        assert len(found[-1]) == len(got) == 60
    assert found[0] == found[1] == found[2] and any(found[0].values()) and not all(found[0].values())


RECORD = "source string, madde_type string, madde string, seq long, rec int, new_text string, old_text string, anchor_text string, amending_article string"


def evidence_rows(r, n):
    words = ["kurumun yetkisi", "kurum", "yetkili kurul", "on beş gün", "otuz gündür", "kurumun yetkisi altında", "Kısa", "İLGİLİ KURUL"]
    some = lambda: " ".join(r.sample(words, r.randrange(1, 3))) if r.random() < 0.8 else None
    return [(r.choice(["s", "t"]), r.choice(["normal", None]), r.choice(["1", "2", None]), r.randrange(1, 40), k, some(), some(), some(), str(k % 3)) for k in range(n)]


def plain_evidence(rows, least=8):
    norm = lambda s: " ".join((s or "").replace("“", "").replace("”", "").split()).lower()
    out = {}
    for s, kind, madde, seq, rec, new, *_ in rows:
        best = None
        for s2, kind2, madde2, seq2, _, _, old, anchor, article in rows:
            if madde is None or (s, kind or "normal", madde) != (s2, kind2 or "normal", madde2) or seq2 <= seq:
                continue
            for field, q in enumerate((old, anchor)):
                a, b = norm(new), norm(q)
                if len(a) >= least and len(b) >= least and (a in b or b in a):
                    hit = (seq2, field, article, b)
                    best = hit if best is None or hit < best else best
        if best:
            out[s, seq, rec] = (best[0], best[2], best[3])
    return out


def test_evidence_equals_all_pairs(spark):
    rows = evidence_rows(random.Random(11), 160)
    found = evidence.quote_evidence(spark.createDataFrame(rows, RECORD).repartition(5))
    assert {(r.source, r.seq, r.rec): (r.later_seq, r.later_article, r.quoted) for r in found.collect()} == plain_evidence(rows)
    assert evidence.quote_evidence(spark.createDataFrame([], RECORD)).collect() == []


def test_evidence_of_articles_with_few_and_many_quotes(spark, monkeypatch):
    rows = evidence_rows(random.Random(12), 160)
    quoted = [sum(len(x or "") >= 8 for r in rows if r[:1] + r[2:3] == at for x in r[6:8]) for at in (("s", "1"), ("s", "2"), ("t", "1"), ("t", "2"))]
    monkeypatch.setattr(evidence, "FEW", sorted(quoted)[1])
    assert sorted(quoted)[1] < sorted(quoted)[2]  # some articles go one way, some the other
    found = evidence.quote_evidence(spark.createDataFrame(rows, RECORD).repartition(5))
    assert {(r.source, r.seq, r.rec): (r.later_seq, r.later_article, r.quoted) for r in found.collect()} == plain_evidence(rows)


def test_evidence_grows_with_the_article(spark):
    """One article whose records all differ, and as many that say the same: candidates stay as many as texts."""
    many = lambda n: spark.range(n).selectExpr("'s' AS source", "'normal' AS madde_type", "'1' AS madde", "id AS seq", "0 AS rec", "concat('tutar ', lpad(id + 1, 9, '0'), ' lira') AS new_text", "concat('tutar ', lpad(id, 9, '0'), ' lira') AS old_text", "'hep aynı çapa' AS anchor_text", "'1' AS amending_article")
    counted = {}
    for n in (2_000, 20_000):
        links = evidence.quote_links(many(n))
        new = many(n).selectExpr("source", "madde_type", "madde", "md5(binary(new_text)) AS id", "new_text AS text")
        counted[n] = grams.candidates(new, many(n).selectExpr("source", "madde_type", "madde", "md5(binary(old_text)) AS id", "old_text AS text"), evidence.PLACE).count()
        assert links.count() == n - 1
    print("candidate pairs:", counted)
    assert counted[20_000] < 12 * counted[2_000] and counted[20_000] < 60_000


def test_contained_texts(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab ") for _ in range(n))
    long = [(r.choice("gh"), f"l{k}", word(r.randrange(0, 40))) for k in range(60)] + [("g", "null", None)]
    short = [(r.choice("gh"), f"s{k}", word(r.randrange(0, 12))) for k in range(60)] + [("g", "none", None), ("g", "empty", "")]
    make = lambda x: spark.createDataFrame(x, "g string, id string, text string")
    want = sorted((a, i, j) for a, i, x in long for b, j, y in short if a == b and x is not None and y and y in x)
    assert sorted(map(tuple, grams.contained(make(long), make(short), ["g"]).collect())) == want
    assert grams.contained(make(long), make([]), ["g"]).collect() == [] == grams.contained(make([]), make(short), ["g"]).collect()


def test_bounds_settle_without_the_ratio(spark):
    r = random.Random(9)
    base = "Başvuru yazılı yapılır ve karar yirmi gün içinde ilgiliye bildirilir. " * 3
    edit = lambda s, n: "".join(c if r.random() > n else r.choice("abcçdeğ ") for c in s)
    pairs = [(k, base, edit(base, n)[: len(base) - cut]) for k, (n, cut) in enumerate(itertools.product((0, 0.002, 0.01, 0.1, 0.5), (0, 1, 5, 60)))] + [(100, None, "x"), (101, "", ""), (102, "x", ""), (103, base, base)]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    got = {x.k: x for x in similarity.ratios(df, "a", "b", 0.98).collect()}
    exact = {x.k: x for x in similarity.ratios(df, "a", "b").collect()}
    for k, a, b in pairs:
        want = None if a is None or b is None else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
        assert exact[k].ratio == want
        if want is not None:
            assert got[k].bound >= want - 1e-12
            assert (got[k].ratio == want) if want >= 0.98 or got[k].settled == "open" else got[k].settled == "below"
            assert ((got[k].ratio or 0) >= 0.98) == (want >= 0.98)
    native = sum(got[k].settled in ("same", "below") for k, a, b in pairs if a is not None)
    print("settled natively:", native, "of", len(pairs) - 1)
    assert native >= 15
    for v, phrases in (("yirmi gun", ["otuz gün", "yirmi gün", "yirmi güne"]), ("x", ["y"]), ("", ["a"])):
        norm = lambda s: " ".join(s.split()).lower()
        best, top = v, 0.5
        for q in phrases:
            n = difflib.SequenceMatcher(None, norm(v)[: len(norm(q)) + 10], norm(q)).ratio()
            if n > top or (n == top == 0.5 and best is v):
                best, top = q, n
        assert similarity.nearest(v, phrases, 0.5) == best


VERSION = f"source string, key string, pos double, steps array<{replay.STEP}>, units array<{replay.UNIT}>, titles array<struct<since:int,title:string>>"


def test_many_days_equal_single_days(spark):
    """Records whose days are out of order, equal or missing."""
    r, day = random.Random(6), datetime.date(2000, 1, 1)
    rows = []
    for k in range(12):
        n = r.randrange(0, 7)
        dates = [None if r.random() < 0.2 else day + datetime.timedelta(r.randrange(0, 2500)) for _ in range(n)]
        steps = [(i, i, 0, d, "x", "uygulandi") for i, d in enumerate(dates, 1)]
        units = []
        for f in range(1, 4):
            cuts = sorted(r.sample(range(1, n + 1), min(n, 2)))
            units += [(a, b, f, None, None, f"{f} {a}") for a, b in zip([0, *cuts], [*cuts, None], strict=True)]
        rows.append((f"s{k % 3}", str(k), 1.0, steps, units, []))
    versions = spark.createDataFrame(rows, VERSION).cache()
    days = [day + datetime.timedelta(x) for x in range(-400, 3000, 211)]
    want = sorted([(*tuple(x), str(d)) for d in days for x in replay.as_of(versions, d).collect()], key=str)
    asked = spark.createDataFrame([(f"s{k}", d, "own") for k in range(3) for d in days] + [("s0", None, ""), (None, day, ""), ("none", day, "")], "source string, day date, note string")
    for bucket in (1, 100, 100_000):
        got = replay.as_of_many(versions, asked, bucket)
        assert got.columns == ["source", "day", "note", "key", "fikra", "bent", "alt_bent", "text"]
        assert sorted([(x.source, x.key, x.fikra, x.bent, x.alt_bent, x.text, str(x.day)) for x in got.collect()], key=str) == want
    one = spark.createDataFrame([("s0", "0", day), ("s0", "0", day), ("s1", "0", day)], "source string, key string, day date")
    single = sorted([tuple(x) for x in replay.as_of(versions, day).where("source = 's0' and key = '0'").collect()], key=str)
    assert sorted([(x.source, x.key, x.fikra, x.bent, x.alt_bent, x.text) for x in replay.as_of_many(versions, one).collect()], key=str) == sorted(single * 2, key=str)
    assert replay.as_of_many(versions, asked.limit(0)).collect() == []


@pytest.mark.parametrize("text, want", [(None, None), ("aynı", True)])
def test_comparison_keeps_order_and_nulls(spark, text, want):
    of = lambda *x: spark.createDataFrame(list(x), "source string, key string, text string")
    got = replay.compare_articles(of(("s", "10", text), ("s", "gecici:1", "x"), ("s", "2", "y")), of(("s", "10", "aynı"), ("s", "2/A", "z")))
    assert [r.key for r in replay.in_order(got).collect()] == ["2", "10", "2/A", "gecici:1"]
    assert {r.key: r.durum for r in got.collect()}["10"] == ("ayni" if want else "bizde_yok")
    assert replay.compare_articles(of(), of()).where(F.lit(True)).collect() == []
