import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lexstrata.functions import text as t
from lexstrata.operators import evaluate, replay, structure, verify
from lexstrata.operators.extract import extract_amendments
from lexstrata.plans import queries as plans

CONSOLIDATED = """DENEME YÖNETMELİĞİ
BİRİNCİ BÖLÜM
Genel Hükümler
Amaç
MADDE 1 – (1) Bu Yönetmeliğin amacı yeni usulleri belirlemektir.
a) Birinci bent
b) İkinci bent
Kapsam
MADDE 2 – (1) Kapsam on iki kuruluştur. (Değişik:RG-3/4/2020-31088)"""
AMENDING = """DENEME YÖNETMELİĞİNDE DEĞİŞİKLİK YAPILMASINA DAİR YÖNETMELİK
MADDE 1 – 1/1/2010 tarihli Resmî Gazete’de yayımlanan Deneme Yönetmeliğinin 1 inci maddesinin birinci fıkrasında yer alan “eski” ibaresi “yeni” şeklinde değiştirilmiştir.
MADDE 2 – Aynı Yönetmeliğin 2 nci maddesinin birinci fıkrasında yer alan “on” ibaresi “yirmi” şeklinde değiştirilmiştir.
MADDE 3 – Aynı Yönetmeliğin 9 uncu maddesinin birinci fıkrasında yer alan “bir” ibaresi “iki” şeklinde değiştirilmiştir.
MADDE 4 – Bu Yönetmelik yayımı tarihinde yürürlüğe girer."""
@pytest.fixture(scope="module")
def units(spark):
    return structure.parse_units(spark.createDataFrame([("s", CONSOLIDATED), ("none", None), ("empty", "")], "doc_id string, text string"))


@pytest.fixture(scope="module")
def records(spark):
    docs = spark.createDataFrame([("d", AMENDING)], "doc_id string, text string")
    seq = F.col("article").cast("bigint")
    return extract_amendments(docs).withColumn("source", F.lit("s")).withColumn("seq", seq).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), seq.cast("int")))


def plain(rows):
    return sorted((tuple(str(v) for _, v in sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "conversations", "pages", "benchmark", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    got = plain(r.asDict() for r in plans.QUERIES[name](spark, sf_dir).collect())
    assert got and got == plain(dict(zip(names, r, strict=True)) for r in found.fetchall())


def test_parse(units):
    got = {(r.key, r.fikra, r.bent): r for r in units.collect()}
    assert set(got) == {("1", 1, None), ("1", 1, "a"), ("1", 1, "b"), ("2", 1, None)}
    assert got["1", 1, None].title == "Amaç" and got["2", 1, None].title == "Kapsam"
    assert got["1", 1, "b"].text == "İkinci bent" and got["1", 1, None].section == "BİRİNCİ BÖLÜM"
    assert [tuple(n) for n in got["2", 1, None].notes] == [("Değişik", "RG-3/4/2020-31088")]


def test_extract_and_verify(units, records):
    rows = sorted(records.collect(), key=lambda r: r.seq)
    assert [(r.madde, r.fikra, r.operation, r.old_text, r.new_text) for r in rows] == [("1", 1, "IBARE_DEGISTIR", "eski", "yeni"), ("2", 1, "IBARE_DEGISTIR", "on", "yirmi"), ("9", 1, "IBARE_DEGISTIR", "bir", "iki")]
    got = verify.verify(records, units)
    assert {r.seq: r.status for r in got.collect()} == {1: "uyumlu", 2: "uyumsuz", 3: "hedef_bulunamadi"}
    later = got.where("seq = 2").unionByName(got.where("seq = 2").withColumn("seq", F.lit(5).cast("bigint")).withColumn("status", F.lit("uyumlu")))
    assert {r.seq: r.status for r in verify.excuse_later(later).collect()} == {2: "sonradan_degisti", 5: "uyumlu"}
    total = [r for r in verify.summary(got).collect() if r.source is None][0]
    assert (total.records, total.uyumlu, round(total.oran, 3)) == (3, 1, 0.333)


def test_replay_as_of(units, records):
    old = units.withColumn("text", F.replace("text", F.lit("yeni"), F.lit("eski")))
    old = old.withColumn("raw", F.col("text"))
    versions = replay.replay(old, records)
    for day, word in ((datetime.date(2020, 1, 1), "eski"), (datetime.date(2020, 1, 2), "yeni"), (datetime.date(2021, 1, 1), "yeni")):
        assert word in replay.as_of(versions, day).where("key = '1' and bent is null").first().text


def test_compare(spark):
    of = lambda rows: spark.createDataFrame(rows, "source string, key string, text string")
    ours, official = of([("s", "1", "aynı metin"), ("s", "2", "bir metin"), ("s", "3", "yalnız")]), of([("s", "1", "Aynı  Metin"), ("s", "2", "bambaşka sözler"), ("s", "4", "onlarda"), ("s", "5", "MADDE 5 – (Mülga:RG-1/1/2020-1)")])
    assert {r.key: r.durum for r in replay.compare_articles(ours, official).collect()} == {"1": "ayni", "2": "farkli", "3": "resmide_yok", "4": "bizde_yok", "5": "mulga_mezari"}


def test_text_functions(spark):
    row = spark.createDataFrame([("ilişki ısı", "z", "zz", "otuz dokuzuncu", "(Ek:RG-5/6/2019-30794 2. Mükerrer)")], "a string, b string, c string, d string, e string")
    got = row.select(t.tr_upper(F.col("a")), t.next_letter(F.col("b")), t.next_letter(F.lit("hh")), t.ordinal(F.col("d")), t.gazette_label(t.gazette_ref(F.col("e")))).first()
    assert tuple(got) == ("İLİŞKİ ISI", None, "ıı", 39, "5/6/2019-30794 2. Mükerrer")


def test_quality_labels(spark):
    rows = spark.createDataFrame([(["uyumlu"], "x"), (["uyumlu", "sonradan_degisti"], "x"), (["uyumsuz"], "x"), ([], "Bu Yönetmelik yürürlüğe girer."), ([], "x")], "s array<string>, x string")
    assert [r[0] for r in rows.select(evaluate.quality_label(F.col("s"), F.col("x"))).collect()] == ["dogrulanmis", "kismen", "sorunlu", "kayitsiz", "supheli"]


def test_article_records_compare_whole_texts(spark, units):
    long = "MADDE 2 – (1) Kapsam on iki kuruluştur."
    rows = [
        (1, "BIRIM_EKLE", "madde", "2", long, "uyumlu"),
        (2, "BIRIM_EKLE", "madde", "2", long + " Fazla.", "uyumsuz"),
        (3, "BIRIM_EKLE", "maddeler", "2", long + "\nMADDE 7 – (1) Yok.", "hedef_bulunamadi"),
        (4, "BIRIM_EKLE", "madde", "2", "Kapsam on iki", "kontrol_edilemedi"),
        (5, "BIRIM_EKLE", "fikra", "2", "(1) Kapsam on iki", "uyumlu"),
        (6, "BIRIM_EKLE", "gecici_madde", "1", "GEÇİCİ MADDE 1 – (1) Yok.", "hedef_bulunamadi"),
        (7, "BIRIM_DEGISTIR", "madde", "2", long, "uyumlu"),
        (8, "BIRIM_DEGISTIR", "madde", "2", long + " Fazla.", "uyumsuz"),
        (9, "BIRIM_DEGISTIR", "madde", "2", "Kapsam on iki kuruluştur.", "kontrol_edilemedi"),
        (10, "BIRIM_DEGISTIR", "madde", "9", long, "hedef_bulunamadi"),
        (11, "BIRIM_EKLE", "madde", "2", None, "kontrol_edilemedi"),
    ]
    kinds = "seq long, operation string, unit string, madde string, new_text string, want string, source string, madde_type string, fikra int, bent string, alt_bent int, cumle string, old_text string"
    records = spark.createDataFrame([(*r, "s", "normal", None, None, None, None, None) for r in rows], kinds)
    got = verify.verify(records, units).collect()
    assert {r.seq: r.status for r in got} == {r[0]: r[5] for r in rows}
