"""Replay of records on an article's units, and what is built on it, in our own words."""

import datetime

import pytest

from lexstrata.operators import replay, structure
from lexstrata.operators.extract import extract_amendments
from pyspark.sql import functions as F

TEXT = """DENEME YÖNETMELİĞİ
Tanımlar
MADDE 1 – (1) Burada geçen;
a) Kurum: Denetim kurumunu,
b) Kurul: Denetim kurulunu,
ç) Kanun: İlgili kanunu,
ifade eder.
Süre
MADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.
(2) Karar yirmi günde verilir.
(3) Karar bildirilir.
MADDE 3 – Tek söz.
GEÇİCİ MADDE 1 – (1) Geçicidir.
İKİNCİ BÖLÜM
Son Hükümler
MADDE 4 – (1) Yürürlük."""
HEAD = "BAŞLIK\nMADDE 1 – 1/1/2000 tarihli ve 24000 sayılı Resmî Gazete’de yayımlanan Deneme Yönetmeliğin "
CASES = {
    "phrase": ("2 nci maddesinin ikinci fıkrasında yer alan “yirmi” ibaresi “otuz” şeklinde değiştirilmiştir.", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar otuz günde verilir.\n(3) Karar bildirilir."}),
    "phrase elsewhere": ("2 nci maddesinin üçüncü fıkrasında yer alan “yirmi” ibaresi “otuz” şeklinde değiştirilmiştir.", ["metin_bulunamadi"], {}),
    "before an anchor": ("2 nci maddesinin üçüncü fıkrasında yer alan “bildirilir” ibaresinden önce gelmek üzere “ilgiliye” ibaresi eklenmiştir.", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Karar ilgiliye bildirilir."}),
    "phrase gone": ("2 nci maddesinin birinci fıkrasında yer alan “yazılı ” ibaresi yürürlükten kaldırılmıştır.", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Karar bildirilir."}),
    "second sentence": ("2 nci maddesinin birinci fıkrasının ikinci cümlesi aşağıdaki şekilde değiştirilmiştir.\n“Süre bir aydır.”", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre bir aydır. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Karar bildirilir."}),
    "a sentence that is not there": ("2 nci maddesinin birinci fıkrasının beşinci cümlesi aşağıdaki şekilde değiştirilmiştir.\n“Yok.”", ["hedef_bulunamadi"], {}),
    "a sentence repealed": ("2 nci maddesinin birinci fıkrasının üçüncü cümlesi yürürlükten kaldırılmıştır.", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür.\n(2) Karar yirmi günde verilir.\n(3) Karar bildirilir."}),
    "paragraph replaced": ("2 nci maddesinin ikinci fıkrası aşağıdaki şekilde değiştirilmiştir.\n“(2) Karar;\na) Yazılı,\nb) Gerekçeli olur.”", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar;\na) Yazılı,\nb) Gerekçeli olur.\n(3) Karar bildirilir."}),
    "a paragraph that is not there": ("2 nci maddesinin sekizinci fıkrası aşağıdaki şekilde değiştirilmiştir.\n“(8) Yok.”", ["hedef_bulunamadi"], {}),
    "item keeps the closing words": ("1 inci maddesinin birinci fıkrasının (ç) bendi aşağıdaki şekilde değiştirilmiştir.\n“ç) Kanun: Yeni kanunu,”", ["uygulandi"], {"1": "Tanımlar\nMADDE 1 – (1) Burada geçen;\na) Kurum: Denetim kurumunu,\nb) Kurul: Denetim kurulunu,\nç) Kanun: Yeni kanunu,\nifade eder."}),
    "items move on": ("1 inci maddesinin birinci fıkrasına (a) bendinden sonra gelmek üzere aşağıdaki bent eklenmiş ve diğer bentler buna göre teselsül ettirilmiştir.\n“b) Kurucu: Kuran kişiyi,”", ["uygulandi"], {"1": "Tanımlar\nMADDE 1 – (1) Burada geçen;\na) Kurum: Denetim kurumunu,\nb) Kurucu: Kuran kişiyi,\nc) Kurul: Denetim kurulunu,\nç) Kanun: İlgili kanunu,\nifade eder."}),
    "item at the end": ("1 inci maddesinin birinci fıkrasına aşağıdaki bent eklenmiştir.\n“d) Kişi: Gerçek kişiyi,”", ["uygulandi"], {"1": "Tanımlar\nMADDE 1 – (1) Burada geçen;\na) Kurum: Denetim kurumunu,\nb) Kurul: Denetim kurulunu,\nç) Kanun: İlgili kanunu,\nd) Kişi: Gerçek kişiyi,\nifade eder."}),
    "sub-items": ("1 inci maddesinin birinci fıkrasının (a) bendine aşağıdaki alt bentler eklenmiştir.\n“1) Bir,\n2) İki,”", ["uygulandi"], {"1": "Tanımlar\nMADDE 1 – (1) Burada geçen;\na) Kurum: Denetim kurumunu,\n1) Bir,\n2) İki,\nb) Kurul: Denetim kurulunu,\nç) Kanun: İlgili kanunu,\nifade eder."}),
    "paragraphs there and not there": ("2 nci maddesine aşağıdaki fıkralar eklenmiştir.\n“(3) Yeni üç.\n(4) Dört.”", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Yeni üç.\n(4) Dört."}),
    "title": ("2 nci maddesinin başlığı “Süreler” şeklinde değiştirilmiştir.", ["uygulandi"], {"2": "Süreler\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Karar bildirilir."}),
    "title and a paragraph": ("2 nci maddesinin başlığı aşağıdaki şekilde değiştirilmiştir.\n“Süreler\n(3) Yeni üç.”", ["uygulandi"], {"2": "Süreler\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(2) Karar yirmi günde verilir.\n(3) Yeni üç."}),
    "article": ("3 üncü maddesi başlığı ile birlikte aşağıdaki şekilde değiştirilmiştir.\n“Ad\nMADDE 3 – (1) Bir.\n(2) İki.”", ["uygulandi"], {"3": "Ad\nMADDE 3 – (1) Bir.\n(2) İki."}),
    "paragraph repealed": ("2 nci maddesinin ikinci fıkrası yürürlükten kaldırılmıştır.", ["uygulandi"], {"2": "Süre\nMADDE 2 – (1) Başvuru yazılı yapılır. Süre on gündür. Uzatılmaz.\n(3) Karar bildirilir."}),
    "article repealed": ("3 üncü maddesi yürürlükten kaldırılmıştır.", ["uygulandi"], {"3": None}),
    "lettered article": ("aşağıdaki 2/A maddesi eklenmiştir.\n“Ek süre\nMADDE 2/A – (1) Bir.”", ["uygulandi"], {"2/A": "Ek süre\nMADDE 2/A – (1) Bir."}),
    "lettered article without its stem": ("aşağıdaki 9/A maddesi eklenmiştir.\n“MADDE 9/A – (1) Bir.”", ["hedef_bulunamadi"], {}),
    "temporary article": ("sonuna aşağıdaki geçici madde eklenmiştir.\n“Geçiş\nGEÇİCİ MADDE 2 – (1) Uyum.”", ["uygulandi"], {"gecici:2": "Geçiş\nGEÇİCİ MADDE 2 – (1) Uyum."}),
    "no such article": ("9 uncu maddesinin birinci fıkrası yürürlükten kaldırılmıştır.", ["hedef_bulunamadi"], {}),
    "annex": ("ekinde yer alan EK-1 ekteki şekilde değiştirilmiştir.", ["desteklenmiyor"], {}),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    """Every case as a source of its own."""
    docs = spark.createDataFrame([(f"{i}", TEXT) for i in range(len(CASES))], "doc_id string, text string")
    amending = spark.createDataFrame([(f"{i}", HEAD + c[0]) for i, c in enumerate(CASES.values())], "doc_id string, text string")
    records = extract_amendments(amending).selectExpr("*", "doc_id AS source", "1L AS seq", "DATE'2001-01-01' AS date")
    versions = replay.replay(structure.parse_units(docs), records).cache()
    lost = {(r.source, r.rec): r.status for r in replay.lost_records(records).collect()}
    log = {}
    for r in replay.apply_log(versions).collect():
        log.setdefault(r.source, {})[r.rec] = r.status
    for (s, rec), status in lost.items():
        log.setdefault(s, {})[rec] = status
    texts = {}
    for r in replay.articles_at(versions).collect():
        texts.setdefault(r.source, {})[r.key] = (f"{r.title}\n" if r.title else "") + r.text
    whole = {r.source: r.text for r in replay.full_version(replay.articles_at(versions)).collect()}
    return log, texts, whole


@pytest.mark.parametrize("name", CASES)
def test_cases(outcomes, name):
    log, texts, _ = outcomes
    at = str(list(CASES).index(name))
    _, statuses, changed = CASES[name]
    assert [s for _, s in sorted(log.get(at, {}).items())] == statuses
    plain = texts[str(list(CASES).index("annex"))]
    want = {**plain, **changed}
    assert texts[at] == {k: v for k, v in want.items() if v is not None}


def test_new_articles_find_their_place(outcomes):
    _, _, whole = outcomes
    at = str(list(CASES).index("lettered article"))
    heads = [x.split(" –")[0] for x in whole[at].split("\n") if "MADDE" in x]
    assert heads == ["MADDE 1", "MADDE 2", "MADDE 2/A", "MADDE 3", "GEÇİCİ MADDE 1", "MADDE 4"]


def test_chain_dates_and_as_of(spark):
    docs = spark.createDataFrame([("s", TEXT)], "doc_id string, text string")
    steps = [("on", "yirmi"), ("yirmi", "otuz"), ("yok", "var")]
    amending = spark.createDataFrame([(f"{k}", HEAD + f"2 nci maddesinin birinci fıkrasında yer alan “{a}” ibaresi “{b}” şeklinde değiştirilmiştir.") for k, (a, b) in enumerate(steps, 1)], "doc_id string, text string")
    notes = "BAŞLIK\nMADDE 2 – (1) (Değişik ibare:RG-1/6/2015-29400) (Değişik:RG-1/3/2020-31000) Söz. (Ek:RG-1/6/2015-29400)\n(1) 5/5/2021 tarihli ve 31400 sayılı Resmî Gazete’de yayımlanan Yönetmeliğin 1 inci maddesiyle değişmiştir."
    told = spark.createDataFrame([("s", notes)], "doc_id string, text string")
    refs = structure.annotation_refs(structure.parse_units(told), structure.footnotes(told)).withColumnRenamed("doc_id", "source")
    assert [r.ref.number for r in refs.orderBy("ref").collect()] == ["29400", "31000", "31400"]
    dated = replay.amendment_dates(refs, spark.createDataFrame([("s", k) for k in (1, 2, 3, 4)], "source string, seq long"))
    assert {r.seq: (str(r.date), r.label) for r in dated.collect()} == {1: ("2015-06-01", "1/6/2015-29400"), 2: ("2020-03-01", "1/3/2020-31000"), 3: ("2021-05-05", "5/5/2021-31400"), 4: ("None", None)}
    records = extract_amendments(amending).withColumn("source", F.lit("s")).withColumn("seq", F.col("doc_id").cast("long")).join(dated, ["source", "seq"])
    versions = replay.replay(structure.parse_units(docs), records)
    for day, word in ((datetime.date(2010, 1, 1), "on"), (datetime.date(2015, 6, 1), "yirmi"), (datetime.date(2020, 2, 28), "yirmi"), (datetime.date(2022, 1, 1), "otuz")):
        assert f"Süre {word} gündür." in replay.as_of(versions, day).where("key = '2' and fikra = 1").first().text
        assert f"Süre {word} gündür." in replay.articles_at(versions, day).where("key = '2'").first().text
    got = {r.seq: (r.applied, [tuple(x) for x in r.failed]) for r in replay.chain(replay.apply_log(versions)).collect()}
    assert got == {1: (1, []), 2: (1, []), 3: (0, [("IBARE_DEGISTIR", "metin_bulunamadi")])}
    assert replay.replay(structure.parse_units(docs), records.limit(0)).count() == 5
    first = replay.original_dates(spark.createDataFrame([("s", "RG-2/3/2004-25000"), ("t", None)], "id string, original_ref string"))
    assert {r.source: str(r.date) for r in first.collect()} == {"s": "2004-03-02", "t": "None"}
    of = lambda *x: spark.createDataFrame(x, "source string, text string")
    alike = replay.chain_similarity(of(("s", "bir iki üç"), ("t", "x"), ("u", "Aynı  söz")), of(("s", "bir iki dört"), ("u", "aynı söz")))
    got = {r.source: r.similarity for r in alike.collect()}
    assert 0.5 < got["s"] < 1 and got["t"] is None and got["u"] == 1.0


def test_comparison_and_differences(spark):
    of = lambda rows: spark.createDataFrame(rows, "source string, key string, text string")
    ours = of([("s", "1", "aynı metin"), ("s", "2", "Bir cümle. İki cümle. Üç cümle."), ("s", "3", "yalnız")])
    official = of([("s", "1", "Aynı  Metin (Değişik:RG-1/1/2020-1)"), ("s", "2", "Bir cümle. Başka cümle. Üç cümle."), ("s", "4", "onlarda"), ("s", "5", "MADDE 5 – (Mülga:RG-1/1/2020-1)"), ("s", "6", "bilinen")])
    got = replay.compare_articles(ours, official, known=of([("s", "6", "")]))
    assert {r.key: r.durum for r in got.collect()} == {"1": "ayni", "2": "farkli", "3": "resmide_yok", "4": "bizde_yok", "5": "mulga_mezari", "6": "kaynak_tutarsizligi"}
    (row,) = replay.show_differences(got).collect()
    assert row.key == "2" and "-Başka cümle." in row["diff"] and "+İki cümle." in row["diff"]
