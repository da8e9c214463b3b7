"""The SQL table function against the parse by windows."""

import random

from lexstrata.functions import text as t
from lexstrata.operators import structure

COLUMNS = ["article", "kind", "num", "key", "title", "section", "section_title", "fikra", "bent", "alt_bent", "text"]
PARTS = ["MADDE 1 – (1) Söz.", "MADDE 2/A – Tek söz.", "GEÇİCİ MADDE 1 – (Değişik:RG-1/2/2020-31000) (3) (1) Geçici.", "EK MADDE 4 – (2)", "Madde 7 - (1) Küçük.", "(2) İkinci fıkra.", "(Ek:RG-1/2/2020-31000) (3) Notlu.", "a) Bent,", "bb) Çift bent,", "1) Alt bent,", "2) Alt,", "devam eden satır", "“(1) Alıntı", "a) içinde”", "\"düz alıntı", "sonu\"", "BİRİNCİ BÖLÜM", "Genel Hükümler", "Amaç ve kapsam", "Son söz.(2) ek.", "(1) 5/5/2021 tarihli ve 31400 sayılı Resmî Gazete’de yayımlanan Yönetmeliğin 1 inci maddesiyle değişmiştir.", "", "   ", "(Mülga ibare:RG-1/1/2019-30000) kalan"]


def texts():
    r = random.Random(8)
    return [(k, "\n".join(["DENEME YÖNETMELİĞİ", *(r.choice(PARTS) for _ in range(r.randrange(0, 22)))])) for k in range(120)] + [(900, None), (901, ""), (902, "MADDE 1 – (1) İlk satır.")]


def test_lateral_and_partitions_equal_the_parse(spark):
    t.register(spark)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([tuple(r) for r in structure.parse_units(docs).select("doc_id", *COLUMNS).collect()], key=str)
    docs.createOrReplaceTempView("udtf_docs")
    got = spark.sql(f"SELECT d.doc_id, {', '.join('u.' + c for c in COLUMNS)} FROM udtf_docs d, LATERAL parse_units(d.text) u").collect()
    assert sorted(map(tuple, got), key=str) == want
    spark.sql("SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM udtf_docs").repartition(5).createOrReplaceTempView("udtf_lines")
    dealt = spark.sql(f"SELECT doc_id, {', '.join(COLUMNS)} FROM parse_units(TABLE(udtf_lines))").collect()
    assert sorted(map(tuple, dealt), key=str) == want


def test_texts_of_one_document_do_not_mix(spark):
    """Whatever the partitions, and however often a text is given."""
    rows = [(1, "BAŞLIK\nMADDE 1 – (1) Bir.\n(2) İki."), (1, "ÖTEKİ\nMADDE 7 – (1) Yedi."), (1, "BAŞLIK\nMADDE 1 – (1) Bir.\n(2) İki.")]
    found = []
    for n, order in ((1, rows), (3, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id int, text string").repartition(n)
        found.append(sorted((r.key, r.fikra, r.text) for r in structure.parse_units(docs).collect()))
    assert found[0] == found[1] and {k for k, *_ in found[0]} == {"1", "7"} and len(found[0]) == 3
    assert {x for *_, x in found[0]} <= {"Bir.", "İki.", "Yedi.", "İki. ÖTEKİ", "Yedi. BAŞLIK"}
