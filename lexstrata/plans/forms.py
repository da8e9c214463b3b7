"""An amending text and an annotated regulation per order, in the forms that lexstrata.plans.rendered does not turn through.

The form turns with the order's key: phrases taken out, annexes, whole, new, temporary and additional articles, sub-items,
lists of three, quotes within quotes, lettered amendments, lists of sentences. Each text names its article by the
customer and its words by the order, so every record follows from the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = 13
NAMED = "1/1/1990 tarihli ve 20390 sayılı Resmî Gazete’de yayımlanan Örnek "
#: For each form the sentence after NAMED with {m} for the article and {x} for the order's word, and the quoted lines below it.
SAID = [
    "Yönetmeliğin {m} inci maddesinin birinci fıkrasında yer alan “{x}” ibaresi yürürlükten kaldırılmıştır.",
    "Yönetmeliğin ekinde yer alan EK-{m} ve EK-{m}/B eklenmiştir.",
    "Yönetmeliğin ekinde yer alan EK-{m} ekteki şekilde değiştirilmiştir.",
    "Yönetmeliğe {m} inci maddesinden sonra gelmek üzere aşağıdaki {m}/A maddesi eklenmiştir.\n“MADDE {m}/A – (1) {x} yeni.”",
    "Yönetmeliğin {m} inci maddesi aşağıdaki şekilde değiştirilmiştir.\n“MADDE {m} – (1) {x} bir.\n(2) {x} iki.”",
    "Yönetmeliğe aşağıdaki geçici madde eklenmiştir.\n“GEÇİCİ MADDE {m} – (1) {x} sürer.”",
    "Yönetmeliğin {m} inci maddesinin ikinci fıkrasının (a) bendinin (2) ve (4) numaralı alt bentleri yürürlükten kaldırılmıştır.",
    "Yönetmeliğin {m} inci maddesinin birinci fıkrasının (a), (b) ve (c) bentleri aşağıdaki şekilde değiştirilmiştir.\n“a) {x} bir,\nb) {x} iki,\nc) {x} üç.”",
    "Yönetmeliğin {m} inci maddesinin birinci fıkrasının (ğğ) bendinde yer alan “{x}” ibaresi “dış “{x}” son” şeklinde değiştirilmiştir.",
    "Yönetmeliğin {m} inci maddesinde aşağıdaki düzenlemeler yapılmıştır.\na) Birinci fıkrasında yer alan “{x}” ibaresinden önce gelmek üzere “çok” ibaresi eklenmiştir.\nb) İkinci fıkrası yürürlükten kaldırılmıştır.",
    "Yönetmeliğin {m} inci maddesinin birinci fıkrasının üçüncü ve dördüncü cümleleri yürürlükten kaldırılmıştır.",
    "Yönetmeliğin ek {m} inci maddesinin on ikinci fıkrası yürürlükten kaldırılmıştır.",
    "Yönetmeliğin geçici {m} inci maddesinin başlığı “{x}” şeklinde değiştirilmiştir.",
]

#: SQL of the records: doc_id, rec, operation, unit, madde_type, madde, fikra, bent, alt_bent, cumle, old_text, new_text, anchor_text, anchor_position, insert_after.
RECORDS = f"""WITH o AS (SELECT o_orderkey::VARCHAR AS doc_id, o_orderkey % {FORMS} AS form, (o_custkey % 40 + 1)::VARCHAR AS m, 'K' || o_orderkey AS x FROM orders),
  r(form, rec, operation, unit, madde_type, fikra, bent, alt_bent, cumle) AS (VALUES
    (0, 0, 'IBARE_KALDIR', 'ibare', 'normal', 1, NULL, NULL, NULL), (1, 0, 'EK_EKLE', 'ek', 'ek_belge', NULL, NULL, NULL, NULL), (1, 1, 'EK_EKLE', 'ek', 'ek_belge', NULL, NULL, NULL, NULL),
    (2, 0, 'EK_DEGISTIR', 'ek', 'ek_belge', NULL, NULL, NULL, NULL), (3, 0, 'BIRIM_EKLE', 'madde', 'normal', NULL, NULL, NULL, NULL), (4, 0, 'BIRIM_DEGISTIR', 'madde', 'normal', NULL, NULL, NULL, NULL),
    (5, 0, 'BIRIM_EKLE', 'gecici_madde', 'normal', NULL, NULL, NULL, NULL), (6, 0, 'BIRIM_KALDIR', 'alt_bent', 'normal', 2, 'a', 2, NULL), (6, 1, 'BIRIM_KALDIR', 'alt_bent', 'normal', 2, 'a', 4, NULL),
    (7, 0, 'BIRIM_DEGISTIR', 'bent', 'normal', 1, 'a', NULL, NULL), (7, 1, 'BIRIM_DEGISTIR', 'bent', 'normal', 1, 'b', NULL, NULL), (7, 2, 'BIRIM_DEGISTIR', 'bent', 'normal', 1, 'c', NULL, NULL),
    (8, 0, 'IBARE_DEGISTIR', 'ibare', 'normal', 1, 'ğğ', NULL, NULL), (9, 0, 'IBARE_EKLE', 'ibare', 'normal', 1, NULL, NULL, NULL), (9, 1, 'BIRIM_KALDIR', 'fikra', 'normal', 2, NULL, NULL, NULL),
    (10, 0, 'BIRIM_KALDIR', 'cumle', 'normal', 1, NULL, NULL, '3,4'), (11, 0, 'BIRIM_KALDIR', 'fikra', 'ek', 12, NULL, NULL, NULL), (12, 0, 'BASLIK_DEGISTIR', 'baslik', 'gecici', NULL, NULL, NULL, NULL))
  SELECT doc_id, rec, operation, unit, madde_type, CASE form WHEN 1 THEN 'EK-' || m || CASE rec WHEN 1 THEN '/B' ELSE '' END WHEN 2 THEN 'EK-' || m WHEN 3 THEN m || '/A' WHEN 5 THEN NULL ELSE m END AS madde, fikra, bent, alt_bent, cumle,
    CASE WHEN form IN (0, 8) THEN x END AS old_text,
    CASE form WHEN 3 THEN 'MADDE ' || m || '/A – (1) ' || x || ' yeni.' WHEN 4 THEN 'MADDE ' || m || ' – (1) ' || x || ' bir.' || chr(10) || '(2) ' || x || ' iki.' WHEN 5 THEN 'GEÇİCİ MADDE ' || m || ' – (1) ' || x || ' sürer.'
      WHEN 7 THEN bent || ') ' || x || CASE rec WHEN 0 THEN ' bir,' WHEN 1 THEN ' iki,' ELSE ' üç.' END WHEN 8 THEN 'dış “' || x || '” son' WHEN 9 THEN CASE rec WHEN 0 THEN 'çok' END WHEN 12 THEN x END AS new_text,
    CASE WHEN form = 9 AND rec = 0 THEN x END AS anchor_text, CASE WHEN form = 9 AND rec = 0 THEN 'önce' END AS anchor_position, CASE form WHEN 3 THEN m END AS insert_after
  FROM o JOIN r USING (form)"""

#: For each form with quoted lines below its sentence, those lines as a model reads them, and how many quotes they hold.
READ_BLOCKS = {3: ("[ALINTI1]", 1), 4: ("[ALINTI1]", 1), 5: ("[ALINTI1]", 1), 7: ("[ALINTI1]", 1), 9: ("a) Birinci fıkrasında yer alan [ALINTI1] ibaresinden önce gelmek üzere [ALINTI2] ibaresi eklenmiştir. b) İkinci fıkrası yürürlükten kaldırılmıştır.", 2)}
_INPUTS = [(k, (NAMED + said.partition("\n")[0] + " " + READ_BLOCKS.get(k, ("", 0))[0]).strip(), READ_BLOCKS.get(k, ("", 0))[1]) for k, said in enumerate(SAID)]
#: SQL of the model inputs of all articles: doc_id, article, input, quotes.
INPUTS = f"""WITH o AS (SELECT o_orderkey::VARCHAR AS doc_id, o_orderkey % {FORMS} AS form, (o_custkey % 40 + 1)::VARCHAR AS m, 'K' || o_orderkey AS x FROM orders),
  i(form, said, quotes) AS (VALUES {", ".join(f"({k}, '{said}', {n})" for k, said, n in _INPUTS)})
  SELECT doc_id, 1 AS article, replace(replace(said, '{{m}}', m), '{{x}}', x) AS input, quotes FROM o JOIN i USING (form) UNION ALL SELECT doc_id, 2, 'Bu Yönetmelik yayımı tarihinde yürürlüğe girer.', 0 FROM o"""


def _filled(said: Column, **values: Column) -> Column:
    for name, value in values.items():
        said = F.replace(said, F.lit(f"{{{name}}}"), value)
    return said


def _word() -> Column:
    return F.concat(F.lit("K"), F.col("o_orderkey").cast("string"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: an amending text per order."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("o_orderkey") % FORMS + 1).cast("int"))
    text = F.concat(F.lit(f"ÖRNEK YÖNETMELİKTE DEĞİŞİKLİK YAPILMASINA DAİR YÖNETMELİK\nMADDE 1 – {NAMED}"), said, F.lit("\nMADDE 2 – Bu Yönetmelik yayımı tarihinde yürürlüğe girer."))
    text = _filled(text, m=(F.col("o_custkey") % 40 + 1).cast("string"), x=_word())
    return _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))


#: SQL of the orders as annotated regulations: doc_id, x (the order's word), d (its day as written), day, n (a gazette's number).
ANNOTATED = "o AS (SELECT o_orderkey::VARCHAR AS doc_id, 'K' || o_orderkey AS x, o_orderdate::DATE AS day, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS d, 20000 + o_orderkey % 9000 AS n FROM orders)"
_TEXT = """ÖRNEK YÖNETMELİK
MADDE 1 – (Ek:RG-{d}-{n}) (1) Tutar {x} liradır.(3)
a) Genel {x}, (Değişik:RG-{d}-1{n} 2. Mükerrer)
1) İlk {x},
MADDE 2 – (1) (Mülga üçüncü cümle:RG-{d}-2{n}) Son {x}.
(3) {d} tarihli ve 3{n} sayılı Resmî Gazete’de yayımlanan Yönetmeliğin 1 inci maddesiyle değişmiştir.
______
Yönetmeliğin Yayımlandığı Resmî Gazete’nin
Tarihi Sayısı
{d} {n}
Yönetmelikte Değişiklik Yapan Yönetmeliklerin Yayımlandığı Resmî Gazetelerin
1. {d} 1{n} 2. Mükerrer
2.
{d}
2{n}
4. {d} 4{n}"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a regulation per order with notes, a footnote and publication tables."""
    day = F.concat_ws("/", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    text = _filled(F.lit(_TEXT), d=day, n=(F.col("o_orderkey") % 9000 + 20000).cast("string"), x=_word())
    return _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))
