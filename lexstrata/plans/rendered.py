"""Regulations and amendments rendered from relational tables, so that every answer can be had in SQL too.

Twenty customers by key are a regulation, so documents multiply with the data and each stays small. A customer with orders
is an article; its first order gives the original, and each later one is an amending text whose kind turns with its
number: a phrase, a paragraph, an insertion, a sentence, a title, a list of items, or a repeal together with a new paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.operators.extract import extract_amendments
from lexstrata.operators.replay import replay
from lexstrata.operators.structure import parse_units
from lexstrata.operators.verify import excuse_later, verify
from lexstrata.sources.shared import written

ARTICLES, KINDS = 20, 7

#: The rendered orders in SQL: source, article, step (0 first), kind, seq, date, price, before (the value it replaces), nth of its kind.
PRICES = f"""
o AS (SELECT (c_custkey // {ARTICLES})::VARCHAR AS source, (c_custkey % {ARTICLES} + 1)::INT AS article, o_orderkey, o_orderdate::DATE AS date, lpad(printf('%.2f', o_totalprice), 12, '0') || '-' AS price
      FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, row_number() OVER (PARTITION BY source, article ORDER BY date, o_orderkey) - 1 AS step, row_number() OVER (PARTITION BY source ORDER BY date, o_orderkey) AS seq FROM o),
p AS (SELECT *, step % {KINDS} AS kind, lag(price) OVER k AS before, row_number() OVER k AS nth FROM s WINDOW k AS (PARTITION BY source, article, step % {KINDS} ORDER BY step))
"""


def state(until: str) -> str:
    """SQL of every article's values from the orders that meet a condition; the first order always counts."""
    return f"""SELECT source, article, arg_max(price, step) FILTER (kind = 0 AND (step = 0 OR {until})) AS v0, coalesce(arg_max(price, step) FILTER (kind = 1 AND {until}), 'sıfır') AS v1,
      coalesce(string_agg(price, ' ' ORDER BY step DESC) FILTER (kind = 2 AND {until}) || ' ', '') AS v2, coalesce(arg_max(price, step) FILTER (kind = 3 AND {until}), 'cümle') AS v3,
      coalesce(arg_max(price, step) FILTER (kind = 4 AND {until}), 'sıfır') AS v4, coalesce(arg_max(price, step) FILTER (kind = 5 AND {until}), 'sıfır') AS v5,
      coalesce(list(price ORDER BY step) FILTER (kind = 6 AND {until}), []) AS v6 FROM p GROUP BY source, article"""


#: SQL of the units of a state: source, article, fikra, bent, text.
UNITS = """SELECT source, article, u.fikra, u.bent, u.text FROM state, LATERAL (VALUES
      (1, NULL, 'Tutar ' || v0 || ' liradır.'), (1, 'a', 'Genel ' || v5), (1, 'b', 'Özel ' || v5), (2, NULL, 'Oran ' || v1 || ' olur.'), (3, NULL, 'Ek ' || v2 || 'tutarları.'),
      (4, NULL, 'Birinci cümle. İkinci ' || v3 || '. Üçüncü cümle.')) u(fikra, bent, text)
    UNION ALL SELECT source, article, 1, 'c', 'Son' FROM state WHERE len(v6) = 0
    UNION ALL SELECT source, article, 10 + unnest(generate_series(1, len(v6))), NULL, 'Yeni ' || unnest(v6) || '.' FROM state"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, article, step, kind, seq (order of amending texts within the source), date, price, before, nth."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(
        F.floor(F.col("c_custkey") / ARTICLES).cast("string").alias("source"), (F.col("c_custkey") % ARTICLES + 1).cast("int").alias("article"), "o_orderkey", F.to_date("o_orderdate").alias("date"),
        F.concat(F.lpad(F.format_string("%.2f", "o_totalprice"), 12, "0"), F.lit("-")).alias("price"))
    of_article = W.partitionBy("source", "article").orderBy("date", "o_orderkey")
    orders = orders.withColumn("seq", F.row_number().over(W.partitionBy("source").orderBy("date", "o_orderkey")).cast("bigint")).withColumn("step", F.row_number().over(of_article) - 1)
    orders = orders.withColumn("kind", F.col("step") % KINDS)
    of_kind = W.partitionBy("source", "article", "kind").orderBy("step")
    return orders.withColumn("before", F.lag("price").over(of_kind)).withColumn("nth", F.row_number().over(of_kind))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def originals(p: DataFrame, last: bool = False) -> DataFrame:
    """doc_id = source, text: the original regulations, or the consolidated ones with every order's change made."""
    value = lambda k, otherwise: F.coalesce(F.max_by(F.when((F.col("kind") == k) & F.lit(last), F.col("price")), F.when(F.col("kind") == k, F.col("step"))), F.lit(otherwise))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & F.lit(last), F.struct("step", "price")))), lambda x: x["price"])
    first = F.max_by(F.when((F.col("kind") == 0) & (F.lit(last) | (F.col("step") == 0)), F.col("price")), F.when((F.col("kind") == 0) & (F.lit(last) | (F.col("step") == 0)), F.col("step")))
    rows = p.groupBy("source", "article").agg(first.alias("v0"), value(1, "sıfır").alias("v1"), F.reverse(listed(2)).alias("v2"), value(3, "cümle").alias("v3"), value(4, "sıfır").alias("v4"), value(5, "sıfır").alias("v5"), listed(6).alias("v6"))
    added = F.array_join(F.transform("v6", lambda x, i: _said("\n(", (i + 11).cast("string"), ") Yeni ", x, ".")), "")
    line = _said(
        "Tutar ", F.col("v4"), "\nMADDE ", F.col("article").cast("string"), " – (1) Tutar ", F.col("v0"), " liradır.\na) Genel ", F.col("v5"), "\nb) Özel ", F.col("v5"), F.when(F.size("v6") == 0, "\nc) Son").otherwise(""),
        "\n(2) Oran ", F.col("v1"), " olur.\n(3) Ek ", F.array_join(F.concat("v2", F.array(F.lit("tutarları."))), " "), "\n(4) Birinci cümle. İkinci ", F.col("v3"), ". Üçüncü cümle.", added)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.col("source").alias("doc_id")).agg(_said("ÖRNEK YÖNETMELİK\nBİRİNCİ BÖLÜM\nGenel Hükümler\n", text).alias("text"))


def amendments(p: DataFrame) -> DataFrame:
    """doc_id = 'source/seq', text, source, seq, date: an amending text per later order."""
    old, new = F.coalesce("before", F.lit("sıfır")), F.col("price")
    kinds = [
        _said(" birinci fıkrasında yer alan “", old, "” ibaresi “", new, "” şeklinde değiştirilmiştir."),
        _said(" ikinci fıkrası aşağıdaki şekilde değiştirilmiştir.\n“(2) Oran ", new, " olur.”"),
        _said(" üçüncü fıkrasında yer alan “Ek” ibaresinden sonra gelmek üzere “", new, "” ibaresi eklenmiştir."),
        _said(" dördüncü fıkrasının ikinci cümlesi aşağıdaki şekilde değiştirilmiştir.\n“İkinci ", new, ".”"),
        _said(" başlığı “Tutar ", new, "” şeklinde değiştirilmiştir."),
        _said(" birinci fıkrasının (a) ve (b) bentlerinde yer alan “", old, "” ibareleri “", new, "” şeklinde değiştirilmiştir."),
        _said(" birinci fıkrasının (c) bendi yürürlükten kaldırılmış ve aynı maddeye aşağıdaki fıkra eklenmiştir.\n“(", (F.col("nth") + 10).cast("string"), ") Yeni ", new, ".”"),
    ]
    change = F.element_at(F.array(*kinds), F.col("kind") + 1)
    head = "ÖRNEK YÖNETMELİKTE DEĞİŞİKLİK YAPILMASINA DAİR YÖNETMELİK\nMADDE 1 – 1/1/1990 tarihli ve 20390 sayılı Resmî Gazete’de yayımlanan Örnek Yönetmeliğin "
    text = _said(head, F.col("article").cast("string"), " inci maddesinin", change, "\nMADDE 2 – Bu Yönetmelik yayımı tarihinde yürürlüğe girer.")
    return p.where("step > 0").select(F.concat_ws("/", "source", F.col("seq").cast("string")).alias("doc_id"), text.alias("text"), "source", "seq", "date")


#: SQL of the records of all amending texts.
RECORDS = """r AS (SELECT source, seq, article, kind, step, nth, date, price, coalesce(before, 'sıfır') AS before FROM p WHERE step > 0),
records AS (
  SELECT source, seq, 0 AS rec, 'IBARE_DEGISTIR' AS operation, 'ibare' AS unit, article, 1 AS fikra, NULL AS bent, NULL AS cumle, before AS old_text, price AS new_text, NULL AS anchor_text, NULL AS anchor_position, kind, step, nth, date, price FROM r WHERE kind = 0
  UNION ALL SELECT source, seq, 0, 'BIRIM_DEGISTIR', 'fikra', article, 2, NULL, NULL, NULL, '(2) Oran ' || price || ' olur.', NULL, NULL, kind, step, nth, date, price FROM r WHERE kind = 1
  UNION ALL SELECT source, seq, 0, 'IBARE_EKLE', 'ibare', article, 3, NULL, NULL, NULL, price, 'Ek', 'sonra', kind, step, nth, date, price FROM r WHERE kind = 2
  UNION ALL SELECT source, seq, 0, 'BIRIM_DEGISTIR', 'cumle', article, 4, NULL, '2', NULL, 'İkinci ' || price || '.', NULL, NULL, kind, step, nth, date, price FROM r WHERE kind = 3
  UNION ALL SELECT source, seq, 0, 'BASLIK_DEGISTIR', 'baslik', article, NULL, NULL, NULL, NULL, 'Tutar ' || price, NULL, NULL, kind, step, nth, date, price FROM r WHERE kind = 4
  UNION ALL SELECT source, seq, i, 'IBARE_DEGISTIR', 'ibare', article, 1, b, NULL, before, price, NULL, NULL, kind, step, nth, date, price FROM r, (VALUES (0, 'a'), (1, 'b')) x(i, b) WHERE kind = 5
  UNION ALL SELECT source, seq, 0, 'BIRIM_KALDIR', 'bent', article, 1, 'c', NULL, NULL, NULL, NULL, NULL, kind, step, nth, date, price FROM r WHERE kind = 6
  UNION ALL SELECT source, seq, 1, 'BIRIM_EKLE', 'fikra', article, NULL, NULL, NULL, NULL, '(' || (nth + 10) || ') Yeni ' || price || '.', NULL, NULL, kind, step, nth, date, price FROM r WHERE kind = 6)"""
#: SQL of the status of every record against the consolidated texts.
STATUS = f"""final AS ({state("TRUE")}),
statuses AS (SELECT r.*, CASE WHEN CASE kind WHEN 0 THEN price IN (v0, v5) WHEN 1 THEN price = v1 WHEN 3 THEN price = v3 WHEN 4 THEN price = v4 WHEN 5 THEN price = v5 ELSE TRUE END THEN 'uyumlu' ELSE 'sonradan_degisti' END AS status
  FROM records r JOIN final USING (source, article))"""


def records(p: DataFrame) -> DataFrame:
    """The extracted records with source, seq and date, written once for the several uses of verification and replay.

    A text's day goes along in its id: joined by source and seq, all texts of all records would be dealt out again.
    """
    texts = amendments(p).withColumn("doc_id", F.concat_ws("/", "doc_id", F.col("date").cast("string")))
    at = F.split("doc_id", "/")
    rows = extract_amendments(texts).withColumns({"doc_id": F.concat_ws("/", at[0], at[1]), "source": at[0], "seq": at[1].cast("bigint"), "date": F.get(at, F.lit(2)).cast("date")})
    return written(rows.select("source", "seq", *[c for c in rows.columns if c not in ("source", "seq", "date")], "date"))


def verified(p: DataFrame) -> DataFrame:
    p = written(p)
    units = parse_units(originals(p, last=True))
    return excuse_later(written(verify(records(p), units)))


def versions(p: DataFrame) -> DataFrame:
    p = written(p)
    return replay(parse_units(originals(p)), records(p))
