"""What would make work grow faster than the input: gram tables broadcast, texts parsed twice, windows over lines."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexstrata.functions.text import annotations, collapse, single_blanks, strip_apparatus, with_notes, without_notes
from lexstrata.operators import evidence, extract, grammar, grams, replay, structure
from lexstrata.operators.extract import amending_articles, extract_amendments
from lexstrata.plans import rendered
from lexstrata.sources.shared import written


def planned(rows, physical=True):
    e = rows._jdf.queryExecution()
    return (e.sparkPlan() if physical else e.optimizedPlan()).toString()


def test_gram_tables_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", "x", "birinci ikinci üçüncü")], "g string, id string, text string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    assert "Broadcast" not in planned(grams.contained(texts, texts, ["g"]))
    assert grams.contained(texts, texts, ["g"]).count() == 1


def test_quotes_of_small_articles_make_no_grams(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(evidence, "contained", lambda *a: asked.append(a) or grams.contained(*a))
    said = "source string, madde_type string, madde string, seq bigint, rec int, new_text string, old_text string, anchor_text string, amending_article string"
    rows = [("s", m, "1", k, 0, f"tutar {k:04d} lira", f"tutar {k - 1:04d} lira", None, "1") for m in ("normal", None, "ek") for k in range(1, 6)] + [(None, None, "1", 1, 0, "tutar 0001 lira", None, None, "1")]
    found = evidence.quote_evidence(spark.createDataFrame(rows, said))
    assert not asked and "Broadcast" not in planned(evidence._hits_by_pairs(spark.createDataFrame(rows, said), 8))
    assert sorted((r.seq, r.later_seq, r.quoted) for r in found.collect()) == [(k, k + 1, f"tutar {k:04d} lira") for k in range(1, 5)]
    monkeypatch.setattr(evidence, "FEW", 7)  # the ten quotes of two kinds that are one article are too many now, those of the third are not
    again = evidence.quote_evidence(spark.createDataFrame(rows, said))
    assert len(asked) == 2 and sorted(again.collect()) == sorted(found.collect())


def test_records_take_their_day_along(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rendered, "written", lambda rows: rows)
    p = written(rendered.prices(spark, sf_dir))
    rows = rendered.records(p)
    assert "Join" not in planned(rows, physical=False) and rows.columns[:3] == ["source", "seq", "doc_id"] and rows.columns[-1] == "date"
    got = {(r.source, r.seq, r.doc_id, r.date) for r in rows.select("source", "seq", "doc_id", "date").collect()}
    assert got == {(r.source, r.seq, f"{r.source}/{r.seq}", r.date) for r in p.where("step > 0").select("source", "seq", "date").collect()}


def test_texts_are_hashed_where_they_are_put_together(spark):
    plan = planned(structure._texts(spark.range(5).selectExpr("string(id) AS doc_id", "concat('MADDE ', id, ' – (1) Bir.') AS text")))
    assert plan.index("xxhash64") < plan.index("hashpartitioning")  # above it: hashes, which nothing makes smaller, are not dealt out


def test_note_evidence_parses_once(spark):
    docs = spark.createDataFrame([("s", "MADDE 1 – (1) Bir.\nMADDE 1 – (Ek:RG-1/2/2020-30000) (1) İki. (Ek:RG-1/2/2020-30000)"), ("t", "MADDE 1 – (1) Bir. (Ek:RG-1/2/2020-30000)")], "doc_id string, text string")
    kinds = "source string, seq bigint, rec int, madde string, fikra int, bent string, status string"
    rows = spark.createDataFrame([(s, 1, 0, "1", 1, None, "sonradan_degisti") for s in "st"], kinds)
    labels = spark.createDataFrame([(s, 1, "RG-1/2/2020-30000") for s in "st"], "source string, seq bigint, label string")
    found = evidence.note_evidence(rows, labels, structure.parse_units(docs))
    assert planned(found, physical=False).count("posexplode") == 1
    # the first article of a key that repeats has no note
    assert [(r.source, r.unit) for r in found.collect()] == [("t", "madde 1 fıkra 1")]


def told(lines):
    """Whether each line starts inside quotes, line by line."""
    s, low, straight, out = 0, 0, False, []
    for x in lines:
        art, low = x.startswith(("MADDE", "Madde")), min(low, s)
        out.append(s - low > 0 or (straight and not art))
        straight = True if x.startswith('"') and not (len(x) > 1 and x.endswith('"')) else False if x.endswith('"') or art else straight
        s += x.count("“") - x.count("”")
    return out


def test_lines_and_articles_without_windows_over_lines(spark):
    draw, kinds = random.Random(3), ["düz satır", "“açar", "kapar”", "“iç “iç” dış”", "iki”” kapar", '"düz açar', 'düz kapar"', '"bütün"', "MADDE 7 – (1) Söz", "Madde 8 – Söz"]
    lines = [draw.choice(kinds) for _ in range(3 * structure.RUN + 7)]
    short = ["MADDE 1 – Bir", "söz", "MADDE 2 – İki"]
    rows = [("long", "\n \n".join(x.replace(" ", " \t\xa0 ") for x in lines)), ("s", "\n".join(short)), ("s", "\n".join(short)), ("none", None), ("none", " \n\t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r for r in structure.lines_of(docs).collect()), key=lambda r: (r.doc_id, r.pos))
    assert [(r.pos, r.line, r.quoted) for r in got if r.doc_id == "long"] == [(i, x, q) for i, (x, q) in enumerate(zip(lines, told(lines), strict=True), 1)]
    assert [r.line for r in got if r.doc_id == "s"] == short and len(got) == len(lines) + 3
    articles = amending_articles(docs)
    assert planned(articles, physical=False).count("Window") == 1 and "Aggregate" not in planned(articles)
    assert [(r.article, r.amending_article, r.sentence, r.block) for r in articles.where("doc_id = 's'").orderBy("article").collect()] == [(1, "1", "Bir", "söz"), (2, "2", "İki", "")]


def test_a_plain_sentence_is_tokenised_once(monkeypatch):
    read, tokens = [], grammar.tokens
    monkeypatch.setattr(grammar, "tokens", lambda s: read.append(s) or tokens(s))
    said = "Yönetmeliğin 3 üncü maddesinin ikinci fıkrasında yer alan “bir” ibaresi “iki” şeklinde değiştirilmiştir."
    assert [(r["madde"], r["fikra"], r["new_text"]) for r in grammar.article_records(said, "")] == [("3", 2, "iki")] and len(read) == 1
    listed = grammar.article_records("Yönetmeliğin 3 üncü maddesinde aşağıdaki düzenlemeler yapılmıştır.", "a) Birinci fıkrası yürürlükten kaldırılmıştır.\nb) İkinci fıkrası yürürlükten kaldırılmıştır.")
    assert [(r["madde"], r["fikra"]) for r in listed] == [("3", 1), ("3", 2)]


def test_lines_are_read_once_and_apparatus_cut_in_one_pass(spark):
    docs = spark.createDataFrame([("a", "MADDE 1 – (1) Bir\n  ___\nson"), ("b", "MADDE 1 – Bir\nx ___ y Eki için tıklayınız\n___"), ("c", None), ("d", "___\nMADDE 1 – Bir")], "doc_id string, text string")
    own = docs.select("doc_id", strip_apparatus(F.col("text")).alias("text"))
    assert {r.doc_id: r.text for r in own.collect()} == {"a": "MADDE 1 – (1) Bir\n", "b": "MADDE 1 – Bir\nx ___ y ", "c": None, "d": ""}
    lines = structure.lines_of(own)
    assert planned(lines, physical=False).count("aggregate(") == 1 and planned(lines, physical=False).count("tıklayınız") == 1
    assert sorted((r.doc_id, r.line) for r in lines.collect()) == [("a", "MADDE 1 – (1) Bir"), ("b", "MADDE 1 – Bir"), ("b", "x ___ y")]


def test_notes_are_read_once_and_equal_the_two_readings(spark):
    said = ["Söz.(3) (Değişik:RG-1/1/2020-1) son", "(a:b) düz, (Ek cümle:RG-2/2/2020-2)", "Söz.(3)", "düz", "", None, "(yarım: "]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", with_notes(F.col("x")).alias("n"), without_notes(F.col("x")).alias("t"), annotations(F.col("x")).alias("a")).collect()
    assert all((r.n.text, r.n.notes) == (r.t, r.a) for r in rows if r.x is not None) and [r.n.text for r in rows if r.x is None] == [None]


def test_replay_parses_originals_and_new_texts_once(spark):
    docs = spark.createDataFrame([("s", "MADDE 1 – (1) Bir.\nMADDE 1 – (1) İki."), (None, "MADDE 1 – Yok.")], "doc_id string, text string")
    units = structure.parse_units(docs)
    articles = replay.original_articles(units)
    assert planned(articles, physical=False).count("posexplode") == 1
    assert [(r.source, r.key, r.pos, [u.raw for u in r.base]) for r in articles.collect()] == [("s", "1", 1.0, ["Bir."])]
    texts = spark.createDataFrame([("s/1", "DEĞİŞİKLİK\nMADDE 1 – Yönetmeliğin 1 inci maddesinin birinci fıkrası aşağıdaki şekilde değiştirilmiştir.\n“(1) Yeni.”")], "doc_id string, text string")
    records = written(extract_amendments(texts).withColumns({"source": F.lit("s"), "seq": F.lit(1).cast("bigint"), "date": F.lit(None).cast("date")}))
    versions = replay.replay(units, records)
    assert "posexplode" not in planned(versions, physical=False)
    assert [(u.raw, u.since, u.until) for u in versions.first().units] == [("Bir.", 0, 1), ("Yeni.", 1, None)]


def test_texts_stay_in_as_many_partitions_as_asked_for(spark):
    docs = spark.range(50).selectExpr("string(id) AS doc_id", "'MADDE 1 – (1) Bir.' AS text")
    # small partitions would be put together, and few tasks would read all texts
    assert structure.line_arrays(docs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_quotes_that_end_on_their_line_need_no_state(spark, monkeypatch):
    monkeypatch.setattr(structure, "_with_quotes", lambda lines: F.lit(None).cast("array<struct<line:string,quoted:boolean,head:boolean>>"))
    texts = ["MADDE 1 – “a” ve “b”\n“(1) Yeni.”", "MADDE 1 – “a\nb”", "MADDE 1 – “a “b” c”", 'MADDE 1 – "a"', "MADDE 1 – a”"]
    rows = structure.line_arrays(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows[0].lines] == [("MADDE 1 – “a” ve “b”", False, True), ("“(1) Yeni.”", False, False)]
    assert all(r.lines is None for r in rows[1:])  # these go through the state


def test_names_of_regulations_are_found_without_cutting_words(spark):
    of = {"yayımlanan Örnek Yönetmeliğin 1 inci": (True, "Örnek Yönetmelik"), "yayımlanan Yönetmeliğin yayımlanan A B Tebliği (x)’nin": (True, "Yönetmeliğin yayımlanan A B Tebliğ"),
          "yayımlanan Yönetmeliğin": (True, None), "Bu Yönetmelik yürürlüğe girer.": (False, None), "yayımlanan, A Yönetmeliğine., Tebliğ'e": (True, None), "": (False, None)}
    assert "split" not in str(extract._target(F.col("s")))
    rows = spark.createDataFrame([(s,) for s in of], "s string").select("s", extract._target(F.col("s")).alias("x")).collect()
    assert {r.s: (r.x.meant, r.x.name) for r in rows} == of


def test_blanks_and_targets_take_one_pattern_at_most(spark):
    said = [None, "", "a b", "a  b", " \t a\xa0b\n c ", "a\x0bb\fc\rd", "a\xa0 b", "\n", "a\nb"]
    rows = spark.createDataFrame([(x,) for x in said], "s string").select("s", F.trim(single_blanks(F.col("s"), feeds=True)).alias("one"), collapse(F.col("s")).alias("all"), single_blanks(F.col("s")).alias("lines")).collect()
    assert [r.one for r in rows] == [r["all"] for r in rows]
    assert [r.lines for r in rows] == [x and re.sub(r"[ \t\x0b\f\r\xa0]+", " ", x) for x in said]
    assert str(extract._target(F.col("s"))).count("regexp_extract") == 1


def test_sentences_that_differ_in_quotes_are_read_once(monkeypatch):
    read, tokens = [], grammar.tokens
    monkeypatch.setattr(grammar, "tokens", lambda s: read.append(s) or tokens(s))
    said = "Yönetmeliğin 37 nci maddesinin ikinci fıkrasında yer alan “{}” ibaresi “{}” şeklinde değiştirilmiştir."
    pairs = [("bir", "iki"), ("üç", "dış “iç” son"), ("", "(dört)")]
    assert [(r["old_text"], r["new_text"]) for x in pairs for r in grammar.article_records(said.format(*x), "")] == pairs and len(read) == 1
    # quotes too deep, and a name's bracket with one, are read as they stand
    for odd in ("Yönetmeliğin 1 inci maddesinde yer alan “a “b “c” d” e” ibaresi “x” şeklinde değiştirilmiştir.", "Yönetmeliği (“a” b)’nin 1 inci maddesinde yer alan “a” ibaresi “x” şeklinde değiştirilmiştir."):
        assert [{k: v for k, v in r.items() if k != "at"} for r in grammar.operations(odd, grammar.EMPTY)] == grammar.Reader(grammar.EMPTY).read(odd)


def test_nested_values_equal_those_of_arrow():
    a = pa.array([[{"a": 1, "b": [1, None]}, None], None, [], [{"a": None, "b": None}], [{"a": 3, "b": []}]])
    assert all(replay.values(x) == x.to_pylist() for x in (a, a[1:4], a[:0], a[1:2]))
