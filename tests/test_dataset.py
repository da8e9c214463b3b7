"""Datasets, predictions, evidence, discovery, sources and the watch, in our own words."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import text as t
from lexstrata.operators import dataset, discover, evaluate, evidence, structure, verify
from lexstrata.operators.extract import amending_articles, extract_amendments
from lexstrata.sources import config, documents, robots, sinks
from lexstrata.streaming import watch

HEAD = "1/2/2003 tarihli ve 25000 sayılı Resmî Gazete’de yayımlanan Deneme Yönetmeliğin "
AMENDING = f"""BAŞLIK
MADDE 1 – {HEAD}2 nci maddesinin birinci fıkrasının (b) bendinde yer alan “eski kurum” ibaresi “yeni kurum” olarak değiştirilmiş ve aynı fıkraya aşağıdaki bentler eklenmiştir.
“c) Uzun söz,
ç) Daha uzun söz,”
MADDE 2 – Aynı Yönetmeliğin 3 üncü maddesinin ikinci fıkrasının birinci cümlesi aşağıdaki şekilde değiştirilmiştir.
“Yeni cümle.”
MADDE 3 – Bu Yönetmelik yayımı tarihinde yürürlüğe girer."""


@pytest.fixture(scope="module")
def examples(spark):
    docs = spark.createDataFrame([("d", AMENDING)], "doc_id string, text string")
    return evaluate.build_examples(amending_articles(docs), extract_amendments(docs).withColumn("status", F.lit("uyumlu"))).cache()


def test_sequence_pairs(examples):
    rows = {r.article: r for r in dataset.seq2seq(examples).collect()}
    assert rows[1].input.endswith("aşağıdaki bentler eklenmiştir. [ALINTI1]") and "“eski kurum” ibaresi “yeni kurum”" in rows[1].input
    assert rows[1].quotes == ["c) Uzun söz,\nç) Daha uzun söz,"]
    assert rows[1].target == "IBARE_DEGISTIR | madde=2 fikra=1 bent=b | birim=ibare | eski=eski kurum | yeni=yeni kurum ;; BIRIM_EKLE | madde=2 fikra=1 | birim=bent"
    assert rows[2].target == "BIRIM_DEGISTIR | madde=3 fikra=2 cumle=1 | birim=cumle" and rows[3].target == "YOK"
    assert {k: r.quality for k, r in rows.items()} == {1: "dogrulanmis", 2: "dogrulanmis", 3: "kayitsiz"}


def test_targets_read_back(examples):
    """What is written comes back, but for the texts of blocks; broken parts are left out."""
    rows = examples.select("article", F.transform("records", dataset.canonical).alias("r"), dataset.delinearize(dataset.linearize(F.transform("records", dataset.canonical))).alias("back")).collect()
    for r in rows:
        want = [{**x.asDict(), "new_text": None if x.operation in evaluate.BLOCK_OPERATIONS else x.new_text} for x in r.r]
        assert [x.asDict() for x in r.back] == want
    said = ["YOK", "", None, "sözler ;; IBARE_DEGISTIR | madde=5 fikra=x | eski=a b | yeni=c=d", "IBARE_KALDIR"]
    spark = examples.sparkSession
    got = [r[0] for r in spark.createDataFrame(enumerate(said), "k int, s string").orderBy("k").select(dataset.delinearize(F.col("s"))).collect()]
    assert [len(g) for g in got] == [0, 0, 0, 1, 0]
    assert (got[3][0].madde, got[3][0].fikra, got[3][0].old_text, got[3][0].new_text, got[3][0].madde_type) == ("5", None, "a b", "c=d", "normal")


def test_predictions(spark, examples):
    """A perfect model equals the rules, copies do not count twice, phrases snap to quotes, blocks are filled."""
    rows = dataset.seq2seq(examples)
    first = rows.where("article = 1").first()
    near = first.target.replace("eski=eski kurum", "eski=eski kurm") + " ;; " + first.target
    pred = spark.createDataFrame([(first.id, "YOK", 1), (first.id, near, 2)], "id string, prediction string, seq int")
    got = dataset.repaired(dataset.predicted(pred, rows)).orderBy("rec").collect()
    assert [x.r.operation for x in got] == ["IBARE_DEGISTIR", "BIRIM_EKLE", "IBARE_DEGISTIR"]
    assert (got[0].r.old_text, got[0].r.new_text, got[1].r.new_text) == ("eski kurum", "yeni kurum", "c) Uzun söz,\nç) Daha uzun söz,")
    perfect = rows.select("id", F.col("target").alias("prediction"), F.lit(1).alias("seq"))
    records = dataset.predicted(perfect, rows).select("id", "r")
    gold = examples.select(F.concat(F.lit("d/madde"), F.col("article").cast("string")).alias("id"), F.explode(F.transform("records", dataset.canonical)).alias("r"))
    row = dataset.silver_metrics(records, gold, rows).first()
    assert (row.rows, row.exact, row.tp, row.f1) == (3, 3, 3, 1.0)
    none = dataset.silver_metrics(records.limit(0), gold, rows).first()
    assert (none.exact, none.missing, none.recall) == (1, 3, 0.0)


def test_prompts(spark):
    pool = [("b", "xx", "YOK"), ("a", "yy", "YOK"), ("c", "z", "IBARE_KALDIR | madde=1 | birim=ibare"), ("d", "zz", "BIRIM_DEGISTIR | madde=1 | birim=cumle"), ("e", "zzz", "BIRIM_DEGISTIR | madde=1 | birim=cumle")]
    rows = spark.createDataFrame(pool, "id string, input string, target string")
    shots = dataset.few_shot(rows)
    assert [s["id"] for s in shots] == ["a", "c", "d", "e"]
    (m,) = dataset.prompts(rows.where("id = 'b'"), shots[:1], "kurallar").collect()
    assert [tuple(x) for x in m.messages] == [("system", "kurallar"), ("user", "yy"), ("assistant", "YOK"), ("user", "xx")]
    said = spark.createDataFrame([("```text\nIBARE_KALDIR | madde=1\nsöz\n```",), ("hiç",)], "s string").select(dataset.clean_output(F.col("s")), dataset.order_free(F.lit("b ;; a"))).collect()
    assert [tuple(r) for r in said] == [("IBARE_KALDIR | madde=1", "a ;; b"), ("YOK", "a ;; b")]


VERIFIED = "source string, seq long, rec int, operation string, madde_type string, madde string, fikra int, bent string, alt_bent int, cumle string, new_text string, old_text string, anchor_text string, amending_article string, unit string, status string"


def verified(spark, *rows):
    base = {"source": "s", "seq": 1, "rec": 0, "operation": "IBARE_DEGISTIR", "madde_type": "normal", "madde": "5", "status": "uyumsuz"}
    names = [x.split(" ")[0] for x in VERIFIED.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(c) for c in names) for r in rows], VERIFIED)


def test_evidence(spark):
    rows = verified(spark, {"new_text": "Düzenleme Kurulu"}, {"seq": 4, "old_text": "düzenleme  kurulu", "amending_article": "2"}, {"seq": 5, "madde": "9", "old_text": "Düzenleme Kurulu"}, {"seq": 2, "madde": "6", "new_text": "yirmi"}, {"seq": 3, "madde": "6", "old_text": "yirmi"})
    (hit,) = evidence.quote_evidence(rows).collect()
    assert (hit.seq, hit.later_seq, hit.later_article) == (1, 4, "2")
    text = "BAŞLIK\nMADDE 26 – (1) Bir.\n(7) (Değişik:RG-25/9/2020-31255) Yedi.\na) (Ek:RG-1/1/2021-31300) Bent.\nMADDE 27 – (Değişik:RG-2/2/2022-31400) (1) Söz."
    units = structure.parse_units(spark.createDataFrame([("s", text)], "doc_id string, text string"))
    labels = spark.createDataFrame([("s", k, x) for k, x in ((1, "RG-25/9/2020-31255"), (2, "RG-1/1/2021-31300"), (3, "RG-2/2/2022-31400"))], "source string, seq long, label string")
    late = [{"status": "sonradan_degisti", **x} for x in ({"madde": "26", "fikra": 7}, {"rec": 1, "madde": "26", "fikra": 1}, {"seq": 2, "madde": "26", "fikra": 7, "bent": "a"}, {"seq": 3, "madde": "27", "fikra": 1})]
    notes = evidence.note_evidence(verified(spark, *late), labels, units)
    assert {(r.seq, r.rec): r.unit for r in notes.collect()} == {(1, 0): "madde 26 fıkra 7", (2, 0): "madde 26 fıkra 7 bent a", (3, 0): "madde 27"}
    assert evidence.explained(evidence.quote_evidence(rows), notes).count() == 3


def test_known_issues_and_gate(spark, tmp_path):
    path = tmp_path / "issues.yaml"
    path.write_text("issues:\n- {id: a, source: s, operation: IBARE_DEGISTIR, location: {madde: '5', fikra: 1}}\n- {id: b, source: s, operation: IBARE_DEGISTIR, location: {madde: '5'}}\n- {id: c, source: s, operation: IBARE_DEGISTIR, location: {madde: '7'}}\n", encoding="utf-8")
    issues = config.read_issues(spark, str(path))
    rows = verified(spark, {"fikra": 1}, {"seq": 2}, {"seq": 3, "madde": "7", "status": "uyumlu"}, {"seq": 4, "madde": "8", "status": "uyumlu"})
    got = {r.seq: (r.status, r.issue) for r in verify.relabel_known(rows, issues).collect()}
    assert got == {1: ("kaynak_tutarsizligi", "a"), 2: ("kaynak_tutarsizligi", "b"), 3: ("uyumlu", None), 4: ("uyumlu", None)}
    assert [r.id for r in verify.resolved_issues(rows, issues).collect()] == ["c"]
    assert verify.passes(verify.summary(rows), 0.5) and not verify.passes(verify.summary(rows), 0.51)
    assert not verify.passes(verify.summary(rows.limit(0)), 0.0)


def test_later_records_count(spark):
    rows = verified(spark, {"fikra": 1}, {"seq": 2, "fikra": 1, "status": "uyumlu"}, {"seq": 3, "status": "uyumlu"}, {"seq": 4, "fikra": 2}, {"seq": 5, "madde": None, "operation": "BIRIM_EKLE", "unit": "madde", "new_text": "MADDE 30 – (1) A."}, {"seq": 6, "madde": "30"})
    got = {r.seq: (r.status, r.later_count) for r in verify.excuse_later(rows).collect()}
    assert got == {1: ("sonradan_degisti", 2), 2: ("uyumlu", 0), 3: ("uyumlu", 0), 4: ("uyumsuz", 0), 5: ("sonradan_degisti", 1), 6: ("uyumsuz", 0)}


def test_discovery(spark):
    html = '<a href="a.htm">–– Kart\n Ödemeleri Hakkında Yönetmelikte Değişiklik Yapılmasına Dair <b>Yönetmelik</b></a><a class=x href=\'b.htm\'>Kart Ödemeleri Hakkında Yönetmelik</a><a href="c.htm">Kart Ödemeleri Hakkında Yönetmeliğin Yürürlükten Kaldırılması</a><a href="d.htm">Eski Ad Değişiklik</a>'
    day = datetime.date(2020, 1, 10)
    pages = spark.createDataFrame([(day, 0, html), (day, 1, html), (datetime.date(2020, 1, 8), 0, html), (day, 2, "")], "day date, repeat int, html string")
    found = discover.links(pages)
    names = [("s", ["Kart Ödemeleri Hakkında", "Eski Ad"]), ("t", ["Başka"])]
    hits = discover.amendment_links(found, names)
    assert {(r.href, r.source) for r in hits.where("day = '2020-01-10' and repeat = 0").collect()} == {("a.htm", "s"), ("d.htm", "s")}
    assert {r.href for r in discover.original_links(found, names).collect()} == {"b.htm"}
    refs = spark.createDataFrame([("s", day, 0), ("s", day, 3), ("s", datetime.date(2020, 1, 12), 0), ("s", datetime.date(2021, 1, 1), 0)], "source string, day date, repeat int")
    got = {(str(r.day), r.repeat): (r.href, str(r.page_day), r.page_repeat) for r in discover.find_urls(refs, hits).collect()}
    assert got == {("2020-01-10", 0): ("a.htm", "2020-01-10", 0), ("2020-01-10", 3): ("a.htm", "2020-01-10", 0), ("2020-01-12", 0): ("a.htm", "2020-01-10", 0), ("2021-01-01", 0): (None, "None", None)}
    text = "MADDE 1 – 5/11/2013 tarihli ve 28812 sayılı Resmî Gazete’de yayımlanan Başka Kanuna göre, 11/7/2014 tarihli ve 29057 sayılı Resmî Gazete’de yayımlanan Kart Ödemeleri Hakkında Genel Yönetmeliğin"
    rows = spark.createDataFrame([("s", 2, "yok"), ("s", 1, text)], "source string, seq int, text string")
    sources = spark.createDataFrame([("s", "Kart Ödemeleri Hakkında Genel Yönetmelik"), ("u", "Hiç")], "source string, name string")
    got = {r.source: r.ref and (r.ref.day, r.ref.number) for r in discover.find_originals(rows, sources).collect()}
    assert got == {"s": (11, "29057"), "u": None}
    fixed = discover.corrected_numbers(spark.createDataFrame([(day, "1"), (datetime.date(2020, 1, 9), "2")], "page_day date, number string"), spark.createDataFrame([(day, "<p>10 Ocak 2020 Tarihli ve <b>31004</b> Sayılı Resmî Gazete</p>")], "day date, html string"))
    assert {str(r.page_day): r.number for r in fixed.collect()} == {"2020-01-10": "31004", "2020-01-09": "2"}


def test_text_functions(spark):
    table = "Son.\n ___\n (1) Dipnot.\n Tebliğin Yayımlandığı Resmî Gazete’nin\n Tarihi\n Sayısı\n 7/3/2020\n 31061\n Tebliğde Değişiklik Yapan Tebliğlerin Yayımlandığı Resmî Gazetelerin\n 1.\n 31/12/2020\n 31351\n 2. 9/8/2021 31563 2. Mükerrer\n 7. 1/1/2022 31700\n"
    row = spark.createDataFrame([(table,)], "x string").select(t.publication_table(F.col("x")).alias("p"), t.strip_apparatus(F.col("x")).alias("s"), t.publication_table(F.lit("yok")).alias("n")).first()
    assert (row.p.first.number, [(a.number, a.repeat) for a in row.p.amendments], row.s.strip()) == ("31061", [("31351", 0), ("31563", 2)], "Son.")
    assert row.n.first is None and row.n.amendments == []
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(t.issue_number_of_index(F.lit("<b>10 Ocak 2020 Tarihli ve 31004 Sayılı</b>"))) == "31004" and f(t.issue_number_of_index(F.lit("Sayı : 31005"))) == "31005" and f(t.issue_number_of_index(F.lit("Sayı : 12"))) is None
    assert f(t.paragraph_blocks(F.lit("önce\n(1) Bir\ndevam\n(2) İki"))) == ["(1) Bir\ndevam", "(2) İki"]
    assert [f(t.pick_item(F.lit("a) Bir\nb) İki"), F.lit(k))) for k in ("b", "z")] == ["b) İki", "a) Bir\nb) İki"] and f(t.pick_item(F.lit("tek"), F.lit("a"))) == "tek"
    assert f(t.rg_digits(F.lit("RG-1/2/2020-31000"))) == "1/2/202031000"
    assert f(t.diff_sentences(F.lit("Bir. İki: (2) Üç; dört."))) == ["Bir.", "İki:", "(2) Üç; dört."]
    notes = f(t.annotations(F.lit("(Başlığı ile Birlikte Değişik:RG-1/1/2020-1) Söz.(3) (Değişik üçüncü cümle:RG-2/2/2020-2) (madde)")))
    assert [tuple(n) for n in notes] == [("Değişik", "RG-1/1/2020-1"), ("Değişik", "RG-2/2/2020-2"), ("Dipnot", "dipnot:3")]
    assert f(t.is_tombstone(F.lit("MADDE 5 – (Mülga:RG-1/1/2020-1)"))) and not f(t.is_tombstone(F.lit("MADDE 5 – (Mülga:RG-1/1/2020-1) (1) Söz")))
    t.register(spark)
    got = spark.sql("SELECT tr_upper('ilişki'), norm_text(' A  b '), rg_ref('RG-5/6/2019-30794 2. Mükerrer').repeat, quality_label(array(), 'x yürürlüğe girer'), seq_ratio('ab', 'ab')").first()
    assert tuple(got) == ("İLİŞKİ", "a b", 2, "kayitsiz", 1.0)


STRUCTURE = """ÖRNEK YÖNETMELİK
EK KURALLAR
BİRİNCİ BÖLÜM
Genel
Amaç (Değişik:RG-1/1/2020-31000)
Madde 1 — (Ek:RG-2/2/2020-31100) (1) Bu kural “(2) değil.
MADDE 9 – değil” böyledir.(4)
(2) 21/12/2008 tarihli ve 5 sayılı Kanun uygulanır.
a) Bir
1) Alt bir
2) Alt iki
bb) Çift
MADDE 2 – (3)
(1) Söz.
(3) 21/12/2008 tarihli ve 27087 sayılı Resmî Gazete’de yayımlanan Yönetmeliğin 2 nci maddesiyle değişmiştir.
İKİNCİ KISIM
Son
GEÇİCİ MADDE 1 – Paragrafsız söz."""


def test_structure(spark):
    docs = spark.createDataFrame([("d", STRUCTURE), ("null", None), ("empty", ""), ("q", 'B\nMADDE 1 – Söz:\n"Uzun\n(2) alıntı"\n(2) Gerçek.\n"Açık kalan\nMADDE 2 – (1) Yeni.')], "doc_id string, text string")
    units = {(r.doc_id, r.key, r.fikra, r.bent, r.alt_bent): r for r in structure.parse_units(docs).collect()}
    assert {k[1:] for k in units if k[0] == "d"} == {("1", 1, None, None), ("1", 2, None, None), ("1", 2, "a", None), ("1", 2, "a", 1), ("1", 2, "a", 2), ("1", 2, "bb", None), ("2", None, None, None), ("2", 1, None, None), ("gecici:1", None, None, None)}
    one = units["d", "1", 1, None, None]
    assert (one.title, one.section, one.section_title) == ("Amaç", "BİRİNCİ BÖLÜM", "Genel")
    assert one.text == "Bu kural “(2) değil. MADDE 9 – değil” böyledir." and [tuple(n) for n in one.notes] == [("Dipnot", "dipnot:4")] and [n.source for n in one.article_notes] == ["RG-2/2/2020-31100"]
    assert units["d", "1", 2, None, None].text.startswith("21/12/2008 tarihli ve 5 sayılı Kanun")
    assert units["d", "gecici:1", None, None, None].section == "İKİNCİ KISIM" and [n.source for n in units["d", "2", 1, None, None].article_notes] == ["dipnot:3"]
    assert units["q", "1", 2, None, None].text == "Gerçek. \"Açık kalan" and ("q", "2", 1, None, None) in units
    assert {r.doc_id: r.title for r in structure.document_titles(docs).collect()} == {"d": "ÖRNEK YÖNETMELİK EK KURALLAR", "q": "B"}
    (notes,) = structure.footnotes(docs).collect()
    assert list(notes.footnotes) == [3] and notes.footnotes[3].endswith("değişmiştir.")
    full = {(r.key, r.fikra, r.bent, r.alt_bent): r.full for r in structure.full_texts(structure.parse_units(docs)).where("doc_id = 'd'").collect()}
    assert full["1", 2, "a", None] == "Bir 1) Alt bir 2) Alt iki" and full["1", None, None, None].endswith("a) Bir 1) Alt bir 2) Alt iki bb) Çift")
    assert structure.parse_units(docs.limit(0)).count() == 0


def test_files(spark, tmp_path):
    d = tmp_path / "kaynak"
    d.mkdir()
    (d / "konsolide_a.txt").write_text("eski", encoding="utf-8")
    (d / "orijinal_a.html").write_text("<header>x</header><p>Bir<sup>(1)</sup> iki</p><!-- y --><div>üç<br>dört</div>", encoding="utf-8")
    (d / "degisiklik100_a.txt").write_bytes("ğüş".encode("windows-1254"))
    (d / "degisiklik09_b.txt").write_text("kesi-\nlen  söz\n\n\n\nson", encoding="utf-8")
    (d / "degisiklik10_c.pdf").write_bytes(b"%PDF")
    rows = {(r.role, r.seq): r.text for r in documents.by_role(documents.read_texts(spark, str(tmp_path))).collect()}
    assert rows == {("konsolide", 0): "eski", ("orijinal", 0): "Bir iki\nüç\ndört", ("degisiklik", 1): "kesilen söz\n\nson", ("degisiklik", 2): None, ("degisiklik", 3): "ğüş"}
    pages = spark.createDataFrame([("p", k, f"Baş {k}\n" + ("söz " * 20 if k < 4 else "")) for k in range(1, 5)], "doc string, page int, text string")
    (r,) = documents.pdf_text(pages).collect()
    assert "Baş" not in r.text and (r.pages_without_text, r.needs_ocr) == (1, False)
    lines = tmp_path / "m.jsonl"
    lines.write_text('{"url": "u1", "path": "a/x.txt"}\nbozuk\n{"path": "b"}\n', encoding="utf-8")
    assert [r.url for r in documents.read_json_lines(spark, str(lines), "url string, path string", "url").collect()] == ["u1"]


def test_incremental_download(spark):
    sources = spark.createDataFrame([("s", "http://x/k", None, ["http://x/a", "http://x/b"])], "id string, url string, original_url string, amendments array<string>")
    jobs = documents.download_jobs(sources)
    assert {(r.role, r.url) for r in jobs.collect()} == {("konsolide", "http://x/k"), ("degisiklik00", "http://x/a"), ("degisiklik01", "http://x/b")}
    manifest = spark.createDataFrame([("http://x/k", "s/konsolide_1.txt"), ("http://x/a", "p")], "url string, path string")
    assert {r.url for r in documents.not_yet_fetched(jobs, manifest).collect()} == {"http://x/b"}
    assert {r.url for r in documents.not_yet_fetched(jobs, manifest, refresh=True).collect()} == {"http://x/b", "http://x/k"}
    fetched = spark.createDataFrame([("s", "konsolide", "http://x/k", b"abc", "application/pdf", "t"), ("s", "konsolide", "http://x/k.html", b"abd", None, "t")], "source string, role string, url string, content binary, content_type string, fetched_at string")
    got = documents.manifest_rows(fetched, manifest).collect()
    assert {r.path.rsplit(".")[-1] for r in got} == {"pdf", "html"} and all(r.path.startswith("s/konsolide_") for r in got)
    assert documents.manifest_rows(fetched, documents.manifest_rows(fetched, manifest)).count() == 0
    url = lambda u: spark.range(1).select(documents.frame_url(F.lit(u))).first()[0]
    assert url("https://h/mevzuat?MEVZUATNO=5&mevzuatTur=7").endswith("MevzuatTur=7&MevzuatNo=5&MevzuatTertip=5") and url("https://h/mevzuat?x=1") is None
    splits = spark.createDataFrame([("train", "a"), ("dev", "a"), ("dev", "b")], "split string, source string")
    assert {(r.split, r.source) for r in documents.move_to_split(splits, spark.createDataFrame([("a", "test")], "source string, split string")).collect()} == {("test", "a"), ("dev", "b")}


def test_config_and_sinks(spark, tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text("sources:\n- id: s\n  name: Ad\n  url: u\n  amendments: [a, {url: b}]\n", encoding="utf-8")
    sources = config.read_sources(spark, str(path))
    assert sources.first().amendments == ["a", "b"]
    config.write_sources(documents.upsert_sources(sources, sources.limit(0)), str(path))
    assert config.read_sources(spark, str(path)).collect() == sources.collect()
    # what the table does not know stays, and a writer that comes second takes the next version
    path.write_text("crawl: {delay_seconds: 3}\nsources:\n- id: s\n  name: Ad\n  note: own\n  amendments: [a, {url: b, label: x}]\n- id: z\n  name: Z\n", encoding="utf-8")
    for f in tmp_path.glob("sources.v*.yaml"):
        f.unlink()
    change = spark.createDataFrame([("s", "Yeni", None, None, [], ["a", "b"], None, None), ("n", "N", None, None, None, None, None, None)], config.SOURCE)
    assert [config.write_sources(change, str(path)) for _ in range(2)] == [1, 2]
    said = json.loads((tmp_path / "sources.v000002.yaml").read_text(encoding="utf-8"))
    assert said == {"crawl": {"delay_seconds": 3}, "sources": [{"id": "s", "name": "Yeni", "note": "own", "amendments": ["a", {"url": "b", "label": "x"}]}, {"id": "z", "name": "Z"}, {"id": "n", "name": "N"}]}
    assert {r.id for r in config.read_sources(spark, str(path)).collect()} == {"s", "z", "n"}
    (tmp_path / "splits.yaml").write_text("train: [s]\ntest: [t]\n", encoding="utf-8")
    assert {tuple(r) for r in config.read_splits(spark, str(tmp_path / "splits.yaml")).collect()} == {("train", "s"), ("test", "t")}
    rows = spark.createDataFrame([("train", 1), ("test", 2)], "split string, x int")
    sinks.write_splits(rows, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    sinks.write_report(rows, str(tmp_path / "rep"))
    sinks.write_report(rows.limit(1), str(tmp_path / "rep"))
    sinks.append_hits(rows, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 3
    sinks.write_versions(spark.createDataFrame([("s", 1, "RG-1/1/2020-5", "bir\niki")], "source string, seq int, label string, text string"), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v/source=s/version=01_RG-1-1-2020-5")).collect()] == ["bir", "iki"]


def test_watch(spark, tmp_path):
    page = lambda k, status=200, href="x.htm": json.dumps({"day": "2020-01-10", "repeat": k, "url": f"http://g/2020/p{k}.htm", "status": status, "html": f"<a href='{href}'>Deneme Yönetmelikte Değişiklik</a>", "at": "2020-01-10T00:00:00"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([page(0), page(1, 404), page(2, 200, "y.htm")]), encoding="utf-8")
    texts = spark.createDataFrame([("http://g/2020/x.htm", AMENDING)], "url string, text string")
    base = spark.createDataFrame([("s", "B\nMADDE 2 – (1) Söz\na) Bir\nb) yeni kurum")], "doc_id string, text string")
    scan = lambda pages: watch.scan_pages(pages, texts, [("s", ["Deneme"])], base)
    out = scan(spark.read.schema(watch.PAGE).json(str(tmp_path / "in"))).collect()
    assert {(r.url[-5:], r.error, len(r.statuses), r.label) for r in out} == {("x.htm", None, 3, "RG-10/1/2020"), ("y.htm", "no text", 0, "RG-10/1/2020 2. Mükerrer")}
    seen = watch.seen_table(spark, f"file://{tmp_path}/seen", 4)
    for _ in range(2):  # the second run finds nothing new
        watch.run_scan(spark, str(tmp_path / "in"), scan, seen, str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/b.json").write_text(page(0), encoding="utf-8")
    watch.run_scan(spark, str(tmp_path / "in"), scan, seen, str(tmp_path / "ck")).awaitTermination()
    # another run over the same files, with a checkpoint of its own, adds nothing either
    watch.run_scan(spark, str(tmp_path / "in"), scan, seen, str(tmp_path / "ck2")).awaitTermination()
    (hit,) = seen.read().collect()
    assert hit.record_count == 3 and sum(hit.statuses.values()) == 3 and hit.statuses["uyumlu"] == 1
    pages = lambda *s: spark.createDataFrame([(x,) for x in s], "status int")
    assert watch.all_failed(pages(500, None)) and not watch.all_failed(pages(500, 404)) and not watch.all_failed(pages().limit(0))
    assert watch.issues_to_scan(spark, "2020-01-01", "2020-01-03", 2).count() == 9
    hits = tmp_path / "hits"
    hits.mkdir()
    (hits / "a.json").write_text("\n".join(json.dumps(x) for x in ({"source": "s", "url": "u", "statuses": ["uyumlu", "uyumlu"]}, {"source": "s", "url": "u", "statuses": []}, {"source": "s", "url": "e", "error": "x"})), encoding="utf-8")
    watch.run_watch(spark, str(hits), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    (hits / "b.json").write_text(json.dumps({"source": "s", "url": "e", "statuses": None}), encoding="utf-8")
    watch.run_watch(spark, str(hits), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert {r.url for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"u", "e"}


def test_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(["a", None, "a"],), (None,), ([None],), ([],)], "statuses array<string>")
    assert sorted((r.record_count, sorted(r.statuses.items())) for r in watch.status_map(rows).collect()) == [(0, []), (0, []), (0, []), (2, [("a", 2)])]
    pages = [("d", k, f"Baş {k}\n{w}\nMADDE 1") for k, w in enumerate("abcd")] + [("d", 1, "Baş 1\nb\nMADDE 1"), ("e", 1, "a\nb"), ("e", 1, "a\nb"), ("n", 1, None), (None, 1, "x")]
    for n in (1, 4):
        got = documents.remove_repeats(spark.createDataFrame(pages, "doc string, page int, text string").repartition(n))
        assert sorted(map(tuple, got.collect()), key=str) == sorted([*(("d", k, f"{w}\nMADDE 1") for k, w in enumerate("abcd")), ("e", 1, "a\nb"), ("n", 1, ""), (None, 1, "x")], key=str)
    assert documents.remove_repeats(spark.createDataFrame([], "doc string, page int, text string")).collect() == []
    day = datetime.date(2020, 1, 10)
    refs = spark.createDataFrame([("r", day), ("r", day), ("q", None)], "ref string, day date")
    found = documents.pages_before(refs, spark.createDataFrame([(datetime.date(2020, 1, 8),)], "page_day date"), 5)
    assert sorted((r.ref, str(r.page_day)) for r in found.collect()) == [("q", "None"), ("r", "2020-01-08"), ("r", "2020-01-08")]
    examples = spark.createDataFrame([("train", "s", "kismen"), ("train", "t", "kismen"), ("test", "s", "sorunlu")], "split string, source string, quality string")
    assert {(r.split, r.source, r.quality): r.n for r in evaluate.split_stats(examples, True).collect()}[None, None, None] == 3
    assert evaluate.split_stats(examples, True).where("split = 'train' and source = 's' and quality is null").first().n == 1
    keys = [(c, "string") for c in evaluate.GOLD_KEY]
    make = lambda *x: spark.createDataFrame([tuple("1" if c == "madde" else v if c == "new_text" else None for c, _ in keys) for v in x], ", ".join(f"{c} {k}" for c, k in keys))
    (row,) = evaluate.strict_prf(make("a", "a", "b"), make("a", " a", "c")).collect()
    assert (row.tp, row.n_pred, row.n_gold, row.f1) == (2, 3, 3, 0.667)


def test_robots(spark):
    text = "# all\nUser-agent: a\nUser-agent: Mine\nDisallow: /x\nAllow: /x/y\nDisallow: /x/y\n\nUser-agent: *\nDisallow: /\n"
    fetched = spark.createDataFrame([("h", 200, text), ("gone", 404, "User-agent: *\nDisallow: /"), ("down", 503, None), ("never", None, None), ("all", 200, "user-agent : *\r\nDISALLOW : /z\r\nbad line"), (None, 200, text)], "host string, status int, text string")
    urls = ["http://H/x", "http://h/x/y/z", "http://h/w", "http://h", "https://gone/q", "http://down/", "http://never/a", "http://unknown/", "http://all/z?q#f", "http://all/?z", "no url", None, "http://h/w"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: (r.allowed, r.rule) for r in robots.allowed(rows, fetched, "mine").collect()}
    assert got == {0: (False, "/x"), 1: (True, "/x/y"), 2: (True, None), 3: (True, None), 4: (True, "/"), 5: (False, "/"), 6: (False, "/"), 7: (False, None), 8: (False, "/z"), 9: (True, None), 10: (False, None), 11: (False, None), 12: (True, None)}
    assert {r.i: r.allowed for r in robots.allowed(rows, fetched, "else").collect()}[2] is False
    assert robots.allowed(rows.limit(0), fetched, "mine").collect() == [] and not any(r.allowed for r in robots.allowed(rows, fetched.limit(0), "mine").collect())
