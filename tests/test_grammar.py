"""Amending sentences made by combining levels, lists and operations; each says what its records are."""

import itertools

import pytest

from lexstrata.functions.text import ORDINALS
from lexstrata.operators.extract import extract_amendments
from lexstrata.operators.grammar import article_records, outer_quotes

WORD = {n: w for w, n in ORDINALS.items()}
FIELDS = ("operation", "unit", "madde_type", "madde", "fikra", "bent", "alt_bent", "cumle", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after")


def read(sentence, *quotes):
    return [{f: r[f] for f in FIELDS if r[f] is not None} for r in article_records("Aynı Yönetmeliğin " + sentence, "\n".join(f"“{q}”" for q in quotes))]


def listed(values):
    return values[0] if len(values) == 1 else ", ".join(values[:-1]) + " ve " + values[-1]


#: Articles as they are referred to, and the place they give.
ARTICLES = {"{} inci madde": ("normal", "12"), "{} ncı madde": ("normal", "26/B"), "geçici {} üncü madde": ("gecici", "3"), "ek {} inci madde": ("ek", "1")}
FIKRAS, BENTS, ALTS = ([2], [1, 3], [4, 5, 38]), (["a"], ["b", "ğğ"], ["c", "ç", "d"]), ([2], [1, 4])


def places(article, fikra=(None,), bent=(None,), alt=(None,)):
    """The locations of a list at each level, in the order of the sentence."""
    kind, number = article
    return [{k: v for k, v in (("madde_type", kind), ("madde", number), ("fikra", f), ("bent", b), ("alt_bent", a)) if v is not None} for f, b, a in itertools.product(fikra, bent, alt)]


def target(article, case, fikra=(), bent=(), alt=()):
    """The words of a location down to its deepest level, which stands in a case; those above are genitives."""
    head = next(h for h, a in ARTICLES.items() if a == article).format(article[1])
    levels = [(head, "sinin", "sinde", "si")]
    if fikra:
        levels.append((listed([WORD[f] for f in fikra]) + (" fıkra" if len(fikra) == 1 else " fıkraları"), *(("sının", "sında", "sı") if len(fikra) == 1 else ("nın", "nda", ""))))
    if bent:
        levels.append((listed([f"({b})" for b in bent]) + (" bendi" if len(bent) == 1 else " bentleri"), "nin", "nde", ""))
    if alt:
        levels.append((listed([f"({a})" for a in alt]) + (" numaralı alt bendi" if len(alt) == 1 else " numaralı alt bentleri"), "nin", "nde", ""))
    above = [w + genitive for w, genitive, *_ in levels[:-1]]
    word, _, inside, plain = levels[-1]
    return " ".join([*above, word + {"inside": inside, "plain": plain}[case]])


DEPTHS = [((), (), ()), *(((f), (), ()) for f in FIKRAS), *(([1], b, ()) for b in BENTS), *(([2], ["a"], a) for a in ALTS)]


@pytest.mark.parametrize("article", ARTICLES.values(), ids=lambda a: "-".join(a))
@pytest.mark.parametrize("fikra, bent, alt", DEPTHS)
def test_phrases_at_every_level(article, fikra, bent, alt):
    at = places(article, fikra or (None,), bent or (None,), alt or (None,))
    many = len(at) > 1
    where = target(article, "inside", fikra, bent, alt)
    noun = "ibareleri" if many else "ibaresi"
    assert read(f"{where} yer alan “eski” {noun} “yeni” şeklinde değiştirilmiştir.") == [{"operation": "IBARE_DEGISTIR", "unit": "ibare", **p, "old_text": "eski", "new_text": "yeni"} for p in at]
    assert read(f"{where} yer alan “eski” {noun} yürürlükten kaldırılmıştır.") == [{"operation": "IBARE_KALDIR", "unit": "ibare", **p, "old_text": "eski"} for p in at]
    for side in ("sonra", "önce"):
        got = read(f"{where} yer alan “çapa” ibaresinden {side} gelmek üzere “ek söz” ibaresi eklenmiştir.")
        assert got == [{"operation": "IBARE_EKLE", "unit": "ibare", **p, "new_text": "ek söz", "anchor_text": "çapa", "anchor_position": side} for p in at]


@pytest.mark.parametrize("article", ARTICLES.values(), ids=lambda a: "-".join(a))
@pytest.mark.parametrize("fikra, bent, alt", DEPTHS[1:])
def test_units_at_every_level(article, fikra, bent, alt):
    at = places(article, fikra or (None,), bent or (None,), alt or (None,))
    unit = "alt_bent" if alt else "bent" if bent else "fikra"
    where = target(article, "plain", fikra, bent, alt)
    said = [f"metin {k}" for k in range(len(at))]
    assert read(f"{where} aşağıdaki şekilde değiştirilmiştir.", *said) == [{"operation": "BIRIM_DEGISTIR", "unit": unit, **p, "new_text": q} for p, q in zip(at, said, strict=True)]
    assert read(f"{where} yürürlükten kaldırılmıştır.") == [{"operation": "BIRIM_KALDIR", "unit": unit, **p} for p in at]
    # one quote for all of a list: each takes its own marked part, or all of it where parts are not marked
    if len(at) > 1:
        mark = {"fikra": lambda p: f"({p['fikra']})", "bent": lambda p: f"{p['bent']})", "alt_bent": lambda p: f"{p['alt_bent']})"}[unit]
        parts = [f"{mark(p)} Söz {k}." for k, p in enumerate(at)]
        assert [r["new_text"] for r in read(f"{where} aşağıdaki şekilde değiştirilmiştir.", "\n".join(parts))] == parts


@pytest.mark.parametrize("count", (1, 2, 3))
def test_added_units_and_what_they_follow(count):
    many = count > 1
    texts = [f"({k}) Yeni {k}." for k in range(5, 5 + count)]
    noun = "fıkralar" if many else "fıkra"
    (got,) = read(f"12 inci maddesine aşağıdaki {noun} eklenmiştir.", *texts)
    assert got == {"operation": "BIRIM_EKLE", "unit": "fikra", "madde_type": "normal", "madde": "12", "new_text": "\n".join(texts)}
    (got,) = read(f"12 inci maddesine dördüncü fıkrasından sonra gelmek üzere aşağıdaki {noun} eklenmiştir.", *texts)
    assert got["insert_after"] == "4" and "fikra" not in got
    items = [f"{c}) Bent," for c in "çde"[:count]]
    (got,) = read(f"12 inci maddesinin ikinci fıkrasına (c) bendinden sonra gelmek üzere aşağıdaki {'bentler' if many else 'bent'} eklenmiştir.", *items)
    assert (got["unit"], got["fikra"], got["insert_after"], got["new_text"]) == ("bent", 2, "c", "\n".join(items))


#: Amendments that may follow one another in a sentence, each with its quotes and what it gives, the place apart.
STEPS = [
    ("birinci fıkrasında yer alan “on” ibaresi “yüz” şeklinde", "değiştirilmiş", [], [("IBARE_DEGISTIR", 1, "yüz")]),
    ("üçüncü fıkrasının ikinci cümlesi aşağıdaki şekilde", "değiştirilmiş", ["Yeni cümle."], [("BIRIM_DEGISTIR", 3, "Yeni cümle.")]),
    ("beşinci fıkrası", "yürürlükten kaldırılmış", [], [("BIRIM_KALDIR", 5, None)]),
    ("sekizinci fıkrasına aşağıdaki bent", "eklenmiş", ["e) Yeni bent."], [("BIRIM_EKLE", 8, "e) Yeni bent.")]),
]


@pytest.mark.parametrize("one, two", itertools.permutations(range(len(STEPS)), 2))
def test_two_operations_share_an_article_and_its_quotes(one, two):
    (a, verb_a, qa, ra), (b, verb_b, qb, rb) = STEPS[one], STEPS[two]
    got = read(f"9 uncu maddesinin {a} {verb_a} ve aynı maddenin {b} {verb_b}tir.", *qa, *qb)
    assert [(r["operation"], r["fikra"], r.get("new_text")) for r in got] == ra + rb and {r["madde"] for r in got} == {"9"}


@pytest.mark.parametrize("names", (["EK-1"], ["EK-2", "EK-3/A"], ["EK-1", "EK-4-B", "EK-11"]))
def test_annexes(names):
    shown = listed([n.replace("EK", "Ek") if k % 2 else n for k, n in enumerate(names)])
    assert [(r["operation"], r["madde_type"], r["madde"]) for r in read(f"ekinde yer alan {shown} eklenmiştir.")] == [("EK_EKLE", "ek_belge", n) for n in names]
    assert [(r["operation"], r["madde"]) for r in read(f"ekinde yer alan {shown} ekteki şekilde değiştirilmiştir.")] == [("EK_DEGISTIR", n) for n in names]


@pytest.mark.parametrize("article", list(ARTICLES.values())[:3], ids=lambda a: "-".join(a))
def test_articles_and_titles(article):
    kind, number = article
    where = target(article, "plain")
    head = {"normal": "", "gecici": "GEÇİCİ "}[kind] + f"MADDE {number} – (1) Söz."
    (got,) = read(f"{where} aşağıdaki şekilde değiştirilmiştir.", head)
    assert (got["operation"], got["unit"], got["madde_type"], got["madde"], got["new_text"]) == ("BIRIM_DEGISTIR", "madde", kind, number, head)
    (got,) = read(f"{where} yürürlükten kaldırılmıştır.")
    assert (got["operation"], got["unit"], got["madde"]) == ("BIRIM_KALDIR", "madde", number)
    (got,) = read(f"{where}nin başlığı “Yeni ad” şeklinde değiştirilmiştir.")
    assert (got["operation"], got["madde"], got["new_text"]) == ("BASLIK_DEGISTIR", number, "Yeni ad") and "fikra" not in got


def test_excluded_cases_are_no_targets():
    got = read("30 uncu maddesinden sonra gelmek üzere aşağıdaki 30/A maddesi eklenmiştir.", "MADDE 30/A – (1) Yeni.")
    assert [(r["operation"], r["madde"], r["insert_after"]) for r in got] == [("BIRIM_EKLE", "30/A", "30")]


def test_quotes_nest_to_any_depth():
    assert outer_quotes("“bir “iki “üç” iki” bir” ara “dört”") == ["bir “iki “üç” iki” bir", "dört"]
    assert outer_quotes('"düz" ve "ikinci"') == ["düz", "ikinci"] and outer_quotes("yok") == []


@pytest.mark.parametrize("name, kind", [("Yönetmeliğin", "Yönetmelik"), ("Yönetmeliğe", "Yönetmelik"), ("Tebliğin", "Tebliğ"), ("Tebliğine", "Tebliğ"), ("Tebliği (Sıra No: 7)’nin", "Tebliğ"), ("Yönetmelik (2)’in", "Yönetmelik")])
def test_regulations_are_carried_on(spark, name, kind):
    first = f"1/2/2011 tarihli ve 27833 sayılı Resmî Gazete’de yayımlanan Kurum ile Kurul İşleri Hakkında {name}"
    text = f"BAŞLIK\nMADDE 1 – {first} 3 üncü maddesinin birinci fıkrası yürürlükten kaldırılmıştır.\nMADDE 2 – Aynı Yönetmeliğin 4 üncü maddesi yürürlükten kaldırılmıştır.\nMADDE 3 – Bu işlem kaldırılmıştır."
    rows = extract_amendments(spark.createDataFrame([("d", text), ("n", None), ("e", "")], "doc_id string, text string")).orderBy("article").collect()
    assert [(r.article, r.madde, r.regulation) for r in rows] == [(1, "3", f"Kurum ile Kurul İşleri Hakkında {kind}"), (2, "4", f"Kurum ile Kurul İşleri Hakkında {kind}")]
