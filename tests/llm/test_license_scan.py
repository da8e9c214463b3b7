import re

import duckdb

from lexstrata.llm import license_scan as ls

SCHEMA = "doc_id bigint, text string, label string, base int"
TEXTS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "UNDER THE MIT LICENSE under the mit license; Apache-License\nVersion 2, cc BY-NC 4.0"), (5, "under mit the license apache version 2 license nc by cc"),
    (6, "This work is licensed under the GNU General Public License, version 3."), (7, "the gnu affero general public license version 3"), (8, "the mit"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (10, "Permission is hereby granted, free of charge, and a lot more, obtaining a copy of this software"), (None, "cc by nc cc by nc"), (3, "Released under the MIT License."), (11, "İ under the mit licensé, under the mit license ı"), (12, "ccby nc cc by\x00nc"),
    (13, "word " * 5000 + "apache license version 2 " * 300), (14, "of charge hereby granted free of charge to any person obtaining a copy of this software and associated documentation files")]


def plain(rows, templates=ls.TEMPLATES, least=ls.LEAST):
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found = []
        for t in templates:
            said = t.text.split()
            keyed = [(i + k, w) for own in (key.split() for key in t.keys) for i in [next(i for i in range(len(said)) if said[i : i + len(own)] == own)] for k, w in enumerate(own)]
            for place in range(-len(said), len(words)):
                at = lambda i, p=place: words[p + i] if 0 <= p + i < len(words) else None
                if all(at(i) == w for i, w in keyed):
                    share = sum(at(i) == w for i, w in enumerate(said)) / len(said)
                    if share >= least:
                        found.append((t.label, t.base, place, share))
        base = [f[2] for f in found if f[1]]
        out.append((doc, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({f[0] for f in found if f[1]})), ",".join(sorted({f[0] for f in found})), round(max((f[3] for f in found), default=0.0), 9)))
    return sorted(out, key=str)


def result(df):
    return sorted([(*tuple(r)[:7], round(r.score, 9)) for r in df.collect()], key=str)


def test_all_places_equal_plain_search(spark):
    docs = spark.createDataFrame([(d, t, "own", 1) for d, t in TEXTS], SCHEMA).repartition(3)
    got = ls.digest(ls.scan(docs))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert result(got) == plain(TEXTS)


def test_templates_of_the_caller(spark):
    own = (ls.Template("x", "one two three four", ("two three",)), ls.Template("y", "alpha of alpha", ("alpha of alpha",), True))
    rows = [(1, "zero two three five"), (2, "one two three"), (3, "alpha of alpha of alpha"), (4, "two three"), (5, "one two nine three four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(ls.digest(ls.scan(docs, own, 0.5))) == plain(rows, own, 0.5)


def test_no_documents(spark):
    assert ls.digest(ls.scan(spark.createDataFrame([], SCHEMA))).collect() == []


def test_rarity_is_that_of_the_corpus(spark):
    docs = spark.createDataFrame([(d, t, "own", 1) for d, t in TEXTS], SCHEMA)
    counts = ls.document_counts(docs, ls.licence_words())
    for w in ls.licence_words():
        assert counts.get(w, 0) == sum(w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for _, t in TEXTS)


def test_query_equals_sql_without_python(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = ls.digest(ls.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert result(got) == sorted([(*r[:7], round(r[7], 9)) for r in con.execute(ls.ORACLE).fetchall()], key=str)
