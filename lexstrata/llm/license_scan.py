"""License scans over a positional index of rare words.

Templates are short licence notices with key phrases that a match must hold word for word. A first pass counts in how
many documents each licence word stands, function words aside; so each word has its rarity (IDF). In the second pass a
file's licence words are taken, rarest first: a template whose key words the file holds is looked up by the rarest of
them, each occurrence giving the place where the template would begin, which is intersected with the places that its
next rarest key word gives. Places left are verified: all key phrases in place, and enough of all the template's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import let, text_or_empty

#: A word, after lower-casing: digits, a to z, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that are never looked up.
FUNCTION_WORDS = frozenset("the of and in to a is or for with by on this under as be it that you may not at an are any all from your".split())
#: The share of a template's words that must stand in place.
LEAST = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: The phrases of the base, then notices by licence with the phrases they must hold.
TEMPLATES = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "obtaining a copy of this software")),
    Template("mit", "spdx license identifier mit", ("license identifier mit",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    Template("apache-2", "spdx license identifier apache 2 0", ("license identifier apache 2 0",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl-2", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: Column) -> Column:
    """The words of a text, letters A to Z in lower case; null is empty."""
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _phrase(t: Template, key: str) -> tuple[int, list[str]]:
    """Where a key phrase stands in its template, and its words."""
    said, own = t.text.split(), key.split()
    return next(i for i in range(len(said)) if said[i : i + len(own)] == own), own


def key_words(t: Template) -> dict[str, int]:
    """The words of a template's key phrases that are looked up, with their first place in a key phrase."""
    out: dict[str, int] = {}
    for key in t.keys:
        at, own = _phrase(t, key)
        for i, w in enumerate(own, at):
            if w not in FUNCTION_WORDS:
                out.setdefault(w, i)
    return out


def licence_words(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in key_words(t)})


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each licence word stands. A document sends a word once, a task one sum a word; as many rows
    as there are licence words come to the driver."""
    present = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col("text")))).alias("word"))
    return {r["word"]: r["count"] for r in present.groupBy("word").count().collect()}


def _index(templates: tuple[Template, ...], rarity: dict[str, int]) -> Column:
    """The templates as one constant array: key words by rarity with their places, key phrases, all words."""
    rows = []
    for t in templates:
        places = sorted(key_words(t).items(), key=lambda x: rarity[x[0]])
        anchors = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("at")) for w, i in places])
        phrases = F.array(*[F.struct(F.lit(i).alias("at"), F.array(*map(F.lit, own)).alias("said")) for i, own in (_phrase(t, k) for k in t.keys)])
        rows.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*[F.lit(w) for w, _ in places]).alias("needs"), anchors.alias("anchors"), phrases.alias("phrases"), F.array(*map(F.lit, t.text.split())).alias("said")))
    return F.array(*rows)


def _begins(words: Column, anchor: Column) -> Column:
    """Where a template would begin by each occurrence of one of its words."""
    spots = F.filter(F.transform(words, lambda w, i: F.when(w == anchor["word"], i - anchor["at"])), lambda i: i.isNotNull())
    return spots.cast("array<int>")


def _matches(words: Column, t: Column, least: float) -> Column:
    """array<struct<at, share>>: the places where a template is verified."""
    same = lambda at: lambda w, i: F.when(F.get(words, at + i) == w, 1.0).otherwise(0.0)
    share = lambda at: F.aggregate(F.transform(t["said"], same(at)), F.lit(0.0), lambda a, x: a + x) / F.size(t["said"])
    in_place = lambda at: F.forall(t["phrases"], lambda p: F.forall(F.transform(p["said"], lambda w, i: F.coalesce(F.get(words, at + p["at"] + i) == w, F.lit(False))), lambda x: x))
    rarest = _begins(words, F.get(t["anchors"], F.lit(0)))
    both = F.when(F.size(t["anchors"]) > 1, F.array_intersect(rarest, _begins(words, F.get(t["anchors"], F.lit(1))))).otherwise(rarest)
    found = F.transform(F.filter(both, in_place), lambda at: F.struct(at.alias("at"), share(at).alias("share")))
    return F.filter(found, lambda x: x["share"] >= least)


MATCH = "array<struct<label:string,base:boolean,at:int,share:double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, text, n_words, matches array<struct<label, base, at, share>> by place: where each template begins, in words
    (below 0 for one whose beginning is cut off), and the share of its words in place. No shuffle but of word counts.

    Null texts are empty; texts of any length are scanned whole. Repeated rows are scanned alike; null doc_ids are kept;
    other columns are ignored; no documents give no rows.
    """
    vocabulary = licence_words(templates)
    counts = document_counts(docs, vocabulary)
    rarity = {w: counts.get(w, 0) for w in vocabulary}
    by_rarity = sorted(vocabulary, key=lambda w: (rarity[w], w))
    index = _index(templates, rarity)
    none = F.array().cast(MATCH)

    def matched(words: Column) -> Column:
        def of(held: Column) -> Column:
            known = F.filter(index, lambda t: F.size(F.array_except(t["needs"], held)) == 0)
            each = F.transform(known, lambda t: F.transform(_matches(words, t, least), lambda m: F.struct(t["label"].alias("label"), t["base"].alias("base"), m["at"].cast("int").alias("at"), m["share"].alias("share"))))
            return F.when(F.size(held) > 0, F.array_sort(F.transform(F.flatten(each), lambda m: F.struct(m["at"].alias("at"), m["label"].alias("label"), m["base"].alias("base"), m["share"].alias("share"))))).otherwise(F.array())

        rows = let(F.array_intersect(F.array(*map(F.lit, by_rarity)), words), of)
        return F.struct(F.size(words).cast("bigint").alias("n_words"), F.coalesce(F.transform(rows, lambda m: F.struct(m["label"].alias("label"), m["base"].alias("base"), m["at"].alias("at"), m["share"].alias("share"))), none).alias("matches"))

    found = docs.select("doc_id", "text", let(words_of(F.col("text")), matched).alias("x"))
    return found.select("doc_id", "text", "x.n_words", "x.matches")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share, 0 without a match)."""
    of = lambda base: F.filter("matches", lambda m: m["base"]) if base else F.col("matches")
    labels = lambda base: F.array_join(F.array_sort(F.array_distinct(F.transform(of(base), lambda m: m["label"]))), ",")
    places = F.transform(of(True), lambda m: m["at"])
    return found.select("doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"), labels(True).alias("base_labels"), labels(False).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))


def _oracle() -> str:
    """Every template at every place that any of its words gives, in DuckDB."""
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {i}, '{w}', {any(_phrase(t, p)[0] <= i < _phrase(t, p)[0] + len(_phrase(t, p)[1]) for p in t.keys)})" for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.text.split()))
    return rf"""WITH t(k, label, base, nth, word, key) AS (VALUES {rows}),
n AS (SELECT k, count(*) AS n, count(*) FILTER (key) AS n_keys FROM t GROUP BY k),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
h AS (SELECT r, k, any_value(label) AS label, any_value(base) AS base, pos - nth AS place, count(*) AS hits, count(*) FILTER (key) AS keys FROM w JOIN t USING (word) GROUP BY r, k, pos - nth),
m AS (SELECT r, label, base, place, hits / n AS share FROM h JOIN n USING (k) WHERE keys = n_keys AND hits / n >= {LEAST})
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, (min(place) FILTER (base))::BIGINT AS first_word, (max(place) FILTER (base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score FROM d LEFT JOIN m USING (r) GROUP BY r"""


ORACLE = _oracle()
