"""Amendment records from amending texts: articles and their target by windows, sentences by the token grammar."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexstrata.functions.text import let, single_blanks
from lexstrata.operators.grammar import article_records
from lexstrata.operators.structure import ARTICLE, line_arrays

#: The word before a regulation's name, and the kinds of regulation with the cases in which it is amended.
PUBLISHED, KINDS, CASES = "yayımlanan", {"Yönetmelik": "Yönetmeli", "Tebliğ": "Tebli"}, ("in", "inin", "e", "ine")
RECORD = (
    "operation string, unit string, madde_type string, madde string, fikra int, bent string, alt_bent int, cumle string, "
    "old_text string, new_text string, anchor_text string, anchor_position string, insert_after string"
)
_FIELDS = {"fikra": pa.int32(), "alt_bent": pa.int32()}
_STRUCT = pa.struct([(x.split(" ")[0], _FIELDS.get(x.split(" ")[0], pa.string())) for x in RECORD.split(", ")])


def amending_articles(docs: DataFrame) -> DataFrame:
    """doc_id, article, amending_article (its number), sentence (its first line without the head), block (the lines after it).

    A null or empty text has no articles. Lines within quotation marks open none.
    """
    def articles(x: Column) -> Column:
        lines, heads = x["lines"], x["heads"]
        after = lambda h, k: F.transform(F.slice(lines, h + 2, F.coalesce(F.get(heads, k + 1), F.size(lines)) - h - 1), lambda y: y["line"])
        return F.transform(heads, lambda h, k: F.struct((k + 1).cast("bigint").alias("article"), F.get(lines, h)["line"].alias("line"), F.array_join(after(h, k), "\n").alias("block")))

    def headed(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda y, i: F.when(y["head"], i)), lambda i: i.isNotNull())
        return let(F.struct(lines.alias("lines"), heads.alias("heads")), articles)

    out = line_arrays(docs).select("doc_id", F.inline(let(F.col("lines"), headed)))
    return out.select("doc_id", "article", F.regexp_extract("line", ARTICLE, 2).alias("amending_article"), F.regexp_replace("line", ARTICLE, "").alias("sentence"), "block")


#: A word that names a kind of regulation in one of CASES, which may stand behind an apostrophe; and the name that such a
#: word ends, with that word, which begins after the first PUBLISHED and has a word of its own. Words stand one blank apart.
NAMES = "|".join(rf"{stem}ğ(?:{'|'.join(CASES)})[.,;:]*|(?:{kind}|{stem}ği)[’'`][^ ]*" for kind, stem in KINDS.items())
MEANT, NAMED = rf"(?:^| )(?:{NAMES})(?= |\z)", rf"(?s)(?:^| ){PUBLISHED} ([^ ].*? (?:{NAMES}))(?= |\z)"


def _target(sentence: Column) -> Column:
    """struct<meant, name>: whether a sentence speaks of a regulation that it amends, and the name of the one it says
    was published, null without. A bracket between the noun and its ending is taken out.

    Each pattern is tried once, and only on sentences that hold a word of it.
    """
    def name(found: Column) -> Column:
        ends = F.substring_index(found, " ", -1)
        kind = F.coalesce(*[F.when(ends.startswith(stem), kind) for kind, stem in KINDS.items()])
        return F.concat(F.substr(found, F.lit(1), F.char_length(found) - F.char_length(ends)), kind)

    def of(said: Column) -> Column:
        may = reduce(or_, [F.contains(said, F.lit(stem)) for stem in KINDS.values()])
        published = F.when(may & F.contains(said, F.lit(PUBLISHED)), let(F.regexp_extract(said, NAMED, 1), name))
        return F.struct((may & said.rlike(MEANT)).alias("meant"), published.alias("name"))

    bare = lambda said: F.when(F.contains(said, F.lit("(")), F.regexp_replace(said, r" ?\([^()]*\) ?(?=[’'`])", "")).otherwise(said)
    return let(let(let(sentence, lambda said: F.trim(single_blanks(said, feeds=True))), bare), of)


def extract_amendments(docs: DataFrame) -> DataFrame:
    """A row per record: doc_id, article, amending_article, rec (from 0 within its article), regulation, then RECORD.

    Lists of targets give a record each. Levels a sentence leaves out come from the operation before it in the article.
    The regulation is the one named last; an article that neither names one nor speaks of a regulation gives nothing.
    A null or empty text has no records; repeated doc_ids are one text; other columns are ignored.
    """
    rows = amending_articles(docs)
    rows = rows.withColumn("target", _target(F.col("sentence")))
    rows = rows.withColumn("regulation", F.last("target.name", True).over(W.partitionBy("doc_id").orderBy("article")))
    rows = rows.where(F.col("target.meant") & F.col("sentence").rlike("miş|mış|düzenlemeler"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = zip(b.column("sentence").to_pylist(), b.column("block").to_pylist(), strict=True)
            found = pa.array([article_records(s, t) for s, t in said], pa.list_(_STRUCT))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), found], names=[*keys, "records"])

    keys = ["doc_id", "article", "amending_article", "regulation"]
    kinds = dict(rows.dtypes)
    found = rows.select(*keys, "sentence", "block").mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", records array<struct<{RECORD.replace(' ', ':').replace(',:', ', ')}>>")
    return found.select(*keys[:3], "regulation", F.posexplode("records").alias("rec", "r")).select("doc_id", "article", "amending_article", "rec", "regulation", "r.*")
