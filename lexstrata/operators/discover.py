"""Gazette discovery over tables of fetched index pages: links of amendments and originals, and where to look for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import collapse, gazette_norm, gazette_ref, issue_number_of_page
from lexstrata.operators.grams import contained

LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
DATED = r"(?s)(\d{1,2}/\d{1,2}/\d{4})\s+tarihli\s+ve\s+(\d+)(?:\s+sayılı)?((?:(?!\d{1,2}/\d{1,2}/\d{4}).){0,160})"


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a row per anchor: href and title, tags aside. Pages without anchors, or without html, have no row; repeated
    pages give theirs each."""
    found = lambda i: F.regexp_extract_all(html, F.lit(LINK), F.lit(i))
    rows = pages.withColumn("_link", F.explode(F.arrays_zip(found(1).alias("href"), found(2).alias("title"))))
    return rows.select(*pages.columns, F.col("_link.href").alias("href"), collapse(F.regexp_replace("_link.title", "<[^>]*>", " ")).alias("title"))


def amendment_links(found: DataFrame, names: DataFrame | Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """found with source: links that bear any of a source's names and speak of a change. A link may serve several sources.

    names: a table (source, name), or pairs of a source and its names. See name_links for how they meet.
    """
    return _matched(found, names, lambda t: F.contains(t, F.lit("DEĞİŞİKLİK")))


def original_links(found: DataFrame, names: DataFrame | Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """found with source: links that bear a source's name and neither change nor repeal anything."""
    return _matched(found, names, lambda t: ~F.contains(t, F.lit("DEĞİŞİKLİK")) & ~F.contains(t, F.lit("YÜRÜRLÜKTEN")))


def name_links(titles: DataFrame, names: DataFrame) -> DataFrame:
    """title, source: the distinct pairs of titles (title) and names (source, name) of which the title contains the name,
    both without regard to case and spaces.

    Each name is kept under its rarest gram among the titles, and titles ask with their grams, so that no name is tried on
    titles that share nothing with it. Equal titles and equal names are looked up once. Null or empty names match nothing.
    """
    said = titles.where("title is not null").select("title", gazette_norm(F.col("title")).alias("text")).distinct()
    keyed = lambda c: F.md5(F.col(c).cast("binary"))
    called = names.where("name is not null and source is not null").select("source", gazette_norm(F.col("name")).alias("text")).distinct()
    hit = contained(said.select(keyed("text").alias("id"), "text").distinct(), called.select(keyed("text").alias("id"), "text").distinct())
    out = hit.join(said.select(keyed("text").alias("long_id"), "title"), "long_id").join(called.select(keyed("text").alias("short_id"), "source"), "short_id")
    return out.select("title", "source").distinct()


def _matched(found: DataFrame, names: DataFrame | Sequence[tuple[str, Sequence[str]]], ok) -> DataFrame:
    if not isinstance(names, DataFrame):
        names = found.sparkSession.createDataFrame([(s, k) for s, keys in names for k in keys], "source string, name string")
    rows = found.where(ok(gazette_norm(F.col("title"))))
    return rows.join(name_links(rows.select("title"), names), "title").select(*found.columns, "source")


def find_urls(refs: DataFrame, matched: DataFrame, days: int = 5) -> DataFrame:
    """refs (source, day, repeat) with href, page_day, page_repeat: where the amending text of a reference stands.

    matched: links with source, day and repeat of their page. The reference's own page goes first, then the repeated
    issues of that day in order, then the days before it, nearest first; the first link of the best page counts. A
    reference without any has nulls. Each reference offers only the days of its window, so the join is on equal days.
    A row for each row of refs, repeated ones too; null sources or days find nothing; no rows give none.
    """
    wanted = refs.select("source", "day", "repeat", F.explode(F.sequence(F.date_sub("day", days), F.col("day"))).alias("page_day"))
    pages = matched.select("source", F.col("day").alias("page_day"), F.col("repeat").alias("page_repeat"), "href")
    back = F.date_diff("day", "page_day")
    rank = F.when((back == 0) & (F.col("page_repeat") == F.col("repeat")), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).when(back == 0, F.struct(F.lit(1).alias("a"), F.col("page_repeat").alias("b"))).when(F.col("page_repeat") == 0, F.struct(F.lit(2).alias("a"), back.alias("b")))
    best = wanted.join(pages, ["source", "page_day"]).withColumn("_rank", rank).where("_rank is not null").groupBy("source", "day", "repeat").agg(F.min(F.struct("_rank", "href", "page_day", "page_repeat")).alias("x"))
    return refs.join(best.select("source", "day", "repeat", "x.href", "x.page_day", "x.page_repeat"), ["source", "day", "repeat"], "left")


def corrected_numbers(found: DataFrame, pages: DataFrame) -> DataFrame:
    """found (page_day, number) with the issue number that the page of that day (day, html) gives, where it gives one."""
    said = pages.select(F.col("day").alias("page_day"), issue_number_of_page(F.col("html")).alias("_said")).groupBy("page_day").agg(F.max("_said").alias("_said"))
    return found.join(said, "page_day", "left").withColumn("number", F.coalesce("_said", "number")).drop("_said")


def original_ref(text: Column, name: Column) -> Column:
    """The gazette reference of the regulation an amending text names: the first reference followed, before the next date
    and within 160 characters, by the first three words of the name; else the first one; null without any."""
    refs = F.regexp_extract_all(text, F.lit(DATED), F.lit(0))
    words = F.array_join(F.slice(F.split(gazette_norm(name), " "), 1, 3), " ")
    mine = F.filter(refs, lambda r: F.contains(gazette_norm(r), words))
    chosen = F.coalesce(F.get(mine, F.lit(0)), F.get(refs, F.lit(0)))
    return gazette_ref(F.regexp_replace(chosen, r"^(\d{1,2}/\d{1,2}/\d{4})\s+tarihli\s+ve\s+(\d+)", "$1-$2"))


def find_originals(amendments: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (source, name) with ref: the original's reference as the source's first amending text (source, seq, text) gives it."""
    first = amendments.groupBy("source").agg(F.min_by("text", "seq").alias("_text"))
    return sources.join(first, "source", "left").withColumn("ref", original_ref(F.col("_text"), F.col("name"))).drop("_text")
