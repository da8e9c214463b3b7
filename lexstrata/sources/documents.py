"""Text sources: files of several formats, HTML, paged text, JSON lines, manifests and source tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lexstrata.functions.text import dehyphenate, tidy

#: Tags without text of their own, and tags that end a line.
SKIPPED = {"script", "style", "nav", "header", "footer"}
BLOCKS = {"p", "div", "li", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
STRUCTURAL = r"^(?:(?:GEÇİCİ |EK )?MADDE\s+\d|\(\d+\)|[a-zçğıöşü]{1,3}\)|\d+\)|[A-ZÇĞİÖŞÜ ]+(?:BÖLÜM|KISIM)$)"


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.sup = [], 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in SKIPPED
        if tag == "br" and not self.skip:
            self.out.append("\n")
        if tag == "sup":
            self.sup = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "sup" and self.sup is not None:
            if re.fullmatch(r"\s*\(?\d{1,3}\)?\s*", "".join(self.out[self.sup :])):
                del self.out[self.sup :]
            self.sup = None
        if tag in BLOCKS and not self.skip:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


@F.pandas_udf(StringType())
def html_to_lines(html: pd.Series) -> pd.Series:
    """The text of a page, a line per block; comments and declarations have none."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Lines()
        p.feed(page)
        p.close()
        return "".join(p.out)

    return html.map(one)


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8, or else windows-1254 with replacement."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("windows-1254", errors="replace")

    return content.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, text, source_type: HTML files as lines, others as they are; PDF files have a null text, as theirs
    comes in as pages by pdf_text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    kind = F.when(kind.isin("html", "htm"), "html").when(kind == "pdf", "pdf").otherwise("txt")
    utf8 = F.try_validate_utf8("content")
    rows = files.select("path", F.col("modificationTime").alias("modified"), kind.alias("source_type"), "content").withColumn("raw", F.when(F.col("source_type") != "pdf", F.coalesce(utf8, decode_text("content"))))
    said = F.when(F.col("source_type") == "html", html_to_lines("raw")).otherwise(F.col("raw"))
    return rows.select("path", "modified", tidy(dehyphenate(said)).alias("text"), "source_type")


def pdf_text(pages: DataFrame) -> DataFrame:
    """doc, text, source_type, pages_without_text, needs_ocr of extracted pages (doc, page, text), running heads removed."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    whole = remove_repeats(pages).groupBy("doc").agg(tidy(dehyphenate(body)).alias("text"))
    return whole.join(needs_ocr(pages), "doc").select("doc", "text", F.lit("pdf").alias("source_type"), "pages_without_text", "needs_ocr")


def newest(files: DataFrame, by: str = "source") -> DataFrame:
    """Of each group the text modified last (ties by path). No files give no rows."""
    return files.groupBy(by).agg(F.max_by("text", F.struct("modified", "path")).alias("text"))


#: The roles of stored files and their names.
ROLES = (("konsolide", "konsolide"), ("orijinal", "orijinal"), ("degisiklik", "degisiklik"))


def by_role(files: DataFrame) -> DataFrame:
    """source, role, seq, path, text of files stored as <source>/<role>[NN]_<name>.

    Of consolidated and original texts the newest counts, seq 0. Amending texts count from 1, by the number in their name,
    so that the hundredth follows the ninety-ninth; equal or missing numbers go by path. Other files are left out.
    """
    name, source = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    role = F.coalesce(*[F.when(name.startswith(prefix), kind) for prefix, kind in ROLES])
    rows = files.select(source.alias("source"), role.alias("role"), F.regexp_extract(name, r"^degisiklik(\d+)", 1).try_cast("int").alias("n"), "path", "modified", "text").where("role is not null")
    last = rows.where("role <> 'degisiklik'").groupBy("source", "role").agg(F.max(F.struct("modified", "path", "text")).alias("x")).select("source", "role", F.lit(0).alias("seq"), "x.path", "x.text")
    order = W.partitionBy("source").orderBy(F.col("n").asc_nulls_last(), "path")
    return last.unionByName(rows.where("role = 'degisiklik'").select("source", "role", F.row_number().over(order).alias("seq"), "path", "text"))


def remove_repeats(pages: DataFrame, share: float = 0.5, longest: int = 90) -> DataFrame:
    """(doc, page, text) without running heads and feet: short lines that, digits aside, are on half the pages and on
    three at least. Structural lines stay; documents of fewer than three pages stay as they are.

    A row per page: equal copies of a page are one, different texts of a page follow one another in the order of their
    hashes. A null text is an empty page; null docs or pages are kept as they are named; no rows give none.
    """
    rows = pages.select("doc", "page", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.lower(F.trim(F.regexp_replace("line", r"\d{1,4}", "")))
    short = (F.char_length("line") <= longest) & ~F.trim("line").rlike(STRUCTURAL) & (F.trim("line") != "")
    rows = rows.withColumn("key", F.when(short, key))
    n = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    often = rows.where("key is not null").groupBy("doc", "key").agg(F.count_distinct("page").alias("on")).join(n, "doc")
    often = often.where((F.col("pages") >= 3) & (F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share)))).select("doc", "key")
    kept = rows.join(often, ["doc", "key"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("of", "pos", "line"))), lambda x: x["line"]), "\n")
    kept = kept.groupBy(F.col("doc").alias("_doc"), F.col("page").alias("_page")).agg(text.alias("text"))
    each = pages.select("doc", "page").distinct()
    return each.join(kept, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")), "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))


def needs_ocr(pages: DataFrame, least: int = 50) -> DataFrame:
    """doc, pages, pages_without_text, needs_ocr: more than half the pages have hardly any text."""
    empty = F.count_if(F.char_length(F.trim("text")) < least)
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), empty.alias("pages_without_text"), (empty / F.count("*") > 0.5).alias("needs_ocr"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, required: str | None = None) -> DataFrame:
    """Tolerant: malformed lines, and lines without the required key, are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(required).isNotNull()) if required else rows


def not_yet_fetched(jobs: DataFrame, manifest: DataFrame, refresh: bool = False) -> DataFrame:
    """jobs (source, role, url) without those in the manifest; with refresh, consolidated texts are fetched again."""
    new = jobs.join(manifest.select("url").distinct(), "url", "left_anti")
    again = jobs.where((F.col("role") == "konsolide") & F.lit(refresh))
    return new.unionByName(again).distinct()


def download_jobs(sources: DataFrame) -> DataFrame:
    """source, role, url to fetch for sources (id, url, original_url, amendments array<string>): amending texts are numbered
    by their place in the list. Null addresses give no job."""
    one = lambda role, c: sources.select(F.col("id").alias("source"), F.lit(role).alias("role"), F.col(c).alias("url"))
    many = sources.select(F.col("id").alias("source"), F.posexplode("amendments").alias("i", "url")).select("source", F.format_string("degisiklik%02d", "i").alias("role"), "url")
    return one("konsolide", "url").unionByName(one("orijinal", "original_url")).unionByName(many).where("url is not null")


def manifest_rows(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """source, role, url, path, sha256, content_type, fetched_at of fetched (source, role, url, content, content_type,
    fetched_at); content already stored under a path adds no row."""
    kind, url = F.lower(F.coalesce("content_type", F.lit(""))), F.lower("url")
    ext = F.when(kind.contains("pdf") | url.rlike(r"\.pdf($|\?)"), ".pdf").when(kind.contains("html") | url.rlike(r"\.html?($|\?)"), ".html").when(kind.contains("text/plain") | url.rlike(r"\.txt($|\?)"), ".txt").otherwise(".bin")
    rows = fetched.withColumn("sha256", F.sha2("content", 256)).withColumn("path", F.concat(F.concat_ws("/", "source", F.concat(F.col("role"), F.lit("_"), F.substring("sha256", 1, 16))), ext))
    return rows.join(known.select("path").distinct(), "path", "left_anti").select("source", "role", "url", "path", "sha256", "content_type", "fetched_at").dropDuplicates(["path"])


def frame_url(url: Column) -> Column:
    """The address that holds a regulation's text, from that of the page around it: number, kind and series of the query,
    whatever their case, series 5 by default. Null where number or kind is missing."""
    key = lambda k: F.nullif(F.regexp_extract(url, rf"(?i)[?&]{k}=([^&#]+)", 1), F.lit(""))
    no, kind, series = key("mevzuatno"), key("mevzuattur"), F.coalesce(key("mevzuattertip"), F.lit("5"))
    base = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)
    return F.when(url.contains("MevzuatFihristDetayIframe"), url).when(no.isNotNull() & kind.isNotNull(), F.concat(base, F.lit("/anasayfa/MevzuatFihristDetayIframe?MevzuatTur="), kind, F.lit("&MevzuatNo="), no, F.lit("&MevzuatTertip="), series))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash, no tracking parameters; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"([?&])(?:utm_\w+|ref)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "&+", "&"), r"\?&", "?"), r"[?&]$", "")
    head = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://[^/?#]*", 0))
    return F.regexp_replace(F.concat(head, F.substr(bare, F.char_length(head) + 1)), "/$", "")


def upsert_sources(sources: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Changed rows replace or join the table; null fields of a change leave the old value."""
    both = sources.alias("s").join(changes.alias("c"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"c.{x}"), F.col(f"s.{x}")).alias(x) for x in sources.columns if x != key])


def move_to_split(splits: DataFrame, moved: DataFrame) -> DataFrame:
    """splits (split, source) where each source of moved (source, split) is in that split alone; the last by name counts."""
    new = moved.groupBy("source").agg(F.max("split").alias("split"))
    return splits.join(new.select("source"), "source", "left_anti").select("split", "source").distinct().unionByName(new.select("split", "source"))


def pages_before(refs: DataFrame, pages: DataFrame, days: int) -> DataFrame:
    """refs (ref, day) with the last page day in the window [day - days, day - 1], null without one.

    The join is on the day itself, of which each ref offers only those of its window. A row for each row of refs, repeated
    ones too; a null day finds nothing; no rows give none.
    """
    wanted = refs.select("ref", "day", F.explode(F.sequence(F.date_sub("day", days), F.date_sub("day", 1))).alias("page_day"))
    hit = wanted.join(pages.select("page_day").distinct(), "page_day").groupBy("ref", "day").agg(F.max("page_day").alias("page_day"))
    return refs.join(hit, ["ref", "day"], "left")


def latest_rows(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key by order; null keys are one key."""
    return rows.select(F.struct("*").alias("_row"), F.row_number().over(W.partitionBy(key).orderBy(order)).alias("_rank")).where("_rank = 1").select("_row.*")
