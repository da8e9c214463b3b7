"""The registered queries for the regulation operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import text as t
from lexstrata.operators import dataset, discover, evaluate, evidence, replay, structure, table_function, verify
from lexstrata.operators.extract import amending_articles, extract_amendments
from lexstrata.plans import forms, rendered
from lexstrata.sources import documents as src
from lexstrata.sources import robots
from lexstrata.sources.shared import written

DAY = datetime.date(1996, 6, 30)
P, R = f"WITH {rendered.PRICES}", f"WITH {rendered.PRICES}, {rendered.RECORDS}"
ORACLES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"{P}, state AS ({rendered.state("date <= DATE '1996-06-30'")}), u AS ({rendered.UNITS}) SELECT source, article::VARCHAR AS key, fikra, bent, text FROM u")
def article_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every article on a day: parse, extract, replay, as-of."""
    return replay.as_of(rendered.versions(rendered.prices(spark, sf_dir)), DAY).select("source", "key", "fikra", "bent", "text")


@query(f"""{P}, w AS (SELECT row_number() OVER () AS nth, source AS s, article AS a, date AS day FROM p), q AS (SELECT * FROM w JOIN p ON p.source = s AND p.article = a AND (p.step = 0 OR p.date <= day)),
  state AS ({rendered.state("TRUE").replace("FROM p GROUP BY source, article", "FROM q GROUP BY source, article, nth, day").replace("SELECT source, article,", "SELECT source, article, nth, day,")}), u AS ({rendered.UNITS.replace("SELECT source, article,", "SELECT source, article, nth, day,")})
  SELECT source, article::VARCHAR AS key, day::VARCHAR AS day, fikra, bent, text FROM u""")
def orders_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the units of its article as they stood on its day: one interval join for all days."""
    p = rendered.prices(spark, sf_dir)
    asked = p.select("source", F.col("article").cast("string").alias("key"), F.col("date").alias("day"))
    return replay.as_of_many(rendered.versions(p), asked).select("source", "key", F.col("day").cast("string").alias("day"), "fikra", "bent", "text")


@query(f"""{P}, state AS ({rendered.state("TRUE")}), t AS (SELECT source, article, v4 FROM state),
  u AS (SELECT source, article, string_agg(CASE WHEN bent IS NULL THEN '(' || fikra || ') ' ELSE bent || ') ' END || text, chr(10) ORDER BY fikra, bent NULLS FIRST) AS body FROM ({rendered.UNITS}) GROUP BY ALL)
  SELECT source, string_agg('Tutar ' || v4 || chr(10) || 'MADDE ' || article || ' – ' || body, chr(10) ORDER BY article) AS text FROM u JOIN t USING (source, article) GROUP BY source""")
def last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every regulation after all its amendments, titles included."""
    return replay.full_version(replay.articles_at(rendered.versions(rendered.prices(spark, sf_dir))))


@query(f"""{R} SELECT source, seq, rec, article::VARCHAR AS madde, fikra, bent, cumle, operation, unit, old_text, new_text, anchor_text, anchor_position, 'normal' AS madde_type, 'Örnek Yönetmelik' AS regulation FROM records""")
def extracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.records(rendered.prices(spark, sf_dir))
    return rows.select("source", "seq", "rec", "madde", "fikra", "bent", "cumle", "operation", "unit", "old_text", "new_text", "anchor_text", "anchor_position", "madde_type", "regulation")


@query(f"{R}, {rendered.STATUS} SELECT source, seq, rec, status FROM statuses")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record against the consolidated text, excused by later records of its place."""
    return rendered.verified(rendered.prices(spark, sf_dir)).select("source", "seq", "rec", "status")


@query(f"""{R}, {rendered.STATUS} SELECT source, count(*) AS records, count(*) FILTER (status = 'uyumlu') AS uyumlu, count(*) FILTER (status = 'sonradan_degisti') AS sonradan_degisti,
         CASE WHEN count(*) FILTER (status = 'uyumlu') > 0 THEN 1.0::DOUBLE END AS oran FROM statuses GROUP BY ROLLUP (source)""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.summary(rendered.verified(rendered.prices(spark, sf_dir))).select("source", "records", "uyumlu", "sonradan_degisti", "oran")


@query(f"""{P}, state AS ({rendered.state("FALSE")}), u AS ({rendered.UNITS})
  SELECT source AS doc_id, article::VARCHAR AS key, 'Tutar sıfır' AS title, 'BİRİNCİ BÖLÜM' AS section, 'Genel Hükümler' AS section_title, fikra, bent, text FROM u""")
def parsed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.parse_units(rendered.originals(rendered.prices(spark, sf_dir))).select("doc_id", "key", "title", "section", "section_title", "fikra", "bent", "text")


@query(ORACLES["parsed_units"])
def units_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of all originals by the SQL table function alone."""
    table_function.register(spark)
    rendered.originals(rendered.prices(spark, sf_dir)).createOrReplaceTempView("rendered_originals")
    return spark.sql("SELECT o.doc_id, u.key, u.title, u.section, u.section_title, u.fikra, u.bent, u.text FROM rendered_originals o, LATERAL parse_units(o.text) u")


@query(f"""{P}, state AS ({rendered.state("TRUE")}), u AS ({rendered.UNITS})
  SELECT source AS doc_id, article::VARCHAR AS key, string_agg(CASE WHEN bent IS NULL THEN '(' || fikra || ') ' ELSE bent || ') ' END || text, ' ' ORDER BY fikra, bent NULLS FIRST) AS text FROM u GROUP BY ALL""")
def article_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = structure.full_texts(structure.parse_units(rendered.originals(rendered.prices(spark, sf_dir), last=True)))
    return full.where("fikra is null").select("doc_id", "key", F.col("full").alias("text"))


@query("SELECT DISTINCT (c_custkey // 20)::VARCHAR AS doc_id, 'ÖRNEK YÖNETMELİK' AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def regulation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.document_titles(rendered.originals(rendered.prices(spark, sf_dir)))


@query(f"""{R} SELECT source, article::VARCHAR AS key, seq, rec, date::VARCHAR AS date, CASE WHEN operation = 'BIRIM_KALDIR' AND nth > 1 THEN 'hedef_bulunamadi' ELSE 'uygulandi' END AS status FROM records""")
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = replay.apply_log(rendered.versions(rendered.prices(spark, sf_dir)))
    return log.select("source", "key", "seq", "rec", F.col("date").cast("string").alias("date"), "status")


@query(f"""{R} SELECT source, seq, min(date)::VARCHAR AS date, count(*) FILTER (NOT (operation = 'BIRIM_KALDIR' AND nth > 1)) AS applied, count(*) FILTER (operation = 'BIRIM_KALDIR' AND nth > 1) AS failed FROM records GROUP BY ALL""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per amending text, with what it could and could not apply."""
    versions = replay.chain(replay.apply_log(rendered.versions(rendered.prices(spark, sf_dir))))
    return versions.select("source", "seq", F.col("date").cast("string").alias("date"), "applied", F.size("failed").cast("bigint").alias("failed"))


_COMPARED = f"""{P}, a AS ({rendered.state("FALSE")}), z AS ({rendered.state("TRUE")}),
  ua AS ({rendered.UNITS.replace("FROM state", "FROM a AS state")}), uz AS ({rendered.UNITS.replace("FROM state", "FROM z AS state")}),
  ta AS (SELECT source, article, string_agg(CASE WHEN bent IS NULL THEN '' ELSE bent || ') ' END || text, ' ' ORDER BY fikra, bent NULLS FIRST) AS said FROM ua GROUP BY ALL),
  tz AS (SELECT source, article, string_agg(CASE WHEN bent IS NULL THEN '' ELSE bent || ') ' END || text, ' ' ORDER BY fikra, bent NULLS FIRST) AS said FROM uz GROUP BY ALL),
  c AS (SELECT source, article::VARCHAR AS key, lower(replace(ta.said, 'İ', 'i̇')) AS x, lower(replace(tz.said, 'İ', 'i̇')) AS y FROM ta JOIN tz USING (source, article)),
  n AS (SELECT source, key, ch, count(*) FILTER (side = 'x') AS nx, count(*) FILTER (side = 'y') AS ny FROM (SELECT source, key, 'x' AS side, unnest(string_split(x, '')) AS ch FROM c UNION ALL SELECT source, key, 'y', unnest(string_split(y, '')) FROM c) GROUP BY ALL),
  m AS (SELECT source, key, sum(least(nx, ny)) AS shared FROM n GROUP BY ALL),
  b AS (SELECT source, key, length(x) AS n_ours, length(y) AS n_official, x = y AS same, 2.0 * least(length(x), length(y)) / (length(x) + length(y)) AS by_length, 2.0 * shared / (length(x) + length(y)) AS by_count FROM c JOIN m USING (source, key))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.prices(spark, sf_dir)
    return replay.compare_articles(replay.official_articles(rendered.originals(p)), replay.official_articles(rendered.originals(p, last=True)))


@query(f"""{_COMPARED} SELECT source, key, same FROM b""")
def article_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original against consolidated articles: which are word for word the same."""
    return _compared(spark, sf_dir).select("source", "key", (F.col("ratio") == 1.0).alias("same")).fillna(False, ["same"])


@query(f"""{_COMPARED} SELECT source, key, n_ours::INT AS n_ours, n_official::INT AS n_official, round(CASE WHEN same THEN 1 WHEN by_length < 0.98 THEN by_length ELSE by_count END, 9)::DOUBLE AS bound,
  CASE WHEN same THEN 'same' WHEN by_length < 0.98 OR by_count < 0.98 THEN 'below' ELSE 'open' END AS settled, CASE WHEN same THEN 'ayni' WHEN by_length < 0.98 OR by_count < 0.98 THEN 'farkli' ELSE 'acik' END AS durum FROM b""")
def article_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original against consolidated articles: their lengths, the bound of their ratio, and what it settles (else 'acik')."""
    n = lambda c: F.char_length(t.version_norm(F.col(c)))
    rows = _compared(spark, sf_dir)
    return rows.select("source", "key", n("ours").alias("n_ours"), n("official").alias("n_official"), F.round("bound", 9).alias("bound"), "settled", F.when(F.col("settled") == "open", "acik").otherwise(F.col("durum")).alias("durum"))


@query()
def article_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original against consolidated articles by sequence similarity, with the outcome."""
    return _compared(spark, sf_dir).select("source", "key", "ratio", "durum")


@query(f"""{R}, l AS (SELECT source, seq, rec, operation || ' | madde=' || article || coalesce(' fikra=' || fikra, '') || coalesce(' bent=' || bent, '') || coalesce(' cumle=' || cumle, '') || ' | birim=' || unit
    || coalesce(' | eski=' || old_text, '') || CASE WHEN operation LIKE 'BIRIM%' THEN '' ELSE coalesce(' | yeni=' || new_text, '') END || coalesce(' | capa=' || anchor_text, '') || coalesce(' | konum=' || anchor_position, '') AS line FROM records)
  SELECT source, seq, 1 AS article, string_agg(line, ' ;; ' ORDER BY rec) AS target FROM l GROUP BY source, seq UNION ALL SELECT source, seq, 2, 'YOK' FROM r""")
def seq2seq_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amending article's records as the target of a sequence model."""
    p = written(rendered.prices(spark, sf_dir))
    texts = rendered.amendments(p)
    rows = dataset.seq2seq(evaluate.build_examples(amending_articles(texts), rendered.records(p).withColumn("status", F.lit("uyumlu"))))
    return rows.join(texts.select("doc_id", "source", "seq"), "doc_id").select("source", "seq", F.col("article").cast("int").alias("article"), "target")


@query(f"""{R}, {rendered.STATUS}, e AS (SELECT source, seq, CASE WHEN bool_and(status = 'uyumlu') THEN 'dogrulanmis' ELSE 'kismen' END AS quality FROM statuses GROUP BY source, seq UNION ALL SELECT source, seq, 'kayitsiz' FROM r)
  SELECT CASE source WHEN '3' THEN 'test' WHEN '5' THEN 'dev' ELSE 'train' END AS split, quality, count(*) AS n FROM e GROUP BY ROLLUP (split, quality)""")
def dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amending articles as labelled examples, counted by split and quality, with totals."""
    p = rendered.prices(spark, sf_dir)
    texts = rendered.amendments(p)
    examples = evaluate.build_examples(amending_articles(texts), rendered.verified(p)).join(texts.select("doc_id", "source"), "doc_id")
    splits = spark.createDataFrame([("3", "test"), ("5", "dev")], "source string, split string")
    return evaluate.split_stats(evaluate.with_split(examples, splits))


@query(f"""{R}, later AS (SELECT a.source, a.seq, a.rec, arg_min(b.seq, b.seq) AS later_seq FROM records a JOIN records b ON a.source = b.source AND a.article = b.article AND b.seq > a.seq
     AND length(a.new_text) >= 8 AND length(coalesce(b.old_text, b.anchor_text)) >= 8 AND (contains(lower(a.new_text), lower(coalesce(b.old_text, b.anchor_text))) OR contains(lower(coalesce(b.old_text, b.anchor_text)), lower(a.new_text))) GROUP BY ALL)
  SELECT * FROM later""")
def superseded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record the first later one of its article that quotes its new text."""
    return evidence.quote_evidence(rendered.records(rendered.prices(spark, sf_dir))).select("source", "seq", "rec", "later_seq")


@query("""WITH g AS (SELECT l_suppkey, l_partkey % 50 AS k, count(*) AS g FROM lineitem GROUP BY ALL),
  p AS (SELECT l_suppkey, l_orderkey % 50 AS k, count(*) AS p FROM lineitem GROUP BY ALL),
  j AS (SELECT coalesce(g.l_suppkey, p.l_suppkey) AS l_suppkey, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM g FULL JOIN p ON g.l_suppkey = p.l_suppkey AND g.k = p.k),
  s AS (SELECT l_suppkey, sum(least(p, g))::BIGINT AS tp, sum(p)::BIGINT AS n_pred, sum(g)::BIGINT AS n_gold FROM j GROUP BY ALL)
  SELECT *, round(tp / greatest(n_pred, 1), 3) AS precision, round(tp / greatest(n_gold, 1), 3) AS recall,
    round(coalesce(2 * (tp / greatest(n_pred, 1)) * (tp / greatest(n_gold, 1)) / nullif(tp / greatest(n_pred, 1) + tp / greatest(n_gold, 1), 0), 0), 3) AS f1 FROM s""")
def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    return evaluate.prf(items.withColumn("k", F.col("l_orderkey") % 50), items.withColumn("k", F.col("l_partkey") % 50), ["l_suppkey"], ["k"])


@query(r"""SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g'))) AS plain, upper(translate(replace(text, 'ß', 'ss'), 'iı', 'İI')) AS turkish,
  trim(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '\s+(Yönetmeliği|Yönetmelik|Tebliği|Tebliğ)$', '')) AS keyword FROM conversations""")
def text_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", t.plain_norm(F.col("text")).alias("plain"), t.tr_upper(F.col("text")).alias("turkish"), t.keyword_of(F.col("text")).alias("keyword"))


@query("""SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, (o_custkey % 7)::VARCHAR AS number, (o_custkey % 3)::INT AS repeat,
  printf('%d/%02d/%d%02d%02d', year(o_orderdate), month(o_orderdate), year(o_orderdate), month(o_orderdate), day(o_orderdate)) || CASE WHEN o_custkey % 3 > 0 THEN 'M' || o_custkey % 3 ELSE '' END AS path FROM orders""")
def gazette_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References rendered into notes and read back, distinct, with the path of their index page."""
    o = _read(spark, sf_dir, "orders")
    repeat = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit(" ("), (F.col("o_custkey") % 3).cast("string"), F.lit(". Mükerrer)"))).otherwise("")
    note = F.concat(F.lit("(Değişik:RG-"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("-"), (F.col("o_custkey") % 7).cast("string"), repeat, F.lit(")"))
    refs = o.select(t.gazette_ref(note).alias("ref")).distinct()
    return refs.select("ref.*", t.index_path(F.col("ref")).alias("path"))


@query("""WITH d AS (SELECT DISTINCT o_orderkey AS ref, o_orderdate::DATE AS day FROM orders), p AS (SELECT DISTINCT l_shipdate::DATE AS page_day FROM lineitem)
  SELECT ref, day::VARCHAR AS day, max(page_day)::VARCHAR AS page_day FROM d LEFT JOIN p ON page_day BETWEEN day - 5 AND day - 1 GROUP BY ref, day""")
def issue_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reference the last issue within the days before it."""
    refs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.to_date("o_orderdate").alias("day"))
    found = src.pages_before(refs, _read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("page_day")), 5)
    return found.select("ref", F.col("day").cast("string").alias("day"), F.col("page_day").cast("string").alias("page_day"))


@query("""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '([?&])(utm_\\w+|ref)=[^&]*', '\\1', 'g'), '[?&]$', ''), '/$', '') AS url FROM pages)
  SELECT url, min(page_id) AS page_id FROM n GROUP BY url""")
def first_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").groupBy(src.normalise_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<header\b[^>]*>.*?</header>|<footer\b[^>]*>.*?</footer>|<!--.*?-->|<![^>]*>', '', 'g') AS x FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g'), '(?i)</(p|div|li|tr|table|section|article|h[1-6])\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS x FROM b)
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM c""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", t.tidy(src.html_to_lines("html")).alias("text"))


@query("""WITH x AS (SELECT conv_id AS doc, turn AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
  k AS (SELECT *, CASE WHEN length(line) <= 90 AND trim(line) <> '' AND NOT regexp_matches(trim(line), '^((GEÇİCİ |EK )?MADDE\\s+\\d|\\(\\d+\\)|[a-zçğıöşü]{1,3}\\)|\\d+\\)|[A-ZÇĞİÖŞÜ ]+(BÖLÜM|KISIM)$)')
        THEN lower(trim(regexp_replace(line, '\\d{1,4}', '', 'g'))) END AS key FROM x),
  n AS (SELECT doc, count(DISTINCT page) AS pages FROM x GROUP BY doc),
  o AS (SELECT k.doc, key FROM k JOIN n ON k.doc = n.doc WHERE key IS NOT NULL GROUP BY k.doc, key, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, floor(pages * 0.5))),
  f AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc = k.doc AND o.key = k.key))
  SELECT c.conv_id AS doc, c.turn AS page, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text FROM conversations c LEFT JOIN f ON f.doc = c.conv_id AND f.page = c.turn GROUP BY c.conv_id, c.turn""")
def without_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.remove_repeats(_read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


@query("""WITH r AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority, l_linenumber FROM lineitem)
  SELECT l_orderkey, priority, l_linenumber FROM r QUALIFY priority = min(priority) OVER (PARTITION BY l_orderkey)""")
def hybrid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the rows of the first system that has any."""
    priority = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return evaluate.hybrid(_read(spark, sf_dir, "lineitem").select("l_orderkey", priority.alias("priority"), "l_linenumber"), ["l_orderkey"])


@query("""SELECT l_orderkey, l_partkey % 5 AS k, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL""")
def first_of_equal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("k"), "l_linenumber")
    return evaluate.keep_first(rows, ["l_orderkey"], ["k"], "l_linenumber")


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS title FROM pages),
  t AS (SELECT page_id, href, trim(regexp_replace(upper(translate(replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), 'ß', 'ss'), 'iı', 'İI')), '[\s\x{A0}]+', ' ', 'g')) AS title FROM a),
  n AS (SELECT DISTINCT item_id::VARCHAR AS source, trim(regexp_replace(upper(translate(replace(regexp_extract(text, '[^\s]+'), 'ß', 'ss'), 'iı', 'İI')), '[\s\x{A0}]+', ' ', 'g')) AS name FROM benchmark)
  SELECT page_id, href, source FROM t JOIN n ON contains(title, name) AND name <> ''""")
def links_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages whose title bears a name of another table, by the rarest gram of each name."""
    names = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("source"), F.regexp_extract("text", r"\S+", 0).alias("name"))
    return discover.original_links(discover.links(_read(spark, sf_dir, "pages")), names).select("page_id", "href", "source")


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS p FROM pages),
  v AS (SELECT page_id, length(host) % 5 AS kind, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM u WHERE host <> ''),
  r(kind, prefix, allow) AS (VALUES (0, '/', TRUE), (1, '/', FALSE), (2, '/en/', FALSE), (2, '/en/6', TRUE), (2, '/fr/8', FALSE), (3, '/es/', TRUE), (3, '/de/', FALSE), (4, '/en/', FALSE), (4, '/en/6', TRUE), (4, '/fr/8', FALSE)),
  b AS (SELECT page_id, arg_max(allow, length(prefix)) AS allow, arg_max(prefix, length(prefix)) AS rule FROM v JOIN r ON v.kind = r.kind AND starts_with(path, prefix) GROUP BY page_id)
  SELECT page_id, CASE WHEN v.page_id IS NULL THEN FALSE ELSE coalesce(allow, TRUE) END AS allowed, rule FROM pages LEFT JOIN v USING (page_id) LEFT JOIN b USING (page_id)""")
def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address against the robots.txt of its host, rendered by the length of the host's name."""
    pages = _read(spark, sf_dir, "pages")
    host = robots.host_of(F.col("url"))
    kind, everyone = F.char_length("host") % 5, "User-agent: *\nDisallow: /en/\nAllow: /en/6 # some\nDisallow: /fr/8\n\nUser-agent: other\nDisallow: /\n"
    own = "User-agent: lexbot\nUser-agent: third\nDisallow: /es/\nAllow: /es/\nDisallow:\nDisallow: /de/\n"
    fetched = pages.select(host.alias("host")).where("host is not null").distinct().select("host", F.when(kind == 0, 404).when(kind == 1, 503).otherwise(200).alias("status"), F.concat(F.lit(everyone), F.when(kind == 3, own).otherwise("")).alias("text"))
    return robots.allowed(pages, fetched, "LexBot").select("page_id", "allowed", "rule")


@query(forms.RECORDS)
def amendment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of amending texts in every form that the other rendered texts do not take."""
    rows = extract_amendments(forms.amendments(spark, sf_dir))
    return rows.select("doc_id", "rec", "operation", "unit", "madde_type", "madde", "fikra", "bent", "alt_bent", "cumle", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after")


@query(f"""WITH {forms.ANNOTATED} SELECT doc_id, u.key, u.fikra, u.bent, u.alt_bent, u.text || x || u.tail AS text, u.type, CASE u.type WHEN 'Dipnot' THEN 'dipnot:3' ELSE 'RG-' || d || '-' || u.before || n || u.after END AS source, u.head
  FROM o, (VALUES ('1', 1, NULL, NULL, 'Tutar ', ' liradır.', 'Ek', '', '', TRUE), ('1', 1, NULL, NULL, 'Tutar ', ' liradır.', 'Dipnot', '', '', FALSE), ('1', 1, 'a', NULL, 'Genel ', ',', 'Ek', '', '', TRUE), ('1', 1, 'a', NULL, 'Genel ', ',', 'Değişik', '1', ' 2. Mükerrer', FALSE),
    ('1', 1, 'a', 1, 'İlk ', ',', 'Ek', '', '', TRUE), ('2', 1, NULL, NULL, 'Son ', '.', 'Mülga', '2', '', FALSE)) u(key, fikra, bent, alt_bent, text, tail, type, before, after, head)""")
def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of all units, sub-items too, and of their articles' heads (head)."""
    own = forms.annotated(spark, sf_dir).select("doc_id", t.strip_apparatus(F.col("text")).alias("text"))
    each = F.concat(F.transform("notes", lambda n: F.struct(n["type"].alias("type"), n["source"].alias("source"), F.lit(False).alias("head"))), F.transform("article_notes", lambda n: F.struct(n["type"].alias("type"), n["source"].alias("source"), F.lit(True).alias("head"))))
    return structure.parse_units(own).select("doc_id", "key", "fikra", "bent", "alt_bent", "text", F.inline(each))


@query(f"""WITH {forms.ANNOTATED} SELECT doc_id, year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS day, u.before || n AS number, u.repeat FROM o, (VALUES ('', 0), ('1', 2), ('2', 0), ('3', 0)) u(before, repeat)""")
def note_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct gazette references of all notes and footnotes."""
    docs = forms.annotated(spark, sf_dir).select("doc_id", t.strip_apparatus(F.col("text")).alias("text"))
    return structure.annotation_refs(structure.parse_units(docs), structure.footnotes(docs)).select("doc_id", "ref.*")


@query(f"""WITH {forms.ANNOTATED} SELECT doc_id, u.nth, year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS day, u.before || n AS number, u.repeat FROM o, (VALUES (0, '', 0), (1, '1', 2), (2, '2', 0)) u(nth, before, repeat)""")
def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first publication (0) and those of the amendments (1, 2, ...) as publication tables say."""
    table = forms.annotated(spark, sf_dir).select("doc_id", t.publication_table(F.col("text")).alias("p"))
    return table.select("doc_id", F.posexplode(F.concat(F.array("p.first"), "p.amendments")).alias("nth", "ref")).select("doc_id", "nth", "ref.*")


@query(f"SELECT * EXCLUDE (new_text), CASE WHEN operation IN ('BIRIM_DEGISTIR', 'BIRIM_EKLE') THEN NULL ELSE new_text END AS new_text FROM ({forms.RECORDS})")
def targets_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every form as targets of a sequence model, and the records that these targets read as."""
    fields = ["operation", "unit", "madde_type", "madde", "fikra", "bent", "alt_bent", "cumle", "old_text", "new_text", "anchor_text", "anchor_position", "insert_after"]
    held = F.array_sort(F.collect_list(F.struct("rec", F.struct(*fields).alias("r"))))
    rows = extract_amendments(forms.amendments(spark, sf_dir)).groupBy("doc_id").agg(held.alias("held"))
    said = rows.select("doc_id", dataset.linearize(F.transform("held", lambda x: dataset.canonical(x["r"]))).alias("target"))
    return said.select("doc_id", F.posexplode(dataset.delinearize(F.col("target"))).alias("rec", "r")).select("doc_id", "rec", *[f"r.{c}" for c in fields])


@query(forms.INPUTS)
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sequence model reads of every amending article: its sentence and the lines below with quotes by name."""
    rows = dataset.model_input(amending_articles(forms.amendments(spark, sf_dir)))
    return rows.select("doc_id", F.col("article").cast("int").alias("article"), "input", F.size("quotes").alias("quotes"))


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS w, o_orderdate::DATE AS day, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS d, (20000 + o_orderkey % 9000)::VARCHAR AS n FROM orders)
  SELECT k, CASE WHEN k % 3 < 2 THEN n END AS of_index, n AS of_page, CASE WHEN k % 29 < 28 THEN repeat(substr('{t.ALPHABET}', (k % 29 + 2)::INT, 1), (k % 3 + 1)::INT) END AS next_letter, CASE k % 3 WHEN 0 THEN 'ılık ' WHEN 1 THEN 'ilk ' ELSE 'kural ' END || w AS lowered,
    CASE WHEN k % 4 > 0 THEN day::VARCHAR END AS day, CASE WHEN k % 2 = 0 THEN w || '/Ç' END AS article, k % 2 = 0 AS tombstone, '(1) Bir ' || w || chr(10) || 'devam|(2) İki' AS paragraphs, d || n AS digits, 'karar ' || w AS joined, w || ' söz' AS cleaned, 'Bir ' || w || '.|İki:|(2) Üç; dört.' AS to_show,
    CASE WHEN k % 2 = 0 THEN 'b) İki ' || w ELSE 'a) Bir ' || w || chr(10) || 'b) İki ' || w END AS item, CASE WHEN k % 40 BETWEEN 1 AND 39 THEN (k % 40)::INT END AS ordinal FROM o""")
def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small readings of texts that carry an order's key and day: issue numbers, letters, dates, numbers, marks, paragraphs."""
    k, word = F.col("k"), F.col("k").cast("string")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws("/", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")).alias("d"), (F.col("o_orderkey") % 9000 + 20000).cast("string").alias("n"))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    in_turn = lambda *texts: F.element_at(F.array(*[said(x) for x in texts]), (k % len(texts) + 1).cast("int"))
    letter = F.repeat(F.substr(F.lit(t.ALPHABET), (k % 29 + 1).cast("int"), F.lit(1)), (k % 3 + 1).cast("int"))
    names = sorted(t.ORDINALS, key=t.ORDINALS.get)
    return rows.select(
        "k", t.issue_number_of_index(in_turn(said("<b>10 Ocak Tarihli ve ", F.col("n"), " Sayılı</b>"), said("Sayı : ", F.col("n")), "Sayı : 12")).alias("of_index"), t.issue_number_of_page(said("<p>", F.col("d"), " <b>tarihli</b> ve ", F.col("n"), " sayılı Resmî Gazete</p>")).alias("of_page"),
        t.next_letter(letter).alias("next_letter"), t.tr_lower_first(said(in_turn("Ilık ", "İlk ", "Kural "), word)).alias("lowered"), t.day_of(F.when(k % 4 == 0, "31/2/2020").otherwise(F.col("d"))).cast("string").alias("day"), t.article_number(in_turn(said(word, "/Ç ncı madde"), "yok")).alias("article"),
        t.is_tombstone(said("MADDE ", word, " – (Mülga:RG-", F.col("d"), "-", F.col("n"), ")", in_turn("", " (1) Söz"))).alias("tombstone"), F.array_join(t.paragraph_blocks(said("önce\n(1) Bir ", word, "\ndevam\n(2) İki")), "|").alias("paragraphs"), t.rg_digits(said("RG-", F.col("d"), "-", F.col("n"))).alias("digits"),
        t.dehyphenate(said("ka-\nrar ", word)).alias("joined"), t.clean_block(said("“", word, "  söz”")).alias("cleaned"), F.array_join(t.diff_sentences(said("Bir ", word, ". İki: (2) Üç; dört.")), "|").alias("to_show"), t.pick_item(said("a) Bir ", word, "\nb) İki ", word), in_turn("b", "z")).alias("item"),
        t.ordinal(F.element_at(F.array(*map(F.lit, ["yok", *names])), (k % 40 + 1).cast("int"))).alias("ordinal"))


_DAYS = "o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS w, o_custkey, o_orderdate::DATE AS day, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS d, (20000 + o_orderkey % 9000)::VARCHAR AS n FROM orders)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, w (as text), o_custkey, d (the day as written), n (a gazette's number) of every order."""
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("w"), "o_custkey", F.concat_ws("/", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")).alias("d"),
        (F.col("o_orderkey") % 9000 + 20000).cast("string").alias("n"))


@query(f"""WITH {_DAYS} SELECT (o_custkey % 50)::VARCHAR AS source, w AS key, CASE WHEN k % 5 IN (0, 2) THEN 'ayni' WHEN k % 5 = 1 THEN 'farkli' WHEN k % 5 = 3 THEN 'resmide_yok' WHEN k % 2 = 0 THEN 'mulga_mezari' WHEN k % 3 = 0 THEN 'kaynak_tutarsizligi' ELSE 'bizde_yok' END AS durum FROM o""")
def article_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of two sides compared, with the reason where one side lacks them."""
    k, at = F.col("k"), [(F.col("o_custkey") % 50).cast("string").alias("source"), F.col("w").alias("key")]
    rows, said = _days(spark, sf_dir), F.concat(F.lit("Söz "), "w", F.lit(" söylendi."))
    official = F.when(k % 5 == 0, F.concat(F.lit("söz  "), "w", F.lit(" söylendi."))).when(k % 5 == 1, F.concat(F.lit("Bambaşka bir şey: "), "w")).when(k % 5 == 2, F.concat(F.lit("(Değişik:RG-1/1/2020-31000) "), said))
    official = official.when(k % 2 == 0, F.concat(F.lit("MADDE "), "w", F.lit(" – (Mülga:RG-1/1/2020-31000)"))).otherwise(said)
    found = replay.compare_articles(rows.where(k % 5 != 4).select(*at, said.alias("text")), rows.where(k % 5 != 3).select(*at, official.alias("text")), known=rows.where(k % 3 == 0).select(*at))
    return found.select("source", "key", "durum")


@query(f"""WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, n) AS i FROM (SELECT DISTINCT o_custkey, day, d, n FROM o)), a AS (SELECT o_custkey, k, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS i FROM o)
  SELECT a.o_custkey::VARCHAR AS source, a.k AS seq, day::VARCHAR AS date, d || '-' || n AS label FROM a LEFT JOIN r ON a.o_custkey = r.o_custkey AND a.i = r.i""")
def amendment_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day and reference of every amending text: of a source's references in order the one at its place."""
    rows = _days(spark, sf_dir).withColumn("source", F.col("o_custkey").cast("string"))
    refs = rows.select("source", t.gazette_ref(F.concat(F.lit("RG-"), "d", F.lit("-"), "n")).alias("ref"))
    found = replay.amendment_dates(refs, rows.select("source", F.col("k").alias("seq")))
    return found.select("source", "seq", F.col("date").cast("string").alias("date"), "label")


@query(f"""WITH {_DAYS} SELECT w AS source, CASE WHEN k % 4 > 0 THEN day::VARCHAR END AS date FROM o""")
def original_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each source was first published."""
    rows = _days(spark, sf_dir).select(F.col("w").alias("id"), F.when(F.col("k") % 4 > 0, F.concat("d", F.lit("-"), "n")).alias("original_ref"))
    return replay.original_dates(rows).select("source", F.col("date").cast("string").alias("date"))


@query(f"""WITH {_DAYS} SELECT w AS source, 'konsolide' AS role, 'https://www.ornek.example/anasayfa/MevzuatFihristDetayIframe?MevzuatTur=' || k % 9 || '&MevzuatNo=' || w || '&MevzuatTertip=' || CASE WHEN k % 2 = 0 THEN 5 ELSE 3 END AS url FROM o
  UNION ALL SELECT w, 'orijinal', 'https://ilk.example/' || w FROM o WHERE k % 4 > 0 AND k % 5 > 0
  UNION ALL SELECT w, 'degisiklik' || lpad(i::VARCHAR, 2, '0'), 'https://ek.example/' || w || '/' || i FROM (SELECT w, k, unnest(generate_series(0, k % 3 - 1)) AS i FROM o)""")
def fetch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be fetched for every source: consolidated texts again, others unless the manifest has them."""
    k, rows = F.col("k"), _days(spark, sf_dir)
    page = F.concat(F.lit("https://www.ornek.example/mevzuat?MevzuatNo="), "w", F.lit("&mevzuattur="), (k % 9).cast("string"), F.when(k % 2 == 0, "").otherwise("&MEVZUATTERTIP=3"))
    first = F.when(k % 4 > 0, F.concat(F.lit("https://ilk.example/"), "w"))
    later = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (k % 3).cast("int")), lambda i: F.concat(F.lit("https://ek.example/"), F.col("w"), F.lit("/"), i.cast("string")))
    jobs = src.download_jobs(rows.select(F.col("w").alias("id"), src.frame_url(page).alias("url"), first.alias("original_url"), later.alias("amendments")))
    manifest = rows.where(k % 5 == 0).select(first.alias("url")).union(rows.where(k % 7 == 0).select(src.frame_url(page)))
    return src.not_yet_fetched(jobs, manifest, refresh=True)


@query("""WITH i AS (SELECT n_nationkey::VARCHAR AS issue, n_nationkey AS place, (n_nationkey % 7)::VARCHAR AS source, n_nationkey % 3 AS op, (n_nationkey % 10)::VARCHAR AS madde, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey % 4 END AS fikra FROM nation),
  r AS (SELECT (o_custkey % 7)::VARCHAR AS source, o_orderkey AS seq, o_orderkey % 3 AS op, (o_orderkey % 10)::VARCHAR AS madde, o_orderkey % 4 AS fikra, CASE WHEN o_orderkey % 5 < 2 THEN 'uyumsuz' WHEN o_orderkey % 5 = 2 THEN 'hedef_bulunamadi' ELSE 'uyumlu' END AS status FROM orders),
  f AS (SELECT seq, arg_min(issue, place) AS issue FROM r JOIN i USING (source, op, madde) WHERE i.fikra IS NULL OR i.fikra = r.fikra GROUP BY seq)
  SELECT source, seq, CASE WHEN f.issue IS NOT NULL AND status <> 'uyumlu' THEN 'kaynak_tutarsizligi' ELSE status END AS status, CASE WHEN status <> 'uyumlu' THEN f.issue END AS issue FROM r LEFT JOIN f USING (seq)""")
def known_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed records told apart by known issues of their source."""
    n, k = F.col("n_nationkey"), F.col("o_orderkey")
    op = lambda x: F.element_at(F.array(*map(F.lit, ("IBARE_DEGISTIR", "BIRIM_EKLE", "BIRIM_KALDIR"))), (x % 3 + 1).cast("int")).alias("operation")
    issues = _read(spark, sf_dir, "nation").select(n.cast("string").alias("id"), n.alias("place"), (n % 7).cast("string").alias("source"), op(n), (n % 10).cast("string").alias("madde"), F.when(n % 2 == 1, n % 4).alias("fikra"))
    status = F.when(k % 5 < 2, "uyumsuz").when(k % 5 == 2, "hedef_bulunamadi").otherwise("uyumlu")
    rows = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("string").alias("source"), k.alias("seq"), F.lit(0).alias("rec"), op(k), (k % 10).cast("string").alias("madde"), (k % 4).alias("fikra"), status.alias("status"))
    return verify.relabel_known(rows, issues).select("source", "seq", "status", "issue")


@query(f"""WITH {_DAYS} SELECT w AS source, u.seq, u.rec, 'RG-' || d || '-' || u.before || n AS label, u.unit FROM o, (VALUES (1, 0, '1', 'madde 1 fıkra 1 bent a'), (2, 1, '2', 'madde 2 fıkra 1'), (3, 0, '', 'madde 1')) u(seq, rec, before, unit)""")
def noted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records overwritten later whose place bears a note of their own amending text, and where it stands."""
    own = forms.annotated(spark, sf_dir).select("doc_id", t.strip_apparatus(F.col("text")).alias("text"))
    kinds = "array<struct<seq:bigint,rec:int,madde:string,fikra:int,bent:string,before:string>>"
    asked = F.from_json(F.lit('[{"seq":1,"rec":0,"madde":"1","fikra":1,"bent":"a","before":"1"},{"seq":2,"rec":1,"madde":"2","fikra":1,"before":"2"},{"seq":3,"rec":0,"madde":"1","before":""},{"seq":4,"rec":0,"madde":"1","before":"9"}]'), kinds)
    rows = _days(spark, sf_dir).select(F.col("w").alias("source"), "d", "n", F.inline(asked)).withColumn("status", F.lit("sonradan_degisti"))
    labels = rows.select("source", "seq", F.concat(F.lit("RG-"), "d", F.lit("-"), "before", "n").alias("label"))
    return evidence.note_evidence(rows.drop("d", "n", "before"), labels, structure.parse_units(own)).select("source", "seq", "rec", "label", "unit")
