"""Secret scans over a trigram inverted index.

Each rule's pattern yields a Boolean trigram query: alternatives, each a set of trigrams that any match must hold in
lower case. The index has a posting (row, trigram) for every trigram some query names; intersecting postings gives
each row the rules it may match, and only those are verified. Rules without mandatory trigrams scan every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch, let, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    min_length: int = 0
    group: int = 0
    base: bool = False


RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 24, 0, True),  # the runs of [0-9a-f]+ that are long enough, runs being maximal
    SecretRule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    SecretRule("api_token", r"AIza[0-9A-Za-z_-]{35}", 39),
    SecretRule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 20),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 20),
    SecretRule("payment_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]{24,}", 32),
    SecretRule("mail_key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 69),
    SecretRule("host_token", r"glpat-[A-Za-z0-9_-]{20,}", 26),
    SecretRule("package_token", r"npm_[A-Za-z0-9]{36}", 40),
    SecretRule("web_hook", r"hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}", 40),
    SecretRule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{24,}", 30),
    SecretRule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$&*+,;=-]{3,64}@", 12),
)
MAX_ALTERNATIVES = 64
#: Postings of matching rows that are sent to all tasks; beyond that they are joined by row.
BROADCAST_ROWS = 500_000


def _atom(p: str, i: int) -> tuple[list[str], int]:
    """(the literal texts of the element of a pattern at i, '\0' for any other text; where the next one begins)."""
    c = p[i]
    if c == "(":
        start = p.index(":", i) + 1 if p[i + 1] == "?" else i + 1
        ways, end = _ways(p, start)
        return ways, end + 1
    if c == "[":
        end = p.index("]", i + 2)
        inside = p[i + 1 : end]
        plain = len(inside) <= 8 and not any(x in inside for x in "^-\\")
        return list(inside) if plain else ["\0"], end + 1
    if c == "\\":
        if p[i + 1] == "x":
            return [chr(int(p[i + 2 : i + 4], 16))], i + 4
        return ["\0" if p[i + 1].isalnum() else p[i + 1]], i + 2
    return ["\0" if c in ".^$" else c], i + 1


def _ways(p: str, i: int) -> tuple[list[str], int]:
    """(for each way through the branches its literal runs, '\0' between them; where the branch ends)."""
    out, ways = [], [""]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            out, ways, i = out + ways, [""], i + 1
            continue
        step, i = _atom(p, i)
        least, most = 1, 1
        if i < len(p) and p[i] in "?*+{":
            if p[i] == "{":
                end = p.index("}", i)
                low, _, high = p[i + 1 : end].partition(",")
                least, most, i = int(low), 1 if (high or low) == low == "1" else 2, end
            else:
                least, most = {"?": (0, 1), "*": (0, 2), "+": (1, 2)}[p[i]]
            i += 1
        if least == 0:
            step = ["", *step] if most == 1 else ["\0"]
        elif most > 1:
            step = [x + "\0" for x in step]
        if len(ways) * len(step) > MAX_ALTERNATIVES:
            step = ["\0"]
        ways = [a + b for a, b in product(ways, step)]
    return out + ways, i


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory lower-case ASCII trigrams; [] means that the pattern must scan every row."""
    ways = [w.split("\0") for w in _ways(pattern, 0)[0]]
    sets = {frozenset(r[i : i + 3] for run in way for r in (run.lower(),) if r.isascii() for i in range(len(r) - 2)) for way in ways}
    return [] if not all(sets) else sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(row, gram): a posting for every row whose lower-case text holds the trigram."""
    low = rows.select("row", F.lower("t").alias("low"))
    return low.select("row", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.col("low"), g))).alias("gram"))


def candidates(index: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(row, rules): the kinds whose trigram query the row's postings satisfy."""
    terms = [(r.kind, f"{r.kind}/{k}", g, 1 << i, (1 << len(alt)) - 1) for r in rules for k, alt in enumerate(trigram_query(r.pattern)) for i, g in enumerate(sorted(alt))]
    query = index.sparkSession.createDataFrame(terms, "kind string, alt string, gram string, bit bigint, full bigint")
    met = index.join(F.broadcast(query), "gram").groupBy("row", "kind", "alt", "full").agg(F.bit_or("bit").alias("bits"))  # the terms of the rules: as many as the rules spell
    return met.where("bits = full").groupBy("row").agg(F.collect_set("kind").alias("rules"))


def spans(text: Column, rule: SecretRule) -> Column:
    """array<struct<start, end, kind>>: the rule's leftmost non-overlapping matches that are long enough, in code points."""
    regex = F.lit(rule.pattern)

    def place(found: Column) -> Column:
        step = lambda a, x: let(a["at"] + F.char_length(x["gap"]), lambda start: F.struct(
            (start + F.char_length(x["m"])).alias("at"),
            F.when(F.char_length(x["v"]) >= rule.min_length, F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"))))).otherwise(a["out"]).alias("out")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(found, start, step, lambda a: a["out"])

    matched = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matched
    found = F.filter(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matched.alias("m"), value.alias("v")), lambda x: x["m"].isNotNull())
    return F.transform(let(found, place), lambda s: F.struct(s["start"], s["end"], F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id, text, spans array<struct<start, end, kind>> in order of start, then of the rules.

    The rows that the index names for some rule come back as a table of row keys; it is sent to all tasks while it has
    BROADCAST_ROWS rows at most and joined by row beyond, so the texts stay where they are in the first case. A null text
    is scanned as empty and has no spans; texts of any length are scanned whole. Repeated rows are scanned alike; rows
    whose keys collide are verified by each other's rules too, which changes nothing. A null doc_id is kept. Other columns
    are ignored; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("t"), F.xxhash64("doc_id", "text").alias("row"))
    grams = sorted({g for r in rules for alt in trigram_query(r.pattern) for g in alt})
    index = scratch.save(build_index(rows, grams).distinct(), "postings")
    may = scratch.save(candidates(index, rules).withColumnRenamed("row", "cand_row"), "candidates")
    scratch.drop(index)
    few = may.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(may) if few else may, F.col("row") == F.col("cand_row"), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    per_rule = [spans(F.col("t"), r) if not trigram_query(r.pattern) else F.when(F.array_contains("rules", r.kind), spans(F.col("t"), r)).otherwise(none) for r in rules]
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ordered = F.array_sort(F.transform(F.concat(*per_rule), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.select("doc_id", F.col("t").alias("text"), F.transform(ordered, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))


def digest(found: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


