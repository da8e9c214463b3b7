"""Quality rules as a learned decision list.

Statistics per document are native expressions. Sequential covering learns conjunctions of threshold tests that
single out low-quality documents: each is grown on two thirds of the labelled rows by information gain, pruned on the
rest, and taken while its precision there holds; the rows it covers leave, and the next rule is learned. The driver
sees only counts per statistic and threshold. The list comes out as an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import WORD, Scratch, let, text_or_empty, words

#: Fixed values of the query's contract.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 8, 20, 30
#: Statistics the rules may test, as expressions over the counted columns.
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capitals_share": "n_capitals / word_chars",
    "digits_share": "n_digits / word_chars",
    "chars_per_word": "word_chars / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "words": "n_words",
}


@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.coalesce(F.col(self.stat) > self.value if self.above else F.col(self.stat) <= self.value, F.lit(False))

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def repeat_words(w: Column, width: int = WINDOW) -> Column:
    """Words of the array that lie in a window of width words found twice or more in the array."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
            starts = F.array_sort(F.transform(found, lambda x: x["i"]))
            gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return let(starts, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, twice)).otherwise(0)

    hashed = lambda hs: F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(width)]))
    return F.when(F.size(w) > width, let(F.transform(w, lambda x: F.xxhash64(x)), lambda hs: let(hashed(hs), covered))).otherwise(0).cast("bigint")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, the ratios, and the columns in keep. A null text counts as empty; ratios over 0 are null."""
    t = docs.select("doc_id", *[F.col(c).alias(f"keep_{c}") for c in keep], text_or_empty().alias("t"))
    drop = lambda chars: F.char_length("t") - F.char_length(F.translate("t", chars, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    counted = let(words(F.col("t")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
        repeat_words(w).alias("n_repeat_words")))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = t.select(
        "doc_id", *[f"keep_{c}" for c in keep], counted.alias("c"),
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        drop(SYMBOLS).cast("bigint").alias("n_symbols"), drop("!?").cast("bigint").alias("n_marks"),
        drop(capitals).cast("bigint").alias("n_capitals"), drop("0123456789").cast("bigint").alias("n_digits"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    t = t.select("*", "c.*").drop("c")
    t = t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return t.select("*", *[F.expr(e.replace(" / ", " / nullif(") + ", 0)" if " / " in e else e).cast("double").alias(n) for n, e in RATIOS.items()])


def learn(labelled: DataFrame, bins: int = 24, max_rules: int = 10, max_tests: int = 3, min_precision: float = 0.8, min_covered: int = 8, scratch: Scratch | None = None) -> list[Rule]:
    """labelled: doc_id, bad (boolean), the ratios. Returns rules in order; none without bad or without good rows.

    Rows are first reduced to counts per combination of bins, and those to counts per statistic and bin at each step.
    """
    scratch = scratch or Scratch(labelled.sparkSession)
    stats = list(RATIOS)
    cuts_of = labelled.select(*[F.percentile_approx(s, [k / bins for k in range(1, bins)], 10_000).alias(s) for s in stats]).first()
    cuts = {s: sorted(set(cuts_of[s])) for s in stats if cuts_of[s]}
    stats = list(cuts)
    if not stats:
        return []
    binned = [reduce(lambda a, c: a + F.when(F.col(s) > c, 1).otherwise(0), map(float, cuts[s]), F.lit(0)).alias(s) for s in stats]  # noqa: B023
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0
    cells = labelled.where(" and ".join(f"{s} is not null" for s in stats)).select(*binned, grow.alias("grow"), "bad")
    cells = scratch.save(cells.groupBy(*stats, "grow").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")), "cells")

    def covers(test: tuple[str, bool, int]) -> Column:
        s, above, k = test
        return F.col(s) > k if above else F.col(s) <= k

    def counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("bin")) for s in stats])).alias("x")
        got = rows.select(pairs, "p", "n").groupBy("x.stat", "x.bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        out: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in stats}
        for r in got:
            out[r["stat"]][r["bin"]] = (r["p"], r["n"])
        return out

    def best(by: dict, p0: int, n0: int) -> tuple[float, tuple | None]:
        top, base = (0.0, None), math.log2(p0 / (p0 + n0))
        for s in stats:
            p = n = 0
            for k in range(len(cuts[s])):
                a, b = by[s].get(k, (0, 0))
                p, n = p + a, n + b
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    if pp >= min_covered and pp + nn < p0 + n0:
                        gain = pp * (math.log2(pp / (pp + nn)) - base)
                        if gain > top[0] + 1e-9:
                            top = (gain, (s, above, k))
        return top

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        tests, rows = [], left.where("grow")
        for _ in range(max_tests):
            by = counts(rows)
            p0, n0 = (sum(v[i] for v in by[stats[0]].values()) for i in (0, 1))
            if p0 < min_covered or n0 == 0:
                break
            found = best(by, p0, n0)[1]
            if not found:
                break
            tests.append(found)
            rows = rows.where(covers(found))
        if not tests:
            break
        prefix = [F.lit(True)]
        for t in tests:
            prefix.append(prefix[-1] & covers(t))
        held = left.where("not grow").agg(*[F.sum(F.when(c, F.col(x)).otherwise(0)).alias(f"{x}{i}") for i, c in enumerate(prefix[1:], 1) for x in "pn"]).first()
        worth = lambda i: ((held[f"p{i}"] or 0) - (held[f"n{i}"] or 0)) / max(1, (held[f"p{i}"] or 0) + (held[f"n{i}"] or 0))
        size = max(range(1, len(tests) + 1), key=lambda i: (worth(i), -i))
        p, n = held[f"p{size}"] or 0, held[f"n{size}"] or 0
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(Test(s, above, float(cuts[s][k])) for s, above, k in tests[:size])))
        left = left.where(~prefix[size])
    scratch.drop(cells)
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """The ordered CASE expression: the text of the first rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **how) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the learned rule that rejects, else null), kept, and keep's columns.

    labels: doc_id, quality (0 or 1); its null rows, and labels without a document, teach nothing; without labels of
    both kinds there are no rules and the base test decides alone. A null or empty text fails the base test (0
    words). Repeated documents are judged alike; a label repeated for a document counts each time. Other columns of
    docs are ignored unless named in keep; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(statistics(docs, keep), "stats")
    marked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("of"), (F.col("quality") == 0).alias("bad"))
    labelled = stats.where("not base_failed").join(marked, F.col("doc_id") == F.col("of")).select("doc_id", "bad", *RATIOS)
    labelled = scratch.save(labelled, "labelled")
    rules = learn(labelled, scratch=scratch, **how)
    scratch.drop(labelled)
    out = stats.withColumn("rule", F.when(~F.col("base_failed"), first_rule(rules)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), *[F.col(f"keep_{c}").alias(c) for c in keep])
