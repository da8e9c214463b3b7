"""Sequence similarity with native bounds: the exact ratio runs only where it can still reach a threshold.

A ratio is twice the matched characters over all characters. Matched ones are at most those of the shorter text, and at
most what both texts have of each character; both bounds are column expressions.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_bound(a: Column, b: Column) -> Column:
    """The highest ratio that two lengths allow; 1 for two empty texts, null if either is null."""
    both = F.char_length(a) + F.char_length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.char_length(a), F.char_length(b)) / F.nullif(both, F.lit(0)))


def count_bound(a: Column, b: Column) -> Column:
    """The highest ratio that the counts of each character allow; never above length_bound, null if either text is."""
    both = F.char_length(a) + F.char_length(b)
    count = lambda x, ch: F.char_length(x) - F.char_length(F.replace(x, ch, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda ch: ch != "")), F.lit(0), lambda n, ch: n + F.least(count(a, ch), count(b, ch)))
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / F.nullif(both, F.lit(0)))


def with_bounds(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """pairs with bound, an upper bound of the ratio of columns a and b, and settled: 'same' for equal texts, 'below' where
    the bound is under least, 'open' where only the exact ratio can tell, null if either text is null.

    Characters are counted only where lengths leave it open.
    """
    x, y = F.col(a), F.col(b)
    by_length = length_bound(x, y)
    bound = F.when(x == y, 1.0).when(by_length < least, by_length).otherwise(count_bound(x, y))
    rows = pairs.withColumn("bound", bound)
    return rows.withColumn("settled", F.when(x == y, "same").when(F.col("bound") < least, "below").when(F.col("bound").isNotNull(), "open"))


def ratios(pairs: DataFrame, a: str, b: str, least: float | None = None) -> DataFrame:
    """pairs with bound, settled and ratio, difflib's ratio with its junk heuristic.

    With least, the ratio is exact where it can reach least and null where the bound says that it cannot; without, it is
    exact everywhere. Null texts have none. Each pair is handled alone; no rows give none. Columns called bound, settled
    or ratio are replaced.
    """
    rows = with_bounds(pairs.drop("bound", "settled", "ratio"), a, b, 2.0 if least is None else least)
    if least is None:
        rows = rows.withColumn("settled", F.when(F.col("settled") == "below", "open").otherwise(F.col("settled")))
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = zip(*(batch.column(c).to_pylist() for c in (a, b, "settled")), strict=True)
            exact = [1.0 if s == "same" else difflib.SequenceMatcher(None, x, y).ratio() if s == "open" else None for x, y, s in said]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exact, pa.float64())], names=[*names, "ratio"])

    return rows.mapInArrow(run, f"{kinds}, ratio double")


def nearest(value: str, phrases: list[str], least: float) -> str:
    """The phrase most like the beginning of value, the first of equals; value itself where none is near or it is one.
    Ratios that their bounds keep below the best so far are not computed."""
    norm = lambda s: " ".join(s.split()).lower()
    if value in phrases:
        return value
    best, top = value, least
    for q in phrases:
        m = difflib.SequenceMatcher(None, norm(value)[: len(norm(q)) + 10], norm(q))
        if min(m.real_quick_ratio(), m.quick_ratio()) < top:
            continue
        likeness = m.ratio()
        if likeness > top or (likeness == top == least and best is value):
            best, top = q, likeness
    return best
