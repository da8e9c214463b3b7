"""Containment between texts by their rarest gram.

If one text contains another, it contains the gram of the other that is rarest in the group. So each short text is kept
under that one gram only, each long text asks with all of its grams, and the pairs that meet are verified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 8


def grams(text: Column, size: int | Column = SIZE) -> Column:
    """The distinct runs of so many characters of a text; none of a shorter one."""
    last = F.char_length(text) - size + 1
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(size) if isinstance(size, int) else size)))


def candidates(long: DataFrame, short: DataFrame, on: Sequence[str], size: int = SIZE) -> DataFrame:
    """on, long_id, short_id: the pairs that share the short text's rarest gram. See contained.

    All joins are merged, as the size of a table of texts says nothing of that of its grams: by it they would be broadcast.
    """
    sizes = F.least(F.char_length("text"), F.lit(size))
    mine = short.where(F.char_length("text") > 0).select(*on, F.col("id").alias("short_id"), F.explode(grams(F.col("text"), sizes)).alias("gram"))
    mine = mine.withColumn("gram", F.concat(F.char_length("gram").cast("string"), F.lit(":"), "gram"))
    # short texts have grams of their own length; long ones ask in each length that occurs, eight at most
    lengths = sorted(r[0] for r in short.where(F.char_length("text") > 0).select(sizes).distinct().collect())
    sized = lambda n: F.transform(grams(F.col("text"), n), lambda g: F.concat(F.lit(f"{n}:"), g))
    every = F.flatten(F.array(*map(sized, lengths))) if lengths else F.array().cast("array<string>")
    theirs = long.select(*on, F.col("id").alias("long_id"), F.explode(every).alias("gram"))
    often = theirs.groupBy(*on, "gram").agg(F.count("*").alias("n"))
    # a short text of which some gram is in no long text at all is in none
    rarest = mine.join(often.hint("merge"), [*on, "gram"], "left").groupBy(*on, "short_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    index = rarest.where("x.n > 0").select(*on, "short_id", F.col("x.gram").alias("gram"))
    return theirs.join(index.hint("merge"), [*on, "gram"]).select(*on, "long_id", "short_id")


def contained(long: DataFrame, short: DataFrame, on: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """on, long_id, short_id: the pairs of a group in which the text of long (on, id, text) contains that of short.

    ids are distinct within a group; give each different text one, so that copies do not multiply. Null or empty short
    texts, null long ones and null groups have no pair; no rows give none. Work grows with the characters of all texts and
    with the pairs that share a short text's rarest gram.
    """
    pairs = candidates(long, short, on, size)
    pairs = pairs.join(long.select(*on, F.col("id").alias("long_id"), F.col("text").alias("_long")).hint("merge"), [*on, "long_id"])
    pairs = pairs.join(short.select(*on, F.col("id").alias("short_id"), F.col("text").alias("_short")).hint("merge"), [*on, "short_id"])
    return pairs.where(F.contains("_long", F.col("_short"))).select(*on, "long_id", "short_id")
