"""Robots rules over fetched robots.txt rows: which addresses an agent may fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host and port of an address, in lower case; null without a scheme."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Path and query of an address, '/' at least."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def rules(fetched: DataFrame, agent: str) -> DataFrame:
    """host, prefix, allow: the rules that hold for an agent, of robots.txt files (host, status, text).

    A file that was had (2xx) is read: lines of agents open a group, the rules after them are the group's. The groups that
    name the agent hold, or those for all ('*') where none does; an empty prefix says nothing. A file that is not there
    (4xx) allows all; any other status, or none, allows nothing. Of several files of a host the last by status and text
    counts. Each file is a few lines, read within its own row.
    """
    one = fetched.where("host is not null").groupBy("host").agg(F.max(F.struct(F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("host", "x.*")
    had, gone = F.col("status").between(200, 299), F.col("status").between(400, 499)
    fixed = one.where(~had).select("host", F.lit("/").alias("prefix"), gone.alias("allow"))
    line = F.explode(F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, "#.*$", "")).alias("line"))), lambda x: F.contains(x["line"], F.lit(":")))).alias("x")
    said = one.where(had).select("host", line).select("host", "x.i", F.lower(F.trim(F.substring_index("x.line", ":", 1))).alias("field"), F.trim(F.substr("x.line", F.call_function("instr", F.col("x.line"), F.lit(":")) + 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    file = W.partitionBy("host").orderBy("i")
    said = said.withColumn("names", F.col("field") == "user-agent")
    said = said.withColumn("group", F.sum((F.col("names") & ~F.coalesce(F.lag("names").over(file), F.lit(False))).cast("int")).over(file)).where("group > 0")
    mine = F.lower("value") == agent.lower()
    groups = said.where("names").groupBy("host", "group").agg(F.bool_or(mine).alias("mine"), F.bool_or(F.col("value") == "*").alias("all"))
    named = groups.withColumn("any", F.bool_or("mine").over(W.partitionBy("host")))
    held = named.where(F.when(F.col("any"), F.col("mine")).otherwise(F.col("all"))).select("host", "group")
    own = said.where("not names and value <> ''").join(held, ["host", "group"]).groupBy("host", F.col("value").alias("prefix")).agg(F.bool_or(F.col("field") == "allow").alias("allow"))
    return own.unionByName(fixed)


def allowed(urls: DataFrame, fetched: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with allowed and rule (the prefix that decided, null where none fits): the longest prefix of an address's path
    counts, an allowing one before a blocking one of the same length; without a rule all is allowed.

    The rules are a table by host and prefix; an address asks for its path's prefixes of just the lengths that its host's
    rules have, so the join is on equal keys. Hosts without a robots row are not known yet and allow nothing, and so do
    addresses without a host. Repeated rows give a row each; no rows give none.
    """
    table = rules(fetched, agent)
    lengths = table.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("_lengths"))
    known = fetched.where("host is not null").select("host").distinct().withColumn("_known", F.lit(True))
    rows = urls.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url)), "_row": F.monotonically_increasing_id()})
    pages = rows.select("_host", "_path").distinct()
    asks = pages.join(lengths.withColumnRenamed("host", "_host"), "_host").select("_host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_path"))).alias("_n"))
    hit = asks.withColumn("prefix", F.substr("_path", F.lit(1), F.col("_n"))).join(table.withColumnRenamed("host", "_host"), ["_host", "prefix"])
    best = hit.groupBy("_host", "_path").agg(F.max(F.struct("_n", "allow", "prefix")).alias("_x"))
    out = rows.join(best, ["_host", "_path"], "left").join(known.withColumnRenamed("host", "_host"), "_host", "left")
    return out.select(*urls.columns, (F.coalesce("_known", F.lit(False)) & F.coalesce("_x.allow", F.lit(True))).alias("allowed"), F.col("_x.prefix").alias("rule"))
