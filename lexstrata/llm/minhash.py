"""MinHash near-dedup.

Sets of 5-word shingles get minima of universal hashes, in bands. Documents with equal sets become one class at once.
Classes that share a band bucket are candidates, in rounds: first each class with the best few of its buckets' pivots
(the members with the most company), then with new pivots, and at last the exact rest, every class outside its
bucket's largest component against the classes of other components there. Signatures drop hopeless candidates; the
full sets confirm the links; large-star and small-star join them to components after each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch
from lexstrata.llm.components import components
from lexstrata.llm.tokens import chunks, constants, fold, mix, shingle_sets

BANDS, ROWS, WORDS, PERCENT = 24, 4, 5, 75
#: Minima in a signature; the first BANDS * ROWS make the bands. A pair goes to the exact test if its share of equal
#: minima is no more than 4 standard errors under the threshold.
MINIMA = 512
PIVOTS, TURNS, TRIED = 2, 2, 3
#: Longs in an odd sketch: a bit for each hash value, set if an odd number of a set's shingles has that value.
PARITY = 16


def least_equal(k: int, percent: int) -> int:
    p = percent / 100
    return int(k * (p - 4 * (p * (1 - p) / k) ** 0.5))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes), sig (a byte per minimum), buckets (a hash per band), parity (the odd sketch)."""
    k = max(MINIMA, bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = constants(k, 11) | np.uint64(1), constants(k, 12)
        salt = constants(bands, 13)[:, None]
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                minima = np.zeros((k, len(sets)), np.uint64)
                if len(full):
                    h, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for j in range(k):
                        minima[j, full] = np.minimum.reduceat(a[j] * h + b[j], at)
                sig = np.ascontiguousarray((mix(minima) & np.uint64(255)).astype(np.uint8).T)
                odd = np.array([np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1 for s in sets], np.uint8)
                odd = np.packbits(odd.reshape(len(sets), 64 * PARITY), axis=1).view(np.int64)
                bucket = fold([*minima[: bands * rows].reshape(bands, rows, -1).transpose(1, 0, 2)]) + salt
                bucket = np.ascontiguousarray(mix(bucket).T).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, len(sets)), pa.array(n),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bucket.size + 1, bands, dtype=np.int32)), pa.array(bucket.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, PARITY, dtype=np.int32)), pa.array(odd.ravel()))],
                    names=["doc_id", "n_shingles", "set_hash", "sig", "buckets", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hash binary, sig binary, buckets array<bigint>, parity array<bigint>")


def _likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(a, b, equal): the pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            s, t = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("sa", "sb"))
            equal = (s == t).sum(1)
            keep = pa.array(equal >= least)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(equal.astype(np.int64))], names=["a", "b", "equal"]).filter(keep)

    of = lambda k: sigs.select(F.col("rep").alias(k), F.col("sig").alias(f"s{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, equal bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, data, offsets in chunks(x.column("ta")):
                n = len(offsets) - 1
                a = shingle_sets(data, offsets, size)
                b = [s for _, d, o in chunks(x.column("tb").slice(row, n)) for s in shingle_sets(d, o, size)]
                keep = []
                for s, t in zip(a, b, strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([x.column("a").slice(row, n), x.column("b").slice(row, n)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "u bigint, v bigint")


def _unshared(texts: DataFrame, size: int) -> DataFrame:
    """(rep, own): how many shingles of each text are in no other text of the table; texts without such have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, data, offsets in chunks(x.column("text")):
                sets = shingle_sets(data, offsets, size)
                reps = np.repeat(x.column("doc_id").slice(row, len(sets)).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "h"])

    rows = texts.mapInArrow(run, "rep bigint, h bigint").groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    return rows.where("rep = last").groupBy("rep").agg(F.count("*").alias("own"))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Links are between documents with 100 * intersection >= percent * union of their shingle sets. A null or empty
    text has no shingles and is its own component. Equal texts are one class however many there are. A doc_id that
    repeats is one node: its rows share a component. A row without doc_id links nothing, has a null component and is
    kept. Other columns are ignored; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    least = least_equal(max(MINIMA, bands * rows), percent)
    sk = scratch.save(sketches(docs, bands, rows, size), "sketches")
    real = sk.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(real.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity")), "classes")
    sigs = classes.select("rep", "sig")
    again = real.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    edges = [scratch.save(real.join(again, "doc_id").join(classes.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct(), "links")]

    members = classes.select("rep", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    spent = [members := scratch.save(members.join(shared, "bucket"), "members")]
    rows_of = docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    spent.append(texts := scratch.save(rows_of.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h"), "texts"))

    def labelled(label: DataFrame | None) -> DataFrame:
        if label is None:
            return members.withColumn("root", F.col("rep"))
        return members.join(label, members.rep == label.node, "left").select("bucket", "rep", "weight", F.coalesce("root", "rep").alias("root"))

    def open_buckets(now: DataFrame) -> DataFrame:
        return now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")

    central = members.groupBy("bucket").agg(F.count("*").alias("n")).join(members, "bucket").groupBy("rep").agg(F.sum("n").alias("weight"))
    spent.append(members := scratch.save(members.join(central, "rep").select("bucket", "rep", "weight"), "members"))
    label = None
    for turn in range(TURNS):
        now = labelled(label)
        seat = F.pmod(F.xxhash64("rep"), F.lit(TURNS * PIVOTS)) - turn * PIVOTS
        seats = [F.max(F.when(seat == j, F.struct("weight", -F.col("rep"), "rep", "root"))).alias(f"p{j}") for j in range(PIVOTS)]
        spare = F.max(F.struct(F.xxhash64("rep", F.lit(turn)), "weight", "rep", "root"))
        pivots = now.groupBy("bucket").agg(*seats, spare.alias("spare"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        chosen = F.array(*[F.struct(F.col(f"{p}.rep").alias("a"), F.col(f"{p}.root").alias("pivot_root")) for p in [*(f"p{j}" for j in range(PIVOTS)), "spare"]])
        pivots = pivots.select("bucket", F.array_distinct(F.filter(chosen, lambda p: p["a"].isNotNull())).alias("pivots"))
        met = now.join(pivots, "bucket").select(F.col("rep").alias("b"), "root", F.inline("pivots")).where("pivot_root <> root").groupBy("b", "a").agg(F.count("*").alias("shared"))
        tried = met.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), False), 1, TRIED).alias("best"))  # a pair per band and pivot at most
        pairs = _likely(tried.select("b", F.inline("best")).select("a", "b"), sigs, least)
        edges.append(scratch.save(_confirmed(pairs, texts, size, percent), "links"))
        label = components(reduce(DataFrame.union, edges), scratch)
        spent.append(edges[-1])
        edges = [label.select(F.col("node").alias("u"), F.col("root").alias("v"))]  # the stars stand for the links so far

    now = labelled(label).join(open_buckets(labelled(label)), "bucket")
    # With s shared and o own shingles, a pair's similarity is at most min(s) / max(n + the other's o).
    waiting = now.select("rep").distinct().withColumnRenamed("rep", "doc_id")
    own = _unshared(texts.join(waiting, "doc_id"), size)
    # Each shingle that only one of two texts has flips one bit of the odd sketches, so they differ in no more bits than that.
    odd = [F.first(F.col("parity")[i]).alias(f"w{i}") for i in range(PARITY)]
    sizes_of = classes.groupBy("rep").agg(F.when(F.count("*") == 1, F.min("n_shingles")).alias("n"), *odd)  # null for a doc_id of several texts, which the bound leaves alone
    facts = sizes_of.join(own, "rep", "left").select("rep", "n", F.coalesce("own", F.lit(0)).alias("own"), *(f"w{i}" for i in range(PARITY)))
    spent.append(now := scratch.save(now.join(facts, "rep"), "open"))
    sizes = now.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    outside = now.join(largest, "bucket").where("root <> largest").select("bucket", F.col("rep").alias("a"), F.col("root").alias("root_a"), "largest", F.col("n").alias("n_a"), F.col("own").alias("own_a"), *(F.col(f"w{i}").alias(f"v{i}") for i in range(PARITY)))
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(PARITY)])
    total = F.col("n") + F.col("n_a")
    near = (100 * F.least(F.col("n") - F.col("own"), F.col("n_a") - F.col("own_a")) >= percent * F.greatest(F.col("n") + F.col("own_a"), F.col("n_a") + F.col("own"))) & (100 * (total - differ) >= percent * (total + differ))
    near = F.col("n").isNull() | F.col("n_a").isNull() | near
    once = (F.col("root") == F.col("largest")) | (F.col("a") < F.col("rep"))
    pairs = outside.join(now, "bucket").where((F.col("root") != F.col("root_a")) & once & near).select("a", F.col("rep").alias("b")).distinct()
    edges.append(scratch.save(_confirmed(_likely(pairs, sigs, least), texts, size, percent), "links"))
    spent.append(edges[-1])
    label = components(reduce(DataFrame.union, edges), scratch)
    scratch.drop(*spent)  # the result rests on the sketches, the classes and the last components

    of_class = classes.select("set_hash", "rep").join(label, F.col("rep") == F.col("node"), "left").select(F.col("set_hash").alias("of"), F.coalesce("root", "rep").alias("class_root"))
    out = sk.join(of_class, F.col("set_hash") == F.col("of"), "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_root")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Every pair that shares a shingle, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS class FROM s),
c AS (SELECT class, min(doc_id) AS rep, any_value(n) AS n FROM n WHERE n > 0 GROUP BY class),
x AS (SELECT rep, unnest(s) AS g FROM c JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c u ON u.rep = a JOIN c v ON v.rep = b WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE m.root END AS component_id, n.doc_id = (CASE WHEN n.n = 0 THEN n.doc_id ELSE m.root END) AS kept
FROM n LEFT JOIN c ON c.class = n.class LEFT JOIN m ON m.node = c.rep
"""
