"""Alignment of the tokens of two tokenizers over the same bytes.

Packed bitsets mark the last byte of every token of either side. Their AND holds the shared cuts, which part a text
into groups; popcounts below a cut (rank) turn it into token numbers of both sides. Their OR holds the ends of all
overlaps: each set bit (select) is one link between the two tokens around that byte.

Corpus-wide, the links of each id pair are counted with a sum per task before the shuffle. The counts that documents
ask for most, HEAD at most, go to all tasks; the rest, each of which few links ask for, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch

#: Pair counts sent to all tasks: some 26 MB.
HEAD = 2_000_000
#: Text handled at once, and id pairs that a task adds up before it sends them.
CHUNK_BYTES, COMBINED = 1 << 20, 2_000_000
#: Longer runs of white space go to the plain encoder, whose pattern needs no stack.
LONG_RUN = re.compile(r"\s{10000}")


class _Table:
    """The bytes of a vocabulary's tokens by id."""

    def __init__(self, tokens: dict[int, bytes]):
        self.size = max(tokens) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for i, b in tokens.items():
            self.lengths[i] = len(b)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        at = np.cumsum(n) - n
        return self.data[np.repeat(self.starts[ids] - at, n) + np.arange(int(n.sum()))]


class ByteLevel:
    """A byte-level BPE from its JSON file. Where the merges are in the order of the ids, as tiktoken needs it, that
    library encodes with the same ranks and pattern, three times as fast; ids are the same, which a test sweeps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.table = _Table({i: b for b, i in ranks.items()} | {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])})
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        first = len(vocab) - len(merged)
        pre = spec.get("pre_tokenizer") or {}
        ordered = all(vocab.get(t) == first + k for k, t in enumerate(merged)) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer")
        self.fast = None
        if ordered:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = lambda t: self.plain.encode(t, add_special_tokens=False).ids
        return [slow(t) if self.fast is None or LONG_RUN.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model; an encoded text begins with the space that the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        of = self.model.id_to_piece
        self.table = _Table({i: bytes([int(of(i)[3:5], 16)]) if self.model.is_byte(i) else of(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Marks:
    """A packed bitset with ranks: bit p is set if something ends with byte p."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, ends: np.ndarray, total: int) -> _Marks:
        bits = np.zeros((total + 63) // 64 * 64, bool)
        bits[ends - 1] = True
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set up to and with each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(2) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def before_end(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        own = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return self.rank(at) - own.astype(np.int64)

    def select(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    said = [str(i).encode() for i in range(size)]
    n = np.array([len(s) for s in said])
    return np.frombuffer(b"".join(s.ljust(int(n.max()) + 1) for s in said), np.uint8).reshape(size, -1), n


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.digits, self.n_digits = _digits(max(a.table.size, b.table.size))
        self.width = a.table.size * b.table.size
        self.pair = ("int", pa.int32()) if self.width < 1 << 31 else ("bigint", pa.int64())

    def tokens(self, raw: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(bytes of each text with its space, 0 without tokens; the ids of both sides; how many of them each text has)."""
        at = [i for i, r in enumerate(raw) if r]
        texts = [raw[i].decode("utf-8", "replace") for i in at]
        said = [self.a.encode([" " + t for t in texts]), self.b.encode(texts)] if at else [[], []]
        good = np.ones(len(at), bool)
        ids = [[np.array(x, np.int64) for x in side] for side in said]
        whole = np.frombuffer(b"".join(b" " + raw[i] for i in at), np.uint8)
        for side, table in zip(ids, (self.a.table, self.b.table), strict=True):
            if at and not np.array_equal(table.joined(np.concatenate(side)), whole):
                good &= [bytes(table.joined(x)) == b" " + raw[i] for x, i in zip(side, at, strict=True)]
        sizes, counts = np.zeros(len(raw), np.int64), [np.zeros(len(raw), np.int64) for _ in ids]
        for k, i in enumerate(at):
            if good[k]:
                sizes[i] = len(raw[i]) + 1
                for side, n in zip(ids, counts, strict=True):
                    n[i] = len(side[k])
        kept = [[x for x, ok in zip(side, good, strict=True) if ok] for side in ids]
        return sizes, [np.concatenate(x) if x else np.empty(0, np.int64) for x in kept], counts

    def align(self, raw: list[bytes | None]) -> dict[str, pa.Array]:
        sizes, (a, b), (n_a, n_b) = self.tokens(raw)
        total, full = int(sizes.sum()), sizes > 0
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(raw), np.int64), "n_links": np.zeros(len(raw), np.int64)}
        sha, pairs, times, offsets = [""] * len(raw), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        if total:
            on_a, on_b = (_Marks.of(np.cumsum(t.table.lengths[x]), total) for t, x in ((self.a, a), (self.b, b)))
            shared, either = _Marks(on_a.words & on_b.words), _Marks(on_a.words | on_b.words)
            last = np.cumsum(sizes[full]) - 1
            for c, marks in (("n_groups", shared), ("n_links", either)):
                out[c][full] = np.diff(marks.rank(last), prepend=0)
            cuts, joint = shared.select(), either.select()
            for i, h in zip(np.flatnonzero(full), self.hashes(a, b, on_a.rank(cuts), on_b.rank(cuts), n_a[full] + n_b[full]), strict=True):
                sha[i] = h
            # the tokens around a byte are those with as many ends before it
            left, right = (x[m.before_end(joint)] for x, m in ((a, on_a), (b, on_b)))
            width = self.width
            key = np.sort(np.repeat(np.flatnonzero(full), out["n_links"][full]) * width + left * self.b.table.size + right)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times, pairs = np.diff(np.append(first, len(key))), key[first] % width
            offsets = np.searchsorted(key[first], np.arange(len(raw) + 1) * width)
        lists = {"pairs": pairs, "times": times}
        held = {c: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, self.pair[1] if c == "pairs" else pa.int32())) for c, v in lists.items()}
        return {c: pa.array(v) for c, v in out.items()} | {"groups_sha256": pa.array(sha)} | held

    def hashes(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, per_text: np.ndarray) -> Iterator[str]:
        """The digest of each text's groups: ids in the order group by group, side by side, and what stands after each."""
        per_a, per_b = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        after = np.full(len(order), ord(","), np.uint8)
        at_a = np.arange(len(a)) + np.repeat(b_end - per_b, per_a)
        at_b = np.arange(len(b)) + np.repeat(a_end, per_b)
        order[at_a], order[at_b] = a, b
        after[at_a[a_end - 1]], after[at_b[b_end - 1]] = ord("|"), ord(";")
        n, said = self.n_digits[order], self.digits[order]
        said[np.arange(len(order)), n] = after
        flat = said[np.arange(said.shape[1]) <= n[:, None]].tobytes()
        ends = np.cumsum(n + 1)[np.cumsum(per_text) - 1]
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            yield hashlib.sha256(flat[start : end - 1]).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(ByteLevel(path_a), Pieces(path_b))
    return _ALIGNERS[path_a, path_b]


COUNTED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """COUNTED, pairs, times of each document: its counts, the digest of its groups, and its linked id pairs (a * size of B + b) in order
    with how often each occurs. row numbers the rows; write the result before the number is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for batch in batches:
            raw, start = batch.column("text").cast(pa.binary()).to_pylist(), 0
            while start < len(raw):
                end, held = start + 1, len(raw[start] or b"")
                while end < len(raw) and held + len(raw[end] or b"") <= CHUNK_BYTES:
                    held += len(raw[end] or b"")
                    end += 1
                own = batch.slice(start, end - start)
                yield pa.RecordBatch.from_pydict({"row": own.column("row"), "doc_id": own.column("doc_id"), **align.align(raw[start:end])})
                start = end

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{COUNTED}, pairs array<{aligner(path_a, path_b).pair[0]}>, times array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold each pair. Tasks add up what they hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> tuple[np.ndarray, np.ndarray]:
            k, w = np.concatenate(keys), np.concatenate(weights)
            order = np.argsort(k, kind="stable")
            k, w = k[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            return k[first], np.add.reduceat(w, first) if len(k) else w

        keys, weights, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            keys.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            weights.append(batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(keys[-1])
            if held > COMBINED:
                k, w = summed()
                if len(k) > COMBINED // 2:
                    yield pa.RecordBatch.from_pydict({"pair": k, "n": w})
                    k, w = k[:0], w[:0]
                keys, weights, held = [k], [w], len(k)
        k, w = summed()
        yield pa.RecordBatch.from_pydict({"pair": k, "n": w})

    return links.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def best_of(counts: DataFrame, size_b: int) -> DataFrame:
    """pair, n, best: whether the count is the highest of the pair's B id. A B id has as many pairs as A has ids at most."""
    of = counts.withColumn("b", F.col("pair") % size_b)
    top = of.groupBy("b").agg(F.max("n").alias("top"))
    return of.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of documents (doc_id, text).

    Texts are encoded whole, each on its own, without special tokens. A null, empty or not losslessly encoded text has no
    tokens: zeros and an empty digest. Repeated rows each give a row and count each; ties for the best all count. A null
    doc_id is kept, other columns are ignored, no documents give no rows. The same results whatever head is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size_b = aligner(path_a, path_b).b.table.size
    links = scratch.save(token_links(docs, path_a, path_b), "links")
    counts = scratch.save(pair_counts(links), "counts")
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()  # 64 rows at most
    least, held = 64, 0
    for level, n in sorted(((r["level"], r["count"]) for r in levels), reverse=True):
        if held + n > head:
            break
        least, held = level, held + n
    whole = held == sum(r["count"] for r in levels)
    marked = best_of(counts, size_b)
    floor = F.lit(1 << least) if least < 63 else F.lit((1 << 63) - 1)
    top = marked.where(F.col("n") >= floor).toPandas().sort_values("pair")  # head rows at most
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            of_text = lambda v, ends=ends: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            own = {"count_sum": of_text(np.where(hit, times * n[at], 0) if len(known) else times * 0), "n_best": of_text(np.where(hit & best[at], times, 0) if len(known) else times * 0)}
            far = pa.array(np.concatenate([[0], np.cumsum(of_text((~hit).astype(np.int64)))]), pa.int32())
            rest = {"pairs": pa.ListArray.from_arrays(far, pa.array(pairs[~hit])), "times": pa.ListArray.from_arrays(far, pa.array(times[~hit]))}
            keep = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield pa.RecordBatch.from_pydict(keep | own | rest)

    found = links.mapInArrow(run, COUNTED + ", count_sum bigint, n_best bigint, pairs array<bigint>, times array<bigint>")
    if not whole:
        found = scratch.save(found, "found")
        asked = found.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
        rest = asked.join(marked.where(F.col("n") < floor), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        found = found.join(rest, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
