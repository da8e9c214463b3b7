"""Language-model scoring with a log-frequency Bloom filter of word pairs and triples.

A count c is stored as level 1 + floor(log2 c): the filter of a level holds every n-gram of that level or above, so a
lookup probes level after level until one is missing. N-grams are known by as many bits of their hash as the size of
the text learned from needs (gram_bits), and live in buckets of it; tasks send each bucket
their sorted hashes and counts, delta-coded, and a bucket is turned into one piece of every level's filter. No n-gram is
left out at any input size: buckets grow in number with the text.

The levels from 'least' on are broadcast, least being 2 or the lowest level from which all fit in filter_bytes, and the
exact counts of the words counted head_from times or more, 2 or the lowest power of two that leaves at most 'head' of
them. An n-gram of a document learned from occurs, so its first level needs no probe, and a word of one that the head
lacks where head_from is 2 occurs once: such documents are scored where they lie. All others (those held out, those with a
word outside the head where head_from is above 2, and, where least is above 2, every document) are far: they are packed
into chunks, a chunk sends each region (a run of buckets) the sorted hashes it needs, the region probes its own pieces and
answers with levels and exact word counts, and the chunk puts the answers together. Both ways probe the same pieces, so
the score does not depend on the bounds.

What a task sends holds many hashes in one row at any input size: counts are dealt to at most FAN ranges of buckets
first, and a task that holds a range deals them on; regions widen with the number of buckets, up to WIDTH of them.

A token's probability mixes its triple, its pair and its additively smoothed word. Levels round counts down; the context
of a triple is the most its pair's level allows, so the probabilities of all words after a context sum to at most 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch
from lexstrata.llm.tokens import chunks, constants, fold, mix, word_hashes

HEAD, FILTER_BYTES, BITS_PER_ENTRY = 200_000, 8 << 20, 12
ADD, TRIPLE_SHARE, PAIR_SHARE = 0.1, 0.5, 0.2
#: Tokens a task counts before it sends them on, n-grams (with repeats) meant for a bucket, bytes of text in a chunk.
FLUSH, BUCKET_ENTRIES, CHUNK_BYTES = 1_000_000, 1_500_000, 4 << 20
#: What a piece's bucket, place and size take beside it.
PIECE_BYTES = 24
#: Rows a flush is cut into at most, and buckets of a region at most.
FAN, WIDTH = 8192, 16
END, START = constants(2, 21)
_LEVELS = constants(64, 22)
#: Words are known by 64 bits, n-grams by this many at least.
MIN_BITS = 36


def gram_bits(n: int) -> int:
    """Bits by which n n-grams are known: one that did not occur is taken for one that did in fewer than 1 of 500 cases."""
    return max(MIN_BITS, min(64, n.bit_length() + 9))


def tokens_of(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with one end per document, hashes of the pairs and triples they end, offsets of documents)."""
    h, at = word_hashes(data, offsets)
    t = np.insert(h, at[1:], END)
    bounds = at + np.arange(len(at))
    one, two = np.roll(t, 1), np.roll(t, 2)
    one[bounds[:-1]] = START
    two[bounds[:-1]] = START
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = START
    shift = np.uint64(64 - bits)
    return t, fold([one, t]) >> shift, fold([two, one, t]) >> shift, bounds


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values by a sort; np.unique hashes them first, which takes many times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


_ZSTD = pa.Codec("zstd", 1)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned values in as many byte planes as the largest needs."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _widen(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, the bytes after them)."""
    width = int(raw[0])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[1 : 1 + width * n].reshape(width, n).T
    return out.reshape(-1).view(np.uint64), raw[1 + width * n :]


def pack(h: np.ndarray, c: np.ndarray | None = None) -> bytes:
    """Sorted distinct hashes as differences, and their counts, by byte planes."""
    raw = _narrow(np.diff(h, prepend=np.uint64(0))) + (b"" if c is None else _narrow(c))
    return np.array([len(h), len(raw)], np.uint64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(blob[:16], np.uint64).tolist()
    d, rest = _widen(np.frombuffer(_ZSTD.decompress(blob[16:], size, asbytes=True), np.uint8), n)
    return np.cumsum(d, dtype=np.uint64), _widen(rest, n)[0] if counted else np.ones(n, np.uint64)


def bucket_of(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The leading 32 of a hash's bits, scaled to the number of buckets: sorted hashes have sorted buckets."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _split(grams: np.ndarray, words: np.ndarray, buckets: int, gram: int, width: int = 1) -> list[tuple[int, slice, slice]]:
    """(region, its part of grams, its part of words) of each run of width buckets that sorted hashes fall into."""
    of = [bucket_of(x, buckets, bits) // np.uint64(width) for x, bits in ((grams, gram), (words, 64))]
    own = np.union1d(*of)
    cut = [[slice(a, b) for a, b in zip(np.searchsorted(x, own), np.searchsorted(x, own, side="right"), strict=True)] for x in of]
    return list(zip(own.tolist(), *cut, strict=True))


def _packed(grams: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], buckets: int, gram: int) -> Iterator[pa.RecordBatch]:
    parts = _split(grams[0], words[0], buckets, gram)
    for at in range(0, len(parts), 256):
        some = parts[at : at + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in some], pa.int64()), pa.array([pack(grams[0][g], grams[1][g]) for _, g, _ in some], pa.binary()),
             pa.array([pack(words[0][w], words[1][w]) for _, _, w in some], pa.binary())], names=["bucket", "grams", "words"])


_COUNTED = "bucket bigint, grams binary, words binary"


def counted(docs: DataFrame, buckets: int, gram: int) -> DataFrame:
    """(bucket, grams, words): counts of pairs and triples, and of words, of a run of documents."""
    fan = min(buckets, FAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            grams, words = (np.unique(np.concatenate([x[i] for x in held]), return_counts=True) for i in (0, 1))
            held.clear()
            yield from _packed(grams, words, fan, gram)

        size = 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                t, pair, triple, _ = tokens_of(data, offsets, gram)
                held += [(pair, t), (triple, t[:0])]
                size += len(t)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0
        for batch in batches:
            for blobs in zip(batch.column("grams").to_pylist(), batch.column("words").to_pylist(), strict=True):
                held.append(blobs)
                size += sum(int(np.frombuffer(x[:8], np.uint64)[0]) for x in blobs)
                if size >= FLUSH:
                    yield from _packed(*(_merged([x[i] for x in held]) for i in (0, 1)), buckets, gram)
                    held, size = [], 0
        if held:
            yield from _packed(*(_merged([x[i] for x in held]) for i in (0, 1)), buckets, gram)

    rows = docs.select("text").mapInArrow(run, _COUNTED)
    if fan == buckets:
        return rows
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(deal, _COUNTED)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in blobs]
    h, c = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in (0, 1))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _probe(h: np.ndarray, level: int, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, four bits of it) of each n-gram in the filter of a level, whose piece for it is first, first + size."""
    own = mix(h ^ _LEVELS[level])
    bits = np.uint64(0)
    for k in (0, 6, 12, 18):
        bits = bits | (np.uint64(1) << ((own >> np.uint64(k)) & np.uint64(63)))
    return first + (((own >> np.uint64(32)) * size) >> np.uint64(32)), bits


def level_filter(h: np.ndarray, level: int, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """A piece of a level's filter that holds h."""
    words = np.zeros(max(1, -(-len(h) * bits_per_entry // 64)), np.uint64)
    at, bits = _probe(h, level, np.uint64(0), np.uint64(len(words)))
    np.bitwise_or.at(words, at, bits)
    return words


class Pieces:
    """Filters of consecutive levels from 'least' on, each of the pieces of the buckets that have any."""

    def __init__(self, least: int, buckets: int, pieces: dict[int, list[tuple[int, bytes]]], gram: int):
        self.least, self.buckets, self.gram, self.levels = least, buckets, gram, []
        for level in range(least, max(pieces, default=least - 1) + 1):
            of = sorted(pieces.get(level, []))
            size = np.array([len(x) // 8 for _, x in of], np.uint64)
            self.levels.append((np.frombuffer(b"".join(x for _, x in of), np.uint64), np.array([b for b, _ in of], np.uint64), np.cumsum(size) - size, size))

    def climb(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """level, raised by the probes of those that stand right under these filters."""
        live = np.flatnonzero(level == self.least - 1)
        for q, (words, own, first, size) in enumerate(self.levels, self.least):
            piece, there = _find(own, bucket_of(h[live], self.buckets, self.gram))
            live, piece = live[there], piece[there]
            if len(live):
                at, bits = _probe(h[live], q, first[piece], size[piece])
                live = live[words[at] & bits == bits]
                level[live] = q
        return level


def build_model(rows: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(bucket, filters array<binary> from level 1 on, sizes, word_h, word_c, v, n, ends, hist) of counted rows.

    hist: for each k the number of words counted 2**k times or more.
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        h, c = _merged(table.column("grams").to_pylist())
        level = np.frexp(c.astype(np.float64))[1]
        filters = [level_filter(h[level >= q], q, bits_per_entry).tobytes() for q in range(1, int(level.max(initial=0)) + 1)]
        w, n = _merged(table.column("words").to_pylist())
        hist = [int((n >= 2**k).sum()) for k in range(50)]
        return pa.table({
            "bucket": [key[0].as_py()], "filters": pa.array([filters], pa.list_(pa.binary())), "sizes": pa.array([[len(f) for f in filters]], pa.list_(pa.int64())), "word_h": pa.array([w.tobytes()], pa.binary()),
            "word_c": pa.array([n.tobytes()], pa.binary()), "v": [len(w)], "n": [int(n.sum())], "ends": [int(n[w == END].sum())], "hist": pa.array([hist], pa.list_(pa.int64()))})

    kinds = "bucket bigint, filters array<binary>, sizes array<bigint>, word_h binary, word_c binary, v bigint, n bigint, ends bigint, hist array<bigint>"
    return rows.groupBy("bucket").applyInArrow(build, kinds)


def _head(model: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words counted least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column("word_h"), b.column("word_c"), strict=True):
                h, c = np.frombuffer(h.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= least]), pa.array(c[c >= least])], names=["h", "c"])

    table = model.select("word_h", "word_c").mapInArrow(run, "h bigint, c bigint").toArrow()
    h, c = (table.column(x).to_numpy() for x in ("h", "c"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], c[order]


def _find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in known, whether it is there)."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    return at, known[at] == h if len(known) else np.zeros(len(h), bool)


def _sums(c: np.ndarray, pair: np.ndarray, triple: np.ndarray, at: np.ndarray, docs: int, space: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each document from its tokens' counts and the levels of their n-grams."""
    size = lambda level: np.where(level > 0, 2.0 ** (level - 1.0), 0.0)
    c, two, three = c.astype(np.float64), size(pair), size(triple)
    before, pair_before = np.roll(c, 1), np.roll(np.where(pair > 0, 2 * two - 1, 0.0), 1)
    before[at[:-1]] = pair_before[at[:-1]] = docs  # every document learned from starts once
    alone = (c + ADD) / space
    p = TRIPLE_SHARE * three / np.maximum(np.maximum(pair_before, three), 1) + PAIR_SHARE * two / np.maximum(np.maximum(before, two), 1) + (1 - TRIPLE_SHARE - PAIR_SHARE) * alone
    of = lambda x: np.add.reduceat(x, at[:-1])
    return of((c > 0).astype(np.int64)), of(np.log10(alone)), of(np.log10(p))


def _facts(n: int, c: np.ndarray, pair: np.ndarray, triple: np.ndarray, at: np.ndarray, docs: int, space: float) -> list[np.ndarray]:
    known, base, whole = _sums(c, pair, triple, at, docs, space)
    return [known, np.full(len(at) - 1, n, np.int64), base, whole]


def _frozen(part: pa.RecordBatch) -> bytes:
    """Documents as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _thawed(blob: pa.Scalar, gram: int) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, whether held out, tokens, pairs, triples, offsets) of packed documents."""
    table = pa.ipc.open_stream(blob.as_buffer()).read_all()
    ((_, data, offsets),) = chunks(table.column("text"), 1 << 62)
    return table.column("doc_id"), table.column("held_out").to_numpy(), *tokens_of(data, offsets, gram)


def score(docs: DataFrame, head: int = HEAD, filter_bytes: int = FILTER_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32 of doc_id as text is not 0 mod 10, and scores all. A null text is empty: one
    token, the end. A null doc_id counts as the empty text, which is held out. Repeated rows learn and score once
    each. A text of any length is scored whole, in one task. Other columns are ignored; no documents give no rows; with
    none to learn from, counts are 0.
    """
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    learned = docs.where(~held_out())
    n_bytes = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grams = 2 * (n_bytes // 5)  # of words of four characters
    buckets, gram = max(1, -(-grams // BUCKET_ENTRIES)), gram_bits(grams)
    model = scratch.save(build_model(counted(learned, buckets, gram), bits_per_entry), "model", drop_shuffles=True)
    facts = model.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "n", "ends")], *[F.coalesce(F.sum(F.col("hist")[k]), F.lit(0)).alias(f"k{k}") for k in range(50)]).first()
    n, docs_learned, space = facts["n"], facts["ends"], facts["n"] + ADD * (facts["v"] + 1)
    sizes = {r.pos + 1: r.b for r in model.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum(F.col("col") + PIECE_BYTES).alias("b")).collect()}
    least = next(q for q in range(2, 66) if sum(b for level, b in sizes.items() if level >= q) <= filter_bytes)
    head_from = 2 ** next(k for k in range(1, 50) if facts[f"k{k}"] <= head)
    pieces: dict[int, list[tuple[int, bytes]]] = {}
    for r in model.where(F.size("filters") >= least).select("bucket", F.slice("filters", least, 64).alias("filters")).toLocalIterator():  # filter_bytes at most
        for q, x in enumerate(r.filters, least):
            pieces.setdefault(q, []).append((r.bucket, bytes(x)))
    shared = spark.sparkContext.broadcast((*_head(model, head_from), Pieces(least, buckets, pieces, gram)))  # and head words at most
    del pieces

    def counts_of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = _find(shared.value[0], t)
        return np.where(there, shared.value[1][at], 0) if len(shared.value[0]) else np.zeros(len(t), np.int64), there

    def wanted(at: np.ndarray, held: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens whose n-grams, and of those whose words, a chunk of far documents must ask for."""
        return np.flatnonzero(np.repeat(held | (least > 2), np.diff(at))), np.flatnonzero(np.repeat(held | (head_from > 2), np.diff(at)) & ~there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = shared.value[2]
        for batch in batches:
            every = batch.column("held_out").to_numpy(zero_copy_only=False)
            for row, data, offsets in chunks(batch.column("text"), CHUNK_BYTES):
                part, far = batch.slice(row, len(offsets) - 1), np.ones(len(offsets) - 1, bool)
                if least == 2:
                    t, pair, triple, at = tokens_of(data, offsets, gram)
                    c, there = counts_of(t)
                    far = every[row : row + len(far)]
                    if head_from > 2:
                        far = far | (np.add.reduceat((~there).astype(np.int64), at[:-1]) > 0)
                    near = np.repeat(~far, np.diff(at))  # all of these tokens and n-grams were counted
                    c = np.where(near & ~there, 1, c)
                    level = [high.climb(g, np.where(near, 1, 0)) for g in (pair, triple)]
                    out = pa.table([part.column("doc_id"), part.column("held_out"), np.diff(at), *_facts(n, c, *level, at, docs_learned, space)], names=scored)
                    out = out.filter(pa.array(~far)).combine_chunks()
                    for x in out.append_column("chunk", pa.nulls(len(out), pa.int64())).append_column("blob", pa.nulls(len(out), pa.binary())).to_batches():
                        yield x
                if far.any():
                    blob = _frozen(part.filter(pa.array(far)))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in kind_of), pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([blob], pa.binary())], names=[*scored, "chunk", "blob"])

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = [x.split(" ")[0] for x in kinds.split(", ")]
    kind_of = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in scored[2:5]), *((c, pa.float64()) for c in scored[5:])])
    first = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"{kinds}, chunk bigint, blob binary")
    first = scratch.save(first, "first")  # chunks have their numbers once written
    far = first.where("blob is not null").select("chunk", "blob")
    width = max(1, min(WIDTH, buckets // 1024))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                _, held, t, pair, triple, at = _thawed(blob, gram)
                of_gram, of_word = wanted(at, held, counts_of(t)[1])
                grams, words = distinct(np.concatenate([pair[of_gram], triple[of_gram]])), distinct(t[of_word])
                parts = _split(grams, words, buckets, gram, width)
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r for r, _, _ in some], pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array([pack(grams[g]) for _, g, _ in some], pa.binary()), pa.array([pack(words[w]) for _, _, w in some], pa.binary())],
                        names=["region", "chunk", "grams", "words"])

    def answer(key: tuple, asked: pa.Table, have: pa.Table) -> pa.Table:
        own = have.sort_by("bucket").to_pylist()
        pieces: dict[int, list[tuple[int, bytes]]] = {}
        for r in own:
            for q, x in enumerate(r["filters"], 1):
                pieces.setdefault(q, []).append((r["bucket"], x))
        low = Pieces(1, buckets, pieces, gram)
        known, count = np.frombuffer(b"".join(r["word_h"] for r in own), np.uint64), np.frombuffer(b"".join(r["word_c"] for r in own), np.int64)
        levels, counts = [], []
        for g, w in zip(asked.column("grams"), asked.column("words"), strict=True):
            h, w = unpack(g.as_py(), False)[0], unpack(w.as_py(), False)[0]
            levels.append(low.climb(h, np.zeros(len(h), np.int64)).astype(np.uint8).tobytes())
            at, there = _find(known, w)
            counts.append(np.uint64(len(w)).tobytes() + _narrow(np.where(there, count[at], 0) if len(known) else np.zeros(len(w), np.int64)))
        return pa.table({"chunk": asked.column("chunk"), "region": asked.column("region"), "levels": pa.array(levels, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        high, out = shared.value[2], []
        answers = answers.sort_by("region")
        low = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        counts = [_widen(np.frombuffer(x, np.uint8)[8:], int(np.frombuffer(x[:8], np.uint64)[0]))[0].astype(np.int64) for x in answers.column("counts").to_pylist()]
        counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        for blob in table.column("blob"):  # one
            ids, held, t, pair, triple, at = _thawed(blob, gram)
            c, there = counts_of(t)
            of_gram, of_word = wanted(at, held, there)  # answers come in the order of the distinct hashes asked for
            c[of_word] = counts[np.unique(t[of_word], return_inverse=True)[1]]
            found = low[np.unique(np.concatenate([pair[of_gram], triple[of_gram]]), return_inverse=True)[1]].reshape(2, -1)
            of_held, level = np.repeat(held, np.diff(at)), []
            c = np.where(~of_held & (c == 0), 1, c)  # only where head_from is 2 is such a word not asked for
            for g, f in zip((pair, triple), found, strict=True):
                own = np.zeros(len(g), np.int64)
                own[of_gram] = f
                level.append(high.climb(g, np.where(of_held, own, np.maximum(own, 1))))
            out.append(pa.table([ids, pa.array(held), np.diff(at), *_facts(n, c, *level, at, docs_learned, space)], names=scored))
        return pa.concat_tables(out) if out else kind_of.empty_table()

    region = F.expr(f"bucket div {width}").alias("region")
    low = model.select(region, "bucket", F.slice("filters", 1, least - 1).alias("filters"), "word_h", "word_c")
    asked = far.mapInArrow(ask, "region bigint, chunk bigint, grams binary, words binary")
    answers = asked.groupBy("region").cogroup(low.groupBy("region")).applyInArrow(answer, "chunk bigint, region bigint, levels binary, counts binary")
    answers = scratch.save(answers, "answers", drop_shuffles=True)
    scratch.drop(model)
    settled = far.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kinds)
    return first.where("blob is null").select(*scored).union(settled)
