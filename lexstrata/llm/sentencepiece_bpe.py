"""SentencePiece encoding and decoding by a merge-type prefix table.

The BPE encoding of every prefix of a text ends in one token that depends on the prefix alone. An automaton over all
reachable pieces lists, at each position, the pieces that end there; the one that is compatible with the last token
of the prefix before it is that token. The table of last tokens then yields the ids from the back.

Pieces hold white space only as leading marks, so a text falls into runs (marks, then other characters) that no piece
spans; each distinct run is encoded once and remembered in a bounded cache.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
CACHE_RUNS = 400_000


class PrefixTable:
    """BPE over the normal pieces of a model, equal to the library's merges (best score first, then leftmost)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        long = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("a piece holds white space inside")
        apart = "" if any("\n" in p for p in long) else "\n"
        self.runs = re.compile(f"{apart}|{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" if apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.automaton = ahocorasick.Automaton()
        self.text: list[str] = []  # pieces by number, and how long each is
        self.length: list[int] = []
        for p in self.ids:
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, (len(self.text), len(p)))
                self.text.append(p)
                self.length.append(len(p))
        self.automaton.make_automaton()
        self.id_of = [self.ids[p] for p in self.text]
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[list[int], str]] = {}

    def merge(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair of best score until none is a piece."""
        parts, nxt, prev = list(text), [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [p for p in parts if p]

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece a then piece b is how BPE encodes their concatenation."""
        if len(self.pairs) > CACHE_RUNS:
            self.pairs.clear()
        x, y = self.text[a], self.text[b]
        known = self.pairs[a << 32 | b] = self.merge(x + y) == [x, y]
        return known

    def encode_pieces(self, run: str) -> list[int]:
        """Ids of a run by the table of last tokens, from the back; a character without a piece is its bytes.

        The automaton names the pieces that end at a place longest first; the first that may follow the last token of
        the prefix before it is the one.
        """
        last, done, known = [-1] * len(run), -1, self.pairs.get
        for end, (piece, n) in self.automaton.iter(run):
            if end == done:
                continue
            before = last[end - n] if end >= n else -1
            if before >= 0:
                fits = known(before << 32 | piece)
                if not (self.compatible(before, piece) if fits is None else fits):
                    continue
            last[end] = piece
            done = end
        out, i = [], len(run) - 1
        while i >= 0:
            piece = last[i]
            if piece >= 0:
                out.append(self.id_of[piece])
                i -= self.length[piece]
            else:
                out.extend(self.bytes[b] for b in reversed(run[i].encode()))
                i -= 1
        out.reverse()
        return out

    def encode_run(self, run: str) -> tuple[list[int], str]:
        known = self.cache.get(run)
        if known is None:
            ids = self.encode_pieces(run)
            known = (ids, ",".join(map(str, ids)))
            if len(run) <= 64:
                if len(self.cache) >= CACHE_RUNS:
                    self.cache.clear()
                self.cache[run] = known
        return known

    def encode(self, text: str) -> tuple[list[int], str]:
        """(ids, the ids joined by commas)."""
        marked = text.replace(" ", MARK)
        if self.dummy_prefix and marked:
            marked = MARK + marked
        known = self.cache.get
        runs = [known(r) or self.encode_run(r) for r in self.runs.findall(marked)]
        return list(chain.from_iterable([r[0] for r in runs])), ",".join([r[1] for r in runs])


_tables: dict[str, tuple] = {}


def loaded(path: str) -> tuple:
    """(prefix table, the library's processor), built once in a worker."""
    if path not in _tables:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        _tables[path] = (PrefixTable(model), sentencepiece.SentencePieceProcessor(model_proto=model))
        gc.freeze()  # tables and remembered runs hold no cycles; looking for them over and over costs a tenth of the time
        gc.set_threshold(200_000, 50, 100)
    return _tables[path]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Every whole text is encoded without begin or end ids, then decoded by the library. A null text counts as empty
    and has no ids; a text of any length is encoded by its task alone. Repeated rows are encoded alike; a null doc_id is kept; other columns are ignored; no documents
    give no rows. model_path is a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, processor = loaded(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, said, back, kept = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids, joined = table.encode(text or "")
                    n.append(len(ids))
                    said.append(sha(joined))
                    back.append(sha(processor.decode(ids) if ids else ""))
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, kind)
