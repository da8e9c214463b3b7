import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest

from lexstrata.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, row string, pairs int"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return alignment.ByteLevel(A), alignment.Pieces(B)


def plain(rows, sides):
    """Token by token with byte sets, every pair of tokens compared."""
    a_side, b_side = sides
    of_a = {i: bytes(a_side.table.joined(alignment.np.array([i]))) for i in range(a_side.table.size)}

    def piece(i):
        p = b_side.model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    def spans(ids, said):
        out, at = [], 0
        for i in ids:
            out.append((at, at := at + len(said(i)), i))
        return out

    docs, counts = [], Counter()
    for doc, text in rows:
        whole = (" " + text).encode() if text else b""
        a = spans(a_side.plain.encode(" " + text, add_special_tokens=False).ids, of_a.get) if text else []
        b = spans(b_side.model.encode(text), piece) if text else []
        if b"".join(of_a[i] for *_, i in a) != whole or b"".join(piece(i) for *_, i in b) != whole:
            a = b = []
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [[",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (a, b)] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        counts.update(links)
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted([(d, n_a, n_b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, n_a, n_b, g, links, sha in docs], key=str)


TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."), (3, None), (4, ""), (5, " "), (6, "  two  spaces \n\n\t tabs"),
    (7, "Ünïcödé ıİ şğ 漢字 🙂🙃 \u0000 end"), (8, "a▁b is no space"), (9, "<|endoftext|> and </s> and <s> are plain <0x41>"), (None, "null id"), (10, "x" * 3000 + " " + "ab " * 700), (11, "  ​odd"), (1, "another row of one id"), (12, "tionessh ndoued thoundwh " * 30)]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_plain_comparison(spark, sides, head):
    docs = spark.createDataFrame([(d, t, "own", 3) for d, t in TEXTS], SCHEMA).repartition(3)
    got = alignment.align_tokens(docs, A, B, head=head)
    assert got.columns == list(COLUMNS)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(TEXTS, sides)


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.align_tokens(docs, A, B).collect() == []
    only = spark.createDataFrame([(1, None, "", 0)], SCHEMA)
    assert [tuple(r) for r in alignment.align_tokens(only, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ranks_give_the_ids_of_the_file(sides):
    """Every code point between letters, digits, signs and spaces, and long runs of each kind."""
    a, _ = sides
    assert a.fast is not None
    texts = [f" a{c}b 1{c}2 {c}{c} .{c}! {c} x" for c in map(chr, [*range(1, 0x3100, 3), *range(0xA000, 0xD800, 97), *range(0xE000, 0x20000, 53)])]
    texts += [" " + x * 20_000 for x in (" ", "a", "\n", "é", "ab ", "1", "!?")] + [" " * 300_000 + "x"]
    for t, ids in zip(texts, a.encode(texts), strict=True):
        assert ids == a.plain.encode(t, add_special_tokens=False).ids


def test_shared_words_of_the_corpus(spark, sides):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 600]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted([tuple(r) for r in alignment.align_tokens(docs, A, B, head=500).collect()], key=str) == plain(rows, sides)
