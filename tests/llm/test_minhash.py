import random

import numpy as np
import pyarrow as pa
from tests.llm import brute

from lexstrata.llm import minhash
from lexstrata.llm.common import Scratch, read
from lexstrata.llm.components import components
from lexstrata.llm.tokens import chunks, shingle_sets


def test_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute.op3([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    assert sum(i != c for i, (_, c) in want.items()) > 20


def test_chain_of_many_copies(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.op3(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b\x0bC"), (4, "a  B\nc"), (5, " \t"), (None, "a b c"), (7, "x y"), (7, "a b c"), (9, "q " * 100_000), (8, "Q q q q q"), (6, "X Y")]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=lambda r: (r[0] or 0, r[1])) == [
        (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 3, False),
        (7, 1, 3, False), (7, 1, 3, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_shingle_hashes_tell_shingles_apart():
    texts = ["the cat sat on the mat", "The  CAT sat\ton the\nmat", "cat the sat on the mat", "", "é ü a b c d", "aa bb", "aab b"]
    sets = [s for _, d, o in chunks(pa.array(texts)) for s in shingle_sets(d, o)]
    want = [brute.shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_odd_sketches_differ_in_no_more_bits_than_the_sets(spark):
    rng, words = random.Random(8), [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 900])))) for i in range(30)]
    rows += [(100 + i, text + " and one more word") for i, text in rows]
    odd = {r.doc_id: r.parity for r in minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: brute.shingles(text) for i, text in rows}
    for a in sets:
        for b in sets:
            differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(odd[a], odd[b], strict=True))
            assert differ <= len(sets[a] ^ sets[b])
    assert all(any(x) for x in odd.values())
