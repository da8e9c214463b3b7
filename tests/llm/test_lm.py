import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tests.llm.brute import WORD

from lexstrata.llm import lm_scoring
from lexstrata.llm.common import read


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        t = tokens(x)
        yield i, out(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)


@pytest.mark.parametrize("head", [2_000_000, 300])
def test_base_is_exact(spark, sf_dir, head):
    docs = read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1001, None), (1002, ""), (1002, ""), (None, "The the A"), (1003, "nowhere " * 30_000), (1004, " \t\n")]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS n_tokens", "text AS score")
    got = lm_scoring.score(more, head=head).collect()
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for r, w in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str), want, strict=True):
        assert r[:5] == w[:5]
        assert math.isclose(r[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r[6]) and r[6] < 0


def test_empty(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.n_known for r in lm_scoring.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [0]


def test_filters_hold_levels():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**48, 40_000).astype(np.uint64))
    want = rng.integers(1, 13, len(h))
    buckets = 7
    own = lm_scoring.bucket_of(h, buckets, 48)
    pieces = {q: [(b, lm_scoring.level_filter(h[(own == b) & (want >= q)], q).tobytes()) for b in range(buckets)] for q in range(1, 13)}
    whole = lm_scoring.Pieces(1, buckets, pieces, 48)
    found = whole.climb(h, np.zeros(len(h), np.int64))
    assert (found >= want).all() and (found == want).mean() > 0.97
    assert (whole.climb(np.setdiff1d(rng.integers(0, 2**48, 40_000).astype(np.uint64), h), np.zeros(40_000, np.int64)) > 0).mean() < 0.03
    for least in (2, 5):  # low levels in their bucket, high ones together: the same answers
        low = lm_scoring.Pieces(1, buckets, {q: x for q, x in pieces.items() if q < least}, 48).climb(h, np.zeros(len(h), np.int64))
        high = lm_scoring.Pieces(least, buckets, {q: x for q, x in pieces.items() if q >= least}, 48).climb(h, low)
        assert (high == found).all()


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5_000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        c = rng.integers(1, 70_000, len(h)).astype(np.uint64)
        x, y = lm_scoring.unpack(lm_scoring.pack(h, c))
        assert (x == h).all() and (y == c).all()
        assert (lm_scoring.unpack(lm_scoring.pack(h), False)[0] == h).all()


def test_pairs_help_on_repeated_text(spark):
    rows = [(i, "alpha beta gamma delta epsilon " * 20) for i in range(40)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def is_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def quantised(k):
    return 2.0 ** math.floor(math.log2(k)) if k else 0.0


class Plain:
    """The model with every n-gram's count rounded down to a power of two and every word's count as it is."""

    def __init__(self, rows):
        self.train = [tokens(x) for i, x in rows if not is_out(i)]
        self.c = Counter(t for x in self.train for t in x)
        full = [[0, 0, *x] for x in self.train]
        self.two = Counter(g for x in full for g in zip(x[1:], x[2:]))
        self.three = Counter(g for x in full for g in zip(x, x[1:], x[2:]))
        self.space = sum(self.c.values()) + 0.1 * (len(self.c) + 1)

    def p(self, u, v, w):
        three, two = quantised(self.three[u, v, w]), quantised(self.two[v, w])
        q = quantised(self.two[u, v])
        after_two = len(self.train) if v == 0 else 2 * q - 1 if q else 0
        after_one = len(self.train) if v == 0 else self.c[v]
        return 0.5 * three / max(after_two, 1) + 0.2 * two / max(after_one, 1) + 0.3 * (self.c[w] + 0.1) / self.space

    def scored(self, rows):
        for i, x in rows:
            t = [0, 0, *tokens(x)]
            yield i, len(t) - 2, sum(math.log10(self.p(*g)) for g in zip(t, t[1:], t[2:]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_row(rows):
    return sorted(rows, key=lambda r: str((r.doc_id, r.n_tokens, r.score)))


def test_probabilities_sum_to_one_at_most(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    model = Plain(rows)
    words, rng = [*model.c, "neverseen"], np.random.default_rng(3)
    pairs = list(model.two)
    for k in rng.integers(0, len(pairs), 150):
        assert 0.29 < sum(model.p(*pairs[k], w) for w in words) <= 1 + 1e-9
    assert sum(model.p(0, 0, w) for w in words) <= 1 + 1e-9
    starts = [(i, f"word{i % 60}") for i in range(1_800)]  # the operator's own start probabilities
    model, got = Plain(starts), {}
    for r in lm_scoring.score(frame(spark, starts)).join(frame(spark, starts), "doc_id").collect():
        got[r.text] = 10**r.score / model.p(0, r.text, None)
    assert len(got) == 60 and sum(got.values()) <= 1


@pytest.fixture(scope="module")
def odd_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    return rows + [(1001, None), (1002, ""), (None, "The the A"), (1003, "nowhere " * 3_000), (1004, "seen once"), (1005, "never seen"), (1006, "seen once")]


def test_score_equals_a_plain_model(spark, odd_rows):
    """A filter with room takes no n-gram for another; one of the usual size takes about one in a hundred."""
    want = sorted(Plain(odd_rows).scored(odd_rows), key=str)
    for bits, off in ((400, 1e-9), (lm_scoring.BITS_PER_ENTRY, 8e-2)):
        got = by_row(lm_scoring.score(frame(spark, odd_rows), bits_per_entry=bits).collect())
        assert all(math.isclose(r.score, w[2], rel_tol=off) for r, w in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def usual(spark, odd_rows):
    return by_row(lm_scoring.score(frame(spark, odd_rows)).collect())


@pytest.mark.parametrize(("head", "filter_bytes"), [(300, 96 << 20), (2_000_000, 1), (0, 40_000)])
def test_score_is_the_same_within_any_bounds(spark, odd_rows, usual, head, filter_bytes):
    a, b = usual, by_row(lm_scoring.score(frame(spark, odd_rows), head=head, filter_bytes=filter_bytes).collect())
    assert [(*x[:5], round(x[5], 6), round(x[6], 6)) for x in a] == [(*x[:5], round(x[5], 6), round(x[6], 6)) for x in b]


@pytest.mark.parametrize(("head", "filter_bytes", "bits", "off"), [(300, 1, 400, 1e-9), (300, 40_000, 12, 8e-2), (2_000_000, 1, 12, 8e-2)])
def test_many_buckets_dealt_in_two_steps(spark, odd_rows, monkeypatch, head, filter_bytes, bits, off):
    """Thousands of buckets of about 60 n-grams each: counts pass 16 ranges first, chunks ask regions of several buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_ENTRIES", 60)
    monkeypatch.setattr(lm_scoring, "FAN", 16)
    got = by_row(lm_scoring.score(frame(spark, odd_rows), head=head, filter_bytes=filter_bytes, bits_per_entry=bits).collect())
    want = sorted(Plain(odd_rows).scored(odd_rows), key=str)
    base = sorted(brute(odd_rows), key=lambda r: str((r[0], r[2])))
    assert all(math.isclose(r.score, w[2], rel_tol=off) for r, w in zip(got, want, strict=True))
    for r, w in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_tokens))), base, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and math.isclose(r.base_score, w[5], rel_tol=1e-9)


def test_rows_sent_hold_runs_of_hashes(spark, odd_rows):
    """The rows of the first step do not grow in number with the buckets."""
    docs = frame(spark, odd_rows).coalesce(1)
    first = lm_scoring.counted(docs, lm_scoring.FAN, 48).count()
    dealt = lm_scoring.counted(docs, 4 * lm_scoring.FAN, 48)
    assert first <= lm_scoring.FAN and dealt.count() <= 4 * lm_scoring.FAN
    fine = [x for r in dealt.collect() for x in lm_scoring.unpack(r.grams)[0].tolist()]
    assert len(set(fine)) == len(fine) == len({x for r in lm_scoring.counted(docs, 1, 48).collect() for x in lm_scoring.unpack(r.grams)[0].tolist()})


def test_documents_learned_twice_stand_apart(spark):
    """Texts of random words: a text that occurs twice scores above those that occur once, and those above texts held out."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 200)) for _ in range(900)]
    rows = [*enumerate(texts), *((10_000 + k, texts[k]) for k in range(60))]
    got = {r.doc_id: (r.score / r.n_tokens, r.held_out) for r in lm_scoring.score(frame(spark, rows)).collect()}
    twice = [got[k][0] for k in range(60) if not is_out(k) and not is_out(10_000 + k)]
    once = [got[k][0] for k in range(60, 900) if not is_out(k)]
    out = [got[k][0] for k in range(60, 900) if is_out(k)]
    assert min(twice) > max(once) and min(once) > max(out)


def test_base_columns_equal_sql(spark, sf_dir):
    sql = r"""
    WITH d AS (SELECT doc_id, held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), NULL) AS t FROM docs),
    x AS (SELECT doc_id, held_out, unnest(t) AS w FROM d),
    c AS (SELECT w, count(*) AS c FROM x WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT x.doc_id, any_value(held_out), count(*), count(c.c), any_value(n)::BIGINT, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1))))
    FROM x LEFT JOIN c ON x.w IS NOT DISTINCT FROM c.w, n GROUP BY x.doc_id"""
    docs = read(spark, sf_dir, "documents")
    con = duckdb.connect()
    table = docs.select("doc_id", "text", lm_scoring.held_out().alias("held_out")).toArrow()
    con.register("docs", table)
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    for r in lm_scoring.score(docs).collect():
        w = want.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
    assert not want
