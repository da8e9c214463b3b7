import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lexstrata.llm import ball_tree as bt

SCHEMA = "vec_id bigint, embedding array<float>, cluster string"


def plain(rows, clusters, rounds):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-bt.LIMIT, min(bt.LIMIT, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    per = {k: sum(d for d, o in last if o == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, per[k], sum(per.values()), sha[k]) for (i, _), (d, k) in zip(kept, last, strict=True)], key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in bt.cluster(docs, **options).collect()], key=str)


def cases():
    r = random.Random(5)
    at = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    near = [(i, [c + r.gauss(0, 0.02) for c in at[i % 6]]) for i in range(150)]
    same = [(1000 + i, at[0]) for i in range(120)]
    odd = [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [math.nan] * 64), (2006, [math.inf] + [0.0] * 63), (2007, [-0.0001] * 64), (None, [0.25] * 64), (7, at[1]), (7, at[2])]
    return near + same + odd


def test_clusters_equal_plain_comparison(spark):
    assert run(spark, cases()) == plain(cases(), 16, 3)
    assert run(spark, cases(), clusters=3, rounds=5) == plain(cases(), 3, 5)


def test_large_components_and_few_vectors(spark):
    rows = [(1, [3.0e4] * 64), (2, [-2.0e6] * 64), (3, [1e30] + [0.0] * 63), (4, [-3.4e38] * 64)]
    assert run(spark, rows) == plain(rows, 16, 3)


def test_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_whole_balls_are_exact(spread):
    """Trees over several kinds of clouds, with ties and copies; most vectors of tight clouds go by whole balls."""
    r = np.random.default_rng(int(spread * 100))
    at = r.integers(-60, 60, (8, 64))
    points = at[r.integers(0, 8, 3000)] + np.round(r.normal(0, 20 * spread, (3000, 64))).astype(np.int64)
    points[:400] = points[0]
    centroids = np.concatenate([at + r.integers(-3, 4, at.shape), at[:2] * 0, at[:2] * 0])
    tree = bt.build(np.arange(3000).astype(object), points)
    cluster, squared = bt.assign(tree, centroids)
    d = ((tree["points"][:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (squared == d.min(1)).all()
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    bt.gather(tree, centroids, counts, sums)
    assert (counts == np.bincount(cluster, minlength=len(centroids))).all()
    assert all((sums[k] == tree["points"][cluster == k].sum(0)).all() for k in range(len(centroids)))
    whole = sum(n for _, _, n, left in bt.walk(tree, centroids) if len(left) == 1)
    assert whole > 2900 if spread == 0.01 else whole >= 400


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = bt.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(bt.ORACLE).fetchall())
