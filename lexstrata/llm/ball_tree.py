"""Centroid clustering filtered by ball trees.

Each task turns its vectors into metric trees of TREE_ROWS vectors at most. A node stores its ball's centre and radius, and
the count and integer sum of its vectors. A round walks every tree with the centroids: where the triangle inequality
leaves one centroid, the ball goes to it whole, by count and sum; else its children are asked about those left, and
leaves compute exact integer distances. The trees are written once and read again by every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of one tree (2 MB of components) and of a leaf; a ball of equal vectors is a leaf of any size.
TREE_ROWS, LEAF = 8192, 24
#: Components are held within this, so that squared distances fit a long: vectors within 2^21 are never touched.
LIMIT = 1 << 27
TREE = "ids array<bigint>, points binary, starts binary, counts binary, children binary, centres binary, radii binary, sums binary"


def integer_vectors(embeddings: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<int>: floor(scale * x) of the vectors with so many components, none null, NaN or infinite."""
    x = F.col(column).cast("array<double>")
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    rows = embeddings.where((F.size(x) == dimensions) & F.forall(x, finite))
    held: Column = F.transform(x, lambda y: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(scale)) * F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), y))))).cast("int"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), held.alias("v"))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = "1") -> np.ndarray:
    """The vectors with the smallest sha256 of '<salt>:<vec_id>', in that order; equal ids by their components. A null id
    is an empty one. At most clusters rows come to the driver."""
    key = F.sha2(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.orderBy(key, "v").limit(clusters).collect()], np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of int64 rows. Within 2^22 a product of floats is exact, and fast."""
    if len(points) and max(np.abs(points).max(), np.abs(centroids).max(initial=0)) < 1 << 22:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (_norms(p)[:, None] - 2 * (p @ c.T) + _norms(c)[None, :]).astype(np.int64)
    return np.stack([_norms(points - c) for c in centroids], 1) if len(centroids) else np.zeros((len(points), 0), np.int64)


def build(ids: np.ndarray, points: np.ndarray) -> dict:
    """A tree over int64 points: nodes in the order of a walk from the root, vectors in the order of the leaves."""
    order = np.arange(len(points))
    nodes: list[tuple[int, int, np.ndarray, float, np.ndarray]] = []
    children: list[list[int]] = []
    todo = [(0, len(points), -1)]
    while todo:
        start, end, parent = todo.pop()
        own = points[order[start:end]]
        total = own.sum(0)
        centre = total / len(own)
        away = np.sqrt(_norms(own - centre))
        at = len(nodes)
        nodes.append((start, end - start, centre, float(away.max()), total))
        children.append([])
        if parent >= 0:
            children[parent].append(at)
        if end - start > LEAF and (own != own[0]).any():
            # two far vectors part the ball: the farthest from the centre, and the farthest from that
            one = own[away.argmax()]
            from_one = _norms((own - one).astype(np.float64))
            near = _norms((own - own[from_one.argmax()]).astype(np.float64)) < from_one
            if not near.any() or near.all():
                near = np.arange(len(own)) < len(own) // 2
            order[start:end] = np.concatenate([order[start:end][~near], order[start:end][near]])
            middle = start + int((~near).sum())
            todo += [(middle, end, at), (start, middle, at)]
    starts, counts, centres, radii, sums = (np.array(x) for x in zip(*nodes, strict=True))
    # what rounding can hide is added to the radius
    radii = radii * (1 + 1e-9) + 1e-6 + np.abs(centres).max() * 1e-12
    pairs = np.array([c or [-1, -1] for c in children], np.int32)
    return {"ids": ids[order], "points": points[order].astype(np.int32), "starts": starts.astype(np.int32), "counts": counts.astype(np.int32), "children": pairs, "centres": centres, "radii": radii, "sums": sums}


def walk(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(node, first, number of vectors, their centroid, or None where they have to be measured) over all vectors once,
    the centroids left for those as the last."""
    floats = centroids.astype(np.float64)
    # one product for all balls of the tree
    gaps = tree["centres"] @ floats.T
    gaps = np.sqrt(np.maximum(0, _norms(tree["centres"])[:, None] - 2 * gaps + _norms(floats)[None, :]))
    slack = 1e-6 + 1e-7 * (np.abs(tree["centres"]).max() + np.abs(floats).max()) * np.sqrt(floats.shape[1])
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        at, left = todo.pop()
        gap, reach = gaps[at, left], tree["radii"][at] + slack
        left = left[gap - reach <= (gap + reach).min()]
        if len(left) == 1 or tree["children"][at, 0] < 0:
            yield at, int(tree["starts"][at]), int(tree["counts"][at]), left
        else:
            todo += [(int(c), left) for c in tree["children"][at]]


def assign(tree: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each of a tree's vectors; ties go to the smaller number."""
    cluster, squared = np.empty(len(tree["ids"]), np.int64), np.empty(len(tree["ids"]), np.int64)
    points = tree["points"].astype(np.int64)
    for _, first, n, left in walk(tree, centroids):
        d = distances(points[first : first + n], centroids[left])
        best = d.argmin(1)
        cluster[first : first + n], squared[first : first + n] = left[best], d[np.arange(n), best]
    return cluster, squared


def gather(tree: dict, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds to each centroid's count and sum what a tree has for it."""
    points = tree["points"].astype(np.int64)
    for at, first, n, left in walk(tree, centroids):
        if len(left) == 1:
            counts[left[0]] += n
            sums[left[0]] += tree["sums"][at]
        else:
            best = left[distances(points[first : first + n], centroids[left]).argmin(1)]
            np.add.at(counts, best, 1)
            np.add.at(sums, best, points[first : first + n])


def _load(row: dict, dimensions: int) -> dict:
    out = {"ids": row["ids"]}
    for c, kind, shape in (("points", np.int32, (-1, dimensions)), ("starts", np.int32, -1), ("counts", np.int32, -1), ("children", np.int32, (-1, 2)), ("centres", np.float64, (-1, dimensions)), ("radii", np.float64, -1), ("sums", np.int64, (-1, dimensions))):
        out[c] = np.frombuffer(row[c], kind).reshape(shape)
    return out


def trees(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """TREE: the vectors (vec_id, v) of each partition as trees; null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        points: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            t = build(np.array(ids, object), np.concatenate(points))
            ids.clear()
            points.clear()
            return pa.RecordBatch.from_pydict({"ids": pa.array([t["ids"].tolist()], pa.list_(pa.int64())), **{c: pa.array([t[c].tobytes()], pa.binary()) for c in t if c != "ids"}})

        for batch in batches:
            own = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            names, start = batch.column("vec_id").to_pylist(), 0
            while start < len(own):
                take = min(TREE_ROWS - len(ids), len(own) - start)
                ids += names[start : start + take]
                points.append(own[start : start + take])
                start += take
                if len(ids) == TREE_ROWS:
                    yield flush()
        if ids:
            yield flush()

    return vectors.mapInArrow(run, TREE)


def moved(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of each one's vectors; those without any stay. A task sends a
    row per centroid, and as many come to the driver."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                gather(_load(row, dimensions), centroids, counts, sums)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": pa.array(counts[own]), "s": pa.array(list(sums[own]), pa.list_(pa.int64()))})

    parts = grown.mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    per = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dimensions)]).alias("s"))
    out = centroids.copy()
    for r in per.collect():
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def cluster(embeddings: DataFrame, column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the kept vectors (vec_id, column).

    Vectors of another length, null ones and ones with a null, NaN or infinite component are left out. Components beyond
    2^21 are cut to what keeps squared distances in a long. Repeated rows each count and each give a row; of fewer vectors
    than clusters each seeds one; null ids stay, other columns are ignored, no vectors give no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    grown = scratch.save(trees(integer_vectors(embeddings, column, dimensions, scale), dimensions), "trees")
    centroids = seeds(integer_vectors(embeddings, column, dimensions, scale), clusters).reshape(-1, dimensions)
    for _ in range(rounds):
        centroids = moved(grown, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _load(row, dimensions)
                own, squared = assign(tree, centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(tree["ids"], pa.int64()), "cluster": pa.array(own, pa.int32()), "distance": pa.array(squared)})

    found = scratch.save(grown.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "assigned")
    scratch.drop(grown)
    per = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row per cluster
    digest = lambda c: hashlib.sha256(",".join(str(x) for x in centroids[c]).encode()).hexdigest()
    rows = [(c, min(d, 2**63 - 1), min(sum(per.values()), 2**63 - 1), digest(c)) for c, d in per.items()]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # totals: a row per cluster


#: The same in DuckDB, one row per component.
ORACLE = f"""WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
v AS (SELECT vec_id, unnest(range(1, {DIMENSIONS + 1})) AS i, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM k),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM k QUALIFY c < {CLUSTERS}),
c0 AS (SELECT c, i, x FROM s JOIN v USING (vec_id)), """ + ", ".join(
    f"""d{r} AS (SELECT vec_id, c, sum((v.x - q.x) * (v.x - q.x))::BIGINT AS d FROM v JOIN c{r} q USING (i) GROUP BY vec_id, c),
a{r} AS (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    + (f""", m{r} AS (SELECT c, i, sum(x)::BIGINT AS t, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, i),
c{r + 1} AS (SELECT q.c, q.i, coalesce((t - ((t % n) + n) % n) // n, q.x) AS x FROM c{r} q LEFT JOIN m{r} USING (c, i))""" if r < ROUNDS else "")
    for r in range(ROUNDS + 1)
) + f""", h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{ROUNDS} JOIN h USING (c)"""  # fmt: skip
