"""Centroid clustering over partition-local ball trees.

Vectors become integers once and are stored in trees of at most TREE vectors, each built by the task that
reads them: balls with count, integer sum and radius, down to leaves of at most LEAF vectors. A round
reads the trees. Where the triangle inequality shows that one centroid is nearer than all others to
every vector of a ball, the ball goes to it as a whole, by its count and sum; other balls are opened, and the
vectors of leaves compared one by one, in whole numbers. What a round sends on is a count and a sum per task and
centroid; the driver holds the centroids, CENTROIDS times COMPONENTS numbers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from highmark.llm._shared import Scratch, stored

CENTROIDS, ROUNDS, COMPONENTS = 8, 10, 64
TREE, LEAF = 8192, 32
#: Components up to this size are compared in 64 bits without overflow; up to the next in exact doubles, which is faster.
MOST, FAST = 1 << 27, 1 << 21
#: Distances in doubles are taken to be exact to this share of what they are made of.
_ERROR = 1e-9


class Tree:
    """Balls over vectors, which are put in the order of the leaves: `order` tells how. Ball k has balls 2k + 1 and 2k + 2 within it."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        depth = max(0, int(np.ceil(np.log2(max(1, len(vectors)) / LEAF))))
        n = (1 << (depth + 1)) - 1
        self.first, self.end, self.radius = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        self.sums = np.zeros((n, vectors.shape[1]), np.int64)
        self.end[0] = len(vectors)
        near = vectors.astype(np.float64)
        for k in range(n):
            a, b = self.first[k], self.end[k]
            rows = self.order[a:b]
            own = near[rows]
            self.sums[k] = vectors[rows].sum(axis=0)
            middle = self.sums[k] / max(1, b - a)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            self.radius[k] = away.max(initial=0.0) * (1 + _ERROR) + _ERROR
            if 2 * k + 1 < n:
                half = (a + b) // 2
                if b - a > 1:  # halves along the line between two far vectors, so that each ball gets smaller
                    one = own[away.argmax()]
                    two = own[((own - one) ** 2).sum(axis=1).argmax()]
                    self.order[a:b] = rows[np.argpartition(own @ (two - one), half - a)]
                self.first[2 * k + 1], self.end[2 * k + 1], self.first[2 * k + 2], self.end[2 * k + 2] = a, half, half, b


def _record(ids: list, vectors: np.ndarray) -> tuple:
    tree = Tree(vectors)
    return ([ids[k] for k in tree.order], vectors[tree.order].astype("<i4").tobytes(), tree.first.tolist(), tree.end.tolist(), tree.radius.tolist(), tree.sums.astype("<i8").tobytes())


_TREES = "ids array<long>, vectors binary, firsts array<long>, ends array<long>, radii array<double>, sums binary"


def trees(vectors: DataFrame) -> DataFrame:
    """Trees of vectors(vec_id, v array<long>), by task, TREE vectors each but the last."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def done() -> pa.RecordBatch:
            record = _record(ids, np.concatenate(rows))
            columns = [pa.array([x], t) for x, t in zip(record, types, strict=True)]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["ids", "vectors", "firsts", "ends", "radii", "sums"]
        types = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, TREE - len(ids))
                at += part.num_rows
                ids += part.column(0).to_pylist()
                rows.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, COMPONENTS))
                if np.abs(rows[-1]).max(initial=0) > MOST:
                    raise ValueError(f"components go up to {MOST} in size")
                if len(ids) == TREE:
                    yield done()
        if ids:
            yield done()

    return vectors.select("vec_id", "v").mapInArrow(build, _TREES)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= FAST:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(tree: tuple, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of a tree (vectors, firsts, ends, radii, sums): the balls that go to a centroid as a whole, and the vectors compared one by one with theirs."""
    vectors, first, end, radius, sums = tree
    whole, leaves, level = [], [], np.array([0])
    while len(level):
        level = level[end[level] > first[level]]
        middle = sums[level] / (end[level] - first[level])[:, None]
        away = np.sqrt(((middle[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
        best = away.argmin(axis=1)
        others = away.copy()
        others[np.arange(len(level)), best] = np.inf
        nearest = away[np.arange(len(level)), best]
        sure = nearest + 2 * radius[level] < others.min(axis=1, initial=np.inf) * (1 - _ERROR) - _ERROR
        whole += zip(level[sure].tolist(), best[sure].tolist(), strict=True)
        level = level[~sure]
        last = 2 * level + 1 >= len(first)
        leaves += level[last].tolist()
        level = np.concatenate([2 * level[~last] + 1, 2 * level[~last] + 2])
    rows = np.concatenate([np.arange(first[k], end[k]) for k in leaves]) if leaves else np.zeros(0, np.int64)
    return whole, rows, distances(vectors[rows], centroids).argmin(axis=1)


def _read(b: pa.RecordBatch) -> Iterator[tuple[list, tuple]]:
    for k in range(b.num_rows):
        ids, raw, first, end, radius, sums = (c[k] for c in b.columns)
        vectors = np.frombuffer(raw.as_buffer(), "<i4").astype(np.int64).reshape(-1, COMPONENTS)
        yield ids.values, (vectors, first.values.to_numpy(), end.values.to_numpy(), radius.values.to_numpy(), np.frombuffer(sums.as_buffer(), "<i8").reshape(-1, COMPONENTS))


def _round(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the vectors that are nearest to each of centroids, which stays where there is none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), COMPONENTS), np.int64)
        for b in batches:
            for _, tree in _read(b):
                vectors, first, end, _, sums = tree
                whole, rows, nearest = assign(tree, centroids)
                for ball, c in whole:
                    n[c] += end[ball] - first[ball]
                    total[c] += sums[ball]
                n += np.bincount(nearest, minlength=len(centroids))
                np.add.at(total, nearest, vectors[rows])
        found = np.flatnonzero(n)
        columns = [pa.array(np.repeat(found, COMPONENTS)), pa.array(np.tile(np.arange(COMPONENTS), len(found))), pa.array(np.repeat(n[found], COMPONENTS)), pa.array(total[found].ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["c", "k", "n", "total"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = centroids.copy()
    for r in forest.mapInArrow(count, "c long, k long, n long, total long").groupBy("c", "k").agg(wide("n"), wide("total")).collect():
        out[r.c, r.k] = int(r.total) // int(r.n)
    return out


def whole_numbers(embedding: Column) -> Column:
    """floor(1024 * x) of each component, as long; null for vectors that don't have COMPONENTS components, all of them finite."""
    fit = (F.size(embedding) == COMPONENTS) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fit, F.transform(embedding, lambda x: F.floor(1024 * x.cast("double")).cast("long")))


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each fitting row of vectors(vec_id, embedding).

    Vectors that are null, of another length than COMPONENTS, or hold null, NaN or infinity are left out.
    The rest is counted in floor(1024 * x). Centroids start as the vectors with the smallest SHA-256 of
    `seed:vec_id` (of equal ids, the smaller components); each round gives every vector to the nearest one (ties to the
    smaller number), then moves each to floor(sum / count) of its vectors; one without vectors stays. Distances
    are squared and exact; centroid_sha256 is that of the centroid's numbers joined by commas.

    A null vec_id is a vector like others (its digest is that of `seed:`), repeated rows count as often as they
    stand. With fewer vectors than centroids there are fewer centroids, with none no row. Components above MOST
    in size raise an error. Other columns don't count.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v")).filter("v is not null")
    fit = scratch.stored(fit, "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = fit.orderBy(drawn, "v").limit(centroids).select("v").collect()
    at = np.array([r.v for r in first], dtype=np.int64).reshape(-1, COMPONENTS)
    forest = scratch.stored(trees(fit), "trees")
    for _ in range(rounds if len(at) else 0):
        at = _round(forest, at)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in _read(b):
                vectors, first, end, _, _ = tree
                whole, rows, nearest = assign(tree, at)
                own = np.zeros(len(vectors), np.int64)
                for ball, c in whole:
                    own[first[ball] : end[ball]] = c
                own[rows] = nearest
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(((vectors - at[own]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    placed = stored(forest.mapInArrow(place, "vec_id long, cluster int, distance long"), "clusters")
    scratch.drop()
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    if not sums:
        return placed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    return placed.select("*", of([sums.get(c, 0) for c in range(len(at))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
