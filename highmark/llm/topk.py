"""Exact top-k by inner product, from sorted lists that are only read in sequence.

Vectors are dealt out in blocks. Each block keeps, for each dimension, its vectors in order of their
component; for a query these are lists of contributions, read from the end that adds most. Reading all
lists to a depth bounds each vector's score from below (what was read, and the least that the unread
components can add) and from above (the last value read in their place). Vectors whose upper bound
lies below the k-th lower bound are out, seen or not. Reading ends when no outsider can qualify and those that
remain are fewer than the entries still unread in a list; their final scores are then resolved in
integers from their own vectors, which the block holds. No list is ever probed for a vector. Blocks meet
in a last selection of k per query.

Blocks are searched in rounds, each MORE times as many as all before. A query's k-th best score so far goes along
to the next round as a bound that its vectors must reach; so later blocks stop earlier and return what
can still count, a few times k rows a query and round in expectation, however many blocks there are.

How much is left unread depends on the data: components that vary alike in all dimensions, as those of random vectors,
keep bounds wide until nine tenths of the lists are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.llm._shared import Scratch, stored

#: Vectors and queries of a block.
BLOCK, QUERIES = 2_048, 256
#: Blocks of a round as a multiple of those before.
MORE = 3
#: Shares of a list that are read before bounds are compared.
DEPTHS = (0.5, 0.8, 0.9, 0.95, 0.99, 1)
_PACKED = "part int, width int, ids binary, rows binary, least binary"
#: Stands for no bound.
_NO_BOUND = -(1 << 63)
_FOUND = "query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of a block of integer vectors, n by d."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows.T, self.order, axis=1).astype(np.float64)
        self.place = np.empty_like(rows, dtype=np.int32)  # a row's place in each list
        np.put_along_axis(self.place, self.order.T, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best (ties to the smaller id) that reach `least`, the query's own row left out; entries read of each list."""
        n = len(self.ids)
        weight, up = query.astype(np.float64), query > 0
        order, values, side = self.order, self.values, up[:, None]
        final = np.where(up, values[:, 0], values[:, -1]) * weight
        read = np.full(n, final.sum())  # lower bounds: an unread component adds its list's last entry
        slack = 1e-12 * (np.abs(values[:, [0, -1]]).max(axis=1) @ np.abs(weight)) if len(query) else 0.0  # of sums in floating point
        alive, at = self.ids != query_id, 0
        for share in DEPTHS if len(query) else ():
            if int(alive.sum()) <= max(k, n - at) and at:
                break
            depth = max(at + 1, min(n, int(np.ceil(n * share))))
            rows = np.where(side, order[:, n - depth : n - at], order[:, at:depth])
            added = np.where(side, values[:, n - depth : n - at], values[:, at:depth]) * weight[:, None] - final[:, None]
            read += np.bincount(rows.ravel(), weights=added.ravel(), minlength=n)
            at = depth
            if at == n:
                break
            left = np.flatnonzero(alive)
            if len(left) > k or (least is not None and len(left)):
                place = self.place[left]
                unread = (place < np.where(up, n - depth, 0)) | (place >= np.where(up, n, depth))
                last = np.where(up, values[:, n - depth], values[:, depth - 1]) * weight
                upper = read[left] + unread @ (last - final)
                bar = np.partition(read[left], len(left) - k)[len(left) - k] if len(left) > k else -np.inf
                alive[left[upper < max(bar, -np.inf if least is None else least) - slack]] = False
        left = np.flatnonzero(alive)
        if at == n and len(left) > k:  # all is read: only what rounding can't tell apart is left
            left = left[read[left] >= np.partition(read[left], len(left) - k)[len(left) - k] - slack]
        score = self.rows[left] @ query
        if least is not None:
            left, score = left[score >= least], score[score >= least]
        best = np.lexsort((self.ids[left], -score))[:k]
        return self.ids[left][best], score[best], at


def _usable(vector: str) -> Column:
    return F.expr(f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """rows(id, v array<long>, least long or left out) in blocks of at most `size` rows of one width, from within each partition, whose number is kept as part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray], list[int]]] = {}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def block(width: int) -> pa.RecordBatch:
            ids, vs, least = held.pop(width)
            row = [TaskContext.get().partitionId(), width, np.array(ids, dtype="<i8").tobytes(), np.array(vs, dtype="<i8").reshape(len(ids), width).tobytes(), np.array(least, dtype="<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

        for b in batches:
            bounds = b.column(2).to_pylist() if b.num_columns > 2 else [_NO_BOUND] * b.num_rows
            for i, v, bound in zip(b.column(0).to_pylist(), b.column(1), bounds, strict=True):
                own = v.values.to_numpy()
                ids, vs, least = held.setdefault(len(own), ([], [], []))
                ids.append(i)
                vs.append(own)
                least.append(bound)
                if len(ids) == size:
                    yield block(len(own))
        for width in [*held]:
            yield block(width)

    return rows.mapInArrow(pack, _PACKED)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, spread: int | None = None) -> DataFrame:
    """For each row of queries(vec_id, embedding), the k best rows of vectors(vec_id, embedding) but those of its own vec_id.

    Components become floor(scale * x); scores are their exact inner products, which should fit in 64 bits.
    Returns query_id, rank (from 1), vec_id, score, best first, ties to the
    smaller vec_id; repeated rows are candidates each. Rows with a null vec_id, or whose vector is null
    or has a null, NaN or infinite component, take no part; vectors of another width than the query's are no
    candidates. A query without candidates has no rows.

    Vectors are dealt evenly over `spread` groups, by default one for each BLOCK of them, and each query block goes to every group,
    so queries meet all rows in blocks: what is copied is queries times `spread`. What comes back is k rows a query from the first
    group, and from later rounds what reaches the k-th score before.
    """
    whole = lambda df: df.filter("vec_id is not null").filter(_usable("embedding")).select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )
    scratch = Scratch(vectors.sparkSession)
    spread = spread or max(1, -(-vectors.count() // BLOCK))
    blocks = scratch.stored(_packed(whole(vectors).repartition(spread), BLOCK).withColumnRenamed("part", "group"), "blocks")
    wanted = scratch.stored(whole(queries), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: tuple[bytes, Lists] | None = None
        for b in batches:
            for at in range(b.num_rows):
                width, ids, rows, q_ids, q_rows, q_least = (c[at].as_py() for c in b.columns)
                if made is None or made[0] != ids:
                    own = np.frombuffer(ids, dtype="<i8")
                    made = ids, Lists(own, np.frombuffer(rows, dtype="<i8").reshape(len(own), width))
                asked_ids, least = np.frombuffer(q_ids, dtype="<i8"), np.frombuffer(q_least, dtype="<i8")
                out: list[tuple[np.ndarray, ...]] = []
                for q, bound, v in zip(asked_ids.tolist(), least.tolist(), np.frombuffer(q_rows, dtype="<i8").reshape(len(asked_ids), width), strict=True):
                    found, score, _ = made[1].top(q, v, k, None if bound == _NO_BOUND else bound)
                    out.append((np.full(len(found), q), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    top, low = None, 0
    while low < spread:
        high = min(spread, max(1, low * (MORE + 1)))
        least = F.lit(_NO_BOUND) if top is None else F.coalesce("least", F.lit(_NO_BOUND))
        bounds = wanted if top is None else wanted.join(top.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least")), "id", "left")
        asked = _packed(bounds.select("id", "v", least.alias("least")).repartition(max(1, spread // 64)), QUERIES)
        asked = asked.select("width", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("least").alias("q_least"), F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("group"))
        # a merge join: a broadcast would bring queries, times groups, to the driver, as explode() makes more rows than Spark reckons with
        met = blocks.filter(F.col("group").between(low, high - 1)).hint("merge").join(asked, ["group", "width"]).select("width", "ids", "rows", "q_ids", "q_rows", "q_least")
        found = met.mapInArrow(search, _FOUND)
        if top is not None:
            found = found.unionByName(top.select("query_id", "vec_id", "score"))
        top = stored(ranked(found), "top") if high == spread else scratch.stored(ranked(found), "top")
        low = high
    scratch.drop()
    return top
