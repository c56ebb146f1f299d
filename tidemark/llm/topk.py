"""Exact top-k search with an M-tree, best first."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

K, SCALE, EVERY = 5, 256, 50
#: Vectors of a leaf page and of one tree; children of an inner node.
PAGE, TREE, FANOUT = 128, 16_384, 16
#: Open nodes that a query with k candidates takes before its bound is looked at again.
STEPS = 16
#: Queries of a row (2,048 at most: their number takes 11 bits), and inner products that a cell of trees and queries would need without any bound.
QUERIES, WORK = 2_048, 20_000_000_000


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    top = np.abs(whole).max(initial=0)
    return whole.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


class MTree:
    """Paged metric nodes with covering radii and stored distances to the parent's pivot.

    Inner products turn into Euclidean distances by one more coordinate that gives all vectors of the
    tree the same norm; the query's is 0, so nearest is largest product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self._place(ids, vectors)
        #: node -> (its pivots, their covering radii, their distances to the node's own pivot, children) or a page
        self.nodes: list = []
        self._build(np.arange(len(ids)), self.centre)

    def _place(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = (vectors.astype(np.float64) ** 2).sum(1)
        self.top = float(norm.max())
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.top - norm, 0))[:, None]])
        self.exact, self.ids, self.centre = vectors.astype(np.float64), ids, self.points.mean(0)

    def pack(self) -> bytes:
        """The tree as it is stored: ids, whole-number vectors and nodes; the rest follows from them."""
        return pickle.dumps((self.ids, _narrow(self.exact), self.nodes), pickle.HIGHEST_PROTOCOL)

    @classmethod
    def unpack(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        ids, vectors, tree.nodes = pickle.loads(data)
        tree._place(ids, vectors)
        return tree

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        x = self.points[rows]
        if len(rows) <= PAGE:
            far = np.sqrt(((x - pivot) ** 2).sum(1))
            order = np.argsort(far)
            self.nodes[number] = ("page", rows[order], far[order])
            return number
        pivots = x[np.linspace(0, len(rows) - 1, FANOUT).astype(int)].copy()
        for _ in range(2):  # two rounds of means draw the pivots apart
            near = self._nearest(x, pivots)
            for k in range(FANOUT):
                if (near == k).any():
                    pivots[k] = x[near == k].mean(0)
        near = self._nearest(x, pivots)
        groups = [rows[near == k] for k in range(FANOUT)]
        if max(map(len, groups)) == len(rows):  # equal points: any even cut will do
            groups = np.array_split(rows, FANOUT)
        kept = [(pivots[k], g) for k, g in enumerate(groups) if len(g)]
        radii = [float(np.sqrt(((self.points[g] - p) ** 2).sum(1).max())) for p, g in kept]
        up = [float(np.sqrt(((p - pivot) ** 2).sum())) for p, _ in kept]
        children = [self._build(g, p) for p, g in kept]
        self.nodes[number] = ("node", np.array([p for p, _ in kept]), np.array(radii), np.array(up), np.array(children))
        return number

    @staticmethod
    def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)

    def search(self, own: int, query: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, -id) of ``best`` and the tree, the query's own id left out."""
        return self.search_all(np.array([own]), query[None, :], [best], k)[0]

    def search_all(self, own: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> list[list[tuple[int, int]]]:
        """``search`` for many queries side by side, each best first by its own bounds.

        Each query takes its nearest open nodes, ``STEPS`` at a time; those that take the same node are compared with it at once. A
        bound may be a step old by then, which costs products but loses nothing: it only falls.
        """
        size = (queries * queries).sum(1)
        slack = 4e-6 * (1 + np.sqrt(size + self.top))  # more than rounding can do to a distance
        floor = np.full(len(queries), -np.inf)
        for q, found in enumerate(best):
            heapq.heapify(found)
            if len(found) == k:
                floor[q] = found[0][0]

        def limits() -> np.ndarray:
            return np.sqrt(np.maximum(size + self.top - 2 * floor, 0)) + slack

        def apart(of: np.ndarray, points: np.ndarray) -> np.ndarray:
            inner = queries[of] @ points[:, :-1].T  # a query's last coordinate is 0
            return np.sqrt(np.maximum(size[of][:, None] + (points**2).sum(1) - 2 * inner, 0))

        far = apart(np.arange(len(queries)), self.centre[None, :])[:, 0]
        todo = [[(0.0, 0, x)] for x in far.tolist()]
        while True:
            limit, taken = limits(), {}
            for q, (heap, most) in enumerate(zip(todo, limit.tolist(), strict=True)):
                for _ in range(STEPS if len(best[q]) == k else 1):
                    if heap and heap[0][0] <= most:
                        _, number, x = heapq.heappop(heap)
                        taken.setdefault(number, ([], []))
                        taken[number][0].append(q)
                        taken[number][1].append(x)
                    else:
                        break
            if not taken:
                return best
            for number, (asking, x) in taken.items():
                node, of, x = self.nodes[number], np.array(asking), np.array(x)
                if node[0] == "page":
                    self._page(node, of, x, limit[of], queries, own, best, floor, k)
                    continue
                _, pivots, radii, up, children = node
                may = np.abs(x[:, None] - up) - radii <= limit[of][:, None]  # known without computing a distance
                near = np.flatnonzero(may.any(0))
                if not len(near):
                    continue
                d = apart(of, pivots[near])
                low = np.maximum(d - radii[near], 0)
                at, child = np.nonzero(may[:, near] & (low <= limit[of][:, None]))
                for q, b, c, y in zip(of[at].tolist(), low[at, child].tolist(), children[near[child]].tolist(), d[at, child].tolist(), strict=True):
                    heapq.heappush(todo[q], (b, c, y))

    def _page(self, node: tuple, of: np.ndarray, far: np.ndarray, limit: np.ndarray, queries: np.ndarray, own: np.ndarray, best: list, floor: np.ndarray, k: int) -> None:
        """The rows of a page that the triangle inequality leaves to any of the queries ``of`` that take it."""
        _, rows, up = node
        first, last = np.searchsorted(up, far - limit), np.searchsorted(up, far + limit + 1e-9)
        rows = rows[first.min() : last.max()]
        if not len(rows):
            return
        ids = self.ids[rows]
        score = queries[of] @ self.exact[rows].T
        score[ids[None, :] == own[of][:, None]] = -np.inf
        least = floor[of]
        if len(rows) > 4 * k:  # no more than the page's own best k of each query, with ties
            crowd = np.flatnonzero((score >= least[:, None]).sum(1) > 4 * k)
            if len(crowd):
                least[crowd] = np.maximum(least[crowd], np.partition(score[crowd], len(rows) - k, axis=1)[:, len(rows) - k])
        at, row = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        for q, s, i in zip(of[at].tolist(), score[at, row].tolist(), ids[row].tolist(), strict=True):
            found = best[q]
            (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (int(s), -i))
        for q in set(of[at].tolist()):
            if len(best[q]) == k:
                floor[q] = best[q][0][0]


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(partition, number, size, ids, vectors) for each ``most`` rows (id, vector) of a task that are of one size."""
    held: dict[int, list] = {}
    part, number = TaskContext.get().partitionId(), 0

    def whole(size: int) -> tuple:
        ids, vectors = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
        return part, number, size, ids, vectors

    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for size in set(sizes.tolist()):
            at = np.flatnonzero(sizes == size)
            while len(at):
                sub, at = np.split(at, [most - sum(len(a) for a, _ in held.get(size, ()))])
                held.setdefault(size, []).append((ids[sub], flat[starts[sub][:, None] + np.arange(size)].reshape(len(sub), size)))
                if sum(len(a) for a, _ in held[size]) == most:
                    yield whole(size)
                    number += 1
    for size in list(held):
        yield whole(size)
        number += 1


def top_k(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", tree: int = TREE, block: int = QUERIES, work: int = WORK) -> DataFrame:
    """For each query (id divisible by ``every``) its ``k`` best rows: query_id, rank, vec_id, score.

    Components x become floor(256 * x); the score is the integer inner product; ties go to the
    smaller id; the query's own row is no candidate, and a query with fewer candidates gets all. Rows
    with a null id or vector, or with null or non-finite components, take no part; repeated rows are
    candidates each, and repeated queries each give rows; vectors of another length than the query's
    have no score with it; an empty table gives no rows.

    Every ``tree`` rows of a task become one M-tree, written once; queries are written in rows of
    ``block``. Groups of trees meet groups of queries in cells, as many as keep a cell at ``work``
    products, cut so that the least is sent twice; a cell searches one tree after the other best
    first and gives out k candidates a query. Neither side comes to the driver or is broadcast.
    """
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("v"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, size, ids, vectors in _cut(batches, tree):
            cols = [pa.array([value], kind) for value, kind in ((part, pa.int64()), (number, pa.int64()), (size, pa.int64()), (len(ids), pa.int64()), (MTree(ids, vectors).pack(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, size, ids, vectors in _cut(batches, block):
            cols = [pa.array([value], kind) for value, kind in ((part, pa.int64()), (number, pa.int64()), (size, pa.int64()), (len(ids), pa.int64()), (pickle.dumps((ids, _narrow(vectors))), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["part", "number", "size", "n", "data"]
    schema = "part long, number long, size long, n long, data binary"
    index, queries = stage(rows.mapInArrow(trees, schema)), stage(rows.where(F.col("id") % every == 0).mapInArrow(asked, schema))
    own, all_rows, n_trees = (int(v or 0) for v in (queries.agg(F.sum("n")).first()[0], *index.agg(F.sum("n"), F.count("*")).first()))
    cells = max(2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own * all_rows // work))
    groups = max(1, min(n_trees, math.ceil(math.sqrt(cells * all_rows / max(1, own)))))
    blocks = max(1, -(-cells // groups))

    def dealt(df: DataFrame, kind: int, mine: str, n: int, other: str, m: int) -> DataFrame:
        rows = df.withColumns({mine: F.pmod(F.xxhash64("part", "number"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        return rows.select("size", "g", "q", F.lit(kind).alias("kind"), "part", "number", "data")

    cell = ["size", "g", "q"]
    both = dealt(queries, 0, "q", blocks, "g", groups).unionAll(dealt(index, 1, "g", groups, "q", blocks))
    both = both.repartition(groups * blocks, *cell).sortWithinPartitions(*cell, "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asking, best = None, [], []

        def found() -> pa.RecordBatch:
            out = [(uid, own, -i, score) for (uid, own, _), b in zip(asking, best, strict=True) for score, i in b]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["uid", "query_id", "vec_id", "score"])

        for batch in batches:
            for size, g, q, kind, part, number, data in zip(*(batch.column(j) for j in range(7)), strict=True):
                if (at := (size.as_py(), g.as_py(), q.as_py())) != here:
                    yield found()
                    here, asking, best = at, [], []
                if kind.as_py() == 0:
                    ids, vectors = pickle.loads(data.as_py())
                    first = (part.as_py() << 20 | number.as_py()) << 11
                    asking += [(first + n, own, v) for n, (own, v) in enumerate(zip(ids.tolist(), vectors.astype(np.float64), strict=True))]
                    best += [[] for _ in ids]
                elif asking:
                    one = MTree.unpack(data.as_py())
                    best = one.search_all(np.array([own for _, own, _ in asking]), np.array([v for *_, v in asking]), best, k)
        yield found()

    out = both.mapInArrow(search, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
