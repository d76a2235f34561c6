"""Exact top-k by inner product: KD-trees per shard, best-first search with bounding boxes."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.tables import saved, small
from wavetally.session import shuffle_partitions

LEAF = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 256
#: A cell of the search grid holds at most so many shards and query blocks: memory for some 70,000 vectors.
CELL_SHARDS, CELL_BLOCKS = 8, 16


def scaled(vector: str | Column, factor: int = 256) -> Column:
    """``floor(factor * x)`` of every component, null if the vector or one of its components is null or not finite.

    Components beyond 2**63 / ``factor`` count as the largest long, and scores beyond 64 bits wrap around: no long
    could hold them.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda x: F.floor(x.cast("double") * factor)))


class Tree:
    """Median splits on the widest dimension; every node keeps the tight box of its points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[int] = []  # of the first child, the second follows; -1 for a leaf
        self.span: list[tuple[int, int]] = []
        todo = [self._node(points[order], 0, len(ids))]
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            width = self.high[node] - self.low[node]
            if b - a <= leaf or not width.any():
                continue
            axis, middle = int(np.argmax(width)), (b - a) // 2
            part = order[a:b]
            order[a:b] = part[np.argpartition(points[part, axis], middle)]
            self.child[node] = self._node(points[order[a : a + middle]], a, a + middle)
            self._node(points[order[a + middle : b]], a + middle, b)
            todo += [self.child[node], self.child[node] + 1]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        for kind in (np.int16, np.int32):
            if np.iinfo(kind).min <= points.min(initial=0) and points.max(initial=0) <= np.iinfo(kind).max:
                self.points = self.points.astype(kind)  # smaller to move
                break

    def ready(self) -> Tree:
        """With points as floating-point numbers if products within the tree are exact so."""
        self.most = float(np.abs(self.points.astype(np.float64)).max(initial=0))
        self.exact = self.most**2 * max(1, self.points.shape[1]) < 2**53
        self.points = self.points.astype(np.float64 if self.exact else np.int64)
        return self

    def scores(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        """Inner products as integers: by floating point where that is exact, else by 64-bit integers."""
        points = self.points[a:b]
        if self.exact and self.most * float(np.abs(query.astype(np.float64)).max(initial=0)) * len(query) < 2**53:
            return (points @ query.astype(np.float64)).astype(np.int64)
        return points.astype(np.int64) @ query

    def _node(self, points: np.ndarray, a: int, b: int) -> int:
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.child.append(-1)
        self.span.append((a, b))
        return len(self.span) - 1


def search(trees: list[Tree], query_id: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The ``k`` best (score, id) of the trees, one's own id left out; scores below ``floor`` may be missing.

    Best first over all trees at once: the box with the greatest possible score comes next, and the search ends when
    that falls below the kth score so far, which thus passes from shard to shard. Boxes that could still tie are
    opened, as ties go to the smaller id. Trees of another number of components are left out.
    """
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    trees = [t for t in trees if t.points.shape[1] == len(query)]
    bounds = [t.high @ up + t.low @ down for t in trees]
    heap = [(-int(b[0]), t, 0) for t, b in enumerate(bounds)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -id), a heap with the worst of the best first
    while heap:
        bound, t, node = heapq.heappop(heap)
        least = best[0][0] if len(best) == k else floor
        if least is not None and -bound < least:
            break
        tree = trees[t]
        child = tree.child[node]
        if child >= 0:
            for c in (child, child + 1):
                if least is None or bounds[t][c] >= least:
                    heapq.heappush(heap, (-int(bounds[t][c]), t, c))
            continue
        a, b = tree.span[node]
        scores = tree.scores(a, b, query)
        for i in np.flatnonzero(scores >= least) if least is not None else range(b - a):
            other = int(tree.ids[a + i])
            if other == query_id:
                continue
            entry = (int(scores[i]), -other)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -i) for s, i in best]


def _vectors(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and points in portions of ``rows``; a portion ends where the number of components changes."""
    ids: list[int] = []
    points: list[np.ndarray] = []
    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
            v = np.array(v.values, np.int64)
            if ids and (len(ids) == rows or len(v) != len(points[0])):
                yield np.array(ids, np.int64), np.array(points, np.int64)
                ids, points = [], []
            ids.append(i)
            points.append(v)
    if ids:
        yield np.array(ids, np.int64), np.array(points, np.int64)


def _packer(rows: int, make):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, points) in enumerate(_vectors(batches, rows)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n]), pa.array([pickle.dumps(make(ids, points))], pa.binary())],
                names=["no", "pack"],
            )

    return pack


def _tree_state(ids: np.ndarray, points: np.ndarray) -> dict:
    return vars(Tree(ids, points))


def _restored(state: dict) -> Tree:
    tree = Tree.__new__(Tree)
    vars(tree).update(state)
    return tree.ready()


def _packed(vectors: DataFrame, rows: int, make, name: str) -> tuple[DataFrame, int]:
    """Portions of ``vectors`` as rows ``no, pack`` with ``no`` from 0, saved; and their number. Nothing is shuffled."""
    packs = saved(vectors.mapInArrow(_packer(rows, make), "no bigint, pack binary"), name)
    order = Window.partitionBy(F.lit(0)).orderBy("no")  # a row for each pack, numbers only
    dense = packs.select("no").withColumn("rank", F.row_number().over(order).cast("int") - 1)
    n = dense.count()
    return packs.join(small(dense, 16 * n), "no").select(F.col("rank").alias("no"), "pack"), n


def _cell(k: int):
    def run(key, shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        trees = [_restored(pickle.loads(p)) for p in shards["pack"]]
        rows = []
        for pack, floors in zip(blocks["pack"], blocks["floors"]):
            least = {} if floors is None else {f["query_id"]: f["floor"] for f in floors}
            for query_id, query in zip(*pickle.loads(pack)):
                query_id = int(query_id)
                rows += [(query_id, i, s) for s, i in search(trees, query_id, query, k, least.get(query_id))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def _on_grid(shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Each cell (row, column) of the grid holds some shards and some query blocks, all of which meet there."""
    return (
        shards.groupBy("row", "column")
        .cogroup(blocks.groupBy("row", "column"))
        .applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    )


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per query its ``k`` best rows of ``vectors`` by integer inner product: ``query_id, rank, vec_id, score``.

    Both tables are ``vec_id BIGINT, vector ARRAY<BIGINT>``; ties go to the smaller id, and rows with the query's own
    id are left out. Rows with a null id or vector take no part; of a query id given twice the smaller vector counts,
    candidates given twice count twice. Vectors of different lengths never meet.

    Portions of the vectors, as they lie in the input, become shards with a KD-tree each; portions of the queries
    become blocks. A grid deals both out so that each shard meets each block in one cell of bounded size. Each block
    first visits one cell; the kth score found there is passed on to all its other cells and prunes their boxes.
    """
    spark = vectors.sparkSession
    clean = "vec_id is not null and vector is not null"
    queries = queries.filter(clean).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards, n_shards = _packed(vectors.filter(clean).select("vec_id", "vector"), SHARD_ROWS, _tree_state, "shards")
    blocks, n_blocks = _packed(queries, BLOCK_ROWS, lambda ids, points: (ids, points), "blocks")
    rows = max(1, -(-n_shards // CELL_SHARDS))
    columns = max(1, -(-n_blocks // CELL_BLOCKS), min(n_blocks, shuffle_partitions(spark)))
    placed = shards.select(
        (F.col("no") % rows).alias("row"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"),
        "pack",
    )
    no_floors = F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>")
    dealt = blocks.select((F.col("no") % columns).alias("column"), "pack").withColumn("home", F.col("column") % rows)
    at_home = dealt.select(F.col("home").alias("row"), "column", "pack", no_floors.alias("floors"))
    first = placed.filter(F.col("row") == F.col("column") % rows)
    found = _on_grid(first, at_home, k)
    if rows > 1:
        found = saved(found, "home")
        kth = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        # the blocks' own lists of floors, by column: bounded like the blocks
        owner = dealt.select("column", "pack").mapInPandas(_ids, "column int, query_id bigint")
        floors = (
            owner.join(kth.filter(F.col("n") == k), "query_id")
            .groupBy("column")
            .agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
        )
        others = F.filter(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r != F.col("home"))
        away = dealt.join(floors, "column", "left").select(F.explode(others).alias("row"), "column", "pack", "floors")
        found = found.unionByName(_on_grid(placed.filter(F.col("row") != F.col("column") % rows), away, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for column, pack in zip(part["column"], part["pack"]):
            ids = pickle.loads(pack)[0]
            yield pd.DataFrame({"column": np.full(len(ids), column, np.int32), "query_id": ids})
