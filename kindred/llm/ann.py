"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits at the median of a random
projection.  Every vector is dealt to one leaf of each tree.  A query walks all trees
through one priority queue: the next node is the one whose splits the query violates
least (by the sum of squared margins on the way), and the walk ends when the leaves
seen hold enough rows.  The leaves' candidates are then ranked exactly.

Leaves of a tree are grouped into a fixed number of cells.  A task holds some of the
queries that reached a cell, while the cell's rows go by, leaf by leaf, and keeps the best
of each query; so what goes on to the merge grows as the queries, not as queries times
rows.  Cells with more than their part of the rows, or many queries, are split again.

Cases: vectors that are null or zero, hold null or non-finite components, or differ in
length from most, take no part.  Of identical vectors only the k + 1 with the smallest
ids are indexed, for no others can be in a result; all may be queries.  Rows with one
id are one candidate, with the best of their scores, and no neighbour of each other.
Ties go to the smaller id.  Rows with a null id are ignored.  A query without
candidates gives no rows, and so does an empty table.  Other columns (texts, of any length,
too) are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Trees; vectors that the trees are fitted on, at most; of these in a leaf.
TREES, SAMPLE, LEAF = 8, 16_384, 32
#: A query's walk ends when the leaves seen hold so many times all rows; a row that is seen
#: in several trees counts in each.
SHARE = 1.3
#: Cells of a tree, and queries of a cell in one task, about.
CELLS, CELL_QUERIES = 4, 16_384
#: Candidates that a task gathers before it keeps only the best of each query.
GATHERED = 1_000_000


@dataclass
class Forest:
    directions: np.ndarray  # trees, nodes, dims
    cuts: np.ndarray  # trees, nodes
    depth: int
    share: np.ndarray  # trees, leaves: each leaf's part of the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.cuts)), dtype=np.int32)
        for t, (w, cut) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > cut[node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, margins: list[list[float]], rows: float, enough: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs a query sees, by its signed distance from every node's split."""
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(len(margins))]
        seen, held, share = [], 0.0, self.share
        while queue and held < enough:
            cost, t, node = heapq.heappop(queue)
            tree = margins[t]
            while node < inner:
                m = tree[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            seen.append((t, node - inner))
            held += share[t, node - inner] * rows
        return seen


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
    """A forest with leaves of about ``leaf`` rows of the sample."""
    n, dims = sample.shape
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf))) if n > leaf else 0
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((trees, (1 << depth) - 1, dims))
    w /= np.linalg.norm(w, axis=2, keepdims=True)
    w = w.astype(np.float32).astype(float)
    cuts = np.zeros(w.shape[:2])
    share = np.zeros((trees, 1 << depth))
    for t in range(trees):
        groups = [np.arange(n)]
        for d in range(depth):
            split = []
            for k, rows in enumerate(groups):
                node = (1 << d) - 1 + k
                p = np.einsum("ij,j->i", sample[rows], w[t, node])
                cuts[t, node] = np.median(p) if len(p) else 0.0
                split += [rows[p <= cuts[t, node]], rows[p > cuts[t, node]]]
            groups = split
        share[t] = [len(g) / n for g in groups] if n else 0
    return Forest(w, cuts, depth, share)


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow column of bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if len(rows) else 0
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


ENTRY = "tree int, cell int, kind int, id long, v binary, leaves binary"


def _entries(batches: Iterator[pa.RecordBatch], forest: Forest, per_cell: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Each indexed vector once for each tree."""
    for batch in batches:
        x = _matrix(batch.column("v"))
        leaves = forest.leaves(x)
        v = _binary(x.astype(kind))
        for t in range(leaves.shape[1]):
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t, np.int32)), pa.array((leaves[:, t] // per_cell).astype(np.int32)), pa.array(np.ones(n, np.int32)),
                 batch.column("id"), v, _binary(leaves[:, t : t + 1].astype(np.int32))],
                names=["tree", "cell", "kind", "id", "v", "leaves"],
            )


def _probes(batches: Iterator[pa.RecordBatch], forest: Forest, per_cell: int, rows: int, enough: float, kind: type) -> Iterator[pa.RecordBatch]:
    """Each query once for each cell that it reaches, with the leaves there."""
    flat = forest.directions.reshape(-1, forest.directions.shape[2])
    for batch in batches:
        x = _matrix(batch.column("v"))
        ids = batch.column("id").to_pylist()
        for at in range(0, len(x), 32):
            some = x[at : at + 32]
            margins = (some @ flat.T - forest.cuts.reshape(1, -1)).reshape(len(some), *forest.cuts.shape).tolist() if flat.size else [[[]] * len(forest.cuts)] * len(some)
            tree, cell, who, what, leaves = [], [], [], [], []
            for i, m in enumerate(margins):
                cells: dict[tuple[int, int], list[int]] = {}
                for t, leaf in forest.search(m, rows, enough):
                    cells.setdefault((t, leaf // per_cell), []).append(leaf)
                raw = some[i].astype(kind).tobytes()
                for (t, c), ls in cells.items():
                    tree.append(t)
                    cell.append(c)
                    who.append(ids[at + i])
                    what.append(raw)
                    leaves.append(np.array(ls, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(cell, pa.int32()), pa.array([0] * len(tree), pa.int32()), pa.array(who, pa.int64()), pa.array(what, pa.binary()), pa.array(leaves, pa.binary())],
                names=["tree", "cell", "kind", "id", "v", "leaves"],
            )


class Cell:
    """Queries of one cell, with the best of what has gone by for each."""

    def __init__(self, asks: list[tuple[int, bytes, bytes]], kind: type, k: int) -> None:
        who, vectors, leaves = zip(*asks, strict=True)
        self.k = k
        self.q = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(who), -1).astype(float)
        self.ids = np.array(who, dtype=np.int64)
        asked = np.repeat(np.arange(len(who)), [len(x) // 4 for x in leaves])
        wanted = np.frombuffer(b"".join(leaves), dtype=np.int32)
        order = np.argsort(wanted, kind="stable")
        self.asked, self.wanted = asked[order], wanted[order]
        self.floor = np.full(len(who), -1e300)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def see(self, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray) -> None:
        """Rows of the cell: each is compared with the queries that want its leaf."""
        order = np.argsort(leaf, kind="stable")
        ids, x, leaf = ids[order], x[order], leaf[order]
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, np.int64)
        for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True):
            lo, hi = np.searchsorted(self.wanted, [leaf[a], leaf[a] + 1])
            most = self.k + (b - a) - len(np.unique(ids[a:b]))  # so many rows have k different ids
            for at in range(lo, hi, 1024):
                mine = self.asked[at : min(hi, at + 1024)]
                s = self.q[mine] @ x[a:b].T
                s[self.ids[mine][:, None] == ids[a:b][None, :]] = -np.inf
                floor = self.floor[mine]
                if s.shape[1] > most:
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
                i, j = np.nonzero(s >= np.maximum(floor - 1e-9 * np.abs(floor), -1e300)[:, None])
                # one order of summing, so that equal vectors tie
                self.found.append((mine[i], ids[a + j], (self.q[mine[i]] * x[a + j]).sum(axis=1)))
                self.many += len(i)
                if self.many > GATHERED:
                    self._keep()

    def _keep(self) -> None:
        q, other, score, rank = _best(*(np.concatenate(c) for c in zip(*self.found, strict=True)), self.k)
        last = rank == self.k - 1
        self.floor[q[last]] = score[last]
        self.found, self.many = [(q, other, score)], len(q)

    def result(self) -> pa.RecordBatch:
        if not self.found:
            return _batch(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        q, other, score, _ = _best(*(np.concatenate(c) for c in zip(*self.found, strict=True)), self.k)
        return _ranked(self.ids[q], other, score, self.k)


def _best(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different others of each query, in order, with their rank from 0."""
    order = np.lexsort((-score, other, query))
    query, other, score = query[order], other[order], score[order]
    if len(query):
        new = np.concatenate([[True], (query[1:] != query[:-1]) | (other[1:] != other[:-1])])
        query, other, score = query[new], other[new], score[new]
    order = np.lexsort((other, -score, query))
    query, other, score = query[order], other[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    some = rank < k
    return query[some], other[some], score[some], rank[some]


def _batch(query: np.ndarray, other: np.ndarray, score: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(rank + 1, pa.int32()), pa.array(other, pa.int64()), pa.array(score, pa.float64())],
        names=["query_id", "rank", "vec_id", "score"],
    )


def _ranked(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best different others of each query, with their rank."""
    return _batch(*_best(query, other, score, k))


RESULT = "query_id long, rank int, vec_id long, score double"


def _searched(batches: Iterator[pa.RecordBatch], k: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, queries before indexed vectors: a cell's queries are held, its rows go by."""
    now, cell, asks = None, None, []
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("tree", "cell", "block", "salt", "kind")]
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in keys[:4])
            if key != now:
                if cell is not None:
                    yield cell.result()
                now, cell, asks = key, None, []
            ids, v, leaves = (batch.column(c).slice(a, b - a) for c in ("id", "v", "leaves"))
            if keys[4][a] == 0:
                asks += zip(ids.to_pylist(), v.to_pylist(), leaves.to_pylist(), strict=True)
                continue
            if cell is None and asks:
                cell, asks = Cell(asks, kind, k), []
            if cell is not None:
                x = np.frombuffer(b"".join(v.to_pylist()), dtype=kind).reshape(b - a, -1).astype(float)
                cell.see(ids.to_numpy(), x, np.frombuffer(b"".join(leaves.to_pylist()), dtype=np.int32))
    if cell is not None:
        yield cell.result()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by query; whole queries are ranked together, some at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        table = pa.Table.from_batches(held)
        query = table.column("query_id").to_numpy()
        cut = int(np.searchsorted(query, query[-1]))  # the last query may go on
        if cut:
            yield _of(table.slice(0, cut), k)
        held = [pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.slice(cut).columns], names=table.column_names)]
    if held:
        yield _of(pa.Table.from_batches(held), k)


def _of(table: pa.Table, k: int) -> pa.RecordBatch:
    return _ranked(*(table.column(c).to_numpy() for c in ("query_id", "vec_id", "score")), k)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float = SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``vectors`` (vec_id, embedding) that ``queries`` names."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("ask"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("v") == lengths["dims"])
    copies = W.partitionBy("v").orderBy("id")
    index = materialize(rows.select("id", "v").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "v"))
    n = index.count()
    picked = index.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # ``sample`` vectors at most
    forest = grow(np.array([r["v"] for r in picked], dtype=float), trees, leaf)
    leaves = 1 << forest.depth
    per_cell = max(1, leaves // CELLS)
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample
    # vectors travel as they are stored: single precision loses nothing of floats
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    # a cell with far more than its part of the rows is cut into blocks, which all its queries visit; one with many queries is copied
    cells = [
        (t, c, max(1, math.ceil(float(forest.share[t, c * per_cell : (c + 1) * per_cell].sum()) * CELLS / 1.5)))
        for t in range(trees) for c in range(leaves // per_cell)
    ]
    blocks = spark.createDataFrame(cells, "tree int, cell int, blocks int")  # trees times leaves rows at most
    names = ["tree", "cell", "block", "salt", "kind", "id", "v", "leaves"]

    def searched(asking: DataFrame, enough: float) -> DataFrame:
        asks = materialize(asking.mapInArrow(lambda it: _probes(it, shared.value, per_cell, n, enough, kind), ENTRY))
        many = asks.groupBy("tree", "cell").agg(F.count("*").alias("asks"))
        plan = F.broadcast(blocks.join(many, ["tree", "cell"]).select("tree", "cell", "blocks", F.ceil(F.col("asks") / CELL_QUERIES).cast("int").alias("salts")))
        entries = index.mapInArrow(lambda it: _entries(it, shared.value, per_cell, kind), ENTRY)
        entries = entries.join(plan, ["tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        entries = entries.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
        asks = asks.join(plan, ["tree", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        asks = asks.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        both = entries.select(*names).unionByName(asks.select(*names))
        dealt = both.repartition("tree", "cell", "block", "salt").sortWithinPartitions("tree", "cell", "block", "salt", "kind", "leaves")
        found = dealt.mapInArrow(lambda it: _searched(it, k, kind), RESULT).select("query_id", "vec_id", "score")
        return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _merged(it, k), RESULT)

    asking = rows.where(F.col("ask")).select("id", "v")
    found = materialize(searched(asking, share * n))
    # where ids repeat, the leaves seen may hold too few of them: such queries see all leaves
    goal = min(k, index.select("id").distinct().count() - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= goal).select(F.col("query_id").alias("id"))
    short = materialize(asking.join(full, "id", "left_anti"))
    if goal > 0 and not short.isEmpty():
        again = searched(short, math.inf)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(again)
    return found
