"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample, all rows are then sent down them. A query descends all trees with one shared
priority queue: the branch whose splitting planes it violates least comes next, in whichever tree, until the leaves found
hold enough rows. Leaf rows and the queries that ask for them meet in blocks of bounded size, where exact distances rank
the candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import materialize

#: Trees; sampled rows in a leaf; rows in the sample that the trees are fitted on.
TREES, LEAF, SAMPLE = 10, 40, 20_000
#: A query looks at leaves until they hold so many rows in all, or this part of the rows times the number of trees.
SEARCH_ROWS, SEARCH_PART = 3_000, 0.08
#: Rows and queries that meet in a block.
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 1_000


@dataclass
class Tree:
    """Inner nodes with a plane each; children are inner nodes, or leaves as -1 - leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if not len(self.normals):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        while (going := np.flatnonzero(at >= 0)).size:
            node = at[going]
            side = (np.einsum("ij,ij->i", x[going], self.normals[node]) > self.offsets[node]).astype(np.int64)
            at[going] = self.children[node, side]
        return -1 - at


def fit_tree(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """Splits the sample at the median of its projection on the line between two of its rows, down to LEAF rows."""
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        left = right = None
        for _ in range(3 if len(rows) > LEAF else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / (np.linalg.norm(a - b) or 1)
            value = x[rows] @ normal
            offset = float(np.median(value))
            left, right = rows[value <= offset], rows[value > offset]
            if len(left) and len(right):
                break
        if left is not None and len(left) and len(right):
            me = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            todo += [(left, me, 0), (right, me, 1)]
        else:
            me, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            children[parent][side] = me
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def search(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs to look at, until they hold enough rows: one queue for all trees, least violated plane first."""
    heap, found, held = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(trees)], [], 0
    planes = [tree.normals @ q - tree.offsets if len(tree.normals) else None for tree in trees]
    while heap and held < enough:
        far, t, node = heapq.heappop(heap)
        while node >= 0:
            margin = planes[t][node]
            near, other = trees[t].children[node, int(margin > 0)], trees[t].children[node, int(margin <= 0)]
            heapq.heappush(heap, (max(far, abs(float(margin))), t, int(other)))
            node = int(near)
        found.append((t, -1 - node))
        held += int(sizes[t][-1 - node])
    return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(vec_id, vector array<double>) of the rows that take part, and their dimension: the one that most rows have."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.filter(fine)
    dims = v.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = dims.dim if dims else 1
    return v.filter(F.size("vector") == dim), dim


def nearest(vectors: DataFrame, column: str = "embedding", every: int = 100, k: int = 10, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` the k nearest rows found, by Euclidean distance.

    Rows with a null vec_id or a vector that is null, zero, of another dimension than most, or has null or non-finite
    components take no part. Rows that share a vec_id are one: its nearest row counts. Ties go to the smaller vec_id. If
    there are fewer than k others, all are found. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v, dim = usable(vectors, column)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # bounded by SAMPLE
    x = np.array(sample["vector"].tolist(), np.float64).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    trees = [fit_tree(x, rng) for _ in range(TREES)]
    sent = spark.sparkContext.broadcast(trees)  # planes: TREES * SAMPLE / LEAF * 2 at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                data, n = _matrix(part.column(1), dim), part.num_rows
                lists = [pa.array(np.full(n, t, np.int32)) for t in range(TREES)]
                for t, tree in enumerate(sent.value):
                    yield pa.RecordBatch.from_arrays([lists[t], pa.array(tree.leaf_of(data)), part.column(0), part.column(1)], names=["tree", "leaf", "vec_id", "vector"])

    placed = v.mapInArrow(place, "tree int, leaf long, vec_id long, vector array<double>")
    counts = placed.select("tree", "leaf").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per leaf
    sizes = [np.zeros(tree.leaves, np.int64) for tree in trees]
    for t, leaf, n in counts.itertuples(index=False):
        sizes[t][leaf] = n
    enough = max(SEARCH_ROWS, SEARCH_PART * float(sizes[0].sum())) * TREES
    known = spark.sparkContext.broadcast(sizes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, q in enumerate(_matrix(batch.column(1), dim)):
                found = search(sent.value, known.value, q, enough)
                one = batch.slice(number, 1)
                rows = [(t, leaf, b) for t, leaf in found for b in range(-(-int(known.value[t][leaf]) // BLOCK_ROWS))]
                index = pa.array([0] * len(rows), pa.int64())
                columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, one.column(0).take(index), one.column(1).take(index)], names=["tree", "leaf", "block", "query_id", "query"])

    queries = v.filter(F.col("vec_id") % every == 0)
    asked = materialize(queries.mapInArrow(ask, "tree int, leaf long, block int, query_id long, query array<double>"), "asked")
    # leaves in blocks of rows, and of the queries that ask for them
    per = asked.groupBy("tree", "leaf", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_QUERIES).cast("int"))
    asked = asked.join(per.drop("n"), ["tree", "leaf", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    blocks = spark.createDataFrame([(t, leaf, max(1, -(-int(n) // BLOCK_ROWS))) for t, s in enumerate(sizes) for leaf, n in enumerate(s)], "tree int, leaf long, blocks int")
    rows = placed.join(F.broadcast(blocks), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.join(per.drop("n"), ["tree", "leaf", "block"]).select("tree", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "vector")

    def rank(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if own.num_rows and asking.num_rows:
            ids = own.column("vec_id").to_numpy()
            data = np.ascontiguousarray(_matrix(own.column("vector").combine_chunks(), dim).T)
            for query_id, q in zip(asking.column("query_id").to_pylist(), _matrix(asking.column("query").combine_chunks(), dim)):
                score = np.sqrt(((data - q[:, None]) ** 2).sum(0))  # component after component
                others = np.flatnonzero(ids != query_id)
                if len(others) > 4 * k:  # all that tie with the k-th stay
                    others = others[score[others] <= np.partition(score[others], k - 1)[k - 1]]
                best = others[np.lexsort((ids[others], score[others]))][:k]
                out.append((np.full(len(best), query_id), ids[best], score[best]))
        columns = [pa.array(np.concatenate([o[j] for o in out])) for j in range(3)]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    keys = ["tree", "leaf", "block", "part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
 FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
