"""Nearest neighbours by vantage-point trees, one for each shard.

The largest inner product becomes the smallest distance once every vector gets
one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).
A node holds a vantage point and the median of the distances from it; a
subtree is left out where the triangle inequality puts it farther away than
FACTOR times the distance of the worst neighbour held so far. Factor 1 leaves
out only what can't contain a neighbour, so the search is exact.

A shard's candidates are read once and make one tree; the queries come after
them in blocks, so a task holds one shard and one block. What a search finds
near the last place is scored anew, term by term in double precision, and
ordered by score and vec_id: ties, however many, go to the smaller ids. Equal
vectors of a shard stand in its tree once, with as many of their smallest ids
as a result can hold, so a very frequent vector costs no more than any other.
The best of each shard are merged by query.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids. Rows of one id count once (the smallest vector).
Vectors only meet vectors of their own length. Fewer candidates than k give
fewer rows; an empty table gives none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echofold.llm._common import parts, table

K = 20
EVERY = 20
#: 1.0 is exact; what smaller factors find and leave out is in the README.
FACTOR = 1.0
#: Rows of a shard at most, and as many as make a shard worth its own task; queries that are searched at once.
SHARD_ROWS, FEW_ROWS, BLOCK_QUERIES, LEAF = 1 << 16, 1 << 12, 512, 256
#: Rounding: inner products and distances that differ by less than this share of the norms count as equal in a search.
SLACK = 1e-9
MET = "n int, shard int, kind int, vec_id long, v array<double>"
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Node:
    rows: np.ndarray | None = None
    point: int = -1
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


class Tree:
    """A vantage-point tree over the rows of x (distinct vectors)."""

    def __init__(self, x: np.ndarray, top: float) -> None:
        self.x, self.top = x, top
        rest = np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0)
        self.y = np.concatenate([x, np.sqrt(rest)[:, None]], 1)
        self.squares = np.einsum("ij,ij->i", self.y, self.y)
        self.root = self._build(np.arange(len(x)))
        self.visited = 0

    def _distance(self, q: np.ndarray, q_squares: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q_squares[:, None] + self.squares[rows] - 2 * (q @ self.x[rows].T), 0))

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF:
            return Node(rows)
        # Of a few rows, the one with the widest spread of distances is the vantage point.
        tried = rows[:: max(1, len(rows) // 5)][:5]
        seen = rows[:: max(1, len(rows) // 64)][:64]
        apart = np.linalg.norm(self.y[tried][:, None] - self.y[seen], axis=2)
        point = tried[apart.std(1).argmax()]
        d = np.linalg.norm(self.y[rows] - self.y[point], axis=1)
        radius = np.median(d)
        inside = d <= radius
        if inside.all():
            return Node(rows)
        return Node(None, point, float(radius), self._build(rows[inside]), self._build(rows[~inside]))

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs: the k rows nearest to each query, and all others as near as the last of them."""
        squares = np.einsum("ij,ij->i", q, q)
        reach = SLACK * np.sqrt(squares) * self.top + 1e-300
        best = np.full((len(q), k), -np.inf)  # the largest inner products so far
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node: Node, own: np.ndarray) -> None:
            if not len(own):
                return
            if node.rows is not None:
                self.visited += len(own) * len(node.rows)
                found = q[own] @ self.x[node.rows].T
                both = np.concatenate([best[own], found], 1)
                best[own] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                a, b = np.nonzero(found >= (best[own].min(1) - reach[own])[:, None])
                seen.append((own[a], node.rows[b], found[a, b]))
                return
            self.visited += len(own)
            gap = self._distance(q[own], squares[own], np.array([node.point]))[:, 0] - node.radius
            for first, near, far in ((gap <= 0, node.inner, node.outer), (gap > 0, node.outer, node.inner)):
                group, apart = own[first], np.abs(gap[first])
                visit(near, group)
                # The largest distance that a neighbour can have; endless while fewer than k are held.
                worst = np.sqrt(np.maximum(squares[group] + self.top**2 - 2 * (best[group].min(1) - reach[group]), 0))
                visit(far, group[~(apart > factor * worst + SLACK * (np.sqrt(squares[group]) + self.top))])

        visit(self.root, np.arange(len(q)))
        who, rows, found = (np.concatenate(c) for c in zip(*seen))
        near = found >= best[who].min(1) - reach[who]
        return who[near], rows[near]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v, n) that take part."""
    v = F.col("embedding")
    whole = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(whole).select("vec_id", v.alias("v"), F.size(v).alias("n"))


def _matrix(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(parts)
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products found for each query."""
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id", "n").agg(F.min("v").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(_norm("v")).alias("top")).first()
    shards = max(-(-size["n"] // SHARD_ROWS), min(parts(vectors.sparkSession), -(-size["n"] // FEW_ROWS)), 1)
    top = (size["top"] or 0.0) * (1 + 1e-12)
    left = rows.select("n", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    right = asked.select("n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    met = left.unionByName(right).repartition("n", "shard").sortWithinPartitions("n", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, given, asked, n = None, None, [], [], 0

        def answer() -> pa.RecordBatch:
            nonlocal asked, n
            found = shard.search(*_matrix(asked), k, factor)
            asked, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("n", "shard", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if key != tuple(keys[a][:2]):
                    if n and shard:
                        yield answer()
                    shard, key, given, asked, n = None, tuple(keys[a][:2]), [], [], 0
                part = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    given.append(part)
                    continue
                if given:
                    shard, given = Shard(*_matrix(given), k, top), []
                for c in range(0, b - a if shard else 0, BLOCK_QUERIES):
                    asked.append(part.slice(c, BLOCK_QUERIES))
                    n += asked[-1].num_rows
                    if n >= BLOCK_QUERIES:
                        yield answer()
        if n and shard:
            yield answer()

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = met.mapInArrow(run, FOUND)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """The tree of a shard's distinct vectors, and the ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, top: float) -> None:
        order = np.lexsort([*x.T[::-1], ids])
        once = order[np.append(True, np.diff(ids[order]) != 0)]  # rows of one id once, the smallest vector
        self.ids, x = ids[once], x[once]
        distinct, of = np.unique(x + 0.0, axis=0, return_inverse=True)
        of = of.ravel()
        # Each distinct vector keeps its k + 1 smallest ids: one may be the query's own.
        order = np.lexsort((self.ids, of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        self.keep = order[rank <= k]
        self.begin = np.searchsorted(of[self.keep], np.arange(len(distinct) + 1))
        self.tree = Tree(distinct, top)

    def search(self, asked: np.ndarray, q: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """(query_id, vec_id, score) of the shard's best k for each query."""
        # One more than k, as the query itself may be among them.
        who, rows = self.tree.search(q, min(len(self.tree.x), k + 1), factor)
        score = np.zeros(len(who))
        for j in range(q.shape[1]):  # term by term, in order: the same sum for equal vectors everywhere
            score += self.tree.x[rows, j] * q[who, j]
        many = self.begin[rows + 1] - self.begin[rows]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = self.ids[self.keep[np.repeat(self.begin[rows], many) + inner]]
        who, score = np.repeat(who, many), np.repeat(score, many)
        other = own != asked[who]
        who, own, score = who[other], own[other], score[other]
        order = np.lexsort((own, -score, who))
        who, own, score = who[order], own[order], score[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        return [asked[who[first]], own[first], score[first]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: Exact search: the query's rows at factor 1.
ORACLE = f"""
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
v AS (SELECT vec_id, len(e) AS n, min(e) AS e FROM u GROUP BY ALL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
