"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from echofold.session import remove, shared_dir, written

MAX_ROUNDS = 60
#: Up to so many edges one task finds all components: some 16 MB for long ids.
LOCAL_EDGES = 1 << 20


def _marked(edges: DataFrame) -> tuple[DataFrame, str, tuple[int, int]]:
    """Edges written to the shared folder, where, and their count and an order-free digest, equal for equal edge sets."""
    spark, seen, path = edges.sparkSession, Observation(), shared_dir(edges.sparkSession, "edges")
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), digest).write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), path, (seen.get["n"], int(seen.get["s"] or 0))


def smallest_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest place connected with each of the places 0 to n - 1."""
    up = np.arange(n)
    while len(u):
        left, right = up[u], up[v]
        np.minimum.at(up, np.maximum(left, right), np.minimum(left, right))
        while (up[up] != up).any():
            up = up[up]
        apart = up[u] != up[v]
        u, v = u[apart], v[apart]
    return up


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most LOCAL_EDGES edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        nodes = pc.unique(pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        u, v = (pc.index_in(t.column(c), nodes).to_numpy().astype(np.int64) for c in "uv")
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(smallest_reachable(u, v, len(nodes))))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node.

    Each round hangs larger neighbours below the smallest node known (large
    star), then neighbours that are smaller than a node (small star), until the
    edges are stars. Rounds grow with the logarithm of a component's size. A
    round's edges are written to the shared folder and counted on the way; those
    of the round before are deleted. Up to LOCAL_EDGES edges go to one task
    instead, with the same rows. Whole
    numbers become LONG, other ids keep their type. Null ends and loops are no
    edges; an empty list gives no rows.
    """
    real = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    kind = edges.schema[a].dataType
    ends = [F.col(c).cast("long") if kind.simpleString() in ("tinyint", "smallint", "int") else F.col(c).cast(kind) for c in (a, b)]
    spark = edges.sparkSession
    e, path, mark = _marked(edges.where(real).select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct())
    if mark[0] <= LOCAL_EDGES:
        found = written(_in_one_task(e), "components")
        remove(spark, path)
        return found
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Joins rather than windows: a node with very many edges can be split over tasks.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        before, old = mark, path
        e, path, mark = _marked(small)
        remove(spark, old)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components were not found in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
