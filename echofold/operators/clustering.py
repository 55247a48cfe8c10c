"""Confidence-aware clustering of scored pairs, and which copy to keep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.operators.graph import connected_components
from echofold.session import written

CORE = 0.9
_SQL = "component long, cluster_id long, member long, weakest_link float, weak_blocked long, size_blocked long"
_SCHEMA = pa.schema([("component", pa.int64()), ("cluster_id", pa.int64()), ("member", pa.int64()), ("weakest_link", pa.float32()), ("weak_blocked", pa.int64()), ("size_blocked", pa.int64())])


class _Sets:
    """Disjoint sets with sizes and the weakest edge that joined each."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.size = [1] * n
        self.weakest = [np.float32(1)] * n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int, p: np.float32) -> None:
        if self.size[i] < self.size[j]:
            i, j = j, i
        self.parent[j] = i
        self.size[i] += self.size[j]
        self.weakest[i] = min(self.weakest[i], self.weakest[j], p)


def greedy(a: np.ndarray, b: np.ndarray, p: np.ndarray, core: float = CORE, max_size: int = 0) -> tuple[dict[int, tuple[list[int], float]], int, int]:
    """Clusters by smallest member, and how many merges weak edges and the size cap were refused.

    Edges are taken by falling probability (ties by a, then b). An edge that
    would exceed max_size (0: no cap) is refused; so is one below `core`
    between two sets of which neither is single.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    p = p.astype(np.float32)
    sets, weak, capped, bar = _Sets(len(nodes)), 0, 0, np.float32(core)
    for k in np.lexsort((b, a, -p)).tolist():
        i, j = sets.root(int(left[k])), sets.root(int(right[k]))
        if i == j:
            continue
        if max_size and sets.size[i] + sets.size[j] > max_size:
            capped += 1
        elif p[k] < bar and sets.size[i] > 1 and sets.size[j] > 1:
            weak += 1
        else:
            sets.join(i, j, p[k])
    found: dict[int, list[int]] = {}
    for i in range(len(nodes)):
        found.setdefault(sets.root(i), []).append(int(nodes[i]))
    return {m[0]: (m, float(sets.weakest[r])) for r, m in found.items() if len(m) > 1}, weak, capped


def clustered(edges: DataFrame, core: float = CORE, max_size: int = 0) -> DataFrame:
    """Members of clusters, and a row of counters (member null) for each component.

    No merge can cross a component of the edges, so components are clustered
    apart; each is one task's group of edges.
    """
    real = edges.where("a IS NOT NULL AND b IS NOT NULL AND probability IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("probability").cast("float").alias("probability"))
    real = written(real, "accepted")  # the pairs behind the edges are not compared twice
    component = connected_components(real).select(F.col("node").alias("a"), "component")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        made, weak, capped = greedy(t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("probability").to_numpy(), core, max_size)
        c = key[0].as_py()
        rows = [(c, i, m, w, None, None) for i, (members, w) in made.items() for m in members] + [(c, None, None, None, weak, capped)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return real.join(component, "a").select("component", "a", "b", "probability").groupBy("component").applyInArrow(run, _SQL)


def clusters(found: DataFrame) -> DataFrame:
    """cluster_id (the smallest member), size, members and weakest_link; the largest first, ties by id."""
    members = F.sort_array(F.collect_list("member"))
    grouped = found.where("member IS NOT NULL").groupBy("cluster_id").agg(members.alias("members"), F.first("weakest_link").alias("weakest_link"))
    return grouped.select("cluster_id", F.size("members").alias("size"), "members", "weakest_link").orderBy(F.col("size").desc(), "cluster_id")


def blocked(found: DataFrame) -> DataFrame:
    """One row: merges refused for a weak edge, and for the size cap."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return found.agg(total("weak_blocked"), total("size_blocked"))


def keepers(members: DataFrame, images: DataFrame, group: str = "cluster_id", member: str = "member") -> DataFrame:
    """The member of each group to keep: most pixels, then most bytes, then the smallest id."""
    place = F.struct((F.col("width").cast("long") * F.col("height").cast("long")).alias("pixels"), F.col("file_size"), (-F.col(member)).alias("first"))
    joined = members.select(group, member).join(images.select(F.col("id").alias(member), "width", "height", "file_size"), member)
    return joined.groupBy(group).agg(F.max_by(member, place).alias("keep"))


def reclaimable(members: DataFrame, images: DataFrame, group: str = "cluster_id", member: str = "member") -> DataFrame:
    """Bytes of the members that are not kept, by group."""
    sized = members.select(group, member).join(images.select(F.col("id").alias(member), "file_size"), member).join(keepers(members, images, group, member), group)
    rest = F.when(F.col(member) != F.col("keep"), F.col("file_size")).otherwise(0)
    return sized.groupBy(group).agg(F.first("keep").alias("keep"), F.sum(rest).cast("long").alias("reclaimable_bytes"))
