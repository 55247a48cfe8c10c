"""Candidate pairs by Hamming distance: a triangular self-join, in blocks where it grows.

No index helps at these radii (a quarter of the bits), so every pair is
compared; what scales is how. Rows are dealt into blocks by a hash of their id,
and each pair of blocks meets in one join key: every unordered pair of rows
meets once, in tiles of bounded size, instead of one broadcast of everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echofold.functions.signatures import HASHES, hamming

#: Rows of a block: a tile compares at most the square of this.
BLOCK_ROWS = 8192
LEAST_BLOCKS = 6
RADII = {"ahash": 16, "dhash": 16, "phash": 16}
KEEP = 50


def blocks_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of bounded size, and enough of them that few rows too keep all tasks busy."""
    return max(LEAST_BLOCKS, -(-rows // block_rows))


def self_pairs(rows: DataFrame, blocks: int, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Structs a and b of every pair of rows with a.id < b.id, each once; with `by`, of rows that are equal in these columns."""
    packed = rows.select(F.struct(*rows.columns).alias("r"), *by, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    # A row stands left in the tiles (own, j) for j >= own and right in the tiles (i, own) for i <= own.
    left = packed.select("r", *by, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"))
    right = packed.select(F.col("r").alias("s"), *by, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["i", "j", *by]).where((F.col("i") < F.col("j")) | (F.col(f"r.{key}") < F.col(f"s.{key}")))
    first = F.col(f"r.{key}") < F.col(f"s.{key}")
    return met.select(F.when(first, F.col("r")).otherwise(F.col("s")).alias("a"), F.when(first, F.col("s")).otherwise(F.col("r")).alias("b")).where(f"a.{key} < b.{key}")


def distances(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The four distances; of the oriented one, a's poses are held against b's upright hash."""
    plain = {f"d_{h}": hamming(F.col(f"{a}.{h}"), F.col(f"{b}.{h}")) for h in ("ahash", "dhash", "phash")}
    poses = [hamming(F.col(f"{a}.{h}"), F.col(f"{b}.dhash")) for h in HASHES if h.startswith("dhash")]
    return plain | {"d_dhash_oriented": F.least(*poses)}


def candidates(rows: DataFrame, radii: dict[str, int] | None = None, blocks: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, four distances, best) within any radius; the oriented distance has dhash's.

    rows: id and the seven hashes. blocks: how many blocks rows are dealt to;
    by default as many as a count of the rows asks for.
    """
    r = RADII | (radii or {})
    rows = rows.select("id", *HASHES, *extra)
    pairs = self_pairs(rows, blocks or blocks_for(rows.count()))
    d = distances()
    within = (d["d_ahash"] <= r["ahash"]) | (d["d_dhash"] <= r["dhash"]) | (d["d_phash"] <= r["phash"]) | (d["d_dhash_oriented"] <= r["dhash"])
    out = pairs.where(within).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *[c.alias(k) for k, c in d.items()])
    return out.withColumn("best", F.least("d_ahash", "d_dhash", "d_phash"))


def ends(pairs: DataFrame) -> DataFrame:
    """Each pair twice, once for each of its images."""
    return pairs.withColumn("image", F.explode(F.array("a", "b")))


def top_candidates(pairs: DataFrame, k: int = KEEP) -> DataFrame:
    """Pairs among the k best of at least one of their images (ties by a, then b); k = 0 keeps all."""
    if not k:
        return pairs
    order = W.partitionBy("image").orderBy("best", "a", "b")
    return ends(pairs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place", "image").dropDuplicates(["a", "b"])


def match_metrics(rows: DataFrame, pairs: DataFrame, k: int = KEEP) -> DataFrame:
    """One row: comparisons, pairs before and after the cap, images that reached it."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("comparisons"))
    before = pairs.agg(F.count(F.lit(1)).alias("pairs_before_cap"))
    full = ends(pairs).groupBy("image").count().where(F.lit(k > 0) & (F.col("count") >= k)).agg(F.count(F.lit(1)).alias("images_capped"))
    kept = top_candidates(pairs, k).agg(F.count(F.lit(1)).alias("pairs_kept"))
    return n.crossJoin(before).crossJoin(full).crossJoin(kept)
