"""Incremental matching: new images against those known, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echofold.functions.signatures import HASHES
from echofold.operators.matching import RADII, blocks_for, candidates, distances


def match_new(known: DataFrame, new: DataFrame, radii: dict[str, int] | None = None) -> DataFrame:
    """Candidate pairs with at least one new image; the smaller id is a."""
    r = RADII | (radii or {})
    inside = candidates(new, r).drop("best")
    # New rows go to every block of the known ones, so that no side is broadcast whole.
    blocks = blocks_for(known.count())
    old = known.select(F.struct("id", *HASHES).alias("x"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    fresh = new.select(F.struct("id", *HASHES).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = old.join(fresh, "block")
    first = F.col("x.id") < F.col("y.id")
    pairs = met.where("x.id != y.id").select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    d = distances()
    within = (d["d_ahash"] <= r["ahash"]) | (d["d_dhash"] <= r["dhash"]) | (d["d_phash"] <= r["phash"]) | (d["d_dhash_oriented"] <= r["dhash"])
    across = pairs.where(within).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *[c.alias(k) for k, c in d.items()])
    return across.unionByName(inside)


def start(spark: SparkSession, signatures: DataFrame, store: str, pairs: str, checkpoint: str, radii: dict[str, int] | None = None) -> StreamingQuery:
    """Match a stream of signatures (id and hashes) against `store`, then add them to it.

    A batch writes its signatures and pairs under its own number, so a batch
    that runs again after a failure replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = batch.select("id", *HASHES).dropDuplicates(["id"]).persist()
        try:
            known = spark.read.schema(new.schema).parquet(store).where(F.col("batch") < number).drop("batch") if number else new.limit(0)
            known = known.join(new.select("id"), "id", "left_anti")
            match_new(known, new, radii).write.mode("overwrite").parquet(f"{pairs}/batch={number}")
            new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            new.unpersist()

    return signatures.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
