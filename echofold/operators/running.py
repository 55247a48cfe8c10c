"""Running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echofold.session import written


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its total over all rows up to the row's own, in order.

    Rows are dealt into ranges of the order and summed within each; what the
    ranges before have in total is added. The ranges are written once, as they
    are drawn from a sample and must be the same in both steps. Rows that are
    equal in the order follow each other in any way; give a total order where
    that matters. Sums are taken as DOUBLE or LONG, as they come.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    ranged = written(df.withColumns(values).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumns({v: F.sum(v).over(within) for v in values})
    joined = local.join(offsets, F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, *[(F.col(v) + F.col(f"{v}_before")).alias(name) for v, name in zip(values, sums)])


def numbered(df: DataFrame, order: list[Column], name: str = "id", first: int = 0) -> DataFrame:
    """df with running numbers in a global order, from `first` on."""
    out = running_sums(df, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, (F.col(name) - 1 + first).cast("long"))
