"""SQL over the engine's stages: temporary views of them, and its functions under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.functions.features import BINS

_SHARED = " + ".join(f"CAST(least(get(a, {k}), get(b, {k})) AS DOUBLE)" for k in range(BINS))

# Bodies of SQL functions, so that Catalyst inlines them and nothing leaves the JVM.
FUNCTIONS = {
    "hamming": "CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    # The engine's histograms are summed bin by bin in generated code; arrays of other sizes by lambdas, some ten times as slowly.
    "hist_distance": f"""CREATE OR REPLACE TEMPORARY FUNCTION hist_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT
        RETURN CAST(1 - CASE WHEN size(a) = {BINS} AND size(b) = {BINS} THEN {_SHARED}
          ELSE aggregate(zip_with(a, b, (x, y) -> least(CAST(x AS DOUBLE), CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, x) -> s + x) END AS FLOAT)""",
}


def register(spark: SparkSession, **stages: DataFrame) -> None:
    """hamming and hist_distance as SQL functions, and each stage as a temporary view of its name."""
    for body in FUNCTIONS.values():
        spark.sql(body)
    for name, stage in stages.items():
        stage.createOrReplaceTempView(name)
