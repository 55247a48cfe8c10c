"""Metrics against ground truth, of pairs and of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes that name how a copy was made, longer ones first where one ends another.
SUFFIXES = ("win_resize", "exact_dup", "captioned", "whatsapp", "cropped", "flipped", "rotated", "resized")
WEAK_RECALL = 0.90


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def base_and_transform(path: Column) -> Column:
    """Struct of base and transform of a file name; a name without suffix is an original."""
    name = stem(path)
    pattern = rf"^(.*)_({'|'.join(SUFFIXES)})$"
    found = F.regexp_extract(name, pattern, 2)
    return F.struct(F.when(found != "", F.regexp_extract(name, pattern, 1)).otherwise(name).alias("base"), F.when(found != "", found).otherwise(F.lit("original")).alias("transform"))


def base_sizes(files: DataFrame, base: str = "base") -> DataFrame:
    """How many bases have how many files; size 1 are singletons, which have no true pair."""
    return files.groupBy(base).agg(F.count(F.lit(1)).alias("files")).groupBy("files").agg(F.count(F.lit(1)).alias("bases")).withColumn("singletons", F.col("files") == 1)


def worst(scored: DataFrame, label: int, n: int = 15) -> DataFrame:
    """The n wrongly judged pairs of a label that were most certain: false positives for 0, false negatives for 1."""
    order = F.col("probability").desc() if label == 0 else F.col("probability").asc()
    return scored.where((F.col("label") == label) & (F.col("verdict") != label)).orderBy(order, "a", "b").limit(n)


def truth_pairs(files: DataFrame, base: str = "base", file: str = "file") -> DataFrame:
    """All pairs of files with one base."""
    a, b = files.select(base, F.col(file).alias("a")), files.select(base, F.col(file).alias("b"))
    return a.join(b, base).where("a < b").select("a", "b")


def confusion(true: DataFrame, found: DataFrame) -> DataFrame:
    """One row: pairs in both, only found, only true."""
    marked = true.select("a", "b", F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select("a", "b", F.lit(0).alias("t"), F.lit(1).alias("f"))).groupBy("a", "b").agg(F.max("t").alias("t"), F.max("f").alias("f"))
    return marked.agg(F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("tp"), F.count_if((F.col("t") == 0) & (F.col("f") == 1)).alias("fp"), F.count_if((F.col("t") == 1) & (F.col("f") == 0)).alias("fn"))


def true_positives(true: DataFrame, found: DataFrame) -> DataFrame:
    return true.select("a", "b").intersect(found.select("a", "b"))


def false_positives(true: DataFrame, found: DataFrame) -> DataFrame:
    return found.select("a", "b").exceptAll(true.select("a", "b"))


def false_negatives(true: DataFrame, found: DataFrame) -> DataFrame:
    return true.select("a", "b").exceptAll(found.select("a", "b"))


def recall_by_transform(true: DataFrame, found: DataFrame, transforms: DataFrame) -> DataFrame:
    """Recall of true pairs by the transform of either end (file, transform); originals are not counted."""
    hit = true.select("a", "b").join(found.select("a", "b").distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left")
    credited = hit.withColumn("file", F.explode(F.array("a", "b"))).join(transforms, "file").where("transform != 'original'")
    recall = F.count("hit") / F.count(F.lit(1))
    return credited.groupBy("transform").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"), recall.alias("recall"), (recall < 0.5).alias("weak"))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """One row of counts, precision, recall, F1 and Brier score; rows: label, verdict, probability."""
    y, v = F.col("label"), F.col("verdict")
    n = scored.agg(F.count_if((y == 1) & (v == 1)).alias("tp"), F.count_if((y == 0) & (v == 1)).alias("fp"), F.count_if((y == 1) & (v == 0)).alias("fn"), F.count_if((y == 0) & (v == 0)).alias("tn"), F.avg(F.pow(F.col("probability").cast("double") - y, 2)).alias("brier"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = n.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum of precision times the step in recall, over falling probabilities."""
    from echofold.operators.training import pr_curve

    # The step in recall at a probability is its own share of the hits.
    step = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))
    return pr_curve(scored).agg(F.sum(step * F.col("precision")).alias("average_precision"))


def recall_by_group(scored: DataFrame, group: str) -> DataFrame:
    """Share of true pairs accepted by group, marked where it is low."""
    share = F.avg(F.col("verdict").cast("double"))
    return scored.where("label = 1").groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), share.alias("recall"), (share < WEAK_RECALL).alias("weak"))


def distance_quantiles(pairs: DataFrame, group: str) -> DataFrame:
    """Median and 90th percentile of the smallest distance by group."""
    d = F.least("d_ahash", "d_dhash", "d_phash")
    return pairs.groupBy(group).agg(F.percentile(d, 0.5).alias("median_distance"), F.percentile(d, 0.9).alias("p90_distance"))
