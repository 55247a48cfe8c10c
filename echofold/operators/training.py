"""Labelled pairs without leaks, hard negatives, training and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echofold.functions.features import FEATURES
from echofold.operators.running import running_sums
from echofold.operators.scoring import Classifier
from echofold.session import written

MIN_DISTANCE = 4
PRECISION = 0.98


def hashed_split(base: Column, seed: int = 42) -> Column:
    """train, val or test (70, 15, 15 of 100) by a hash of the base image: copies never cross splits."""
    return split_at(F.conv(F.substring(drawn(seed, base), 1, 8), 16, 10).cast("long") % 100, 70, 85)


def drawn(seed: int, *values: Column) -> Column:
    """A hash in hex that draws rows in an order of their own, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[v.cast("string") for v in values]))


def split_at(place: Column, val_from: int, test_from: int) -> Column:
    return F.when(place < val_from, "train").when(place < test_from, "val").otherwise("test")


def positives(variants: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """For each base the k variants (base, variant, split) with the smallest hash, as pairs of label 1."""
    order = W.partitionBy("base").orderBy(drawn(seed, F.col("base"), F.col("variant")), "variant")
    picked = variants.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return picked.select(F.col("base").alias("base_a"), F.col("base").alias("base_b"), "variant", "split", F.lit(1).alias("label"))


def random_negatives(bases: DataFrame, per_base: int = 1, seed: int = 42) -> DataFrame:
    """Pairs of different bases (base, split) of one split, label 0, each pair once.

    Bases of a split are ranked by a hash; each is paired with the next
    per_base in that order (round the end), which needs no cross join. Ranks
    are made in two steps, so that no task sees a whole split.
    """
    cells = bases.select("base", "split").distinct().withColumn("h", drawn(seed, F.col("base"))).withColumn("cell", F.substring("h", 1, 3))
    sizes = cells.groupBy("split", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("split").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).withColumn("total", F.sum("n").over(W.partitionBy("split"))).drop("n")
    own = F.row_number().over(W.partitionBy("split", "cell").orderBy("h", "base")) - 1
    ranked = cells.withColumn("own", own).join(offsets, ["split", "cell"]).select("base", "split", (F.col("own") + F.col("before")).alias("rank"), "total")
    steps = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(per_base)))).withColumn("rank", F.pmod(F.col("rank") + F.col("step"), F.col("total")))
    met = steps.select(F.col("base").alias("x"), "split", "rank").join(ranked.select(F.col("base").alias("y"), "split", "rank"), ["split", "rank"]).where("x != y")
    return met.select(F.least("x", "y").alias("base_a"), F.greatest("x", "y").alias("base_b"), "split").distinct().withColumn("label", F.lit(0))


def mined(pairs: DataFrame, split_of: DataFrame, quota: int, min_distance: int = MIN_DISTANCE) -> DataFrame:
    """Hard negatives among candidate pairs (a, b, distances).

    In order: both bases are known, both lie in one split, the smallest plain
    distance is not below min_distance; then the first `quota` by (a, b) of
    each split.
    """
    side = lambda c: split_of.select(F.col("base").alias(c), F.col("split").alias(f"split_{c}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").where("split_a = split_b")
    far = known.withColumn("d_min", F.least("d_ahash", "d_dhash", "d_phash")).where(F.col("d_min") >= min_distance)
    place = F.row_number().over(W.partitionBy("split_a").orderBy("a", "b"))
    return far.withColumn("_n", place).where(F.col("_n") <= quota).select("a", "b", F.col("split_a").alias("split"), "d_min", F.lit(0).alias("label"), F.lit("hard_negative").alias("transform"))


def unknown_pairs(pairs: DataFrame, split_of: DataFrame) -> DataFrame:
    """Pairs of which a base has no split."""
    ids = split_of.select("base")
    return pairs.join(ids, pairs["a"] == ids["base"], "left_anti").unionByName(pairs.join(ids, pairs["b"] == ids["base"], "left_anti")).dropDuplicates(["a", "b"])


def distance_histogram(negatives: DataFrame, width: int = 4) -> DataFrame:
    return negatives.groupBy((F.floor(F.col("d_min") / width) * width).cast("int").alias("d_from")).agg(F.count(F.lit(1)).alias("pairs"))


def merged_manifest(original: DataFrame, extra: DataFrame) -> DataFrame:
    """Original rows and mined ones, none dropped."""
    return original.unionByName(extra, allowMissingColumns=True)


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, max_iter: int = 200) -> Classifier:
    """A logistic model over standardised features; rows: label and the features.

    Features are scaled by the population's deviation; the penalty is that of
    an inverse strength of one, 1 / n for a mean loss.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # Read several times below: what stands behind the rows, all pairs of images for one, runs once.
    rows = written(rows.select("label", *features), "training")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.mean(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    if not stats["n"]:
        raise ValueError("no rows to train on")
    mean, scale = [stats[f"m_{c}"] for c in features], [stats[f"s_{c}"] or 1.0 for c in features]
    scaled = rows.select(F.col("label").cast("double").alias("label"), *[((F.col(c).cast("double") - m) / s).alias(c) for c, m, s in zip(features, mean, scale)])
    made = VectorAssembler(inputCols=list(features), outputCol="x").transform(scaled)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", maxIter=max_iter, regParam=1.0 / stats["n"], standardization=False, tol=1e-8).fit(made)
    return Classifier(tuple(mean), tuple(scale), tuple(float(c) for c in fitted.coefficients), float(fitted.intercept), 0.5, True)


def pr_curve(scored: DataFrame) -> DataFrame:
    """By probability: how many pairs reach it, how many of them are duplicates, precision and recall."""
    by = scored.groupBy("probability").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    total = scored.agg(F.sum("label").alias("total"))
    run = running_sums(by, [F.col("probability").desc()], {"tp": F.col("hits"), "reached": F.col("n")})
    return run.crossJoin(total).select("probability", "tp", "reached", (F.col("tp") / F.col("reached")).alias("precision"), F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(F.lit(0.0)).alias("recall"), F.col("hits"), F.col("total"))


def best_threshold(scored: DataFrame, precision: float = PRECISION, default: float = 0.5) -> DataFrame:
    """One row: of the thresholds with enough precision the one with most recall, the lowest of several."""
    good = pr_curve(scored).where(F.col("precision") >= precision)
    best = good.agg(F.max_by(F.struct(F.col("probability").cast("double").alias("threshold"), "precision", "recall"), F.struct("recall", -F.col("probability"))).alias("t"))
    none = F.struct(F.lit(default).alias("threshold"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"))
    return best.select(F.coalesce("t", none).alias("t")).select("t.*")


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def baseline_grid(pairs: DataFrame, features: tuple[str, ...] = ("d_ahash", "d_dhash", "d_phash"), limit: int = 32) -> DataFrame:
    """Precision, recall and F1 of every single distance and threshold up to `limit`.

    Pairs are counted by distance first, so thresholds only meet counts.
    """
    wide = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("d")) for f in features]))
    counts = pairs.select("label", wide.alias("x")).groupBy("x.feature", "x.d").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    at = counts.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(limit))))
    within = F.col("d") <= F.col("threshold")
    g = at.groupBy("feature", "threshold").agg(F.sum(F.when(within, F.col("hits")).otherwise(0)).alias("tp"), F.sum(F.when(within, F.col("n")).otherwise(0)).alias("reached"), F.sum("hits").alias("total"))
    p, r = _safe(F.col("tp"), F.col("reached")), _safe(F.col("tp"), F.col("total"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("feature", "threshold", "precision", "recall", "f1")


def best_baseline(grid: DataFrame) -> DataFrame:
    """The best F1 (ties: features in order of name, then the lowest threshold)."""
    return grid.orderBy(F.col("f1").desc(), "feature", "threshold").limit(1)


def coefficients(model: Classifier, spark) -> DataFrame:
    """Coefficients, the weightiest first."""
    rows = [(f, float(c)) for f, c in zip(FEATURES, model.coef)]
    return spark.createDataFrame(rows, "feature string, coef double").orderBy(F.abs("coef").desc(), "feature")
