"""Pair features, the logistic classifier, verdicts and their summaries."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions import features as f
from echofold.functions.features import FEATURES

IMAGE_FIELDS = ("width", "height", "file_size", "mean_brightness", "contrast", "histogram")
#: Without a model, pairs within this distance of the DCT hash are taken for duplicates.
FALLBACK_DISTANCE = 8

# The shipped classifier, by feature: mean, scale, coefficient.
SHIPPED = {
    "d_ahash": (17.147702127659574, 14.237027429872137, -0.5310298268308171),
    "d_dhash": (21.337191489361704, 13.97049641153128, -0.7282043343217908),
    "d_phash": (21.36727659574468, 13.830312123525381, -3.6627753860217718),
    "dim_ratio": (0.8376894885085107, 0.22939517984077185, 1.487114459731858),
    "aspect_delta": (0.21360693144369153, 0.2942977728672763, -1.645551886559048),
    "size_ratio": (0.5682479152319149, 0.24363905203348452, -0.472387099645332),
    "hist_distance": (0.3989688325704681, 0.28581847500823354, -4.499604627292366),
    "brightness_delta": (0.09053375947019411, 0.10224431588102602, -0.055479066369182206),
    "contrast_delta": (0.0883906394312573, 0.0941778553200357, -0.3913939947956006),
    "d_dhash_oriented": (17.48617021276596, 11.646006539215628, -4.909913937600102),
}
SHIPPED_INTERCEPT, SHIPPED_THRESHOLD = -3.756952625129102, 0.06806269820763886


class ModelError(ValueError):
    """A model file that can't be used; the message says why."""


@dataclass(frozen=True)
class Classifier:
    """A logistic model over the ten features, in their order."""

    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    coef: tuple[float, ...] = ()
    intercept: float = 0.0
    threshold: float = 0.5
    loaded: bool = False

    @classmethod
    def shipped(cls) -> Classifier:
        m, s, c = zip(*(SHIPPED[k] for k in FEATURES))
        return cls(m, s, c, SHIPPED_INTERCEPT, SHIPPED_THRESHOLD, True)

    def probability(self) -> Column:
        """The probability as FLOAT, over columns named as FEATURES; 0 without a model."""
        if not self.loaded:
            return F.lit(0.0).cast("float")
        terms = [F.lit(c) * (F.col(k).cast("double") - F.lit(m)) / F.lit(s or 1.0) for k, m, s, c in zip(FEATURES, self.mean, self.scale, self.coef)]
        z = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).cast("float")

    def verdict(self) -> Column:
        """Whether a pair counts as duplicate; without a model by the DCT hash alone."""
        if not self.loaded:
            return F.col("d_phash") <= FALLBACK_DISTANCE
        return F.col("probability").cast("double") >= F.lit(self.threshold)


def parse_model(text: str) -> Classifier:
    """A classifier from JSON, or a ModelError that names what is wrong."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ModelError(f"malformed JSON: {e}") from e
    if raw.get("schema_version") != 1:
        raise ModelError(f"unsupported schema_version {raw.get('schema_version')}")
    if raw.get("model") != "logistic_regression":
        raise ModelError(f"unsupported model {raw.get('model')}")
    if list(raw.get("feature_names", ())) != list(FEATURES):
        raise ModelError("feature mismatch: names or their order differ")
    parts = [tuple(map(float, raw.get(k, ()))) for k in ("mean", "scale", "coef")]
    if any(len(p) != len(FEATURES) for p in parts):
        raise ModelError(f"mean, scale and coef must have {len(FEATURES)} entries")
    if not all(math.isfinite(x) for p in parts for x in p):
        raise ModelError("mean, scale and coef must be finite")
    return Classifier(*parts, float(raw.get("intercept", 0.0)), float(raw.get("threshold", 0.5)), True)


def load_model(path: str) -> Classifier:
    try:
        with open(path) as file:
            return parse_model(file.read())
    except OSError as e:
        raise ModelError(f"cannot open {path}: {e}") from e


def model_json(model: Classifier, metrics: dict[str, float] | None = None) -> str:
    made = {"schema_version": 1, "model": "logistic_regression", "feature_names": list(FEATURES), "mean": model.mean, "scale": model.scale, "coef": model.coef, "intercept": model.intercept, "threshold": model.threshold, "test_metrics": metrics or {}}
    return json.dumps(made, indent=2)


def pair_features(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs whose images both have features, with all ten; images: id and IMAGE_FIELDS."""
    side = lambda s: images.select(F.col("id").alias(s), F.struct(*IMAGE_FIELDS).alias(f"_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("_a"), F.col("_b")
    return both.select(
        *[F.col(c) for c in pairs.columns],
        f.dim_ratio(a["width"], a["height"], b["width"], b["height"]).alias("dim_ratio"),
        f.aspect_delta(a["width"], a["height"], b["width"], b["height"]).alias("aspect_delta"),
        f.size_ratio(a["file_size"], b["file_size"]).alias("size_ratio"),
        f.hist_distance(a["histogram"], b["histogram"]).alias("hist_distance"),
        f.brightness_delta(a["mean_brightness"], b["mean_brightness"]).alias("brightness_delta"),
        f.contrast_delta(a["contrast"], b["contrast"]).alias("contrast_delta"),
    )


def skipped_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs of which an image has no features."""
    ids = images.select("id")
    lacking = lambda s: pairs.join(ids, pairs[s] == ids["id"], "left_anti")
    return lacking("a").unionByName(lacking("b")).dropDuplicates(["a", "b"])


def score(featured: DataFrame, model: Classifier) -> DataFrame:
    """Adds probability (FLOAT) and verdict (INT)."""
    return featured.withColumn("probability", model.probability()).withColumn("verdict", model.verdict().cast("int"))


def probability_histogram(scored: DataFrame) -> DataFrame:
    """Pairs by tenth of the probability; 1 falls into the last. All ten buckets have a row."""
    tenth = F.least(F.lit(9), F.floor((F.col("probability") * F.lit(10).cast("float")).cast("float"))).cast("int")
    counted = scored.groupBy(tenth.alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))
    every = scored.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


def verdict_summary(scored: DataFrame) -> DataFrame:
    """Accepted and rejected pairs, and the share rejected in percent (0 if there are none)."""
    n = F.count(F.lit(1))
    no = F.count_if(F.col("verdict") == 0)
    return scored.agg(F.count_if(F.col("verdict") == 1).alias("accepted"), no.alias("rejected"), F.when(n > 0, no * 100.0 / n).otherwise(F.lit(0.0)).alias("rejected_percent"))


def most_confident(scored: DataFrame) -> DataFrame:
    """The pair with the highest probability (ties by a, then b)."""
    return scored.orderBy(F.col("probability").desc(), "a", "b").limit(1)
