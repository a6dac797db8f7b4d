"""Fold ensembles over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clip


def ensemble(scores: DataFrame, keys: list[str], score: str = "score", least_folds: int = 1) -> DataFrame:
    """Per cell: mean score in [0.001, 0.999], population deviation in [0, 1], coefficient of variation in [0, 5]; cells with too few folds go.

    The coefficient is 0 where the mean is at most 0.05.
    """
    out = scores.groupBy(*keys).agg(F.avg(score).alias("__m"), F.stddev_pop(score).alias("__s"), F.count(score).alias("folds")).where(F.col("folds") >= least_folds)
    mean = clip(F.col("__m"), 0.001, 0.999)
    return out.select(*keys, "folds", mean.alias("suitability"), clip(F.col("__s"), 0.0, 1.0).alias("uncertainty_std"), clip(F.when(mean > 0.05, clip(F.col("__s"), 0.0, 1.0) / mean).otherwise(F.lit(0.0)), 0.0, 5.0).alias("uncertainty_cv"))


def extrapolation(grid: DataFrame, training: DataFrame, features: list[str]) -> DataFrame:
    """Adds extrapolation: the share of features outside the training rows' range; a missing value is not outside."""
    ends = training.agg(*[f(c).alias(f"__{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = [F.coalesce((F.col(c) < F.col(f"__lo_{c}")) | (F.col(c) > F.col(f"__hi_{c}")), F.lit(False)).cast("int") for c in features]
    return grid.crossJoin(F.broadcast(ends)).withColumn("extrapolation", sum(out[1:], out[0]) / float(len(features))).select(*grid.columns, "extrapolation")


def usable_ensembles(models: DataFrame, least: int = 3, expected: int = 4) -> DataFrame:
    """(species, folds, note) of species with enough fold models; noted where some are missing."""
    n = models.groupBy("species").agg(F.count_distinct("fold").alias("folds")).where(F.col("folds") >= least)
    return n.withColumn("note", F.when(F.col("folds") < expected, "incomplete ensemble").otherwise(""))
