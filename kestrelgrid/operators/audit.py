"""Audits: each gives rows of checks or one row of verdicts, for reports and gates."""

from __future__ import annotations

import platform
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_of(messages: Column) -> Column:
    """FAIL if any message has FAIL, else WARN if any has WARN, else PASS."""
    has = lambda word: F.exists(messages, lambda m: F.contains(F.upper(m), F.lit(word)))
    return F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").otherwise("PASS")


def observation_audit(df: DataFrame, leakage: DataFrame, box: tuple[float, float, float, float] = (6.0, 15.0, 91.0, 95.0), least_m: float = 100.0) -> DataFrame:
    """One row: rows, outliers of the box, least fold distance in metres, status."""
    lat, lon = F.col("latitude"), F.col("longitude")
    out = df.agg(F.count(F.lit(1)).alias("raw_obs_total"), F.count_if((lat < box[0]) | (lat > box[1]) | (lon < box[2]) | (lon > box[3])).alias("coord_outliers"))
    out = out.crossJoin(leakage.agg((F.min("min_dist_km") * 1000.0).alias("leakage_min_dist")))
    bad = (F.col("coord_outliers") > 0) | F.coalesce(F.col("leakage_min_dist") < least_m, F.lit(True))
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def model_audit(summary: DataFrame, models: DataFrame, least_pass: int = 30, least_auc: float = 0.70, folds: int = 4) -> DataFrame:
    """One row: species that pass, their mean AUC, fold models that should be there and aren't, status.

    A model row whose optional column ``readable`` is false is corrupt, and counts as missing.
    """
    if "readable" in models.columns:
        models = models.where("readable")
    ok = summary.where("governance = 'PASS'").select("species", "auc_mean")
    due = ok.select("species", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    missing = due.join(models.select("species", "fold").distinct(), ["species", "fold"], "left_anti").agg(F.count(F.lit(1)).alias("missing_folds"))
    out = ok.agg(F.count(F.lit(1)).alias("pass_count"), F.avg("auc_mean").alias("avg_auc")).crossJoin(missing)
    notes = F.array_compact(F.array(F.when(F.col("pass_count") < least_pass, "FAIL few species"), F.when(F.col("avg_auc") < least_auc, "FAIL low auc"), F.when(F.col("missing_folds") > 0, "FAIL missing folds")))
    return out.withColumn("messages", F.array_join(notes, " | ")).withColumn("status", status_of(notes))


def raster_audit(layers: DataFrame, total_pixels: int, least_coverage: float = 3.0) -> DataFrame:
    """One row over suitability layers (layer, value, perhaps extrapolation): layers out of range or not finite, least coverage percent, status; mean extrapolation where it is given."""
    v = F.col("value")
    per = layers.groupBy("layer").agg(F.max((~(F.abs(v) < float("inf")) | F.isnan(v)).cast("int")).alias("odd"), F.min(v).alias("lo"), F.max(v).alias("hi"), (F.count(v) * 100.0 / total_pixels).alias("coverage"))
    extra = [layers.agg(F.avg("extrapolation").alias("mean_extrapolation"))] if "extrapolation" in layers.columns else []
    out = per.agg(F.count(F.lit(1)).alias("layers"), F.coalesce(F.sum("odd"), F.lit(0)).alias("non_finite"), F.count_if((F.col("lo") < -0.01) | (F.col("hi") > 1.01)).alias("bad_range"), F.min("coverage").alias("min_coverage"))
    for one in extra:
        out = out.crossJoin(one)
    return out.withColumn("status", F.when((F.col("non_finite") > 0) | (F.col("bad_range") > 0) | F.coalesce(F.col("min_coverage") < least_coverage, F.lit(True)), "FAIL").otherwise("PASS"))


def index_range_audit(grid: DataFrame, column: str = "ndvi_mean", low: float = -1.1, high: float = 1.1) -> DataFrame:
    """One row: pixels, range, WARN if the range is suspicious."""
    out = grid.agg(F.count(F.lit(1)).alias("grid_pixels"), F.min(column).alias("least"), F.max(column).alias("most"))
    return out.withColumn("status", F.when((F.col("least") < low) | (F.col("most") > high), "WARN").otherwise("PASS"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))


def require(audit: DataFrame, count: str = "fail_count") -> None:
    """Raises if any row of an audit counts a failure."""
    bad = audit.where(F.col(count) > 0).limit(5).collect()
    if bad:
        raise ValueError(f"checks failed: {[r.asDict() for r in bad]}")


def environment(spark) -> DataFrame:
    """(item, value) of the running environment."""
    return spark.createDataFrame([("python", sys.version.split()[0]), ("platform", platform.system()), ("spark", spark.version)], "item string, value string")


def diagnostics(audit: DataFrame) -> DataFrame:
    """Mosaic diagnostics by status: how many, their mean index over those that did not fail."""
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("mosaics"), F.avg(F.when(F.col("status") != "FAIL", F.col("ndvi_mean"))).alias("mean_ndvi"))


def messages(audits: dict[str, DataFrame]) -> DataFrame:
    """(category, status) of several audits with a ``status`` column, the worst of each."""
    out = None
    for name, a in audits.items():
        one = a.agg(F.collect_set("status").alias("s")).select(F.lit(name).alias("category"), status_of(F.col("s")).alias("status"))
        out = one if out is None else out.unionAll(one)
    return out


def verdict(audits: DataFrame, mean_auc: DataFrame, least_auc: float = 0.7) -> DataFrame:
    """One row over all audits: failures, warnings, and READY if nothing failed and the mean AUC (``avg_auc``) is over the bar, else UNSTABLE."""
    out = audits.agg(F.count_if(F.col("status") == "FAIL").alias("failures"), F.count_if(F.col("status") == "WARN").alias("warnings")).crossJoin(mean_auc.select("avg_auc").limit(1))
    good = (F.col("failures") == 0) & F.coalesce(F.col("avg_auc") > least_auc, F.lit(False))
    return out.withColumn("verdict", F.when(good, "READY").otherwise("UNSTABLE"))
