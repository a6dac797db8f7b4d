"""Many species' surfaces brought together: richness, agreement, stability, priority, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .stats import quantile_row


def valid(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name)


def synthesis(cube: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per cell with at least one valid species: support, weighted and binary richness, agreement and the means.

    ``cube``: (species, pixel_y, pixel_x, suit, unc, extrap); ``thresholds``: (species, threshold), which also
    says how many species there are. A species that is not valid in a cell counts as absent there, so the
    deviation of the presences over all n species is that of a share p of ones: sqrt(p (1 - p)).
    """
    n = thresholds.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("threshold") <= 0).alias("__always"))
    rows = cube.where(valid("suit") & valid("unc") & valid("extrap")).join(thresholds, "species")
    present = F.count_if(F.col("suit") >= F.col("threshold"))
    # where a threshold is not positive, an absent species' zero reaches it
    always = F.count_if(F.col("threshold") <= 0)
    out = rows.groupBy("pixel_y", "pixel_x").agg(F.count(F.lit(1)).alias("support"), F.sum("suit").alias("weighted_richness"), F.avg("suit").alias("mean_suit"), F.avg("unc").alias("mean_unc"), F.avg("extrap").alias("mean_extrap"), present.alias("__present"), always.alias("__here"))
    out = out.crossJoin(F.broadcast(n)).withColumn("binary_richness", F.col("__present") + F.col("__always") - F.col("__here"))
    p = F.col("binary_richness") / F.col("__n")
    return out.withColumn("agreement", 1 - F.sqrt(p * (1 - p))).drop("__n", "__always", "__present", "__here")


def stability(cells: DataFrame, percent: float = 0.99) -> DataFrame:
    """Adds stability = mean_suit / (mean_unc + 0.01), from 0 up to its 99th percentile."""
    raw, _ = materialise(cells.withColumn("stability", F.col("mean_suit") / (F.col("mean_unc") + 0.01)), "cells")
    top = quantile_row(raw, {"__top": ("stability", percent)})
    return raw.crossJoin(F.broadcast(top)).withColumn("stability", F.greatest(F.lit(0.0), F.least("stability", "__top"))).drop("__top")


def priority(cells: DataFrame) -> DataFrame:
    """Adds priority = rich * stable * (1 - extrapolated), each scaled to its range over the cells; in [0, 1]."""
    parts = ("binary_richness", "stability", "mean_extrap")
    ends = cells.agg(*[f(c).cast("double").alias(f"__{n}_{c}") for c in parts for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = [(F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + 1e-8) for c in parts]
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled[0] * scaled[1] * (1 - scaled[2])))
    return cells.crossJoin(F.broadcast(ends)).withColumn("priority", value).select(*cells.columns, "priority")


def hotspots(cells: DataFrame, rich: float = 0.95, stable: float = 0.75, extrapolated: float = 0.5) -> DataFrame:
    """Adds hotspot (0 or 1): rich and stable cells that are little extrapolated, by percentiles over the cells."""
    at = quantile_row(cells, {"__rich": ("binary_richness", rich), "__stable": ("stability", stable), "__extrap": ("mean_extrap", extrapolated)})
    hit = (F.col("binary_richness") >= F.col("__rich")) & (F.col("stability") >= F.col("__stable")) & (F.col("mean_extrap") <= F.col("__extrap"))
    return cells.crossJoin(F.broadcast(at)).withColumn("hotspot", hit.cast("smallint")).select(*cells.columns, "hotspot")


def triad_manifest(summary: DataFrame, folds: DataFrame, layers: DataFrame, grid_tolerance: float = 1e-10) -> DataFrame:
    """Per governed species: threshold, counts of valid cells, whether it is included, or why not.

    ``summary``: (species, governance, auc_mean); ``folds``: (species, th); ``layers``: (species, layer,
    width, height, crs, transform array, valid_coverage) with layer suitability, uncertainty or
    extrapolation. The reference grid is that of the first species in order that has all layers.
    """
    names = ("suitability", "uncertainty", "extrapolation")
    th = folds.groupBy(F.trim("species").alias("species")).agg(F.avg("th").alias("threshold"))
    rows = summary.select(F.trim("species").alias("species"), F.trim("governance").alias("governance"), "auc_mean").where(F.col("governance").isin("PASS", "WARN"))
    grid = F.struct("width", "height", "crs", "transform")
    wide = layers.groupBy("species").pivot("layer", list(names)).agg(F.first(F.struct(grid.alias("grid"), F.col("valid_coverage"))))
    rows = rows.join(th, "species", "left").join(wide, "species", "left")
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    first = rows.where(complete & F.col("threshold").isNotNull()).agg(F.min_by("suitability.grid", "species").alias("__ref"))
    rows = rows.crossJoin(F.broadcast(first))
    off = [
        F.when(F.col(n).isNotNull() & ~(
            F.col(f"{n}.grid.width").eqNullSafe(F.col("__ref.width")) & F.col(f"{n}.grid.height").eqNullSafe(F.col("__ref.height")) & F.col(f"{n}.grid.crs").eqNullSafe(F.col("__ref.crs"))
            & F.forall(F.zip_with(F.col(f"{n}.grid.transform"), F.col("__ref.transform"), lambda a, b: F.abs(a - b) <= grid_tolerance + 1e-5 * F.abs(b)), lambda ok: F.coalesce(ok, F.lit(False)))
        ), F.lit(n)) for n in names
    ]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    astray = F.array_compact(F.array(*off))
    reason = (
        F.when(F.col("threshold").isNull(), "Missing optimal threshold").when(F.size(missing) > 0, F.concat(F.lit("Missing layer triad: "), F.array_join(missing, ", ")))
        .when(F.size(astray) > 0, F.concat(F.lit("Spatial mismatch: "), F.array_join(astray, ", ")))
    )
    coverage = [F.col(f"{n}.valid_coverage").alias(f"{n}_coverage") for n in names]
    return rows.select("species", F.translate("species", " /", "__").alias("safe_name"), "threshold", F.col("auc_mean").alias("auc"), *coverage, reason.isNull().alias("included"), reason.alias("reason"))


def manifest_summary(manifest: DataFrame, width: int, height: int) -> DataFrame:
    """One row: species included and excluded, memory of the cube, whether to read it in chunks, and a hash of the included names."""
    gb = 3 * F.col("validated_species") * width * height * 4 / float(1 << 30)
    out = manifest.agg(F.count_if("included").alias("validated_species"), F.count_if(~F.col("included")).alias("excluded_species"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("included"), F.col("species")))), ""), 256).alias("integrity_hash"))
    return out.withColumns({"raw_cube_gb": F.round(gb, 3), "peak_gb": F.round(gb * 3, 3), "chunk_strategy": F.when(gb * 3 > 4.0, "recommended").otherwise("full_load")})
