"""Raster values at dated points, with the reasons why points are lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import fold_by_latitude, pixel_index
from ..functions.names import reasons
from .occurrence import first_non_null
from .stats import confidence_bins

#: Valid ranges of the yearly layers; fixed values.
RANGES = {"ndvi_mean": (0.0, 1.0), "ndvi_std": (0.0, 1.0), "ndvi_cv": (0.0, 5.0), "ndvi_temporal_range": (0.0, 1.0), "ndvi_valid_count": (0.0, 23.0)}
ECO = ("ndvi_mean", "ndvi_std", "ndvi_cv", "ndvi_temporal_range")


def training_points(presence: DataFrame, background: DataFrame, species: DataFrame) -> DataFrame:
    """Presences of the given species and all background points in one table, with target, weight and the row id of their source."""
    keep = ["species_name", "longitude", "latitude", "year", "month", "target", "observer_weight", "original_row_id"]
    p = presence.join(species.select("species_name"), "species_name", "left_semi").withColumns({"target": F.lit(1), "observer_weight": F.lit(1.0)})
    b = background.withColumns({"species_name": F.lit("BACKGROUND"), "target": F.lit(0), "observer_weight": F.col("weight").cast("double")})
    return p.select(*keep).unionByName(b.select(*keep))


def at_pixels(points: DataFrame, geo: list[float], height: int, width: int) -> DataFrame:
    """Points with pixel_x, pixel_y, spatial_fold, and whether they are on the grid."""
    px, py = pixel_index(F.col("longitude"), geo[0], geo[1]), pixel_index(geo[3] - F.col("latitude"), 0.0, abs(geo[5]))
    out = points.withColumns({"pixel_x": px, "pixel_y": py, "spatial_fold": fold_by_latitude(F.col("latitude"))})
    inside = (F.col("pixel_x") >= 0) & (F.col("pixel_x") < width) & (F.col("pixel_y") >= 0) & (F.col("pixel_y") < height)
    return out.withColumn("on_grid", F.coalesce(inside, F.lit(False)))


def quality_years(stats: DataFrame, least: int = 75_000) -> DataFrame:
    """Years with more valid pixels than ``least`` in some layer."""
    return stats.where(F.col("valid_pixel_count") > least).select("year").distinct()


def quality_years_or_all(stats: DataFrame | None, spark, least: int = 75_000, years: tuple[int, int] = (2005, 2025)) -> DataFrame:
    """:func:`quality_years`; without the report, or one that lacks the count, every year of the span."""
    if stats is None or not {"year", "valid_pixel_count"} <= set(stats.columns):
        return spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    return quality_years(stats, least)


def extract(points: DataFrame, layers: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES, eco: tuple[str, ...] = ECO, least: int = 3, years: DataFrame | None = None) -> DataFrame:
    """Every point of a year that has all layers, with its features and ``reason`` (null for those that stay).

    ``layers``: (year, pixel_y, pixel_x, layer, value). A missing value is NODATA, one outside its range
    INVALID_RANGE and null; points with fewer than ``least`` valid ``eco`` features are lost. Layers are made
    wide once by an aggregate on (year, pixel), and joined once.
    """
    names = list(ranges)
    full = layers.groupBy("year").agg(F.count_distinct("layer").alias("n")).where(F.col("n") == len(names)).select("year")
    if years is not None:
        full = full.join(years.select("year").distinct(), "year", "left_semi")  # a row a year
    wide = layers.groupBy("year", "pixel_y", "pixel_x").pivot("layer", names).agg(F.first("value", ignorenulls=True))
    rows = points.join(F.broadcast(full), "year", "left_semi").join(wide, ["year", "pixel_y", "pixel_x"], "left")
    good = {n: F.col(n).between(*ranges[n]) for n in names}
    why: list[Column] = [F.when(~F.col("on_grid"), F.lit("OUT_OF_BOUNDS"))]
    for n in names:
        why.append(F.when(F.col("on_grid") & F.col(n).isNull(), F.lit("NODATA")).when(F.col("on_grid") & ~good[n], F.lit("INVALID_RANGE")))
    valid = sum((F.coalesce(good[n], F.lit(False)).cast("int") for n in eco), F.lit(0))
    rows = rows.withColumn("reason", F.when(F.col("on_grid") & (valid >= least), F.lit(None)).otherwise(reasons(why)))
    return rows.withColumns({n: F.when(good[n], F.col(n)) for n in names})


def failure_breakdown(extracted: DataFrame) -> DataFrame:
    return extracted.where("reason IS NOT NULL").groupBy("target", "reason").agg(F.count(F.lit(1)).alias("count"))


def yearly_health(extracted: DataFrame) -> DataFrame:
    """Per year: points in, points that stay, percent."""
    out = extracted.groupBy("year").agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("reason").isNull()).alias("retained"))
    return out.withColumn("retained_pct", F.col("retained") * 100.0 / F.col("input"))


def collapse(extracted: DataFrame, tie: list[str]) -> DataFrame:
    """One row for each (pixel, year, target, species), of the heaviest points' first non-null values, with its confidence."""
    rows = extracted.where("reason IS NULL").drop("reason", "on_grid")
    one = first_non_null(rows, ["pixel_x", "pixel_y", "year", "target", "species_name"], [F.desc("observer_weight"), *map(F.col, tie)])
    return confidence_bins(one, "ndvi_valid_count")
