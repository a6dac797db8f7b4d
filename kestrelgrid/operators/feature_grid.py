"""The wall-to-wall table of predictors for inference: one row for each land pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import pixel_centre
from ..functions.pixels import clip
from . import audit, fuse, stack

#: Predictors of the grid and their least values; fixed values.
PREDICTORS = ("ndvi_mean", "ndvi_std", "ndvi_cv", "ndvi_temporal_range", "ndvi_valid_count", "static_elevation", "static_slope", "static_terrain_roughness", "static_dist_coast", "static_dist_water", "static_local_ndvi_mean_1km", "static_local_ndvi_std_1km")
FLOORS = {"static_slope": 0.0, "static_dist_coast": 0.0, "static_dist_water": 0.0, "static_elevation": -100.0}
MODEL_FEATURES = ("ndvi_mean", "ndvi_std", "ndvi_cv", "ndvi_temporal_range", "static_elevation", "static_slope", "static_dist_coast", "static_dist_water", "static_local_ndvi_mean_1km", "static_local_ndvi_std_1km", "ndvi_valid_fraction", "is_lowland", "is_highland")


def feature_grid(mask: DataFrame, layers: DataFrame, geo: list[float], predictors: tuple[str, ...] = PREDICTORS, floors: dict[str, float] | None = None, year: int = 2024, month: int = 6) -> DataFrame:
    """Predictors of every cell whose mask value is over -1, with coordinates and the year and month to predict for.

    ``mask``: (pixel_y, pixel_x, value), nodata already null; ``layers``: (layer, pixel_y, pixel_x, value).
    """
    floors = FLOORS if floors is None else floors
    lon, lat = pixel_centre(F.col("pixel_y"), F.col("pixel_x"), geo)
    land = mask.where("value > -1").select("pixel_y", "pixel_x", lon.alias("longitude"), lat.alias("latitude"))
    wide = stack.to_wide(layers, ["pixel_y", "pixel_x"], list(predictors))
    out = land.join(wide, ["pixel_y", "pixel_x"], "left").withColumns({"year": F.lit(year), "month": F.lit(month)})
    return out.withColumns({c: clip(F.col(c), low) for c, low in floors.items() if c in predictors})


def checks(grid: DataFrame) -> DataFrame:
    """(check, fail_count) of the grid's bounds; :func:`..audit.require` raises on any."""
    c = F.col
    rows = {"NDVI Mean within 1.1": (c("ndvi_mean") < -1.1) | (c("ndvi_mean") > 1.1), "Slope >= 0": c("static_slope") < 0, "Elevation > -150": c("static_elevation") <= -150}
    dup = audit.duplicates(grid, ["pixel_y", "pixel_x"]).select(F.lit("Unique pixels").alias("check"), F.col("duplicate_keys").alias("fail_count"))
    return fuse.assertions(grid, rows).unionAll(dup)


def model_inputs(grid: DataFrame, limits: tuple[float, float] = fuse.TRAINING_LIMITS, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Features of the model, derived flags included, with nulls as the grid's medians (a missing valid fraction as one half)."""
    e = F.col("static_elevation")
    out = grid.withColumns({"ndvi_valid_fraction": F.col("ndvi_valid_count") / 23.0, "is_lowland": F.coalesce(e < limits[0], F.lit(False)).cast("double"), "is_highland": F.coalesce(e > limits[1], F.lit(False)).cast("double")})
    missing = [f for f in features if f not in out.columns]
    if missing:
        raise ValueError(f"the grid lacks features: {missing}")
    plain = [f for f in features if f not in ("is_lowland", "is_highland")]
    return fuse.median_impute(out.select("pixel_y", "pixel_x", *features), plain, {"ndvi_valid_fraction": 0.5} if "ndvi_valid_fraction" in plain else {})
