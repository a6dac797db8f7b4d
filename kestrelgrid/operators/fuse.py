"""Training matrix: joins of feature tables, derived indicators, imputation, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import flag
from .stats import quantile_row

#: Elevation limits of the lowland and highland flags: the training set, and the other set some surfaces were made with; fixed values.
TRAINING_LIMITS, SURFACE_LIMITS = (100.0, 300.0), (50.0, 150.0)


def fuse(dynamic: DataFrame, landscape: DataFrame, compat: bool = False) -> DataFrame:
    """Dynamic and landscape rows of the same record. ``compat`` joins on the row id alone, which repeats across
    classes, so that a row meets the other class's features too."""
    if compat:
        return dynamic.join(landscape.drop("target"), "original_row_id")
    return dynamic.join(landscape, ["target", "original_row_id"])


def indicators(df: DataFrame, elevation: str, water: str, valid_count: str, limits: tuple[float, float] = TRAINING_LIMITS, composites: float = 23.0) -> DataFrame:
    """Lowland and highland flags, valid fraction and missing-value flags. An unknown elevation is neither low nor high."""
    e = F.col(elevation)
    return df.withColumns({
        "is_lowland": flag(e < limits[0]), "is_highland": flag(e > limits[1]), "ndvi_valid_fraction": F.col(valid_count) / composites,
        f"{elevation}_missing_flag": e.isNull().cast("int"), f"{water}_missing_flag": F.col(water).isNull().cast("int"),
    })


def assertions(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, fail_count): rows for which each condition is true, from one pass."""
    names = list(checks)
    row = df.agg(*[F.count_if(checks[n]).alias(f"k{k}") for k, n in enumerate(names)])
    cols = ", ".join(f"'{n}', k{k}" for k, n in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {cols}) AS (check, fail_count)")


def median_impute(df: DataFrame, values: list[str], fixed: dict[str, float] | None = None) -> DataFrame:
    """Nulls as the column's exact median, or as a fixed value. Medians of all columns are found together."""
    fixed = fixed or {}
    found = [c for c in values if c not in fixed]
    out = df
    if found:
        out = out.crossJoin(F.broadcast(quantile_row(df, {f"__{c}": (c, 0.5) for c in found})))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fixed[c]) if c in fixed else F.col(f"__{c}")) for c in values}).select(*df.columns)


def imputation_audit(df: DataFrame, values: list[str]) -> DataFrame:
    """(feature, imputed, imputed_pct)."""
    row = df.agg(*[F.array(F.count_if(F.col(c).isNull()).cast("double"), F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in values])
    out = row.unpivot([], values, "feature", "v")
    return out.select("feature", F.col("v")[0].cast("long").alias("imputed"), F.col("v")[1].alias("imputed_pct"))


def complete_share(df: DataFrame, values: list[str]) -> DataFrame:
    every = F.lit(True)
    for c in values:
        every = every & F.col(c).isNotNull()
    return df.agg((F.avg(every.cast("double")) * 100).alias("complete_row_pct"))


def retention(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows before and after and the percent kept, by class."""
    count = lambda df, n: df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    out = count(before, "before").join(count(after, "after"), by, "left").withColumn("after", F.coalesce("after", F.lit(0).cast("long")))
    return out.withColumn("retained_pct", F.try_divide(F.col("after") * 100.0, F.col("before")))


def landscape_flags(df: DataFrame, elevation: str, coast: str) -> DataFrame:
    from ..functions.pixels import terrain_confidence

    return df.withColumns({"coastal_zone_flag": flag(F.col(coast) < 5), "terrain_confidence_flag": terrain_confidence(F.col(elevation), F.col(coast))})


def feature_manifest(spark) -> DataFrame:
    """Where the features come from; fixed values."""
    rows = [
        ("ndvi_mean", "MODIS MOD13Q1", "500m", "Yearly Mean"), ("static_elevation", "SRTM 30m", "30m->500m", "Bilinear Warp"), ("static_slope", "SRTM 30m", "30m", "Native DEMProcessing (Slope)"),
        ("static_terrain_roughness", "SRTM 30m", "30m", "Native DEMProcessing (TRI)"), ("static_dist_coast", "NDVI Landmask", "500m", "EDT (Inland Directed)"), ("coastal_zone_flag", "Derived", "500m", "Dist < 5km"),
    ]
    return spark.createDataFrame(rows, "feature string, source string, res string, method string")
