"""Raster time series and stacks as pixel tables: one aggregate by cell replaces stacking arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import season

#: Composites of a full year.
COMPOSITES = 23
STACK_FEATURES = ("ndvi_mean", "ndvi_std", "ndvi_min", "ndvi_max", "ndvi_temporal_range", "ndvi_cv", "ndvi_valid_count", "ndvi_monsoon_mean", "ndvi_dry_mean", "ndvi_winter_mean", "ndvi_monsoon_std", "ndvi_dry_std", "ndvi_monsoon_minus_dry", "ndvi_peak_seasonality")


def year_completeness(series: DataFrame, expected: int = COMPOSITES, least_dates: int = 3) -> DataFrame:
    """Per year with enough dates: dates in all and by season, their shares, completeness and the weak-year flag."""
    dates = series.select("year", "date_str", "month").distinct().withColumn("season", season(F.col("month")))
    n = F.count(F.lit(1))
    out = dates.groupBy("year").agg(n.alias("total_valid_mosaics"), *[F.count_if(F.col("season") == s).alias(f"{s}_dates") for s in ("monsoon", "dry", "winter")]).where(F.col("total_valid_mosaics") >= least_dates)
    out = out.withColumns({f"{s}_ratio": F.col(f"{s}_dates") / F.col("total_valid_mosaics") for s in ("monsoon", "dry", "winter")})
    ratio = F.col("total_valid_mosaics") / F.lit(float(expected))
    return out.withColumns({"completeness_ratio": ratio, "weak_year_flag": (ratio < 0.5).cast("int")})


def yearly_stack(series: DataFrame, expected: int = COMPOSITES, least_dates: int = 3, least_valid: int = 3, cv_from: float = 0.05, cv_to: float = 3.0) -> DataFrame:
    """STACK_FEATURES of each (year, pixel_y, pixel_x) from (year, month, date_str, pixel_y, pixel_x, value).

    One aggregate by cell with conditional seasonal sums; masks then apply in a fixed order. A missing or
    negative mean clears mean, seasonal values and count, but spread and extremes stay, because a count that
    is already missing no longer counts as low. Too few valid dates, or a weak year, clear everything.
    """
    v, s = F.col("value"), season(F.col("month"))
    of = lambda name: F.when(s == name, v)
    px = series.groupBy("year", "pixel_y", "pixel_x").agg(
        F.avg(v).alias("mean0"), F.stddev_pop(v).alias("std0"), F.min(v).alias("min0"), F.max(v).alias("max0"), F.count(v).alias("n0"),
        *[F.avg(of(x)).alias(f"{x}0") for x in ("monsoon", "dry", "winter")], *[F.stddev_pop(of(x)).alias(f"{x}_std0") for x in ("monsoon", "dry")],
    )
    px = px.join(F.broadcast(year_completeness(series, expected, least_dates).select("year", "weak_year_flag")), "year")  # a row a year
    bad = F.coalesce(F.col("mean0") < 0, F.lit(True))
    count = F.when(~bad, F.col("n0"))
    hidden = F.coalesce(count < least_valid, F.lit(False)) | (F.col("weak_year_flag") == 1)
    mean = F.when(~bad, F.col("mean0"))
    cv = F.when(mean > cv_from, F.col("std0") / mean)
    seasonal = {x: F.when(~bad, F.col(f"{x}0")) for x in ("monsoon", "dry", "winter")}
    means = list(seasonal.values())
    made: dict[str, Column] = {
        "ndvi_mean": mean, "ndvi_std": F.col("std0"), "ndvi_min": F.col("min0"), "ndvi_max": F.col("max0"), "ndvi_temporal_range": F.col("max0") - F.col("min0"),
        "ndvi_cv": F.when(cv <= cv_to, cv), "ndvi_valid_count": count, "ndvi_monsoon_mean": seasonal["monsoon"], "ndvi_dry_mean": seasonal["dry"], "ndvi_winter_mean": seasonal["winter"],
        "ndvi_monsoon_std": F.when(~bad, F.col("monsoon_std0")), "ndvi_dry_std": F.when(~bad, F.col("dry_std0")),
        "ndvi_monsoon_minus_dry": seasonal["monsoon"] - seasonal["dry"], "ndvi_peak_seasonality": F.greatest(*means) - F.least(*means),
    }
    return px.select("year", "pixel_y", "pixel_x", *[F.when(~hidden, c).alias(n) for n, c in made.items()])


def yearly_summary(series: DataFrame, stack: DataFrame, expected: int = COMPOSITES, least_dates: int = 3) -> DataFrame:
    """Per year: completeness and the means over cells of mean, cv and peak seasonality, after masking."""
    means = stack.groupBy("year").agg(F.avg("ndvi_mean").alias("mean_ndvi"), F.avg("ndvi_cv").alias("mean_cv"), F.avg("ndvi_peak_seasonality").alias("mean_peak_seasonality"))
    years = year_completeness(series, expected, least_dates).select("year", "completeness_ratio", "total_valid_mosaics", "weak_year_flag")
    return years.join(means, "year", "left")


def aligned(grids: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Layers whose grid equals the reference's: shape, EPSG, and each transform number within tolerance."""
    r = reference.select(*[F.col(c).alias(f"ref_{c}") for c in ("epsg", "geo", "xs", "ys")])
    near = F.forall(F.zip_with("geo", "ref_geo", lambda a, b: F.abs(a - b) <= tolerance + 1e-5 * F.abs(b)), lambda x: F.coalesce(x, F.lit(False)))
    same = (F.col("xs") == F.col("ref_xs")) & (F.col("ys") == F.col("ref_ys")) & F.col("epsg").eqNullSafe(F.col("ref_epsg")) & near
    return grids.crossJoin(F.broadcast(r.limit(1))).where(same).drop("ref_epsg", "ref_geo", "ref_xs", "ref_ys")


def mosaic(tiles: DataFrame, keys: list[str], order: str, place: tuple[str, str] | None = None, covers: Column | None = None) -> DataFrame:
    """One value a cell where tiles overlap: that of the last tile in order which has one.

    With ``place``, a row's file (as ``_metadata.file_path`` gives it) and its number there, the order is a whole
    number, and of rows of one order the first by place wins; files stand by folder, then by name. Without, it is any
    of them. Cells without a value are left out; with ``covers`` those that have a row for which it holds stay, as null.
    """
    rows, has = tiles.where("value IS NOT NULL" if covers is None else covers), F.col("value").isNotNull()
    if place is None:
        return rows.groupBy(*keys).agg(F.max_by("value", F.when(has, F.col(order))).alias("value"))
    file, row = place
    # order and row in one number, as a struct would have every row sorted: 64 bits times 10^18 less a row number fit 38 digits
    last = F.when(has, F.col(order).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") - F.col(row).cast("decimal(18,0)"))
    each = rows.groupBy(*keys, file).agg(F.max_by("value", last).alias("value"), F.max(F.when(has, F.col(order))).alias("__last"))
    # blanks, brackets and their like are encoded in the path, and would stand elsewhere
    path = F.when(F.contains(file, F.lit("%")), F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B")))).otherwise(F.col(file))
    folder, name = F.regexp_replace(path, "/[^/]*$", ""), F.substring_index(path, "/", -1)
    return each.groupBy(*keys).agg(F.min_by("value", F.when(F.col("__last").isNotNull(), F.struct(F.bitwise_not("__last"), folder, name))).alias("value"))


def mosaic_audit(series: DataFrame, total_pixels: int) -> DataFrame:
    """Per date: valid pixels, their share, mean and population deviation, missing percent."""
    return series.groupBy("date_str", "year", "month").agg(F.count("value").alias("valid_pixels"), (F.count("value") / total_pixels).alias("valid_pixel_ratio"), F.avg("value").alias("ndvi_mean"), F.stddev_pop("value").alias("ndvi_std"), (100 - F.count("value") / total_pixels * 100).alias("nodata_pct"))


def layer_stats(layers: DataFrame, by: list[str], total_pixels: int | None = None) -> DataFrame:
    """Per layer: minimum, maximum, mean, population deviation, missing percent and valid count of ``value``."""
    n = F.lit(total_pixels) if total_pixels else F.count(F.lit(1))
    return layers.groupBy(*by).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (100 - F.count("value") / n * 100).alias("nodata_pct"), F.count("value").alias("valid_pixel_count"))


def to_layers(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Wide cells as (keys, layer, value) rows, nulls too."""
    return wide.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "layer", "value")


def to_wide(layers: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Layers stacked onto cells: one column a layer. The list of layers is given, so that no pass finds it."""
    return layers.groupBy(*keys).pivot("layer", features).agg(F.first("value", ignorenulls=True))


def report_of(layer: Column) -> Column:
    """Which report a layer's statistics belong to."""
    return F.when(layer.rlike("monsoon|dry|winter|seasonality"), "seasonal").otherwise("aggregate")


def layer_inventory(layers: DataFrame, features: int = len(STACK_FEATURES)) -> DataFrame:
    """One row: layers there and expected (years times features), and whether they agree."""
    found = layers.select("year", "layer").distinct()
    out = found.agg(F.count(F.lit(1)).alias("layers"), (F.count_distinct("year") * features).alias("expected_layers"))
    return out.withColumn("status", F.when(F.col("layers") == F.col("expected_layers"), "PASS").otherwise("FAIL"))


def bounds_audit(layers: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Per layer: values out of range."""
    return layers.groupBy("layer").agg(F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("fail_count"))


def land_mask(counts: DataFrame) -> DataFrame:
    """Cells that ever had a valid date."""
    return counts.where("value IS NOT NULL AND value > 0").select("pixel_y", "pixel_x")


def cell_histogram(points: DataFrame, y: Column, x: Column) -> DataFrame:
    """Counts of points by cell."""
    return points.select(y.alias("pixel_y"), x.alias("pixel_x")).dropna().groupBy("pixel_y", "pixel_x").agg(F.count(F.lit(1)).alias("count"))


def warp(pixels: DataFrame, factor: float, how: str = "avg", shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cells regridded to coarser ones, ``factor`` source cells a side: avg, max, min or nearest (the source cell at the target's centre)."""
    ty, tx = (F.floor((F.col(c) + 0.5 + s) / factor).cast("int") for c, s in (("pixel_y", shift[0]), ("pixel_x", shift[1])))
    rows = pixels.where("value IS NOT NULL").withColumns({"ty": ty, "tx": tx})
    if how == "nearest":
        off = lambda c, t, s: F.abs(F.col(c) + 0.5 + s - (F.col(t) + 0.5) * factor)
        value = F.min_by("value", F.struct(off("pixel_y", "ty", shift[0]) + off("pixel_x", "tx", shift[1]), F.col("pixel_y"), F.col("pixel_x")))
    else:
        value = {"avg": F.avg, "max": F.max, "min": F.min}[how]("value")
    return rows.groupBy(F.col("ty").alias("pixel_y"), F.col("tx").alias("pixel_x")).agg(value.alias("value"))


def warp_bilinear(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """Values at real-valued source positions (sy, sx) of target cells (pixel_y, pixel_x), from the four neighbours' weights.

    Positions are in source cells, centres at whole numbers plus a half; missing neighbours leave their weight to the others.
    """
    fy, fx = F.col("sy") - 0.5, F.col("sx") - 0.5
    y0, x0 = F.floor(fy), F.floor(fx)
    corner = F.array(*[F.struct((y0 + dy).cast("int").alias("y"), (x0 + dx).cast("int").alias("x"), ((1 - F.abs(fy - y0 - dy)) * (1 - F.abs(fx - x0 - dx))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    want = targets.select("pixel_y", "pixel_x", F.explode(corner).alias("c")).select("pixel_y", "pixel_x", F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.w").alias("w")).where("w > 0")
    src = pixels.where("value IS NOT NULL").select(F.col("pixel_y").alias("y"), F.col("pixel_x").alias("x"), "value")
    return want.join(src, ["y", "x"]).groupBy("pixel_y", "pixel_x").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def target_positions(height: int, width: int, geo: list[float], source_geo: list[float], spark, to_source=None) -> DataFrame:
    """(pixel_y, pixel_x, sy, sx): where the centre of every cell of a target grid stands in the source grid's cells.

    Both transforms are north-up: (x origin, x step, 0, y origin, 0, y step). ``to_source`` maps the target's
    (x, y) columns to the source's coordinates, where these are of another reference system.
    """
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("pixel_y"), (F.col("id") % width).cast("int").alias("pixel_x"))
    x, y = geo[0] + (F.col("pixel_x") + 0.5) * geo[1], geo[3] + (F.col("pixel_y") + 0.5) * geo[5]
    x, y = to_source(x, y) if to_source else (x, y)
    return cells.select("pixel_y", "pixel_x", ((y - source_geo[3]) / source_geo[5]).alias("sy"), ((x - source_geo[0]) / source_geo[1]).alias("sx"))


def warp_to(pixels: DataFrame, source_geo: list[float], geo: list[float], height: int, width: int, how: str = "nearest", to_source=None, to_target=None) -> DataFrame:
    """(pixel_y, pixel_x, value) on a target grid: nearest or bilinear at its cells' centres, or avg, max, min of the source cells whose centres fall into a target cell.

    Cells without a source value have no row. ``to_source`` and ``to_target`` map coordinates (x, y) between
    two reference systems; without them both grids are of one.
    """
    rows = pixels.where("value IS NOT NULL").select("pixel_y", "pixel_x", "value")
    if how in ("nearest", "bilinear"):
        at = target_positions(height, width, geo, source_geo, pixels.sparkSession, to_source)
        if how == "bilinear":
            return warp_bilinear(rows, at)
        at = at.select("pixel_y", "pixel_x", F.floor("sy").cast("int").alias("y"), F.floor("sx").cast("int").alias("x"))
        return at.join(rows.select(F.col("pixel_y").alias("y"), F.col("pixel_x").alias("x"), "value"), ["y", "x"]).select("pixel_y", "pixel_x", "value")
    x, y = source_geo[0] + (F.col("pixel_x") + 0.5) * source_geo[1], source_geo[3] + (F.col("pixel_y") + 0.5) * source_geo[5]
    x, y = to_target(x, y) if to_target else (x, y)
    rows = rows.select(F.floor((y - geo[3]) / geo[5]).cast("int").alias("pixel_y"), F.floor((x - geo[0]) / geo[1]).cast("int").alias("pixel_x"), "value")
    inside = F.col("pixel_y").between(0, height - 1) & F.col("pixel_x").between(0, width - 1)
    return rows.where(inside).groupBy("pixel_y", "pixel_x").agg({"avg": F.avg, "max": F.max, "min": F.min}[how]("value").alias("value"))


def cut_by(pixels: DataFrame, polygon: list[tuple[float, float]], geo: list[float]) -> DataFrame:
    """Cells whose centre is within a polygon's ring of (x, y) corners, by crossings of a ray; the ring closes by itself.

    A cutline has few corners; they are literals of the plan, and no cell is shuffled.
    """
    x, y = geo[0] + (F.col("pixel_x") + 0.5) * geo[1], geo[3] + (F.col("pixel_y") + 0.5) * geo[5]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + (spans & (x < ax + (y - ay) / (by - ay) * (bx - ax))).cast("int")
    return pixels.where(crossings % 2 == 1)
