"""Neighbourhood operators over pixel tables. A cell sends its value to the cells that need it, and these add up."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .components import connected_components
from .stats import prefix_sums, quantile_row


def reflect(index: Column, size: int) -> Column:
    """Index beyond an edge mirrored back, the edge cell repeated (d c b a | a b c d | d c b a)."""
    m = F.pmod(index, F.lit(2 * size))
    return F.when(m < size, m).otherwise(2 * size - 1 - m).cast("int")


def _neighbours(pixels: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """(pixel_y, pixel_x, dy, dx, value): each cell's neighbourhood, its own value too, edges reflected.

    A reflected edge needs a value more than once, so for each offset a cell finds the targets it serves:
    itself shifted back, and the mirrored ones. A target t takes source s at offset o if reflect(t + o) = s,
    that is t = s - o, -1 - s - o or 2 size - 1 - s - o.
    """

    def targets(at: str, offset: Column, size: int) -> Column:
        t = F.array(F.col(at) - offset, -1 - F.col(at) - offset, F.lit(2 * size - 1) - F.col(at) - offset)
        return F.filter(t, lambda k: (k >= 0) & (k < size))

    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    rows = pixels.withColumn("dy", offsets).withColumn("dx", offsets)
    rows = rows.withColumn("ty", F.explode(targets("pixel_y", F.col("dy"), height))).withColumn("tx", F.explode(targets("pixel_x", F.col("dx"), width)))
    return rows.select(F.col("ty").cast("int").alias("pixel_y"), F.col("tx").cast("int").alias("pixel_x"), "dy", "dx", "value")


def focal(pixels: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    """Mean and population deviation of each cell's square neighbourhood, missing values skipped, edges reflected.

    Also cells without a value of their own get one if a neighbour has any; ``pixels`` needs rows only where there is a value.
    """
    near = _neighbours(pixels.where("value IS NOT NULL").select("pixel_y", "pixel_x", "value"), reach, height, width)
    return near.groupBy("pixel_y", "pixel_x").agg(F.avg("value").alias("focal_mean"), F.stddev_pop("value").alias("focal_std"))


def _window3(pixels: DataFrame) -> DataFrame:
    """The 3 x 3 window of every cell that has all nine values, as columns w<row><column>."""
    offsets = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    rows = pixels.where("value IS NOT NULL").select("pixel_y", "pixel_x", "value").withColumn("dy", offsets).withColumn("dx", offsets)
    rows = rows.select((F.col("pixel_y") - F.col("dy")).alias("pixel_y"), (F.col("pixel_x") - F.col("dx")).alias("pixel_x"), "dy", "dx", "value")
    at = lambda dy, dx: F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("value"))).alias(f"w{dy + 1}{dx + 1}")
    out = rows.groupBy("pixel_y", "pixel_x").agg(*[at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return out.dropna()


def slope(elevation: DataFrame, cell_y: float, cell_x: float) -> DataFrame:
    """Slope in degrees by Horn's weights; cells without a full neighbourhood have none."""
    w = _window3(elevation)
    c = F.col
    dx = ((c("w02") + 2 * c("w12") + c("w22")) - (c("w00") + 2 * c("w10") + c("w20"))) / (8 * cell_x)
    dy = ((c("w20") + 2 * c("w21") + c("w22")) - (c("w00") + 2 * c("w01") + c("w02"))) / (8 * cell_y)
    return w.select("pixel_y", "pixel_x", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("value"))


def roughness(elevation: DataFrame, squares: bool = True) -> DataFrame:
    """Terrain ruggedness: the root of the summed squared differences to the eight neighbours, or else their mean absolute difference."""
    w = _window3(elevation)
    diffs = [F.col(f"w{y}{x}") - F.col("w11") for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    value = F.sqrt(sum(d * d for d in diffs)) if squares else sum(F.abs(d) for d in diffs) / 8
    return w.select("pixel_y", "pixel_x", value.alias("value"))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of offsets -r..r, r = int(truncate * sigma + 0.5), summing to one."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _blur_axis(pixels: DataFrame, sigma: float, axis: str, size: int) -> DataFrame:
    w = gaussian_kernel(sigma)
    r = len(w) // 2
    other = "pixel_x" if axis == "pixel_y" else "pixel_y"
    rows = pixels.select(other, axis, "value", F.posexplode(F.array(*[F.lit(x) for x in w])).alias("k", "w"))
    # every target whose reflected index meets this cell: the offset's sign makes no difference to a symmetric kernel
    o = F.col("k") - r
    spans = -(-r // size) + 1
    images = F.array(*[x for m in range(-spans, spans + 1) for x in (F.col(axis) + 2 * size * m, F.lit(-1) - F.col(axis) + 2 * size * m)])
    rows = rows.withColumn("t", F.explode(F.filter(F.transform(images, lambda i: i - o), lambda t: (t >= 0) & (t < size))))
    return rows.groupBy(other, F.col("t").cast("int").alias(axis)).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def gaussian_blur(pixels: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Separable Gaussian blur with reflected edges; absent cells count as zero. Two aggregates, one a direction."""
    rows = pixels.where("value IS NOT NULL AND value <> 0").select("pixel_y", "pixel_x", F.col("value").cast("double").alias("value"))
    return _blur_axis(_blur_axis(rows, sigma, "pixel_y", height), sigma, "pixel_x", width).select("pixel_y", "pixel_x", "value")


def observer_kernel_density(points: DataFrame, land: DataFrame, height: int, width: int, resolution: float, bandwidth_km: float = 10.0, km_per_degree: float = 111.0) -> DataFrame:
    """Observer effort on land: counts of (pixel_y, pixel_x) blurred at the bandwidth, masked to land, smoothed once more and masked again, scaled by the 99th percentile of the land cells and cut to [0, 1] (left as it is if that is zero)."""
    fine, top = _raw_density(points, land, height, width, resolution, bandwidth_km, km_per_degree)
    return fine.crossJoin(F.broadcast(top)).select("pixel_y", "pixel_x", F.when(F.col("top") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / F.col("top")))).otherwise(F.col("value")).alias("value"))


def raw_density_percentile(points: DataFrame, land: DataFrame, height: int, width: int, resolution: float, bandwidth_km: float = 10.0, km_per_degree: float = 111.0) -> DataFrame:
    """One row, raw_max_percentile: the value that :func:`observer_kernel_density` scales to one."""
    return _raw_density(points, land, height, width, resolution, bandwidth_km, km_per_degree)[1].withColumnRenamed("top", "raw_max_percentile")


def _raw_density(points: DataFrame, land: DataFrame, height: int, width: int, resolution: float, bandwidth_km: float, km_per_degree: float) -> tuple[DataFrame, DataFrame]:
    counts = points.groupBy("pixel_y", "pixel_x").agg(F.count(F.lit(1)).cast("double").alias("value"))
    rough = gaussian_blur(counts, bandwidth_km / km_per_degree / resolution, height, width).join(land, ["pixel_y", "pixel_x"], "left_semi")
    fine = land.join(gaussian_blur(rough, 1.0, height, width), ["pixel_y", "pixel_x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    fine, _ = materialise(fine, "effort")
    return fine, quantile_row(fine, {"top": ("value", 0.99)})


def distance_transform(cells: DataFrame, feature: str = "feature", scale: float = 1.0) -> DataFrame:
    """Exact Euclidean distance of every cell of the table to the nearest cell where the boolean ``feature`` is true, times ``scale``.

    First each raster row with a feature gives the horizontal gap to its nearest one, at every column, by two
    running windows. Then a column alone decides: the least of gap^2 + (vertical distance)^2, found from the
    lower envelope of its parabolas in one pass. A task holds one column. Cells may be missing from the table.
    Null where it has no feature at all.
    """
    features = cells.where(F.col(feature)).select("pixel_y", "pixel_x").distinct()
    span = cells.agg(F.min("pixel_x").alias("from"), F.max("pixel_x").alias("to"))
    grid = features.select("pixel_y").distinct().crossJoin(F.broadcast(span)).select("pixel_y", F.explode(F.sequence("from", "to")).alias("pixel_x"))
    grid = grid.join(features.withColumn("here", F.col("pixel_x")), ["pixel_y", "pixel_x"], "left")
    row = W.partitionBy("pixel_y").orderBy("pixel_x")
    left = F.last("here", ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, W.currentRow))
    right = F.first("here", ignorenulls=True).over(row.rowsBetween(W.currentRow, W.unboundedFollowing))
    gaps = grid.select("pixel_y", "pixel_x", F.least(F.col("pixel_x") - left, right - F.col("pixel_x")).cast("double").alias("gap"))
    both = gaps.unionByName(cells.select("pixel_y", "pixel_x", F.lit(None).cast("double").alias("gap")))

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf[pdf.gap.notna()].sort_values("pixel_y")
        wanted = pdf[pdf.gap.isna()]
        base, height, y = given.pixel_y.to_numpy(float), given.gap.to_numpy(float) ** 2, wanted.pixel_y.to_numpy(float)
        out = np.full(len(y), np.nan)
        if len(base):
            hull, cut = [0], [-np.inf]
            for k in range(1, len(base)):
                while True:
                    j = hull[-1]
                    at = (height[k] + base[k] ** 2 - height[j] - base[j] ** 2) / (2 * (base[k] - base[j]))
                    if at > cut[-1]:
                        break
                    hull.pop()
                    cut.pop()
                hull.append(k)
                cut.append(at)
            best = np.array(hull)[np.searchsorted(cut, y, side="right") - 1]
            out = np.sqrt(height[best] + (y - base[best]) ** 2)
        return pd.DataFrame({"pixel_y": wanted.pixel_y, "pixel_x": wanted.pixel_x, "distance": out})

    out = both.groupBy("pixel_x").applyInPandas(column, "pixel_y int, pixel_x int, distance double")
    return out.select("pixel_y", "pixel_x", (F.nanvl("distance", F.lit(None).cast("double")) * scale).alias("distance"))


def inland_water_distance(cells: DataFrame, km_per_cell: float, least: float = 50.0) -> DataFrame:
    """(pixel_y, pixel_x, distance): kilometres from every land cell to the nearest land cell with more water than ``least`` percent; cells off land have none.

    ``cells``: (pixel_y, pixel_x, water, land boolean).
    """
    water = F.col("land") & F.coalesce(F.col("water") > least, F.lit(False))
    near = distance_transform(cells.select("pixel_y", "pixel_x", water.alias("feature")), scale=km_per_cell)
    return cells.select("pixel_y", "pixel_x", "land").join(near, ["pixel_y", "pixel_x"]).select("pixel_y", "pixel_x", F.when(F.col("land"), F.col("distance")).alias("distance"))


def label_components(cells: DataFrame) -> DataFrame:
    """4-neighbour components of a set of (pixel_y, pixel_x) cells: (pixel_y, pixel_x, component), numbered from 1 in row order of their first cells.

    Horizontal runs are the nodes, so the graph has a node a run instead of one a cell; touching runs of
    neighbouring rows are its edges.
    """
    rows = W.partitionBy("pixel_y").orderBy("pixel_x")
    start = F.coalesce((F.col("pixel_x") - F.lag("pixel_x").over(rows)) != 1, F.lit(True))
    at = (F.col("pixel_y").cast("long") * F.lit(1 << 31) + F.col("pixel_x")).alias("cell")
    runs = cells.select("pixel_y", "pixel_x").distinct().withColumn("start", F.when(start, at))
    runs = runs.withColumn("run", F.last("start", ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("start")
    below = runs.select((F.col("pixel_y") + 1).alias("pixel_y"), "pixel_x", F.col("run").alias("b"))
    edges = runs.join(below, ["pixel_y", "pixel_x"]).select(F.col("run").alias("a"), "b").distinct()
    found = connected_components(edges)
    named = runs.join(found.withColumnRenamed("node", "run"), "run", "left").withColumn("component", F.coalesce("component", "run"))
    order = prefix_sums(named.select("component").distinct().withColumn("n", F.lit(1)), "component", ["n"]).select("component", F.col("n_upto").cast("int").alias("label"))
    return named.join(order, "component").select("pixel_y", "pixel_x", F.col("label").alias("component"))
