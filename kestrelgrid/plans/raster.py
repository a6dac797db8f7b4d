"""Raster queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import pixel_index
from ..functions.pixels import coverage_status, quality, vegetation_index
from ..operators import stack, stats, stencil
from .mapping import MOSAIC, PIXELS, mosaics, pixel_series, read, round9
from .registry import query

#: A year of the driver's tables has twelve months, so twelve dates are a full year here.
EXPECTED = 12

_YEARS = MOSAIC + f""",
dates AS (SELECT DISTINCT year, date_str, month FROM mo),
ye AS (SELECT year, count(*) AS total_valid_mosaics, count(*) FILTER (month BETWEEN 6 AND 9) AS monsoon_dates, count(*) FILTER (month BETWEEN 2 AND 5) AS dry_dates, count(*) FILTER (month IN (10, 11, 12, 1)) AS winter_dates,
  count(*) / {EXPECTED}.0::DOUBLE AS completeness_ratio, (count(*) / {EXPECTED}.0::DOUBLE < 0.5)::INT AS weak_year_flag FROM dates GROUP BY year HAVING count(*) >= 3)"""

_STACK = _YEARS + """,
a AS (SELECT year, pixel_y, pixel_x, avg(value) AS mean0, stddev_pop(value) AS std0, min(value) AS min0, max(value) AS max0, count(value) AS n0,
  avg(value) FILTER (month BETWEEN 6 AND 9) AS mo0, avg(value) FILTER (month BETWEEN 2 AND 5) AS dr0, avg(value) FILTER (month IN (10, 11, 12, 1)) AS wi0,
  stddev_pop(value) FILTER (month BETWEEN 6 AND 9) AS mos0, stddev_pop(value) FILTER (month BETWEEN 2 AND 5) AS drs0 FROM mo GROUP BY ALL),
b AS (SELECT a.*, weak_year_flag, coalesce(mean0 < 0, true) AS bad FROM a JOIN ye USING (year)),
c AS (SELECT *, weak_year_flag = 1 OR coalesce(CASE WHEN NOT bad THEN n0 END < 3, false) AS hidden FROM b),
st AS (SELECT year, pixel_y, pixel_x, CASE WHEN NOT hidden AND NOT bad THEN mean0 END AS ndvi_mean, CASE WHEN NOT hidden THEN std0 END AS ndvi_std, CASE WHEN NOT hidden THEN min0 END AS ndvi_min,
  CASE WHEN NOT hidden THEN max0 END AS ndvi_max, CASE WHEN NOT hidden THEN max0 - min0 END AS ndvi_temporal_range, CASE WHEN NOT hidden AND NOT bad AND mean0 > 0.05 AND std0 / mean0 <= 3 THEN std0 / mean0 END AS ndvi_cv,
  CASE WHEN NOT hidden AND NOT bad THEN n0 END AS ndvi_valid_count, CASE WHEN NOT hidden AND NOT bad THEN mo0 END AS ndvi_monsoon_mean, CASE WHEN NOT hidden AND NOT bad THEN dr0 END AS ndvi_dry_mean,
  CASE WHEN NOT hidden AND NOT bad THEN wi0 END AS ndvi_winter_mean, CASE WHEN NOT hidden AND NOT bad THEN mos0 END AS ndvi_monsoon_std, CASE WHEN NOT hidden AND NOT bad THEN drs0 END AS ndvi_dry_std,
  CASE WHEN NOT hidden AND NOT bad THEN mo0 - dr0 END AS ndvi_monsoon_minus_dry, CASE WHEN NOT hidden AND NOT bad THEN greatest(mo0, dr0, wi0) - least(mo0, dr0, wi0) END AS ndvi_peak_seasonality FROM c)"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 9) + 0 AS {n}" for n in names)


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    return stack.yearly_stack(mosaics(spark, d), EXPECTED)


@query("qa_mask", f"WITH {PIXELS} SELECT qa & 3 AS quality, count(*) AS pixels, count(*) FILTER ((qa & 3) <> 3 AND ndvi_raw::DOUBLE * 0.0001::DOUBLE >= -0.2) AS usable, round(avg(ndvi_raw) FILTER ((qa & 3) <> 3 AND ndvi_raw::DOUBLE * 0.0001::DOUBLE >= -0.2) * 0.0001, 9) AS mean_index FROM px GROUP BY 1")
def qa_mask(spark: SparkSession, d: str) -> DataFrame:
    px = pixel_series(spark, d).withColumn("index", vegetation_index(F.col("ndvi_raw"), F.col("qa")))
    out = px.groupBy(quality(F.col("qa")).alias("quality")).agg(F.count(F.lit(1)).alias("pixels"), F.count("index").alias("usable"), (F.avg(F.when(F.col("index").isNotNull(), F.col("ndvi_raw"))) * 0.0001).alias("mean_index"))
    return round9(out)


_YEARLY = ("ndvi_mean", "ndvi_std", "ndvi_min", "ndvi_max", "ndvi_temporal_range")
_SEASONAL = ("ndvi_monsoon_mean", "ndvi_dry_mean", "ndvi_winter_mean", "ndvi_monsoon_std", "ndvi_dry_std", "ndvi_monsoon_minus_dry", "ndvi_peak_seasonality")


@query("stack_yearly_stats", f"WITH {_STACK} SELECT year, pixel_y, pixel_x, ndvi_valid_count, {_r(*_YEARLY)} FROM st")
def stack_yearly_stats(spark: SparkSession, d: str) -> DataFrame:
    return round9(_yearly(spark, d).select("year", "pixel_y", "pixel_x", "ndvi_valid_count", *_YEARLY))


@query("stack_seasonal", f"WITH {_STACK} SELECT year, pixel_y, pixel_x, {_r(*_SEASONAL)} FROM st")
def stack_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return round9(_yearly(spark, d).select("year", "pixel_y", "pixel_x", *_SEASONAL))


@query("stable_cv", f"WITH {_STACK} SELECT year, pixel_y, pixel_x, {_r('ndvi_cv')} FROM st")
def stable_cv(spark: SparkSession, d: str) -> DataFrame:
    return round9(_yearly(spark, d).select("year", "pixel_y", "pixel_x", "ndvi_cv"))


@query("season_completeness", f"WITH {_YEARS} SELECT year, total_valid_mosaics, monsoon_dates, dry_dates, winter_dates, " + ", ".join(f"round({s}_dates / total_valid_mosaics::DOUBLE, 9) AS {s}_ratio" for s in ("monsoon", "dry", "winter")) + ", round(completeness_ratio, 9) AS completeness_ratio, weak_year_flag FROM ye")
def season_completeness(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.year_completeness(mosaics(spark, d), EXPECTED))


@query("yearly_summary", f"WITH {_STACK} SELECT year, any_value(round(completeness_ratio, 9)) AS completeness_ratio, any_value(total_valid_mosaics) AS total_valid_mosaics, any_value(ye.weak_year_flag) AS weak_year_flag, round(avg(ndvi_mean), 9) AS mean_ndvi, round(avg(ndvi_cv), 9) AS mean_cv, round(avg(ndvi_peak_seasonality), 9) AS mean_peak_seasonality FROM st JOIN ye USING (year) GROUP BY year")
def yearly_summary(spark: SparkSession, d: str) -> DataFrame:
    m = mosaics(spark, d)
    return round9(stack.yearly_summary(m, stack.yearly_stack(m, EXPECTED), EXPECTED))


_LADDER = "CASE WHEN 100.0 - n / t * 100 >= 99.9 AND n < 500 THEN 'EXPECTED_EMPTY' WHEN n = 0 THEN 'FAIL' WHEN n < 10000 THEN 'SKIPPED_VERY_LOW' WHEN n < 50000 THEN 'LOW_COVERAGE_USED' WHEN n < 100000 THEN 'MEDIUM_COVERAGE' ELSE 'HIGH_COVERAGE' END"


@query("coverage_status", f"WITH {PIXELS}, c AS (SELECT date_str, count(*) FILTER ((qa & 3) <> 3) * 120 AS n, 1200000.0::DOUBLE AS t FROM px GROUP BY 1) SELECT date_str, n AS valid_pixels, {_LADDER} AS status FROM c")
def coverage_status_query(spark: SparkSession, d: str) -> DataFrame:
    n = pixel_series(spark, d).groupBy("date_str").agg((F.count_if(quality(F.col("qa")) != 3) * 120).alias("valid_pixels"))
    return n.withColumn("status", coverage_status(F.col("valid_pixels"), F.lit(1_200_000.0)))


@query("mosaic_audit", f"WITH {MOSAIC} SELECT date_str, year, month, count(value) AS valid_pixels, round(count(value) / 256.0, 9) AS valid_pixel_ratio, round(avg(value), 9) AS ndvi_mean, round(stddev_pop(value), 9) AS ndvi_std, round(100 - count(value) / 256.0 * 100, 9) AS nodata_pct FROM mo GROUP BY ALL")
def mosaic_audit(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.mosaic_audit(mosaics(spark, d), 256))


_WIDE_SQL = ", ".join(f"ndvi_{n}::DOUBLE AS ndvi_{n}" for n in ("mean", "std", "cv", "monsoon_mean", "peak_seasonality"))
_LAYERS = ("ndvi_mean", "ndvi_std", "ndvi_cv", "ndvi_monsoon_mean", "ndvi_peak_seasonality")
_LONG = _STACK + ", lay AS (" + " UNION ALL ".join(f"SELECT year, pixel_y, pixel_x, '{n}' AS layer, {n}::DOUBLE AS value FROM st" for n in _LAYERS) + ")"


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return stack.to_layers(_yearly(spark, d), ["year", "pixel_y", "pixel_x"], list(_LAYERS))


@query("raster_stats", f"WITH {_LONG} SELECT year, layer, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, round(100 - count(value) / 256.0 * 100, 9) AS nodata_pct, count(value) AS valid_pixel_count, CASE WHEN regexp_matches(layer, 'monsoon|dry|winter|seasonality') THEN 'seasonal' ELSE 'aggregate' END AS report FROM lay GROUP BY ALL")
def raster_stats(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.layer_stats(_layers(spark, d), ["year", "layer"], 256).withColumn("report", stack.report_of(F.col("layer"))))


@query("layer_inventory", f"WITH {_LONG}, f AS (SELECT DISTINCT year, layer FROM lay) SELECT count(*) AS layers, count(DISTINCT year) * 5 AS expected_layers, CASE WHEN count(*) = count(DISTINCT year) * 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM f")
def layer_inventory(spark: SparkSession, d: str) -> DataFrame:
    return stack.layer_inventory(_layers(spark, d), len(_LAYERS))


@query("bounds_audit", f"WITH {_LONG} SELECT layer, count(*) FILTER (value < 0 OR value > 0.4567) AS fail_count FROM lay GROUP BY 1")
def bounds_audit(spark: SparkSession, d: str) -> DataFrame:
    return stack.bounds_audit(_layers(spark, d), 0.0, 0.4567)


@query("grid_stack_pivot", f"WITH {_LONG} SELECT year, pixel_y, pixel_x, " + ", ".join(f"round(max(value) FILTER (layer = '{n}'), 9) AS {n}" for n in _LAYERS) + " FROM lay GROUP BY ALL")
def grid_stack_pivot(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.to_wide(_layers(spark, d), ["year", "pixel_y", "pixel_x"], list(_LAYERS)))


@query("feature_describe", "SELECT feature, count(v) AS count, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, min(v) AS min, " + ", ".join(f"round(quantile_cont(v, {p}), 9) AS p{n}" for n, p in (("01", 0.01), ("50", 0.5), ("99", 0.99))) + ", max(v) AS max FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")) + ") GROUP BY 1")
def feature_describe(spark: SparkSession, d: str) -> DataFrame:
    return round9(stats.describe(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))


@query("hist2d", "SELECT trunc(l_quantity / 5)::INT AS pixel_y, trunc((l_extendedprice - 900) / 10000)::INT AS pixel_x, count(*) AS count FROM lineitem GROUP BY ALL")
def hist2d(spark: SparkSession, d: str) -> DataFrame:
    return stack.cell_histogram(read(spark, d, "lineitem"), pixel_index(F.col("l_quantity"), 0.0, 5.0), pixel_index(F.col("l_extendedprice"), 900.0, 10000.0))


H = W_ = 24
#: A small raster of all rows: the summed quantity of each (supplier, part) cell. Sums that divide by five are holes: cells (in ca) without a value (not in ra).
_FULL = f"ra AS (SELECT (l_suppkey % {H})::INT AS pixel_y, (l_partkey % {W_})::INT AS pixel_x, (sum(l_quantity::BIGINT) % 97)::DOUBLE AS value FROM lineitem GROUP BY ALL)"
_RASTER = _FULL.replace("ra AS", "al AS") + ", ca AS (SELECT pixel_y, pixel_x, CASE WHEN value % 5 <> 0 THEN value END AS value FROM al), ra AS (SELECT * FROM ca WHERE value IS NOT NULL)"


def _full(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select((F.col("l_suppkey") % H).cast("int").alias("pixel_y"), (F.col("l_partkey") % W_).cast("int").alias("pixel_x"), F.col("l_quantity").cast("long").alias("q"))
    return line.groupBy("pixel_y", "pixel_x").agg((F.sum("q") % 97).cast("double").alias("value"))


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).withColumn("value", F.when(F.col("value") % 5 != 0, F.col("value")))


_CELLS = f"ce AS (SELECT y::INT AS pixel_y, x::INT AS pixel_x FROM range({H}) a(y), range({W_}) b(x))"


@query("focal_mean_3x3", f"""WITH {_RASTER}, {_CELLS}, n AS (SELECT pixel_y, pixel_x,
  CASE WHEN pixel_y + dy < 0 THEN -1 - pixel_y - dy WHEN pixel_y + dy >= {H} THEN {2 * H - 1} - pixel_y - dy ELSE pixel_y + dy END AS sy,
  CASE WHEN pixel_x + dx < 0 THEN -1 - pixel_x - dx WHEN pixel_x + dx >= {W_} THEN {2 * W_ - 1} - pixel_x - dx ELSE pixel_x + dx END AS sx FROM ce, range(-1, 2) a(dy), range(-1, 2) b(dx))
SELECT n.pixel_y, n.pixel_x, round(avg(value), 9) AS focal_mean, round(stddev_pop(value), 9) AS focal_std FROM n JOIN ra ON ra.pixel_y = sy AND ra.pixel_x = sx GROUP BY ALL""")
def focal_mean_3x3(spark: SparkSession, d: str) -> DataFrame:
    return round9(stencil.focal(_raster(spark, d), H, W_))


_SIGMA = 1.5
_KERNEL = ", ".join(f"({k - 6}, {w!r}::DOUBLE)" for k, w in enumerate(stencil.gaussian_kernel(_SIGMA)))


def _mirror(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"


@query("gaussian_blur", f"""WITH {_RASTER}, {_CELLS}, k(o, w) AS (VALUES {_KERNEL}),
v AS (SELECT ce.pixel_y, ce.pixel_x, sum(w * value) AS value FROM ce, k JOIN ra ON ra.pixel_x = ce.pixel_x AND ra.pixel_y = {_mirror('ce.pixel_y + o', H)} GROUP BY ALL)
SELECT ce.pixel_y, ce.pixel_x, round(sum(w * v.value), 9) AS value FROM ce, k JOIN v ON v.pixel_y = ce.pixel_y AND v.pixel_x = {_mirror('ce.pixel_x + o', W_)} GROUP BY ALL""")
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return round9(stencil.gaussian_blur(_raster(spark, d), _SIGMA, H, W_))


@query("distance_transform", f"""WITH {_RASTER}, f AS (SELECT pixel_y AS fy, pixel_x AS fx FROM ra WHERE value >= 80)
SELECT pixel_y, pixel_x, round(min(sqrt((pixel_y - fy) ** 2 + (pixel_x - fx) ** 2)) * 0.5, 9) AS distance FROM ca, f GROUP BY ALL""")
def distance_transform(spark: SparkSession, d: str) -> DataFrame:
    return round9(stencil.distance_transform(_raster(spark, d).withColumn("feature", F.col("value") >= 80), scale=0.5))


@query("connected_components", f"""WITH RECURSIVE {_RASTER}, c AS (SELECT pixel_y AS y, pixel_x AS x, pixel_y * 1000 + pixel_x AS id FROM ra WHERE value >= 40),
reach(id, y, x) AS (SELECT id, y, x FROM c UNION SELECT reach.id, c.y, c.x FROM reach JOIN c ON abs(c.y - reach.y) + abs(c.x - reach.x) = 1),
root AS (SELECT y, x, min(id) AS r FROM reach GROUP BY y, x)
SELECT y AS pixel_y, x AS pixel_x, dense_rank() OVER (ORDER BY r)::INT AS component FROM root""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return stencil.label_components(_raster(spark, d).where("value >= 40"))


@query("terrain_slope", f"""WITH {_FULL}, w AS (SELECT c.pixel_y, c.pixel_x, count(*) AS n, sum(n.value * (n.pixel_x - c.pixel_x) * CASE WHEN n.pixel_y = c.pixel_y THEN 2 ELSE 1 END) AS gx,
  sum(n.value * (n.pixel_y - c.pixel_y) * CASE WHEN n.pixel_x = c.pixel_x THEN 2 ELSE 1 END) AS gy, sum((n.value - c.value) ** 2) AS sq FROM ra c JOIN ra n ON abs(n.pixel_y - c.pixel_y) <= 1 AND abs(n.pixel_x - c.pixel_x) <= 1 GROUP BY ALL)
SELECT pixel_y, pixel_x, round(degrees(atan(sqrt((gx / 240) ** 2 + (gy / 240) ** 2))), 9) AS slope, round(sqrt(sq), 9) AS roughness FROM w WHERE n = 9""")
def terrain_slope(spark: SparkSession, d: str) -> DataFrame:
    line = _full(spark, d)
    s = stencil.slope(line, 30.0, 30.0).withColumnRenamed("value", "slope")
    return round9(s.join(stencil.roughness(line).withColumnRenamed("value", "roughness"), ["pixel_y", "pixel_x"]))


@query("warp_resample", f"""WITH {_RASTER} SELECT (pixel_y // 3)::INT AS pixel_y, (pixel_x // 3)::INT AS pixel_x, round(avg(value), 9) AS mean_value, max(value) AS max_value,
  arg_min(value, (abs(pixel_y % 3 - 1) + abs(pixel_x % 3 - 1), pixel_y, pixel_x)) AS nearest_value FROM ra GROUP BY ALL""")
def warp_resample(spark: SparkSession, d: str) -> DataFrame:
    r = _raster(spark, d)
    out = stack.warp(r, 3, "avg").withColumnRenamed("value", "mean_value")
    for how in ("max", "nearest"):
        out = out.join(stack.warp(r, 3, how).withColumnRenamed("value", f"{how}_value"), ["pixel_y", "pixel_x"])
    return round9(out)
