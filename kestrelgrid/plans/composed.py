"""Composed queries: effort surface, background pool, extraction, feature grid, report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import utm46
from ..operators import audit, background, extract, feature_grid, stack, stats, stencil
from ..operators.occurrence import draw_order, first_of
from .mapping import MOSAIC, NAMED, OCCURRENCES, PIXELS, mosaics, occurrences, read, round6, round9
from .occurrence import _named
from .registry import query
from .spatial import _THIN, _U

H, W_ = 20, 24
GEO = [92.0, 0.1, 0.0, 14.0, 0.0, -0.4]
_POINTS = f"ep AS (SELECT (o_custkey % {H})::INT AS pixel_y, (o_orderkey // 3 % {W_})::INT AS pixel_x FROM orders WHERE o_orderstatus = 'F'), la AS (SELECT y::INT AS pixel_y, x::INT AS pixel_x FROM range({H}) a(y), range({W_}) b(x) WHERE (y * 5 + x * 3) % 7 <> 0)"


def _effort(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pts = read(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % H).cast("int").alias("pixel_y"), (F.floor(F.col("o_orderkey") / 3) % W_).cast("int").alias("pixel_x"))
    y, x = F.floor(F.col("id") / W_).cast("int"), (F.col("id") % W_).cast("int")
    land = spark.range(H * W_).select(y.alias("pixel_y"), x.alias("pixel_x")).where((F.col("pixel_y") * 5 + F.col("pixel_x") * 3) % 7 != 0)
    return pts, land


def _mirror(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"


def _blur(name: str, src: str, sigma: float) -> str:
    w = stencil.gaussian_kernel(sigma)
    r = len(w) // 2
    k = ", ".join(f"({i - r}, {x!r}::DOUBLE)" for i, x in enumerate(w))
    return f"""{name}k(o, w) AS (VALUES {k}),
{name}v AS (SELECT ce.pixel_y, ce.pixel_x, sum(w * s.value) AS value FROM ce, {name}k JOIN {src} s ON s.pixel_x = ce.pixel_x AND s.pixel_y = {_mirror('ce.pixel_y + o', H)} GROUP BY ALL),
{name} AS (SELECT ce.pixel_y, ce.pixel_x, sum(w * v.value) AS value FROM ce, {name}k JOIN {name}v v ON v.pixel_y = ce.pixel_y AND v.pixel_x = {_mirror('ce.pixel_x + o', W_)} GROUP BY ALL)"""


_SIGMA = 20.0 / 111.0 / 0.1
_KDE = f"""{_POINTS}, ce AS (SELECT y::INT AS pixel_y, x::INT AS pixel_x FROM range({H}) a(y), range({W_}) b(x)), hi AS (SELECT pixel_y, pixel_x, count(*)::DOUBLE AS value FROM ep GROUP BY ALL),
{_blur('r1', 'hi', _SIGMA)}, m1 AS (SELECT r1.* FROM r1 SEMI JOIN la USING (pixel_y, pixel_x)), {_blur('r2', 'm1', 1.0)},
m2 AS (SELECT pixel_y, pixel_x, coalesce(value, 0) AS value FROM la LEFT JOIN r2 USING (pixel_y, pixel_x)), kde AS (SELECT pixel_y, pixel_x, greatest(0, least(1, value / (SELECT quantile_cont(value, 0.99) FROM m2))) AS value FROM m2)"""


def _kde(spark: SparkSession, d: str) -> DataFrame:
    pts, land = _effort(spark, d)
    return stencil.observer_kernel_density(pts, land, H, W_, 0.1, bandwidth_km=20.0)


@query("observer_kde", f"WITH {_KDE} SELECT pixel_y, pixel_x, round(value, 6) AS value FROM kde")
def observer_kde(spark: SparkSession, d: str) -> DataFrame:
    return round6(_kde(spark, d))


_NIC = "14.0 - pixel_y * 0.4::DOUBLE <= 10"


@query("effort_audit", f"""WITH {_KDE}, e AS (SELECT * FROM kde WHERE value > 0), n AS (SELECT count(*) AS land FROM la),
a AS (SELECT -sum(value * ln(value + 1e-12)) AS entropy_shannon, avg((value > 0.9)::INT) * 100 AS hotspot_density_pct_top1, count(*) * 100.0::DOUBLE / {H * W_} AS nonzero_pixel_pct, any_value(land) * 100.0::DOUBLE / {H * W_} AS land_coverage_pct,
  (count(*) FILTER (NOT ({_NIC})))::DOUBLE AS andaman_nonzero_pixels, (count(*) FILTER ({_NIC}))::DOUBLE AS nicobar_nonzero_pixels, sum(value) FILTER ({_NIC}) AS nicobar_effort_sum FROM e, n)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT a ON * INTO NAME metric VALUE value)""")
def effort_audit(spark: SparkSession, d: str) -> DataFrame:
    _, land = _effort(spark, d)
    return round6(background.effort_audit(_kde(spark, d), land.count(), H * W_, GEO))


def _utm(name: str, src: str) -> str:
    """CTEs that add x and y in metres to (longitude, latitude)."""
    return f"""{name}a AS (SELECT *, radians(latitude) AS phi, radians(longitude - 93.0::DOUBLE) AS lam, 0.0016792203863836474::DOUBLE AS n FROM {src}), {name}b AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM {name}a),
{name}c AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM {name}b),
{name}d AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM {name}c),
{name} AS (SELECT * EXCLUDE (phi, lam, n, e, t, xi, eta, r, a1, a2, a3), 500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
  0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM {name}d)"""


_POOL = f"""WITH RECURSIVE {NAMED}, {_KDE},
reach(id, y, x) AS (SELECT pixel_y * 1000 + pixel_x, pixel_y, pixel_x FROM la UNION SELECT reach.id, la.pixel_y, la.pixel_x FROM reach JOIN la ON abs(la.pixel_y - reach.y) + abs(la.pixel_x - reach.x) = 1),
root AS (SELECT y, x, min(id) AS cl FROM reach GROUP BY y, x),
cand AS (SELECT cl, value AS weight, 92.0 + (pixel_x + 0.5) * 0.1::DOUBLE AS longitude, 14.0 - (pixel_y + 0.5) * 0.4::DOUBLE AS latitude, pixel_y::BIGINT * 2147483648 + pixel_x AS id FROM kde JOIN root ON y = pixel_y AND x = pixel_x WHERE value > 0),
strat AS (SELECT cl, CASE WHEN avg(latitude) > 10 THEN 'Andaman' ELSE 'Nicobar' END AS stratum FROM cand GROUP BY cl), cs AS (SELECT cand.*, stratum FROM cand JOIN strat USING (cl)),
pr AS (SELECT occurrence_id AS id, longitude, latitude, year, month FROM named QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY longitude, latitude, year, month) = 1), {_utm('cc', 'cs')}, {_utm('pp', 'pr')}, pl AS (SELECT DISTINCT x, y FROM pp),
far AS (SELECT * FROM cc WHERE NOT EXISTS (SELECT 1 FROM pl WHERE (cc.x - pl.x) ** 2 + (cc.y - pl.y) ** 2 <= 1000000)),
drawn AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY -ln({_U.format(key='id')}) / greatest(sqrt(weight), 1e-12), id) <= CASE stratum WHEN 'Andaman' THEN 105 ELSE 45 END),
{_THIN.format(u=_U.format(key='id'), src='drawn', r='500.0::DOUBLE')}, th AS (SELECT unnest(kept) AS k FROM visit WHERE n = (SELECT max(n) FROM o)), po AS (SELECT drawn.* FROM drawn JOIN th ON drawn.id = th.k.id),
nb AS (SELECT po.id, pp.year, pp.month, row_number() OVER (PARTITION BY po.id ORDER BY sqrt((po.x - pp.x) ** 2 + (po.y - pp.y) ** 2), pp.id) AS rank FROM po, pp QUALIFY rank <= 25),
ch AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, {_U.format(key='id')} AS u FROM nb)
SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, year, month, 0 AS target, stratum, round(weight, 6) AS weight, id AS cell FROM po JOIN ch USING (id) WHERE rank = floor(u * n) + 1"""


@query("background_pool", _POOL)
def background_pool(spark: SparkSession, d: str) -> DataFrame:
    _, land = _effort(spark, d)
    presence = _named(spark, d).select(F.col("occurrence_id").alias("id"), "longitude", "latitude", "year", "month")
    presence = first_of(presence, ["id"], ["longitude", "latitude", "year", "month"])  # ids name presences here
    return round6(background.background_pool(_kde(spark, d), land, presence, GEO, goal=150))


@query("utm_project", f"""WITH {OCCURRENCES}, p AS (SELECT DISTINCT latitude, longitude, radians(latitude) AS phi, radians(longitude - 93.0::DOUBLE) AS lam, 0.0016792203863836474::DOUBLE AS n FROM occ WHERE latitude > 0 AND longitude > 0),
t AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM p), u AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM t),
v AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM u)
SELECT latitude, longitude, round(500000 + 0.9996 * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
  round(0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM v""")
def utm_project(spark: SparkSession, d: str) -> DataFrame:
    places = occurrences(spark, d).where("latitude > 0 AND longitude > 0").select("latitude", "longitude").distinct()
    east, north = utm46(F.col("longitude"), F.col("latitude"))
    return places.select("latitude", "longitude", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


_EX_LAYERS = ("ndvi_mean", "ndvi_std", "ndvi_cv", "ndvi_temporal_range", "ndvi_valid_count")
_EX = MOSAIC + """,
ly AS (SELECT year, pixel_y, pixel_x, avg(value) * 2 AS ndvi_mean, stddev_pop(value) AS ndvi_std, CASE WHEN pixel_x <> 3 THEN 1.0 END AS ndvi_cv, max(value) - min(value) AS ndvi_temporal_range, count(value)::DOUBLE * 3 AS ndvi_valid_count FROM mo WHERE pixel_x <> 5 GROUP BY ALL),
pt AS (SELECT o_orderkey AS original_row_id, (o_orderkey % 2)::INT AS target, 's' || (o_custkey % 3)::VARCHAR AS species_name, year(o_orderdate)::INT AS year, (o_custkey % 18)::INT AS pixel_y, (o_orderkey % 18)::INT AS pixel_x, o_custkey % 18 < 16 AND o_orderkey % 18 < 16 AS on_grid, (o_custkey % 5)::DOUBLE AS observer_weight FROM orders),
j AS (SELECT pt.*, ndvi_mean, ndvi_std, ndvi_cv, ndvi_temporal_range, ndvi_valid_count FROM pt SEMI JOIN (SELECT DISTINCT year FROM ly) USING (year) LEFT JOIN ly USING (year, pixel_y, pixel_x)),
ex AS (SELECT *, coalesce(ndvi_mean BETWEEN 0 AND 1, false)::INT + coalesce(ndvi_std BETWEEN 0 AND 1, false)::INT + coalesce(ndvi_cv BETWEEN 0 AND 5, false)::INT + coalesce(ndvi_temporal_range BETWEEN 0 AND 1, false)::INT AS ok,
  array_to_string(list_sort(list_distinct(list_filter([CASE WHEN NOT on_grid THEN 'OUT_OF_BOUNDS' END,
    """ + ", ".join(f"CASE WHEN on_grid AND {n} IS NULL THEN 'NODATA' WHEN on_grid AND NOT {n} BETWEEN {a} AND {b} THEN 'INVALID_RANGE' END" for n, (a, b) in extract.RANGES.items()) + """], lambda x: x IS NOT NULL))), '|') AS why FROM j),
er AS (SELECT *, CASE WHEN on_grid AND ok >= 3 THEN NULL ELSE why END AS reason FROM ex)"""


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    s = mosaics(spark, d).where("pixel_x <> 5").groupBy("year", "pixel_y", "pixel_x")
    v = F.col("value")
    wide = s.agg((F.avg(v) * 2).alias("ndvi_mean"), F.stddev_pop(v).alias("ndvi_std"), F.when(F.col("pixel_x") != 3, 1.0).alias("ndvi_cv"), (F.max(v) - F.min(v)).alias("ndvi_temporal_range"), (F.count(v).cast("double") * 3).alias("ndvi_valid_count"))
    layers = stack.to_layers(wide, ["year", "pixel_y", "pixel_x"], list(_EX_LAYERS))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pts = read(spark, d, "orders").select(o.alias("original_row_id"), (o % 2).cast("int").alias("target"), F.concat(F.lit("s"), (c % 3).cast("string")).alias("species_name"), F.year("o_orderdate").alias("year"), (c % 18).cast("int").alias("pixel_y"), (o % 18).cast("int").alias("pixel_x"), ((c % 18 < 16) & (o % 18 < 16)).alias("on_grid"), (c % 5).cast("double").alias("observer_weight"))
    return extract.extract(pts, layers)


@query("dynamic_extract", f"WITH {_EX} SELECT original_row_id, year, pixel_y, pixel_x, reason, round(CASE WHEN ndvi_mean BETWEEN 0 AND 1 THEN ndvi_mean END, 9) AS ndvi_mean, CASE WHEN ndvi_valid_count <= 23 THEN ndvi_valid_count END AS ndvi_valid_count FROM er")
def dynamic_extract(spark: SparkSession, d: str) -> DataFrame:
    return round9(_extracted(spark, d).select("original_row_id", "year", "pixel_y", "pixel_x", "reason", "ndvi_mean", "ndvi_valid_count"))


@query("failure_breakdown", f"WITH {_EX} SELECT target, reason, count(*) AS count FROM er WHERE reason IS NOT NULL GROUP BY ALL")
def failure_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return extract.failure_breakdown(_extracted(spark, d))


@query("temporal_health", f"WITH {_EX} SELECT year, count(*) AS input, count(*) FILTER (reason IS NULL) AS retained, round(count(*) FILTER (reason IS NULL) * 100.0::DOUBLE / count(*), 9) AS retained_pct FROM er GROUP BY year")
def temporal_health(spark: SparkSession, d: str) -> DataFrame:
    return round9(extract.yearly_health(_extracted(spark, d)))


@query("matrix_collapse", f"""WITH {_EX}, k AS (SELECT * FROM er WHERE reason IS NULL), g AS (SELECT pixel_x, pixel_y, year, target, species_name, arg_max(original_row_id, (observer_weight, -original_row_id)) AS original_row_id, first(CASE WHEN ndvi_valid_count <= 23 THEN ndvi_valid_count END ORDER BY observer_weight DESC, original_row_id) FILTER (ndvi_valid_count <= 23) AS v FROM k GROUP BY ALL), m AS (SELECT max(v) AS m FROM g)
SELECT pixel_x, pixel_y, year, target, species_name, original_row_id, CASE WHEN v <= m * 0.5 THEN 'LOW' WHEN v <= m * 0.8 THEN 'MEDIUM' WHEN v IS NOT NULL THEN 'HIGH' END AS confidence_flag FROM g, m""")
def matrix_collapse(spark: SparkSession, d: str) -> DataFrame:
    return extract.collapse(_extracted(spark, d), ["original_row_id"]).select("pixel_x", "pixel_y", "year", "target", "species_name", "original_row_id", "confidence_flag")


_FG = PIXELS + f""",
la AS (SELECT pixel_y, pixel_x, avg(ndvi_raw) - 1500 AS value FROM px GROUP BY ALL),
w AS (SELECT pixel_y, pixel_x, avg(ndvi_raw) * 0.0001 AS ndvi_mean, CASE WHEN pixel_x <> 4 THEN min(ndvi_raw) / 10.0::DOUBLE END AS static_elevation, (min(ndvi_raw) + 1000)::DOUBLE AS static_slope FROM px GROUP BY pixel_y, pixel_x)
"""


@query("feature_grid", f"WITH {_FG} SELECT pixel_y, pixel_x, round(92.0 + (pixel_x + 0.5) * 0.1::DOUBLE, 9) AS longitude, round(14.0 - (pixel_y + 0.5) * 0.4::DOUBLE, 9) AS latitude, round(ndvi_mean, 9) AS ndvi_mean, CASE WHEN static_elevation IS NOT NULL THEN greatest(static_elevation, -100) END AS static_elevation, greatest(static_slope, 0) AS static_slope, 2024 AS year, 6 AS month FROM la JOIN w USING (pixel_y, pixel_x) WHERE value > -1")
def feature_grid_query(spark: SparkSession, d: str) -> DataFrame:
    from .mapping import pixel_series

    px = pixel_series(spark, d).groupBy("pixel_y", "pixel_x")
    raw = F.col("ndvi_raw")
    wide = px.agg((F.avg(raw) * 0.0001).alias("ndvi_mean"), F.when(F.col("pixel_x") != 4, F.min(raw) / 10.0).alias("static_elevation"), (F.min(raw) + 1000).cast("double").alias("static_slope"))
    names = ("ndvi_mean", "static_elevation", "static_slope")
    mask = px.agg((F.avg(raw) - 1500).alias("value"))
    return round9(feature_grid.feature_grid(mask, stack.to_layers(wide, ["pixel_y", "pixel_x"], list(names)), GEO, names))


@query("mosaic_diagnostics", f"WITH {MOSAIC}, a AS (SELECT date_str, count(value) * 200 AS n, avg(value) AS v FROM mo GROUP BY 1), s AS (SELECT *, CASE WHEN n < 10000 THEN 'SKIPPED_VERY_LOW' WHEN n < 50000 THEN 'LOW_COVERAGE_USED' ELSE 'MEDIUM_COVERAGE' END AS status FROM a) SELECT status, count(*) AS mosaics, round(avg(v), 9) AS mean_ndvi FROM s GROUP BY 1")
def mosaic_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.pixels import coverage_status

    a = mosaics(spark, d).groupBy("date_str").agg((F.count("value") * 200).alias("n"), F.avg("value").alias("ndvi_mean"))
    return round9(audit.diagnostics(a.withColumn("status", coverage_status(F.col("n"), F.lit(60_000.0)))))


@query("top_species", f"WITH {NAMED} SELECT species_name, count(*) AS records FROM named GROUP BY 1 ORDER BY records DESC, species_name LIMIT 10")
def top_species(spark: SparkSession, d: str) -> DataFrame:
    counts = _named(spark, d).groupBy("species_name").agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), "species_name").limit(10)  # the report is a top ten


@query("yearly_richness", f"WITH {NAMED} SELECT year, count(*) AS records, count(DISTINCT species_name) AS richness FROM named GROUP BY 1")
def yearly_richness(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("species_name").alias("richness"))


@query("observer_histogram", f"WITH {OCCURRENCES}, c AS (SELECT count(*) AS n FROM occ WHERE observer_name IS NOT NULL GROUP BY observer_name) SELECT (n // 10)::BIGINT AS bin, count(*) AS observers FROM c GROUP BY 1")
def observer_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = occurrences(spark, d).where("observer_name IS NOT NULL").groupBy("observer_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(F.floor(F.col("n") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("observers"))


@query("random_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', o_orderkey::VARCHAR, '42')))::INT AS place FROM orders")
def random_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = read(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(W.partitionBy("o_orderstatus").orderBy(draw_order(["o_orderkey"]))).alias("place"))


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS original_row_id FROM orders")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    return stats.row_ids(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("display_roc", "SELECT k / 99.0::DOUBLE AS fpr, round(pow(k / 99.0::DOUBLE, 0.25 / 0.75), 9) AS tpr FROM range(0, 100) r(k)")
def display_roc(spark: SparkSession, d: str) -> DataFrame:
    return stats.display_roc(spark, 0.75).select("fpr", F.round("tpr", 9).alias("tpr"))
