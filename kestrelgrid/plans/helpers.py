"""Queries of the small operators: expressions, gates, audits, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import impact_direction, month_name
from ..functions.pixels import USABLE, guarded_divide, normalised_difference, to_null, token_date
from ..operators import audit, background, extract, feature_grid, fuse, spatial, stack, stats, stencil, training
from ..operators import occurrence as occ
from .composed import _KDE, _NIC, GEO, _effort, _kde
from .composed import H as KH
from .composed import W_ as KW
from .ecosystem import _SUMMARY, _summary
from .mapping import CUBE, FILLED, OCCURRENCES, cube, occurrences, read, round6, round9
from .raster import _RASTER, H, W_, _raster
from .registry import query
from .spatial import _DYN, _matrices


@query("index_formula", "SELECT l_orderkey, l_linenumber, round((l_quantity - l_linenumber * 10) / nullif(l_quantity + l_linenumber * 10, 0), 9) + 0 AS ndvi, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 9) ELSE 0 END AS ratio, CASE WHEN l_quantity NOT IN (7, 8) THEN l_quantity END AS valid FROM lineitem")
def index_formula(spark: SparkSession, d: str) -> DataFrame:
    line, red = read(spark, d, "lineitem"), F.col("l_linenumber") * 10.0
    nan = F.when(F.col("l_quantity") == 8, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    out = line.select("l_orderkey", "l_linenumber", (normalised_difference(F.col("l_quantity"), red)).alias("ndvi"), guarded_divide(F.col("l_tax"), F.col("l_discount"), F.col("l_discount") > 0).alias("ratio"), to_null(nan, 7.0).alias("valid"))
    return round9(out).withColumn("ndvi", F.col("ndvi") + 0.0)


@query("date_tokens", "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders")
def date_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = F.concat(F.lit("A"), F.date_format("o_orderdate", "yyyyDDD"))
    return read(spark, d, "orders").select("o_orderkey", token_date(token).alias("at")).select("o_orderkey", F.year("at").alias("year"), F.month("at").alias("month"))


@query("date_parsing", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Dates in three forms and some that are none."""
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy")).when(k == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("31 Nevuary")
    return read(spark, d, "orders").select("o_orderkey", F.date_format(occ.parse_date(text, ("dd/MM/yyyy",)), "yyyy-MM-dd").alias("day"))


@query("impact_labels", "SELECT p_partkey, CASE WHEN starts_with(CASE WHEN p_size % 2 = 0 THEN 'Negative (' || p_name ELSE p_name END, 'Negative') THEN -1 ELSE 1 END AS direction FROM part")
def impact_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Negative ("), "p_name")).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", impact_direction(label).alias("direction"))


@query("month_names", f"WITH {FILLED} SELECT month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] AS month_name, count(*) AS records FROM dated GROUP BY ALL")
def month_names(spark: SparkSession, d: str) -> DataFrame:
    rows = occ.fill_dates(occurrences(spark, d)).groupBy("month").agg(F.count(F.lit(1)).alias("records"))
    return rows.select("month", month_name(F.col("month")).alias("month_name"), "records")


@query("surface_limits", f"WITH {_DYN} SELECT target, original_row_id, line, CASE WHEN static_elevation < 50 THEN 1 ELSE 0 END AS is_lowland, CASE WHEN static_elevation > 150 THEN 1 ELSE 0 END AS is_highland FROM dyn JOIN lan USING (target, original_row_id)")
def surface_limits(spark: SparkSession, d: str) -> DataFrame:
    out = fuse.indicators(fuse.fuse(*_matrices(spark, d)), "static_elevation", "static_dist_water", "ndvi_valid_count", fuse.SURFACE_LIMITS)
    return out.select("target", "original_row_id", "line", "is_lowland", "is_highland")


@query("dense_columns", f"WITH {OCCURRENCES} SELECT occurrence_id, species_name, latitude, longitude, observation_date, observer_name, year, month FROM occ")
def dense_columns(spark: SparkSession, d: str) -> DataFrame:
    """A column that is mostly null goes; year and month are as sparse, but protected."""
    sparse = occurrences(spark, d).withColumn("rare", F.when(F.col("occurrence_id") % 3 == 0, "x"))
    return occ.drop_sparse(sparse)


@query("numeric_downcast", "SELECT l_orderkey::INT AS l_orderkey, round(l_quantity::FLOAT::DOUBLE, 6) AS l_quantity, (l_partkey + 5000000000)::BIGINT AS far, l_returnflag FROM lineitem")
def numeric_downcast(spark: SparkSession, d: str) -> DataFrame:
    out = stats.downcast(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_partkey") + 5_000_000_000).alias("far"), "l_returnflag"))
    kinds = dict(out.dtypes)
    if (kinds["l_orderkey"], kinds["l_quantity"], kinds["far"]) != ("int", "float", "bigint"):
        raise ValueError(f"not downcast: {kinds}")
    return out.withColumn("l_quantity", F.round(F.col("l_quantity").cast("double"), 6))


_LADDER = "CASE WHEN n = 0 THEN 'FAIL' WHEN n < 10000 THEN 'SKIPPED_VERY_LOW' WHEN n < 50000 THEN 'LOW_COVERAGE_USED' WHEN n < 100000 THEN 'MEDIUM_COVERAGE' ELSE 'HIGH_COVERAGE' END"


@query("usable_dates", f"WITH a AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE count(*) * 3000 END AS n FROM orders GROUP BY 1) SELECT o_custkey, {_LADDER} AS status FROM a WHERE {_LADDER} <> 'FAIL'")
def usable_dates(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.pixels import coverage_status

    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.col("o_custkey") % 5 == 0, F.lit(0).cast("long")).otherwise(F.count(F.lit(1)) * 3000).alias("n"))
    out = n.select("o_custkey", coverage_status(F.col("n"), F.lit(200_000.0)).alias("status"))
    return out.where(F.col("status").isin(*USABLE))


@query("grid_alignment", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 NOT IN (1, 2, 3)")
def grid_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Grids off in shape, code or transform go; a shift below the tolerance stays."""
    k = F.col("n_nationkey")
    geo = lambda shift: F.array(F.lit(92.0) + shift, *[F.lit(x) for x in (0.005, 0.0, 14.0, 0.0, -0.005)])
    grids = read(spark, d, "nation").select("n_nationkey", F.when(k % 5 == 2, "EPSG:32646").otherwise("EPSG:4326").alias("epsg"), geo(F.when(k % 5 == 3, 0.01).when(k % 5 == 4, 1e-12).otherwise(0.0)).alias("geo"), F.when(k % 5 == 1, 9).otherwise(10).alias("xs"), F.lit(20).alias("ys"))
    reference = spark.range(1).select(F.lit("EPSG:4326").alias("epsg"), geo(F.lit(0.0)).alias("geo"), F.lit(10).alias("xs"), F.lit(20).alias("ys"))
    return stack.aligned(grids, reference).select("n_nationkey")


@query("year_gate", "SELECT 'report' AS gate, year(o_orderdate)::INT AS year FROM orders GROUP BY ALL HAVING count(*) > 150 UNION ALL SELECT 'none', y::INT FROM range(2005, 2026) r(y)")
def year_gate(spark: SparkSession, d: str) -> DataFrame:
    report = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("valid_pixel_count"))
    kept = extract.quality_years_or_all(report, spark, 150).select(F.lit("report").alias("gate"), "year")
    return kept.unionByName(extract.quality_years_or_all(report.drop("valid_pixel_count"), spark).select(F.lit("none").alias("gate"), "year"))


@query("pixel_lookup", f"WITH {_RASTER} SELECT o_orderkey, value FROM orders JOIN ra ON pixel_y = o_custkey % 30 AND pixel_x = o_orderkey % 30")
def pixel_lookup(spark: SparkSession, d: str) -> DataFrame:
    pts = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).cast("int").alias("pixel_y"), (F.col("o_orderkey") % 30).cast("int").alias("pixel_x"))
    return spatial.pixel_lookup(pts, _raster(spark, d).where("value IS NOT NULL"), ["pixel_y", "pixel_x"]).select("o_orderkey", "value")


_ROWS = "tr AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN 'BACKGROUND' ELSE 's' || (l_suppkey % 4 * l_suppkey % 7)::VARCHAR END AS species_name, (l_linenumber <= 3)::INT AS target FROM lineitem)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n > 3, "BACKGROUND").otherwise(F.concat(F.lit("s"), (s % 4 * s % 7).cast("string"))).alias("species_name"), (n <= 3).cast("int").alias("target"))


@query("species_rows", f"WITH {_ROWS} SELECT l_orderkey, l_linenumber, target FROM tr WHERE species_name = 's2' OR target = 0")
def species_rows(spark: SparkSession, d: str) -> DataFrame:
    return training.species_rows(_rows(spark, d), "s2").select("l_orderkey", "l_linenumber", "target")


@query("eligible_tiers", f"WITH {_ROWS}, e AS (SELECT species_name, count(*) AS presences FROM tr WHERE target = 1 GROUP BY 1 HAVING count(*) >= 25) SELECT species_name, presences, CASE WHEN presences > 500 THEN 4 WHEN presences > 100 THEN 3 ELSE 2 END AS depth, CASE WHEN presences > 500 THEN 500 WHEN presences > 100 THEN 300 ELSE 150 END AS trees FROM e")
def eligible_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The gate by presences, and each species' model size."""
    found = training.eligible_species(_rows(spark, d))
    rows = [(r.species_name, r.presences, training.tier(r.presences).depth, training.tier(r.presences).trees) for r in found.collect()]  # a row a species
    return spark.createDataFrame(rows, "species_name string, presences long, depth int, trees int")


@query("fold_assignment", """WITH RECURSIVE g AS (SELECT o_custkey % 11 AS grp, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS k FROM g),
deal(k, grp, fold, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INT, [0, 0, 0, 0]::BIGINT[] UNION ALL
  SELECT o.k, o.grp, list_position(loads, list_min(loads))::INT - 1, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END) FROM deal JOIN o ON o.k = deal.k + 1)
SELECT grp, fold FROM deal WHERE k > 0""")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 11).alias("grp"))
    return training.assign_folds(rows, "grp").select("grp", F.col("fold").cast("int").alias("fold")).distinct()


_FM = "fm AS (SELECT 's' || (l_partkey % 6)::VARCHAR AS species, l_linenumber AS fold, " + ", ".join(f"avg((l_orderkey + l_suppkey * {k}) % {m}) AS {n}" for k, (n, m) in enumerate(zip(training.METRICS, (7, 11, 13, 17, 19, 23, 29), strict=True))) + " FROM lineitem GROUP BY ALL)"


@query("fold_summary", f"WITH {_FM} SELECT species, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in training.METRICS) + " FROM fm GROUP BY 1")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    value = {n: F.avg((F.col("l_orderkey") + F.col("l_suppkey") * k) % m) for k, (n, m) in enumerate(zip(training.METRICS, (7, 11, 13, 17, 19, 23, 29), strict=True))}
    fm = line.groupBy(F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string")).alias("species"), F.col("l_linenumber").alias("fold")).agg(*[c.alias(n) for n, c in value.items()])
    return round6(training.fold_summary(fm))


_REC = f"""tg AS (SELECT DISTINCT species_name FROM occ WHERE occurrence_id % 50 = 0), rec AS (SELECT species_name, latitude, longitude, species_name IN (SELECT species_name FROM tg) AS target, trunc((longitude - 92.0) / 0.1)::INT AS px, trunc((latitude - 14.0) / -0.4)::INT AS py FROM occ),
val AS (SELECT *, NOT target AND latitude IS NOT NULL AND longitude IS NOT NULL AS ok, coalesce(px >= 0 AND px < {KW} AND py >= 0 AND py < {KH}, false) AS inside FROM rec)"""


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = occurrences(spark, d)
    points, counts = background.effort_records(o.select("species_name", "longitude", "latitude"), o.where("occurrence_id % 50 = 0"), GEO, KH, KW)
    return points, counts


@query("effort_records", f"WITH {OCCURRENCES}, {_REC} SELECT count(*) AS n_total_records, count(*) FILTER (target) AS n_target_removed, count(*) FILTER (NOT target AND (latitude IS NULL OR longitude IS NULL)) AS n_invalid_coords, round((1 - avg(inside::INT) FILTER (ok)) * 100, 6) AS outside_pct, count(*) FILTER (ok AND inside) AS n_final_effort_records FROM val")
def effort_records(spark: SparkSession, d: str) -> DataFrame:
    return round6(_records(spark, d)[1])


@query("effort_audit_whole", f"""WITH {OCCURRENCES}, {_REC}, {_KDE}, e AS (SELECT * FROM kde WHERE value > 0), n AS (SELECT count(*) AS land FROM la),
a AS (SELECT (SELECT count(*) FROM val)::DOUBLE AS n_total_records, (SELECT count(*) FILTER (target) FROM val)::DOUBLE AS n_target_removed, (SELECT count(*) FILTER (NOT target AND (latitude IS NULL OR longitude IS NULL)) FROM val)::DOUBLE AS n_invalid_coords, (SELECT count(*) FILTER (ok AND inside) FROM val)::DOUBLE AS n_final_effort_records,
  (SELECT quantile_cont(value, 0.99) FROM m2) AS raw_max_percentile, 20.0::DOUBLE AS bandwidth_km, 20.0::DOUBLE / 111.0::DOUBLE / 0.1::DOUBLE AS sigma_pixels, 0.1::DOUBLE AS raster_resolution_deg,
  -sum(value * ln(value + 1e-12)) AS entropy_shannon, avg((value > 0.9)::INT) * 100 AS hotspot_density_pct_top1, count(*) * 100.0::DOUBLE / {KH * KW} AS nonzero_pixel_pct, any_value(land) * 100.0::DOUBLE / {KH * KW} AS land_coverage_pct,
  (count(*) FILTER (NOT ({_NIC})))::DOUBLE AS andaman_nonzero_pixels, (count(*) FILTER ({_NIC}))::DOUBLE AS nicobar_nonzero_pixels, sum(value) FILTER ({_NIC}) AS nicobar_effort_sum FROM e, n)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT a ON * INTO NAME metric VALUE value)""")
def effort_audit_whole(spark: SparkSession, d: str) -> DataFrame:
    pts, land = _effort(spark, d)
    top = stencil.raw_density_percentile(pts, land, KH, KW, 0.1, bandwidth_km=20.0)
    return round6(background.effort_audit_whole(_kde(spark, d), _records(spark, d)[1], top, land.count(), KH * KW, GEO, 20.0))


@query("index_range_audit", f"WITH {_RASTER} SELECT count(*) AS grid_pixels, min(value / 50) AS least, max(value / 50) AS most, CASE WHEN min(value / 50) < -1.1 OR max(value / 50) > 1.1 THEN 'WARN' ELSE 'PASS' END AS status FROM ra")
def index_range_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_range_audit(_raster(spark, d).where("value IS NOT NULL").withColumn("ndvi_mean", F.col("value") / 50))


@query("environment_items", "SELECT * FROM (VALUES ('python'), ('platform'), ('spark')) v(item)")
def environment_items(spark: SparkSession, d: str) -> DataFrame:
    return audit.environment(spark).where("length(value) > 0").select("item")


@query("audit_verdict", f"""WITH {_SUMMARY}, {CUBE}, ok AS (SELECT trim(species) AS species, auc_mean FROM su WHERE trim(governance) = 'PASS'), due AS (SELECT species, k AS fold FROM ok, range(0, 4) r(k)),
m AS (SELECT CASE WHEN (SELECT count(*) FROM ok) < 30 OR (SELECT avg(auc_mean) FROM ok) < 0.7 OR (SELECT count(*) FROM due WHERE (species, fold) NOT IN (SELECT species, fold FROM fd)) > 0 THEN 'FAIL' ELSE 'PASS' END AS s),
r AS (SELECT CASE WHEN min(suit) < -0.01 OR max(suit) > 1.01 THEN 'FAIL' ELSE 'PASS' END AS s FROM cube), g AS (SELECT CASE WHEN min(extrap) < -1.1 OR max(extrap) > 0.5 THEN 'WARN' ELSE 'PASS' END AS s FROM cube), al AS (SELECT s FROM m UNION ALL SELECT s FROM r UNION ALL SELECT s FROM g)
SELECT count(*) FILTER (s = 'FAIL') AS failures, count(*) FILTER (s = 'WARN') AS warnings, round((SELECT avg(auc_mean) FROM ok), 9) AS avg_auc, CASE WHEN count(*) FILTER (s = 'FAIL') = 0 AND (SELECT avg(auc_mean) FROM ok) > 0.7 THEN 'READY' ELSE 'UNSTABLE' END AS verdict FROM al""")
def audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    su, fd, _ = _summary(spark, d)
    models = audit.model_audit(su.select(F.trim("species").alias("species"), F.trim("governance").alias("governance"), "auc_mean"), fd)
    rasters = audit.raster_audit(cube(spark, d).select(F.col("species").alias("layer"), F.col("suit").alias("value")), 600, 0.0)
    grid = audit.index_range_audit(cube(spark, d), "extrap", -1.1, 0.5)
    return round9(audit.verdict(audit.messages({"models": models, "rasters": rasters, "grid": grid}), models))


@query("grid_checks", f"WITH {_RASTER}, g AS (SELECT pixel_y % 20 AS pixel_y, pixel_x, value / 80 AS ndvi_mean, value - 3 AS static_slope, value * 2 - 160 AS static_elevation FROM ra) SELECT 'NDVI Mean within 1.1' AS check, count(*) FILTER (ndvi_mean > 1.1) AS fail_count FROM g UNION ALL SELECT 'Slope >= 0', count(*) FILTER (static_slope < 0) FROM g UNION ALL SELECT 'Elevation > -150', count(*) FILTER (static_elevation <= -150) FROM g UNION ALL SELECT 'Unique pixels', count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM g GROUP BY pixel_y, pixel_x)")
def grid_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    g = _raster(spark, d).where("value IS NOT NULL").select((F.col("pixel_y") % 20).alias("pixel_y"), "pixel_x", (v / 80).alias("ndvi_mean"), (v - 3).alias("static_slope"), (v * 2 - 160).alias("static_elevation"))
    return feature_grid.checks(g)


@query("land_cells", f"WITH {_RASTER} SELECT pixel_y, pixel_x FROM ra WHERE value > 0")
def land_cells(spark: SparkSession, d: str) -> DataFrame:
    return stack.land_mask(_raster(spark, d))


@query("inland_water", f"WITH {_RASTER}, c AS (SELECT pixel_y, pixel_x, value, coalesce(value >= 20, false) AS land FROM ca), f AS (SELECT pixel_y AS fy, pixel_x AS fx FROM c WHERE land AND value > 80) SELECT pixel_y, pixel_x, CASE WHEN land THEN round(min(sqrt((pixel_y - fy) ** 2 + (pixel_x - fx) ** 2)) * 0.5, 9) END AS distance FROM c, f GROUP BY pixel_y, pixel_x, land")
def inland_water(spark: SparkSession, d: str) -> DataFrame:
    cells = _raster(spark, d).select("pixel_y", "pixel_x", F.col("value").alias("water"), F.coalesce(F.col("value") >= 20, F.lit(False)).alias("land"))
    return round9(stencil.inland_water_distance(cells, 0.5, 80.0))


_SOURCE_GEO, _TARGET_GEO = [92.0, 0.1, 0.0, 14.0, 0.0, -0.4], [92.07, 0.23, 0.0, 13.9, 0.0, -0.31]


@query("warp_nearest_cut", f"""WITH {_RASTER}, t AS (SELECT y::INT AS pixel_y, x::INT AS pixel_x, 92.07::DOUBLE + (x + 0.5::DOUBLE) * 0.23::DOUBLE AS cx, 13.9::DOUBLE - (y + 0.5::DOUBLE) * 0.31::DOUBLE AS cy FROM range(30) a(y), range(10) b(x))
SELECT t.pixel_y, t.pixel_x, value FROM t JOIN ra ON ra.pixel_y = floor((cy - 14.0::DOUBLE) / -0.4::DOUBLE) AND ra.pixel_x = floor((cx - 92.0::DOUBLE) / 0.1::DOUBLE) WHERE cx > 92.5 AND cx < 94.0 AND cy > 7.0 AND cy < 12.0""")
def warp_nearest_cut(spark: SparkSession, d: str) -> DataFrame:
    """A raster brought onto another grid by its cells' centres, and cut to a polygon."""
    out = stack.warp_to(_raster(spark, d), _SOURCE_GEO, _TARGET_GEO, 30, 10)
    return stack.cut_by(out, [(92.5, 7.0), (94.0, 7.0), (94.0, 12.0), (92.5, 12.0)], _TARGET_GEO)


@query("warp_average", f"WITH {_RASTER} SELECT floor((14.0::DOUBLE + (pixel_y + 0.5::DOUBLE) * -0.4::DOUBLE - 13.9::DOUBLE) / -0.31::DOUBLE)::INT AS pixel_y, floor((92.0::DOUBLE + (pixel_x + 0.5::DOUBLE) * 0.1::DOUBLE - 92.07::DOUBLE) / 0.23::DOUBLE)::INT AS pixel_x, round(avg(value), 9) AS value FROM ra GROUP BY 1, 2 HAVING pixel_y BETWEEN 0 AND 29 AND pixel_x BETWEEN 0 AND 9".replace("HAVING pixel_y", "HAVING floor((14.0::DOUBLE + (any_value(pixel_y) + 0.5::DOUBLE) * -0.4::DOUBLE - 13.9::DOUBLE) / -0.31::DOUBLE)").replace("AND pixel_x", "AND floor((92.0::DOUBLE + (any_value(pixel_x) + 0.5::DOUBLE) * 0.1::DOUBLE - 92.07::DOUBLE) / 0.23::DOUBLE)"))
def warp_average(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.warp_to(_raster(spark, d), _SOURCE_GEO, _TARGET_GEO, 30, 10, "avg"))


@query("warp_bilinear", f"""WITH {_RASTER}, t AS (SELECT y::INT AS pixel_y, x::INT AS pixel_x, ((13.9::DOUBLE + (y + 0.5::DOUBLE) * -0.31::DOUBLE) - 14.0::DOUBLE) / -0.4::DOUBLE - 0.5::DOUBLE AS fy, ((92.07::DOUBLE + (x + 0.5::DOUBLE) * 0.23::DOUBLE) - 92.0::DOUBLE) / 0.1::DOUBLE - 0.5::DOUBLE AS fx FROM range(30) a(y), range(10) b(x)),
c AS (SELECT t.pixel_y, t.pixel_x, (floor(fy) + dy)::INT AS sy, (floor(fx) + dx)::INT AS sx, (1 - abs(fy - floor(fy) - dy)) * (1 - abs(fx - floor(fx) - dx)) AS w FROM t, range(2) p(dy), range(2) q(dx))
SELECT c.pixel_y, c.pixel_x, round(sum(value * w) / sum(w), 9) AS value FROM c JOIN ra ON ra.pixel_y = sy AND ra.pixel_x = sx WHERE w > 0 GROUP BY ALL""")
def warp_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return round9(stack.warp_to(_raster(spark, d), _SOURCE_GEO, _TARGET_GEO, 30, 10, "bilinear"))


@query("tile_mosaic", "SELECT (l_suppkey % 12)::INT AS pixel_y, (l_partkey % 12)::INT AS pixel_x, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber)) FILTER (l_linenumber <> 2) AS value FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_linenumber <> 2) > 0")
def tile_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Where tiles overlap the last one with a value wins; of equal (orderkey, linenumber) the row that stands first in the files, as ``arg_max`` keeps it."""
    n = F.col("l_linenumber")
    cell = [(F.col("l_suppkey") % 12).cast("int").alias("pixel_y"), (F.col("l_partkey") % 12).cast("int").alias("pixel_x")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    tiles = read(spark, d, "lineitem").select(*cell, *place, F.when(n != 2, F.col("l_quantity")).alias("value"), (F.col("l_orderkey") * 10 + n).alias("tile"), (n != 2).alias("covers"))
    return stack.mosaic(tiles, ["pixel_y", "pixel_x"], "tile", ("file", "row"), F.col("covers"))


@query("report_head", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY o_custkey LIMIT 3")
def report_head(spark: SparkSession, d: str) -> DataFrame:
    """The first three rows of a report; the limit is the feature."""
    return stats.first_rows(read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ["o_custkey"])


@query("dashboard_scatter", f"WITH {_FM} SELECT species, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, round(avg(avg(auc)) OVER (), 6) AS overall_auc FROM fm GROUP BY 1")
def dashboard_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the AUC by species, with the mean over species."""
    line = read(spark, d, "lineitem")
    fm = line.groupBy(F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string")).alias("species"), F.col("l_linenumber").alias("fold")).agg(F.avg(F.col("l_orderkey") % 7).alias("auc"))
    per = training.fold_summary(fm, metrics=("auc",))
    return round6(per.crossJoin(F.broadcast(per.agg(F.avg("auc_mean").alias("overall_auc")))))
