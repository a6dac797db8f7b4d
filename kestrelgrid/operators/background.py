"""Target-group background: candidates weighed by observer effort, away from presences, thinned, dated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import pixel_centre, pixel_index, utm46
from ..sources.scratch import materialise
from . import sampling, spatial, stats, stencil

#: Points wanted and their shares; fixed values.
GOAL, SHARES = 30_000, {"Andaman": 0.7, "Nicobar": 0.3}


def projected(df: DataFrame, key: str) -> DataFrame:
    """Adds x and y in metres, and id from ``key``."""
    east, north = utm46(F.col("longitude"), F.col("latitude"))
    return df.withColumns({"id": F.col(key).cast("long"), "x": east, "y": north})


def candidates(effort: DataFrame, land: DataFrame, geo: list[float], split: float = 10.0) -> DataFrame:
    """Land cells with effort: centre, weight, cluster, and the stratum by the mean latitude of the cluster's candidates."""
    lon, lat = pixel_centre(F.col("pixel_y"), F.col("pixel_x"), geo)
    clusters = stencil.label_components(land).withColumnRenamed("component", "cluster_id")
    rows = effort.where("value > 0").join(clusters, ["pixel_y", "pixel_x"]).select("pixel_y", "pixel_x", "cluster_id", F.col("value").alias("weight"), lon.alias("longitude"), lat.alias("latitude"))
    rows, _ = materialise(rows, "candidates")
    strata = rows.groupBy("cluster_id").agg(F.avg("latitude").alias("mean")).select("cluster_id", F.when(F.col("mean") > split, "Andaman").otherwise("Nicobar").alias("stratum"))
    return rows.join(strata, "cluster_id").withColumn("cell", F.col("pixel_y").cast("long") * F.lit(1 << 31) + F.col("pixel_x"))


def background_pool(effort: DataFrame, land: DataFrame, presence: DataFrame, geo: list[float], goal: int = GOAL, shares: dict[str, float] | None = None, buffer_m: float = 1_000.0, thin_m: float = 500.0, split: float = 10.0, seed: int = 42) -> DataFrame:
    """(longitude, latitude, year, month, target, stratum, weight, cell) of the pool.

    ``presence``: (id, longitude, latitude, year, month). Candidates within the buffer of a presence go; each
    stratum gives its share by weighted sampling; greedy thinning in random order; the date of one of the 25
    nearest presences is borrowed.
    """
    shares = shares or SHARES
    p, _ = materialise(projected(presence, "id"), "presence")
    c = projected(candidates(effort, land, geo, split), "cell")
    far = spatial.radius_anti_join(c, p, buffer_m)
    drawn, _ = materialise(sampling.weighted_stratified_sample(far, "stratum", "weight", {k: int(goal * v) for k, v in shares.items()}, ["id"], seed), "drawn")
    thinned, _ = materialise(sampling.greedy_thin(drawn, thin_m, seed), "pool")
    dated = sampling.temporal_borrow(thinned, p, seed=seed)
    return dated.select("longitude", "latitude", "year", "month", F.lit(0).alias("target"), "stratum", "weight", "cell")


def overlap(presence: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value): Kolmogorov-Smirnov statistic between presences and background of each column both have."""
    out = None
    for c in columns:
        both = presence.select(c, F.lit(1).alias("g")).unionByName(pool.select(c, F.lit(0).alias("g")))
        one = stats.ks_statistic(both, c, "g").select(F.lit(f"{c}_ks_stat").alias("metric"), F.col("ks_stat").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


def effort_audit(effort: DataFrame, land_cells: int, all_cells: int, geo: list[float], split: float = 10.0) -> DataFrame:
    """(metric, value) of an effort surface: unnormalised entropy, share of cells above 0.9, coverage, cells and sum by region."""
    v = F.col("value")
    nicobar = geo[3] + F.col("pixel_y") * geo[5] <= split
    row = effort.where("value > 0").agg(
        (-F.sum(v * F.ln(v + 1e-12))).alias("entropy_shannon"), (F.avg((v > 0.9).cast("double")) * 100).alias("hotspot_density_pct_top1"), (F.count(v) * 100.0 / all_cells).alias("nonzero_pixel_pct"), F.lit(land_cells * 100.0 / all_cells).alias("land_coverage_pct"),
        F.count_if(~nicobar).cast("double").alias("andaman_nonzero_pixels"), F.count_if(nicobar).cast("double").alias("nicobar_nonzero_pixels"), F.coalesce(F.sum(F.when(nicobar, v)), F.lit(0.0)).alias("nicobar_effort_sum"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def effort_records(records: DataFrame, targets: DataFrame, geo: list[float], height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Effort points (pixel_y, pixel_x) on the grid, and one row: n_total_records, n_target_removed, n_invalid_coords, outside_pct, n_final_effort_records.

    ``records``: (species_name, longitude, latitude); rows of ``targets`` (species_name) go, then those without
    coordinates, then those off the grid. The counts come from one pass.
    """
    marked = records.join(targets.select("species_name", F.lit(True).alias("__target")).distinct(), "species_name", "left")
    px, py = pixel_index(F.col("longitude"), geo[0], geo[1]), pixel_index(F.col("latitude"), geo[3], geo[5])
    marked = marked.select(F.col("__target").isNotNull().alias("target"), (F.col("longitude").isNull() | F.col("latitude").isNull()).alias("invalid"), py.alias("pixel_y"), px.alias("pixel_x"))
    inside = F.coalesce((F.col("pixel_x") >= 0) & (F.col("pixel_x") < width) & (F.col("pixel_y") >= 0) & (F.col("pixel_y") < height), F.lit(False))
    valid = ~F.col("target") & ~F.col("invalid")
    counts = marked.agg(
        F.count(F.lit(1)).alias("n_total_records"), F.count_if("target").alias("n_target_removed"), F.count_if(~F.col("target") & F.col("invalid")).alias("n_invalid_coords"),
        ((1 - F.avg(F.when(valid, inside.cast("double")))) * 100).alias("outside_pct"), F.count_if(valid & inside).alias("n_final_effort_records"),
    )
    return marked.where(valid & inside).select("pixel_y", "pixel_x"), counts


def effort_audit_whole(effort: DataFrame, counts: DataFrame, raw_max: DataFrame, land_cells: int, all_cells: int, geo: list[float], bandwidth_km: float = 10.0, km_per_degree: float = 111.0, split: float = 10.0) -> DataFrame:
    """(metric, value): the fifteen metrics of the effort report. ``counts``: of :func:`effort_records`; ``raw_max``: one row, raw_max_percentile."""
    names = ["n_total_records", "n_target_removed", "n_invalid_coords", "n_final_effort_records"]
    first = counts.select(*[F.col(n).cast("double").alias(n) for n in names]).crossJoin(raw_max.select(F.col("raw_max_percentile").cast("double").alias("raw_max_percentile")))
    first = first.withColumns({"bandwidth_km": F.lit(float(bandwidth_km)), "sigma_pixels": F.lit(bandwidth_km / km_per_degree / geo[1]), "raster_resolution_deg": F.lit(float(geo[1]))})
    return first.unpivot([], first.columns, "metric", "value").unionByName(effort_audit(effort, land_cells, all_cells, geo, split))
