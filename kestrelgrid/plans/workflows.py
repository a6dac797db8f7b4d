"""The three workflows end to end, as compositions of the operators that write their reports and tables.

Each returns the tables it made. Reports go to ``out`` as small CSV folders, tables as Parquet. A workflow
stops at the first failing gate, before anything after it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import USABLE, coverage_status, token_date, vegetation_index
from ..operators import audit, ecosystem, feature_grid, inference, stack, training
from ..operators import occurrence as occ
from ..sources import sinks
from ..sources.occurrence import read_occurrences
from ..sources.scratch import materialise


def occurrence_workflow(spark: SparkSession, folder: str, out: str, formats: tuple[str, ...] = (), years: tuple[int, int] = (2005, 2025), box: tuple[float, float, float, float] = (6.0, 14.0, 92.0, 94.5), score: dict | None = None) -> DataFrame:
    """Raw files to thinned presences, with all reports. Raises if the final gate fails."""
    raw, files = read_occurrences(spark, folder)
    sinks.write_report(spark.createDataFrame(files, "file string, columns int, note string, names string"), f"{out}/schema_audit")
    raw, _ = materialise(raw, "raw")
    sinks.write_report(occ.missing_report(raw), f"{out}/missing_value_report")
    dense = occ.drop_sparse(raw)
    if "observer_name" in dense.columns:
        sinks.write_report(occ.observer_counts(dense), f"{out}/observer_bias_report")
        sinks.write_manifest(occ.observer_share(dense), f"{out}/observer_stats")
    when = occ.parse_date(F.col("observation_date"), formats) if "observation_date" in dense.columns else F.lit(None).cast("timestamp_ntz")
    typed = dense.withColumn("observation_date", when).withColumns({c: F.col(c).try_cast("double").cast("int") if c in dense.columns else F.lit(None).cast("int") for c in ("year", "month")})
    dated = occ.fill_dates(typed)
    sinks.write_report(occ.temporal_report(dated, years), f"{out}/temporal_validation_report")
    timely = occ.temporal_filter(dated, years)
    sinks.write_report(occ.monthly_distribution(timely), f"{out}/monthly_sampling_distribution")
    placed = occ.spatial_filter(timely, box)
    sinks.write_report(occ.precision_report(placed), f"{out}/spatial_validation_report")
    whole = F.xxhash64(*sorted(placed.columns))
    keyed = placed.withColumn("row_key", whole)
    single, _ = materialise(occ.dedupe(keyed, ["source_file", "row_key"]), "single")  # several reports read it
    sinks.write_report(occ.taxonomy_report(single), f"{out}/taxonomic_cleaning_report")
    named = occ.clean_names(single)
    sinks.write_report(occ.monthly_presence(named), f"{out}/species_monthly_presence")
    scores, _ = materialise(occ.species_score(named, **(score or {})), "scores")
    sinks.write_report(scores, f"{out}/species_validation_report")
    migratory = occ.keep_species(named, scores)
    thinned, _ = materialise(occ.thin(migratory, ["row_key", "source_file"]), "thinned")
    sinks.write_report(occ.thinning_report(migratory, thinned), f"{out}/spatial_thinning_report")
    steps = [("1_Ingestion", raw), ("2_FeatureDensity", dense), ("3_Temporal", timely), ("4_Spatial", placed), ("4.5_Duplicates", single), ("5_Taxonomy", named), ("6_Migratory", migratory), ("7_Thinning", thinned)]
    sinks.write_report(occ.attrition(steps), f"{out}/species_attrition_tracking")
    sinks.write_report(occ.region_year_coverage(thinned), f"{out}/ecological_coverage_report")
    gate = occ.validation_gate(thinned, migratory, box, years)
    sinks.write_report(gate, f"{out}/validation_report")
    occ.assert_gate(gate)
    sinks.write_table(thinned.drop("row_key"), f"{out}/presences")
    return thinned


def index_workflow(pixels: DataFrame, out: str, total_pixels: int, expected: int = stack.COMPOSITES) -> DataFrame:
    """Pixels of tiles (date_str, tile, pixel_y, pixel_x, ndvi_raw, qa) to yearly features, with audits."""
    at = token_date(F.col("date_str"))
    clean = pixels.select("date_str", "tile", F.year(at).alias("year"), F.month(at).alias("month"), "pixel_y", "pixel_x", vegetation_index(F.col("ndvi_raw"), F.col("qa")).alias("value"))
    keys = ["date_str", "year", "month", "pixel_y", "pixel_x"]
    daily, _ = materialise(stack.mosaic(clean, keys, "tile"), "daily")
    audits = stack.mosaic_audit(daily, total_pixels).withColumn("status", coverage_status(F.col("valid_pixels"), F.lit(float(total_pixels))))
    audits, _ = materialise(audits, "audits")
    sinks.write_report(audits, f"{out}/daily_mosaic_validation")
    sinks.write_report(audit.diagnostics(audits), f"{out}/diagnostics")
    series = daily.join(audits.where(F.col("status").isin(*USABLE)).select("date_str"), "date_str", "left_semi")
    sinks.write_report(stack.year_completeness(series, expected), f"{out}/seasonal_completeness")
    years, _ = materialise(stack.yearly_stack(series, expected), "years")
    sinks.write_report(stack.yearly_summary(series, years, expected), f"{out}/yearly_ecological_summary")
    layers = stack.to_layers(years, ["year", "pixel_y", "pixel_x"], list(stack.STACK_FEATURES))
    stats = stack.layer_stats(layers, ["year", "layer"], total_pixels).withColumn("report", stack.report_of(F.col("layer")))
    for report in ("aggregate", "seasonal"):
        sinks.write_report(stats.where(F.col("report") == report).drop("report"), f"{out}/{report}_validation")
    bounded = [f for f in stack.STACK_FEATURES if f in ("ndvi_mean", "ndvi_min", "ndvi_max", "ndvi_monsoon_mean", "ndvi_dry_mean", "ndvi_winter_mean")]
    audit.require(stack.bounds_audit(layers.where(F.col("layer").isin(*bounded))))
    sinks.write_report(stack.layer_inventory(layers), f"{out}/layer_inventory")
    sinks.write_table(layers.where("value IS NOT NULL"), f"{out}/yearly_layers", by=["year"])
    return years


def model_workflow(spark: SparkSession, matrix: DataFrame, grid: DataFrame, features: list[str], key: str, out: str, choose=training.tier) -> DataFrame:
    """Training matrix and grid to fold metrics, verdicts and the synthesis of the species that pass; gives the synthesis."""
    folds, failed = training.train_all(matrix, features, key, save_to=f"{out}/models", choose=choose)
    if failed:
        sinks.write_report(spark.createDataFrame(failed, "species string, error string"), f"{out}/failed_species", append=True)
    if folds is None:
        raise ValueError("no species could be trained")
    folds, _ = materialise(folds, "folds")
    sinks.write_report(folds, f"{out}/fold_performance_metrics")
    null = None
    for r in training.eligible_species(matrix).join(folds.select(F.col("species").alias("species_name")).distinct(), "species_name").orderBy("species_name").collect():
        one = training.spatial_cv(training.species_rows(matrix, r.species_name), features, key, t=choose(r.presences), null_model=True).agg(F.avg("auc").alias("null_auc_mean")).select(F.lit(r.species_name).alias("species"), "null_auc_mean")
        null = one if null is None else null.unionByName(one)
    summary, _ = materialise(training.governance(folds, null), "summary")
    sinks.write_report(summary, f"{out}/model_performance_summary")
    inputs, _ = materialise(feature_grid.model_inputs(grid, features=tuple(features)), "inputs")
    cube = None
    for r in summary.where("governance = 'PASS'").select("species").orderBy("species").collect():
        scores = training.ensemble_scores(spark, inputs, features, f"{out}/models", r.species)
        surface = inference.ensemble(scores, ["pixel_y", "pixel_x"], least_folds=3)
        extra = inference.extrapolation(inputs, training.species_rows(matrix, r.species), features).select("pixel_y", "pixel_x", "extrapolation")
        one = surface.join(extra, ["pixel_y", "pixel_x"]).select(F.lit(r.species).alias("species"), "pixel_y", "pixel_x", F.col("suitability").alias("suit"), F.col("uncertainty_std").alias("unc"), F.col("extrapolation").alias("extrap"))
        cube = one if cube is None else cube.unionByName(one)
    if cube is None:
        raise ValueError("no species passed")
    cube, _ = materialise(cube, "cube")
    sinks.write_table(cube, f"{out}/surfaces", by=["species"])
    thresholds = folds.groupBy("species").agg(F.avg("th").alias("threshold")).join(cube.select("species").distinct(), "species", "left_semi")
    cells, _ = materialise(ecosystem.stability(ecosystem.synthesis(cube, thresholds)), "cells")
    out_cells = ecosystem.hotspots(ecosystem.priority(cells))
    sinks.write_table(out_cells, f"{out}/ecosystem")
    return out_cells
