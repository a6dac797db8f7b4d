"""Occurrence queries: harmonising, cleaning, scoring, thinning, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import in_box, valid_position
from ..operators import occurrence as occ
from ..sources.occurrence import harmonise, union_sources
from ..sources.scratch import materialise
from .mapping import CLEAN, FILLED, NAMED, OCCURRENCES, PLACED, SCORE_LIMITS, SCORED, THINNED, YEARS, occurrences, read, round6
from .registry import query

_PARTY = {"name": ("c_name", "s_name"), "account": ("c_acctbal", "s_acctbal"), "nation": ("c_nationkey", "s_nationkey")}


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return occ.temporal_filter(occ.fill_dates(occurrences(spark, d)), YEARS)


def _single(spark: SparkSession, d: str) -> DataFrame:
    return occ.dedupe(occ.spatial_filter(_dated(spark, d)), ["occurrence_id"])


def _named(spark: SparkSession, d: str) -> DataFrame:
    return occ.clean_names(_single(spark, d))


def _scores(named: DataFrame) -> DataFrame:
    return occ.species_score(named, **SCORE_LIMITS)


def _migratory(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d)
    return occ.keep_species(named, _scores(named))


def _thinned(spark: SparkSession, d: str) -> DataFrame:
    return occ.thin(_migratory(spark, d), ["occurrence_id"])


def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """single, named, migratory and thinned rows for reports that read several of them: written once, read as often as needed."""
    single, _ = materialise(_single(spark, d), "single")
    named = occ.clean_names(single)
    migratory, _ = materialise(occ.keep_species(named, _scores(named)), "migratory")
    thinned, _ = materialise(occ.thin(migratory, ["occurrence_id"]), "thinned")
    return single, named, migratory, thinned


@query("harmonize_union", """
SELECT c_name AS name, c_acctbal AS account, c_nationkey AS nation, c_custkey AS customer_id, c_mktsegment AS segment, NULL::BIGINT AS s_suppkey, 'customer' AS source_file FROM customer
UNION ALL SELECT s_name, s_acctbal, s_nationkey, NULL, NULL, s_suppkey, 'supplier' FROM supplier""")
def harmonize_union(spark: SparkSession, d: str) -> DataFrame:
    aliases = _PARTY | {"customer_id": ("c_custkey",), "segment": ("c_mktsegment",)}
    # a repeated header in other case, and a second alias of the same column: the first of each stays
    c = read(spark, d, "customer").select("*", F.lit("x").alias(" C_NAME"), F.lit(None).cast("string").alias("empty"))
    s = read(spark, d, "supplier")
    return union_sources([harmonise(f, aliases).withColumn("source_file", F.lit(n)) for f, n in ((c, "customer"), (s, "supplier"))])


_COLUMNS = ("occurrence_id", "species_name", "latitude", "longitude", "observation_date", "observer_name", "year", "month")


@query("missing_report", f"WITH {OCCURRENCES}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_percent FROM occ" for c in _COLUMNS) + """)
SELECT column_name, missing_percent, CASE WHEN missing_percent <= 5 OR column_name IN ('latitude','longitude','species_name','observation_date','occurrence_id') THEN 'retained' ELSE 'removed' END AS retained_or_removed FROM m""")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    protected = ("latitude", "longitude", "species_name", "observation_date", "occurrence_id")
    return round6(occ.missing_report(occurrences(spark, d), 5.0, protected))


@query("observer_share", f"""
WITH {OCCURRENCES}, c AS (SELECT observer_name, count(*) AS n FROM occ WHERE observer_name IS NOT NULL GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, count(*) OVER () AS t FROM c), a AS (SELECT count(*) AS rows FROM occ)
SELECT any_value(t)::BIGINT AS total_observers, """ + ", ".join(f"round(sum(n) FILTER (k <= greatest(1, floor(t * {p / 100}::DOUBLE))) / any_value(rows), 6) AS top_{p}_pct_contribution" for p in (1, 5, 10)) + " FROM r, a")
def observer_share(spark: SparkSession, d: str) -> DataFrame:
    return round6(occ.observer_share(occurrences(spark, d)))


@query("observer_counts", f"WITH {OCCURRENCES} SELECT observer_name, count(*) AS records FROM occ WHERE observer_name IS NOT NULL GROUP BY 1")
def observer_counts(spark: SparkSession, d: str) -> DataFrame:
    return occ.observer_counts(occurrences(spark, d))


@query("temporal_fill_filter", f"WITH {FILLED} SELECT occurrence_id, year, month FROM timely")
def temporal_fill_filter(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("occurrence_id", "year", "month")


@query("temporal_report", f"WITH {FILLED} SELECT min(year) AS min_year_before, max(year) AS max_year_before, count(*) FILTER (year BETWEEN 1996 AND 2000) AS records_after FROM dated")
def temporal_report(spark: SparkSession, d: str) -> DataFrame:
    return occ.temporal_report(occ.fill_dates(occurrences(spark, d)), YEARS)


@query("monthly_distribution", f"WITH {FILLED} SELECT month, count(*) AS records, count(DISTINCT species_name) AS species FROM timely GROUP BY month")
def monthly_distribution(spark: SparkSession, d: str) -> DataFrame:
    return occ.monthly_distribution(_dated(spark, d))


@query("coord_precision", """
SELECT CASE WHEN contains(l_extendedprice::VARCHAR, '.') THEN length(split_part(l_extendedprice::VARCHAR, '.', 2)) ELSE 0 END::INT AS lat_precision,
       CASE WHEN contains(l_discount::VARCHAR, '.') THEN length(split_part(l_discount::VARCHAR, '.', 2)) ELSE 0 END::INT AS lon_precision, count(*) AS count FROM lineitem GROUP BY ALL""")
def coord_precision(spark: SparkSession, d: str) -> DataFrame:
    return occ.precision_report(read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("latitude"), F.col("l_discount").alias("longitude")))


@query("bbox_filter", f"WITH {PLACED} SELECT occurrence_id, latitude, longitude FROM placed")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    return occ.spatial_filter(_dated(spark, d)).select("occurrence_id", "latitude", "longitude")


@query("dedupe_exact", f"WITH {PLACED} SELECT occurrence_id, species_name, latitude, longitude, observation_date FROM single")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return _single(spark, d).select("occurrence_id", "species_name", "latitude", "longitude", "observation_date")


@query("clean_names", f"WITH {OCCURRENCES}, {CLEAN.replace('{src}', 'occ')} SELECT DISTINCT species_name AS original_name, cleaned_name, lower(species_name) <> lower(cleaned_name) AS modified_flag FROM cleaned WHERE species_name IS NOT NULL")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    return occ.taxonomy_report(occurrences(spark, d))


_SCORE_COLUMNS = "species_name, total_count, round(summer_ratio, 6) AS summer_ratio, round(winter_ratio, 6) AS winter_ratio, peak_month, active_months, round(entropy_score, 6) AS entropy_score, round(migration_score, 6) AS migration_score, retained_or_removed"


@query("species_score", f"WITH {SCORED} SELECT {_SCORE_COLUMNS} FROM scores")
def species_score(spark: SparkSession, d: str) -> DataFrame:
    return round6(_scores(_named(spark, d)))


@query("species_monthly_presence", f"WITH {NAMED} SELECT species_name, month, count(*) AS records FROM named GROUP BY ALL")
def species_monthly_presence(spark: SparkSession, d: str) -> DataFrame:
    return occ.monthly_presence(_named(spark, d))


@query("migratory_semi_join", f"WITH {SCORED} SELECT occurrence_id, species_name FROM migratory")
def migratory_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return _migratory(spark, d).select("occurrence_id", "species_name")


@query("spatial_thin", f"WITH {THINNED} SELECT occurrence_id, species_name, latitude, longitude FROM thinned")
def spatial_thin(spark: SparkSession, d: str) -> DataFrame:
    return _thinned(spark, d).select("occurrence_id", "species_name", "latitude", "longitude")


@query("thinning_report", f"""
WITH {THINNED}, cells AS (SELECT count(*) AS n FROM thinned GROUP BY latitude, longitude)
SELECT (SELECT count(*) FROM migratory) AS original_records, (SELECT count(DISTINCT species_name) FROM migratory) AS original_species, (SELECT count(*) FROM thinned) AS final_records,
       (SELECT count(DISTINCT species_name) FROM thinned) AS final_species, max(n) AS max_grid_density, round(avg(n), 6) AS mean_grid_density FROM cells""")
def thinning_report(spark: SparkSession, d: str) -> DataFrame:
    _, _, migratory, thinned = _stages(spark, d)
    return round6(occ.thinning_report(migratory, thinned))


@query("grid_density", f"WITH {PLACED} SELECT latitude, longitude, count(*) AS density, count(DISTINCT species_name) AS richness FROM single GROUP BY ALL")
def grid_density(spark: SparkSession, d: str) -> DataFrame:
    return occ.grid_density(_single(spark, d))


@query("attrition_track", f"WITH {THINNED} " + " UNION ALL ".join(f"SELECT '{n}' AS step, count(*) AS records, count(DISTINCT species_name) AS species FROM {t}" for n, t in (("1_Ingestion", "occ"), ("3_Temporal", "timely"), ("4_Spatial", "placed"), ("4.5_Duplicates", "single"), ("5_Taxonomy", "named"), ("6_Migratory", "migratory"), ("7_Thinning", "thinned"))))
def attrition_track(spark: SparkSession, d: str) -> DataFrame:
    at, raw = F.col("observation_date"), occurrences(spark, d)
    timely = F.coalesce("year", F.year(at)).between(*YEARS) & F.coalesce("month", F.month(at)).isNotNull()
    placed = timely & valid_position(F.col("latitude"), F.col("longitude")) & in_box(F.col("latitude"), F.col("longitude"))
    single, named, migratory, thinned = _stages(spark, d)
    filters = occ.step_counts(raw, {"1_Ingestion": F.lit(True), "3_Temporal": timely, "4_Spatial": placed})
    return filters.unionAll(occ.attrition([("4.5_Duplicates", single), ("5_Taxonomy", named), ("6_Migratory", migratory), ("7_Thinning", thinned)]))


@query("validation_gate", f"""
WITH {THINNED}, n AS (SELECT (SELECT count(DISTINCT species_name) FROM thinned) * 100.0 / (SELECT count(DISTINCT species_name) FROM named) AS kept,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM thinned GROUP BY latitude, longitude)) AS densest),
m AS (SELECT list_filter([CASE WHEN kept < 90 THEN 'Species retention ' || printf('%.1f', kept) || '% < 90%' END, CASE WHEN densest > 3 THEN 'Max grid density ' || densest || ' > 3' END], lambda x: x IS NOT NULL) AS failed FROM n)
SELECT CASE WHEN len(failed) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN len(failed) > 0 THEN array_to_string(failed, ' | ') ELSE 'All thresholds passed' END AS message FROM m""")
def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    _, named, _, thinned = _stages(spark, d)
    return occ.validation_gate(thinned, named, years=YEARS, density=3)


@query("region_year_coverage", f"""
WITH {PLACED} SELECT year, count(*) FILTER (latitude >= 10.5) AS andaman_records, count(*) FILTER (latitude < 10.5) AS nicobar_records, count(*) AS total_records, count(DISTINCT species_name) AS richness FROM single GROUP BY year""")
def region_year_coverage(spark: SparkSession, d: str) -> DataFrame:
    return occ.region_year_coverage(_single(spark, d))


@query("dedupe_first_nonnull", f"""
WITH {OCCURRENCES} SELECT species_name, month, first(observer_name ORDER BY occurrence_id) FILTER (observer_name IS NOT NULL) AS observer_name,
  first(observation_date ORDER BY occurrence_id) FILTER (observation_date IS NOT NULL) AS observation_date FROM occ WHERE month IS NOT NULL GROUP BY species_name, month""")
def dedupe_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    rows = occurrences(spark, d).select("species_name", "month", "observer_name", "observation_date", "occurrence_id")
    return occ.first_non_null(rows, ["species_name", "month"], [F.col("occurrence_id")]).drop("occurrence_id")


@query("target_anti_join", f"""
WITH {OCCURRENCES}, {CLEAN.replace('{src}', 'occ')} SELECT occurrence_id, cleaned_name AS species_name FROM cleaned
WHERE cleaned_name <> 'INVALID_TAXON' AND cleaned_name NOT IN (SELECT upper(p_name[1]) || substr(p_name, 2) FROM part WHERE p_size = 1)""")
def target_anti_join(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "part").where("p_size = 1").select(F.col("p_name").alias("species_name"))
    return occ.clean_names(occurrences(spark, d)).join(occ.clean_names(targets).distinct(), "species_name", "left_anti").select("occurrence_id", "species_name")
