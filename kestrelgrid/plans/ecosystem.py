"""Species-cube, audit and training queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import reasons, safe_file_name
from ..functions.pixels import failure_category, season
from ..operators import audit, ecosystem, training
from ..operators.occurrence import value_counts
from ..sources.sinks import metrics
from .mapping import CUBE, cube, read, round9, thresholds
from .registry import query

_SYN = CUBE + """,
nn AS (SELECT count(*) AS n FROM thr),
sy AS (SELECT pixel_y, pixel_x, count(*) AS support, sum(suit) AS weighted_richness, avg(suit) AS mean_suit, avg(unc) AS mean_unc, avg(extrap) AS mean_extrap, count(*) FILTER (suit >= threshold) AS binary_richness FROM cube JOIN thr USING (species) GROUP BY ALL),
ag AS (SELECT sy.*, 1 - sqrt(binary_richness / n::DOUBLE * (1 - binary_richness / n::DOUBLE)) AS agreement, mean_suit / (mean_unc + 0.01::DOUBLE) AS raw FROM sy, nn),
sb AS (SELECT * EXCLUDE (raw), greatest(0, least(raw, (SELECT quantile_cont(raw, 0.99) FROM ag))) AS stability FROM ag),
en AS (SELECT min(binary_richness) AS r0, max(binary_richness) AS r1, min(stability) AS s0, max(stability) AS s1, min(mean_extrap) AS e0, max(mean_extrap) AS e1 FROM sb),
pr AS (SELECT sb.*, greatest(0, least(1, (binary_richness - r0) / (r1 - r0 + 1e-8) * (stability - s0) / (s1 - s0 + 1e-8) * (1 - (mean_extrap - e0) / (e1 - e0 + 1e-8)))) AS priority FROM sb, en),
qs AS (SELECT quantile_cont(binary_richness::DOUBLE, 0.95) AS a, quantile_cont(stability, 0.75) AS b, quantile_cont(mean_extrap, 0.5) AS c FROM sb)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.synthesis(cube(spark, d), thresholds(spark, d))


@query("eco_richness", f"WITH {_SYN} SELECT pixel_y, pixel_x, support, round(weighted_richness, 9) AS weighted_richness, binary_richness, round(mean_suit, 9) AS mean_suit, round(mean_unc, 9) AS mean_unc, round(mean_extrap, 9) AS mean_extrap FROM sy")
def eco_richness(spark: SparkSession, d: str) -> DataFrame:
    return round9(_cells(spark, d).select("pixel_y", "pixel_x", "support", "weighted_richness", "binary_richness", "mean_suit", "mean_unc", "mean_extrap"))


@query("eco_agreement", f"WITH {_SYN} SELECT pixel_y, pixel_x, round(agreement, 9) AS agreement FROM ag")
def eco_agreement(spark: SparkSession, d: str) -> DataFrame:
    return round9(_cells(spark, d).select("pixel_y", "pixel_x", "agreement"))


@query("eco_stability_priority", f"WITH {_SYN} SELECT pixel_y, pixel_x, round(stability, 9) AS stability, round(priority, 9) AS priority FROM pr")
def eco_stability_priority(spark: SparkSession, d: str) -> DataFrame:
    return round9(ecosystem.priority(ecosystem.stability(_cells(spark, d))).select("pixel_y", "pixel_x", "stability", "priority"))


@query("eco_hotspots", f"WITH {_SYN} SELECT pixel_y, pixel_x, (binary_richness >= a AND stability >= b AND mean_extrap <= c)::SMALLINT AS hotspot FROM sb, qs")
def eco_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.hotspots(ecosystem.stability(_cells(spark, d))).select("pixel_y", "pixel_x", "hotspot")


_SUMMARY = """
su AS (SELECT ' s' || p_size::VARCHAR || ' ' AS species, CASE WHEN p_size % 3 = 0 THEN 'FAIL' ELSE 'PASS ' END AS governance, 0.6::DOUBLE + (p_size % 30) * 0.01::DOUBLE AS auc_mean FROM (SELECT DISTINCT p_size FROM part)),
fd AS (SELECT 's' || p_size::VARCHAR AS species, k AS fold, (p_size + k) / 100.0::DOUBLE AS th FROM (SELECT DISTINCT p_size FROM part), range(0, 4) r(k) WHERE p_size % 7 <> 0 AND NOT (p_size % 5 = 0 AND k = 2)),
ly AS (SELECT 's' || p_size::VARCHAR AS species, l AS layer, 20 + (p_size % 11 = 0 AND l = 'uncertainty')::INT AS width, p_size * 3 AS valid_coverage FROM (SELECT DISTINCT p_size FROM part), (VALUES ('suitability'), ('uncertainty'), ('extrapolation')) v(l) WHERE NOT (p_size % 13 = 0 AND l <> 'suitability'))"""


def _summary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = read(spark, d, "part").select("p_size").distinct()
    s = F.col("p_size")
    name = F.concat(F.lit("s"), s.cast("string"))
    su = sizes.select(F.concat(F.lit(" "), name, F.lit(" ")).alias("species"), F.when(s % 3 == 0, "FAIL").otherwise("PASS ").alias("governance"), (0.6 + (s % 30) * 0.01).alias("auc_mean"))
    fd = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3)))).where((s % 7 != 0) & ~((s % 5 == 0) & (F.col("fold") == 2))).select(name.alias("species"), "fold", ((s + F.col("fold")) / 100.0).alias("th"))
    ly = sizes.withColumn("layer", F.explode(F.array(F.lit("suitability"), F.lit("uncertainty"), F.lit("extrapolation")))).where(~((s % 13 == 0) & (F.col("layer") != "suitability")))
    ly = ly.select(name.alias("species"), "layer", (20 + ((s % 11 == 0) & (F.col("layer") == "uncertainty")).cast("int")).alias("width"), F.lit(30).alias("height"), F.lit("EPSG:4326").alias("crs"), F.array(*[F.lit(x) for x in (92.0, 0.005, 0.0, 14.0, 0.0, -0.005)]).alias("transform"), (s * 3).alias("valid_coverage"))
    return su, fd, ly


@query("triad_manifest", f"""WITH {_SUMMARY}, g AS (SELECT trim(species) AS species, auc_mean FROM su WHERE trim(governance) IN ('PASS', 'WARN')), t AS (SELECT species, avg(th) AS threshold FROM fd GROUP BY 1),
w AS (SELECT species, max(valid_coverage) FILTER (layer = 'suitability') AS a, max(valid_coverage) FILTER (layer = 'uncertainty') AS b, max(valid_coverage) FILTER (layer = 'extrapolation') AS c, bool_or(width <> 20) AS off FROM ly GROUP BY 1),
r AS (SELECT g.*, threshold, a, b, c, CASE WHEN threshold IS NULL THEN 'Missing optimal threshold' WHEN b IS NULL THEN 'Missing layer triad: uncertainty, extrapolation' WHEN off THEN 'Spatial mismatch: uncertainty' END AS reason FROM g LEFT JOIN t USING (species) LEFT JOIN w USING (species))
SELECT species, species AS safe_name, round(threshold, 9) AS threshold, round(auc_mean, 9) AS auc, a AS suitability_coverage, b AS uncertainty_coverage, c AS extrapolation_coverage, reason IS NULL AS included, reason FROM r""")
def triad_manifest(spark: SparkSession, d: str) -> DataFrame:
    return round9(ecosystem.triad_manifest(*_summary(spark, d)))


@query("manifest_summary", f"""WITH {_SUMMARY}, g AS (SELECT trim(species) AS species, CAST(substr(trim(species), 2) AS INT) AS k FROM su WHERE trim(governance) IN ('PASS', 'WARN')),
i AS (SELECT *, k % 7 <> 0 AND k % 13 <> 0 AND k % 11 <> 0 AS ok FROM g)
SELECT count(*) FILTER (ok) AS validated_species, count(*) FILTER (NOT ok) AS excluded_species, sha256(string_agg(species, '' ORDER BY species) FILTER (ok)) AS integrity_hash,
  round(3 * count(*) FILTER (ok) * 8000 * 6000 * 4 / 1073741824.0::DOUBLE, 3) AS raw_cube_gb, round(3 * count(*) FILTER (ok) * 8000 * 6000 * 4 / 1073741824.0::DOUBLE * 3, 3) AS peak_gb, CASE WHEN 3 * count(*) FILTER (ok) * 8000 * 6000 * 4 / 1073741824.0::DOUBLE * 3 > 4 THEN 'recommended' ELSE 'full_load' END AS chunk_strategy FROM i""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.manifest_summary(ecosystem.triad_manifest(*_summary(spark, d)), 8000, 6000)


@query("model_audit", f"""WITH {_SUMMARY}, ok AS (SELECT trim(species) AS species, auc_mean FROM su WHERE trim(governance) = 'PASS'), due AS (SELECT species, k AS fold FROM ok, range(0, 4) r(k)),
a AS (SELECT (SELECT count(*) FROM ok) AS pass_count, (SELECT avg(auc_mean) FROM ok) AS avg_auc, (SELECT count(*) FROM due WHERE (species, fold) NOT IN (SELECT species, fold FROM fd)) AS missing_folds),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN pass_count < 30 THEN 'FAIL few species' END, CASE WHEN avg_auc < 0.7 THEN 'FAIL low auc' END, CASE WHEN missing_folds > 0 THEN 'FAIL missing folds' END], lambda x: x IS NOT NULL), ' | ') AS messages FROM a)
SELECT pass_count, round(avg_auc, 9) AS avg_auc, missing_folds, messages, CASE WHEN contains(messages, 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status FROM m""")
def model_audit(spark: SparkSession, d: str) -> DataFrame:
    su, fd, _ = _summary(spark, d)
    su = su.select(F.trim("species").alias("species"), F.trim("governance").alias("governance"), "auc_mean")
    return round9(audit.model_audit(su, fd))


@query("usable_ensembles", f"WITH {_SUMMARY} SELECT species, count(DISTINCT fold) AS folds, CASE WHEN count(DISTINCT fold) < 4 THEN 'incomplete ensemble' ELSE '' END AS note FROM fd GROUP BY 1 HAVING count(DISTINCT fold) >= 3")
def usable_ensembles(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.inference import usable_ensembles as usable

    return usable(_summary(spark, d)[1])


@query("raster_audit", f"WITH {CUBE}, p AS (SELECT species, min(suit) AS lo, max(suit) AS hi, count(suit) * 100.0::DOUBLE / 600 AS coverage FROM cube GROUP BY 1) SELECT count(*) AS layers, 0::BIGINT AS non_finite, count(*) FILTER (lo < -0.01 OR hi > 1.01) AS bad_range, round(min(coverage), 9) AS min_coverage, CASE WHEN count(*) FILTER (lo < -0.01 OR hi > 1.01) > 0 OR min(coverage) < 3 THEN 'FAIL' ELSE 'PASS' END AS status FROM p")
def raster_audit(spark: SparkSession, d: str) -> DataFrame:
    return round9(audit.raster_audit(cube(spark, d).select(F.col("species").alias("layer"), F.col("suit").alias("value")), 600))


@query("observation_audit", """WITH a AS (SELECT count(*) AS raw_obs_total, count(*) FILTER (l_quantity < 2 OR l_quantity > 49 OR l_discount > 0.095) AS coord_outliers FROM lineitem)
SELECT *, 410.0::DOUBLE AS leakage_min_dist, CASE WHEN coord_outliers > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM a""")
def observation_audit(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select(F.col("l_quantity").alias("latitude"), F.col("l_discount").alias("longitude"))
    return round9(audit.observation_audit(line, spark.createDataFrame([(0.41,)], "min_dist_km double"), (2.0, 49.0, 0.0, 0.095)))


@query("duplicate_keys", "SELECT count(*) FILTER (n > 1) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("failure_taxonomy", "WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'TIFF read' WHEN 'view' THEN 'out of Memory' ELSE event_type END AS message, event_id % 10 = 0 AS v FROM events) SELECT CASE WHEN v THEN 'GIS_FAILURE' WHEN contains(lower(message), 'tiff') THEN 'WARP_FAILURE' WHEN contains(lower(message), 'memory') THEN 'RESOURCE_FAILURE' ELSE 'READ_FAILURE' END AS category, count(*) AS n FROM m GROUP BY 1")
def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    message = F.when(F.col("event_type") == "click", "TIFF read").when(F.col("event_type") == "view", "out of Memory").otherwise(F.col("event_type"))
    return e.select(failure_category(message, F.col("event_id") % 10 == 0).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("season_labels", "SELECT CASE WHEN month(l_shipdate) BETWEEN 2 AND 5 THEN 'dry' WHEN month(l_shipdate) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'winter' END AS season, count(*) AS n FROM lineitem GROUP BY 1")
def season_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(season(F.month("l_shipdate")).alias("season")).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("value_shares", "SELECT l_returnflag, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return round9(value_counts(read(spark, d, "lineitem"), "l_returnflag", normalised=True))


@query("report_metrics", "WITH a AS (SELECT count(*)::VARCHAR AS n, count(DISTINCT o_custkey)::VARCHAR AS c FROM orders) SELECT 'orders' AS metric, n AS value FROM a UNION ALL SELECT 'observers', c FROM a")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(read(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("observers")))


@query("reason_sets", "SELECT p_partkey, replace(p_name, ' ', '_') AS safe_name, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'costly' END, CASE WHEN p_size > 40 THEN 'large' END], lambda x: x IS NOT NULL))), '|') AS reasons FROM part")
def reason_sets(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    found = reasons([F.when(size > 25, F.lit("large")), F.when(price > 1000, F.lit("costly")), F.when(size > 40, F.lit("large"))])
    return read(spark, d, "part").select("p_partkey", safe_file_name(F.col("p_name")).alias("safe_name"), found.alias("reasons"))


FEATURES = [f"f{k}" for k in range(8)]


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as training rows: their first eight components are the features, odd labels the presences, bands of one component the folds."""
    e = read(spark, d, "embeddings")
    at = lambda k: F.col("embedding").getItem(k).cast("double")
    fold = F.when(at(8) >= 0.08, "North").when(at(8) >= 0.0, "Middle").when(at(8) >= -0.08, "South").otherwise("Nicobar")
    return e.select("vec_id", F.col("label").alias("k"), (F.col("label") % 2).cast("int").alias("target"), fold.alias("spatial_fold"), *[at(k).alias(f) for k, f in enumerate(FEATURES)])


@query("gbt_spatial_cv")
def gbt_spatial_cv(spark: SparkSession, d: str) -> DataFrame:
    """Fold scores of the tier by presence count, and the AUC of the null model beside them. Times are left out."""
    rows = _training(spark, d)
    null = training.spatial_cv(rows, FEATURES, "vec_id", null_model=True).select("fold", F.col("auc").alias("null_auc"))
    return round9(training.spatial_cv(rows, FEATURES, "vec_id").drop("time").join(null, "fold"))


@query("feature_importance")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = _training(spark, d)
    presences = rows.dropna(subset=FEATURES).where("target = 1").count()
    return round9(training.importance(rows, FEATURES, training.tier(presences), "vec_id"))


@query("governance_verdict", """WITH fm AS (SELECT 's' || (l_partkey % 6)::VARCHAR AS species, l_linenumber AS fold, avg(round(l_discount * 100)::INT) / 10.0::DOUBLE AS auc FROM lineitem GROUP BY ALL)
SELECT species, round(avg(auc), 9) AS auc_mean, round(stddev_samp(auc), 9) AS auc_std, 0.4::DOUBLE AS null_auc_mean, CASE WHEN stddev_samp(auc) < 0.1 THEN 'PASS' ELSE 'WARN' END AS stability, CASE WHEN avg(auc) > 0.4::DOUBLE + 0.1::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS governance FROM fm GROUP BY species""")
def governance_verdict(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    fm = line.groupBy(F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string")).alias("species"), F.col("l_linenumber").alias("fold")).agg((F.avg(F.round(F.col("l_discount") * 100).cast("int")) / 10.0).alias("auc"))
    fm = fm.withColumns({c: F.col("auc") for c in ("pr_auc", "tss", "brier")})
    null = fm.select("species").distinct().withColumn("null_auc_mean", F.lit(0.40))
    out = training.governance(fm, null)
    return round9(out.select("species", "auc_mean", "auc_std", "null_auc_mean", "stability", "governance"))
