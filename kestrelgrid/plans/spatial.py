"""Distance joins, sampling and training-matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import fold_by_latitude
from ..operators import fuse, inference, sampling, spatial, stats
from .mapping import MOSAIC, POINTS, mosaics, points, read, round6
from .registry import query

_SIDES = POINTS + ", le AS (SELECT id, x, y FROM pt WHERE label % 2 = 0), ri AS (SELECT id, x, y FROM pt WHERE label % 2 = 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return p.where("label % 2 = 0").select("id", "x", "y"), p.where("label % 2 = 1").select("id", "x", "y")


@query("radius_anti_join", f"WITH {_SIDES} SELECT id FROM le WHERE NOT EXISTS (SELECT 1 FROM ri WHERE (le.x - ri.x) ** 2 + (le.y - ri.y) ** 2 <= 2.25)")
def radius_anti_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return spatial.radius_anti_join(left, right, 1.5).select("id")


@query("radius_self_join", f"WITH {POINTS} SELECT a.id, b.id AS right_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pt a, pt b WHERE a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1")
def radius_self_join(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", "x", "y")
    return round6(spatial.within(p, p, 1.0).where("id < right_id").select("id", "right_id", "distance"))


@query("knn_join", f"WITH {_SIDES}, d AS (SELECT le.id AS left_id, ri.id AS right_id, sqrt((le.x - ri.x) ** 2 + (le.y - ri.y) ** 2) AS distance FROM le, ri) SELECT left_id, right_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id)::INT AS rank FROM d QUALIFY rank <= 25")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return round6(spatial.knn(left, right, 25))


_FOLD = POINTS + ", fo AS (SELECT id, x, y, CASE WHEN z >= 8 THEN 'North_Andaman' WHEN z >= 0 THEN 'Middle_Andaman' WHEN z >= -8 THEN 'South_Andaman' ELSE 'Nicobar' END AS fold FROM pt)"


@query("seam_trim", f"""WITH {_FOLD}, p AS (SELECT a.id, a.fold AS fold_1, b.fold AS fold_2, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM fo a, fo b WHERE a.fold < b.fold GROUP BY ALL),
kept AS (SELECT * FROM fo WHERE id NOT IN (SELECT id FROM p WHERE d < 0.5)),
k AS (SELECT a.fold AS fold_1, b.fold AS fold_2, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS after_ FROM kept a, kept b WHERE a.fold < b.fold GROUP BY ALL)
SELECT fold_1, fold_2, round(min(d), 6) AS min_dist_before, round(any_value(after_), 6) AS min_dist_after, count(*) FILTER (d < 0.5) AS dropped FROM p LEFT JOIN k USING (fold_1, fold_2) GROUP BY ALL""")
def seam_trim(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", "x", "y", fold_by_latitude(F.col("z"), (8.0, 0.0, -8.0)).alias("fold"))
    _, report = spatial.seam_trim(p, "fold", 0.5)
    return round6(report)


_ORDER = "md5(concat_ws('|', {key}::VARCHAR, '42'))"
_U = "((('0x' || substr(" + _ORDER + ", 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"


@query("weighted_stratified_sample", f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS stratum FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY -ln({_U.format(key='(l_orderkey * 10 + l_linenumber)')}) / greatest(sqrt(l_quantity), 1e-12), l_orderkey * 10 + l_linenumber) <= CASE l_returnflag WHEN 'A' THEN 700 WHEN 'N' THEN 300 ELSE 100 END""")
def weighted_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("stratum"), "l_quantity")
    return sampling.weighted_stratified_sample(line, "stratum", "l_quantity", {"A": 700, "N": 300, "R": 100}, ["id"]).select("id", "stratum")


#: Points in their order one after the other, each kept if no kept one is near: (place, kept points).
_THIN = """o AS (SELECT id, x, y, row_number() OVER (ORDER BY {u}, id) AS n FROM {src}),
visit(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL
  SELECT o.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 <= {r} * {r})) = 0 THEN list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y}}) ELSE kept END FROM visit JOIN o ON o.n = visit.n + 1)"""


@query("greedy_thin", f"WITH RECURSIVE {POINTS}, {_THIN.format(u=_U.format(key='id'), src='pt', r='1.0::DOUBLE')} SELECT k.id AS id FROM (SELECT unnest(kept) AS k FROM visit WHERE n = (SELECT max(n) FROM o))")
def greedy_thin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.greedy_thin(points(spark, d).select("id", "x", "y"), 1.0).select("id")


@query("temporal_borrow", f"""WITH {_SIDES}, d AS (SELECT le.id, ri.id AS other, row_number() OVER (PARTITION BY le.id ORDER BY sqrt((le.x - ri.x) ** 2 + (le.y - ri.y) ** 2), ri.id) AS rank FROM le, ri QUALIFY rank <= 25),
c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, {_U.format(key='id')} AS u FROM d)
SELECT id, (2005 + other % 20)::INT AS year, (1 + other % 12)::INT AS month FROM c WHERE rank = floor(u * n) + 1""")
def temporal_borrow(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    right = right.withColumns({"year": (F.col("id") % 20 + 2005).cast("int"), "month": (F.col("id") % 12 + 1).cast("int")})
    return sampling.temporal_borrow(left, right).select("id", "year", "month")


@query("leakage_audit", f"""WITH {_SIDES}, n AS (SELECT le.id, arg_min(ri.id, (sqrt((le.x - ri.x) ** 2 + (le.y - ri.y) ** 2), ri.id)) AS other, min(sqrt((le.x - ri.x) ** 2 + (le.y - ri.y) ** 2)) AS d FROM le, ri GROUP BY le.id)
SELECT round(min(d), 6) AS min_dist, round(avg((id % 20 = other % 20)::INT) * 100, 6) AS same_year_overlap_pct, round(avg((id % 12 = other % 12)::INT) * 100, 6) AS same_month_overlap_pct FROM n""")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    left, right = (s.withColumns({"year": F.col("id") % 20, "month": F.col("id") % 12}) for s in _sides(spark, d))
    return round6(sampling.leakage_audit(left, right))


@query("season_alignment", "WITH a AS (SELECT month(o_orderdate)::INT AS month, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <> 2 GROUP BY 1), b AS (SELECT month(o_orderdate)::INT AS month, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus = 'O' AND month(o_orderdate) <> 3 GROUP BY 1) SELECT month, round(coalesce(a.p, 0), 6) AS presence_prop, round(coalesce(b.p, 0), 6) AS background_prop FROM a FULL JOIN b USING (month)")
def season_alignment(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderstatus", F.month("o_orderdate").alias("month"))
    return round6(sampling.season_alignment(o.where("o_orderstatus = 'F' AND month <> 2"), o.where("o_orderstatus = 'O' AND month <> 3"), "month"))


_SERIES = MOSAIC + ", ly AS (SELECT year, pixel_y, pixel_x, avg(value) AS mean_v, max(value) AS max_v, min(value) AS min_v FROM mo GROUP BY ALL HAVING count(value) > 0)"


@query("pixel_lookup_join", f"""WITH {_SERIES}, pt AS (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year, (o_custkey % 18)::INT AS pixel_y, (o_orderkey % 18)::INT AS pixel_x FROM orders)
SELECT id, year, pixel_y, pixel_x, round(mean_v, 9) AS mean_v, max_v, CASE WHEN pixel_x <> 3 THEN min_v END AS min_v FROM pt JOIN ly USING (year, pixel_y, pixel_x) WHERE (pixel_x <> 3)::INT + 2 >= 3""")
def pixel_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    layers = mosaics(spark, d).groupBy("year", "pixel_y", "pixel_x").agg(F.avg("value").alias("mean_v"), F.max("value").alias("max_v"), F.min("value").alias("min_v")).where("mean_v IS NOT NULL")
    layers = layers.withColumn("min_v", F.when(F.col("pixel_x") != 3, F.col("min_v"))).unpivot(["year", "pixel_y", "pixel_x"], ["mean_v", "max_v", "min_v"], "layer", "value")
    pts = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 18).cast("int").alias("pixel_y"), (F.col("o_orderkey") % 18).cast("int").alias("pixel_x"))
    out = spatial.year_lookup(pts, layers, ["mean_v", "max_v", "min_v"], 3, 3)
    return out.select("id", "year", "pixel_y", "pixel_x", F.round("mean_v", 9).alias("mean_v"), "max_v", "min_v")


_DYN = """
dyn AS (SELECT (l_linenumber % 2)::INT AS target, l_orderkey AS original_row_id, l_linenumber AS line, (l_linenumber * 3)::INT AS ndvi_valid_count, l_discount AS ndvi_mean FROM lineitem),
lan AS (SELECT (o_custkey % 2)::INT AS target, o_orderkey AS original_row_id, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 400)::DOUBLE END AS static_elevation, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 11)::DOUBLE END AS static_dist_water FROM orders)"""
_DERIVED = "CASE WHEN static_elevation < 100 THEN 1 ELSE 0 END AS is_lowland, CASE WHEN static_elevation > 300 THEN 1 ELSE 0 END AS is_highland, round(ndvi_valid_count / 23.0::DOUBLE, 6) AS ndvi_valid_fraction, (static_elevation IS NULL)::INT AS static_elevation_missing_flag, (static_dist_water IS NULL)::INT AS static_dist_water_missing_flag"


def _matrices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, c = F.col("l_linenumber"), F.col("o_custkey")
    dyn = read(spark, d, "lineitem").select((n % 2).cast("int").alias("target"), F.col("l_orderkey").alias("original_row_id"), n.alias("line"), (n * 3).cast("int").alias("ndvi_valid_count"), F.col("l_discount").alias("ndvi_mean"))
    lan = read(spark, d, "orders").select((c % 2).cast("int").alias("target"), F.col("o_orderkey").alias("original_row_id"), F.when(c % 7 != 0, (c % 400).cast("double")).alias("static_elevation"), F.when(c % 5 != 0, (c % 11).cast("double")).alias("static_dist_water"))
    return dyn, lan


def _fused(spark: SparkSession, d: str, compat: bool) -> DataFrame:
    out = fuse.fuse(*_matrices(spark, d), compat=compat)
    out = fuse.indicators(out, "static_elevation", "static_dist_water", "ndvi_valid_count")
    return round6(out.select("target", "original_row_id", "line", "is_lowland", "is_highland", "ndvi_valid_fraction", "static_elevation_missing_flag", "static_dist_water_missing_flag"))


@query("matrix_fuse", f"WITH {_DYN} SELECT target, original_row_id, line, {_DERIVED} FROM dyn JOIN lan USING (target, original_row_id)")
def matrix_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, compat=False)


@query("matrix_fuse_compat", f"WITH {_DYN} SELECT dyn.target, original_row_id, line, {_DERIVED} FROM dyn JOIN lan USING (original_row_id)")
def matrix_fuse_compat(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, compat=True)


@query("ecological_assertions", f"WITH {_DYN} SELECT 'Elevation >= 100' AS check, count(*) FILTER (static_elevation < 100) AS fail_count FROM lan UNION ALL SELECT 'Water <= 9', count(*) FILTER (static_dist_water > 9) FROM lan")
def ecological_assertions(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    return fuse.assertions(lan, {"Elevation >= 100": F.col("static_elevation") < 100, "Water <= 9": F.col("static_dist_water") > 9})


@query("landscape_flags", f"""WITH {_DYN} SELECT CASE WHEN static_elevation < 20 OR static_dist_water < 0.1 THEN 'LOW' WHEN static_elevation > 300 THEN 'MEDIUM' ELSE 'HIGH' END AS terrain_confidence_flag,
CASE WHEN static_dist_water < 5 THEN 1 ELSE 0 END AS coastal_zone_flag, count(*) AS n FROM lan GROUP BY ALL""")
def landscape_flags(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    shifted = lan.withColumn("e", F.when(F.col("static_elevation") < 20, -1.0).otherwise(F.when(F.col("static_elevation") > 300, 501.0).when(F.col("static_elevation").isNotNull(), 100.0)))
    return fuse.landscape_flags(shifted, "e", "static_dist_water").groupBy("terrain_confidence_flag", "coastal_zone_flag").agg(F.count(F.lit(1)).alias("n"))


@query("median_impute", f"WITH {_DYN}, m AS (SELECT quantile_cont(static_elevation, 0.5) AS a, quantile_cont(static_dist_water, 0.5) AS b FROM lan) SELECT original_row_id, coalesce(static_elevation, a) AS static_elevation, coalesce(static_dist_water, b) AS static_dist_water FROM lan, m")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    return fuse.median_impute(lan, ["static_elevation", "static_dist_water"]).select("original_row_id", "static_elevation", "static_dist_water")


@query("imputation_audit", f"WITH {_DYN} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS imputed, round(avg(({c} IS NULL)::INT) * 100, 6) AS imputed_pct FROM lan" for c in ("static_elevation", "static_dist_water")))
def imputation_audit(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    return round6(fuse.imputation_audit(lan, ["static_elevation", "static_dist_water"]))


@query("retention_by_class", f"WITH {_DYN} SELECT target, count(*) AS before, count(*) FILTER (static_elevation IS NOT NULL) AS after, round(count(*) FILTER (static_elevation IS NOT NULL) * 100.0 / count(*), 6) AS retained_pct FROM lan GROUP BY 1")
def retention_by_class(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    return round6(fuse.retention(lan, lan.where("static_elevation IS NOT NULL"), "target"))


@query("complete_rows", f"WITH {_DYN} SELECT round(avg((static_elevation IS NOT NULL AND static_dist_water IS NOT NULL)::INT) * 100, 6) AS complete_row_pct FROM lan")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    _, lan = _matrices(spark, d)
    return round6(fuse.complete_share(lan, ["static_elevation", "static_dist_water"]))


_VALUES = ("l_quantity", "l_discount", "l_tax")


@query("ks_statistic", """WITH v AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS g FROM lineitem), h AS (SELECT v, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM v GROUP BY v)
SELECT round(max(gap), 6) AS ks_stat FROM (SELECT abs(sum(a) OVER w / (sum(a) OVER ())::DOUBLE - sum(b) OVER w / (sum(b) OVER ())::DOUBLE) AS gap FROM h WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))""")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.ks_statistic(read(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("g")), "l_extendedprice", "g"))


def _cohen(c: str) -> str:
    s = lambda f, g: f"{f}({c}) FILTER (l_returnflag {g} 'R')"
    pooled = f"sqrt(({s('var_samp', '=')} + {s('var_samp', '<>')}) / 2)"
    return f"SELECT '{c}' AS feature, round(({s('avg', '=')} - {s('avg', '<>')}) / greatest({pooled}, 1e-8), 6) AS cohens_d FROM lineitem"


@query("cohens_d", " UNION ALL ".join(map(_cohen, _VALUES)))
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.cohens_d(read(spark, d, "lineitem").withColumn("g", F.col("l_returnflag") == "R"), list(_VALUES), "g"))


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_VALUES) for b in _VALUES[i:]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.correlation(read(spark, d, "lineitem"), list(_VALUES)))


def _det(rows: tuple[int, ...], cols: tuple[int, ...]) -> str:
    """The determinant of some rows and columns of the matrix of sums g<i>_<j>, by its first row."""
    if not rows:
        return "1.0::DOUBLE"
    parts = [f"{'-' if k % 2 else '+'} g{min(rows[0], c)}_{max(rows[0], c)} * ({_det(rows[1:], cols[:k] + cols[k + 1 :])})" for k, c in enumerate(cols)]
    return " ".join(parts)


_GRAM = (*_VALUES, "l_linenumber")
_ALL4 = tuple(range(4))
_VIF = "WITH g AS (SELECT " + ", ".join(f"sum({a}::DOUBLE * {b}) AS g{i}_{j}" for i, a in enumerate(_GRAM) for j, b in enumerate(_GRAM) if j >= i) + " FROM lineitem) "
_VIF += " UNION ALL ".join(f"SELECT '{c}' AS feature, round(g{i}_{i} * ({_det(_ALL4[:i] + _ALL4[i + 1 :], _ALL4[:i] + _ALL4[i + 1 :])}) / ({_det(_ALL4, _ALL4)}), 6) AS vif FROM g" for i, c in enumerate(_GRAM))


@query("vif", _VIF)
def vif(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.vif(read(spark, d, "lineitem"), [*_VALUES, "l_linenumber"]))


@query("missing_infinite", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg((v IS NULL)::INT) * 100, 6) AS missing_pct, round(avg((coalesce(isinf(v), false))::INT) * 100, 6) AS invalid_pct FROM (SELECT CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'inf'::DOUBLE ELSE {c} END AS v FROM lineitem)" for c in ("l_quantity", "l_tax")))
def missing_infinite(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    odd = lambda c: F.when(n == 3, F.lit(None)).when(n == 4, F.lit(float("inf"))).otherwise(F.col(c)).alias(c)
    return round6(stats.infinite_share(read(spark, d, "lineitem").select(odd("l_quantity"), odd("l_tax")), ["l_quantity", "l_tax"]))


@query("ecdf", "SELECT DISTINCT l_quantity, round(cume_dist() OVER (ORDER BY l_quantity), 6) AS ecdf FROM lineitem")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.ecdf(read(spark, d, "lineitem"), "l_quantity"))


@query("topk_rank", "SELECT p_name, sum(l_quantity)::DOUBLE AS total, row_number() OVER (ORDER BY sum(l_quantity) DESC, p_name)::INT AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name QUALIFY rank <= 15")
def topk_rank(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    total = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("l_quantity").alias("total"))
    top = total.orderBy(F.desc("total"), "p_name").limit(15)  # the report has fifteen rows
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "p_name")))


@query("confidence_bins", "WITH m AS (SELECT max(l_quantity) AS m FROM lineitem) SELECT CASE WHEN l_quantity <= m * 0.5 THEN 'LOW' WHEN l_quantity <= m * 0.8 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence_flag, count(*) AS n FROM lineitem, m GROUP BY 1")
def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    return stats.confidence_bins(read(spark, d, "lineitem"), "l_quantity").groupBy("confidence_flag").agg(F.count(F.lit(1)).alias("n"))


_SCORED = "sc AS (SELECT (l_returnflag = 'R')::INT AS y, (l_quantity * 3 + l_linenumber * 13) % 101 / 101.0::DOUBLE AS s FROM lineitem)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_quantity") * 3 + F.col("l_linenumber") * 13) % 101 / 101.0).alias("s"))


_H = _SCORED + ", h AS (SELECT s, sum(y)::BIGINT AS p, count(*) - sum(y)::BIGINT AS n FROM sc GROUP BY s)"


@query("roc_auc", f"WITH {_H} SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n))::DOUBLE, 6) AS roc_auc FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - n AS below FROM h)")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.roc_auc(_scored(spark, d), "y", "s"))


@query("avg_precision", f"WITH {_H} SELECT round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS avg_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.average_precision(_scored(spark, d), "y", "s"))


@query("brier_ece", f"WITH {_SCORED}, b AS (SELECT least(floor(s * 10), 9) AS bin, avg(y) AS o, avg(s) AS p FROM sc GROUP BY 1) SELECT (SELECT round(avg((s - y) ** 2), 6) FROM sc) AS brier, round(avg(abs(o - p)), 6) AS ece FROM b")
def brier_ece(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.brier_ece(_scored(spark, d), "y", "s"))


@query("tss_threshold", f"""WITH {_SCORED}, t AS (SELECT k, k / 100.0::DOUBLE AS th FROM range(1, 100) r(k)),
m AS (SELECT k, th, count(*) FILTER (y = 1 AND s >= th) / (count(*) FILTER (y = 1))::DOUBLE + count(*) FILTER (y = 0 AND s < th) / (count(*) FILTER (y = 0))::DOUBLE - 1 AS tss FROM sc, t GROUP BY ALL)
SELECT arg_max(th, (tss, -k)) AS threshold, round(max(tss), 6) AS tss FROM m""")
def tss_threshold(spark: SparkSession, d: str) -> DataFrame:
    return round6(stats.tss_threshold(_scored(spark, d), "y", "s"))


@query("confusion", f"WITH {_SCORED} SELECT count(*) FILTER (y = 0 AND s < 0.5) AS tn, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 1 AND s >= 0.5) AS tp FROM sc")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(_scored(spark, d), "y", "s", 0.5)


@query("split_validation", f"""WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS label FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U.format(key='id')}, id) AS k, count(*) OVER (PARTITION BY label) AS n FROM n)
SELECT id, label, k <= round(n * 0.1::DOUBLE) AS is_validation FROM r""")
def split_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"))
    return sampling.split(rows, "label", ["id"])


@query("label_permutation", f"""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT o_orderstatus AS label, row_number() OVER (ORDER BY {_U.format(key='o_orderkey')}, o_orderkey) AS k FROM orders) SELECT id, label FROM a JOIN b USING (k)""")
def label_permutation(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permute(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label")), "label", "id", 42)


_ENS = "en AS (SELECT (l_suppkey % 20)::INT AS pixel_y, (l_partkey % 20)::INT AS pixel_x, l_linenumber AS fold, round(l_discount * 100)::INT / 10.0::DOUBLE AS score FROM lineitem)"


@query("ensemble_stats", f"WITH {_ENS}, m AS (SELECT pixel_y, pixel_x, count(*) AS folds, avg(score) AS m, stddev_pop(score) AS s FROM en GROUP BY ALL HAVING count(*) >= 3) SELECT pixel_y, pixel_x, folds, round(least(greatest(m, 0.001), 0.999), 6) AS suitability, round(s, 6) AS uncertainty_std, CASE WHEN m > 0.05 THEN round(least(s / least(greatest(m, 0.001), 0.999), 5), 6) ELSE 0 END AS uncertainty_cv FROM m")
def ensemble_stats(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("pixel_y"), (F.col("l_partkey") % 20).cast("int").alias("pixel_x"), (F.round(F.col("l_discount") * 100).cast("int") / 10.0).alias("score"))
    return round6(inference.ensemble(line, ["pixel_y", "pixel_x"], least_folds=3))


@query("extrapolation_score", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem WHERE l_linenumber = 1 AND l_quantity BETWEEN 10 AND 40) SELECT l_orderkey, l_linenumber, ((l_quantity < a OR l_quantity > b)::INT + (l_tax < c OR l_tax > d)::INT) / 2.0::DOUBLE AS extrapolation FROM lineitem, e")
def extrapolation_score(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    train = line.where("l_linenumber = 1 AND l_quantity BETWEEN 10 AND 40")
    return inference.extrapolation(line, train, ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "extrapolation")


