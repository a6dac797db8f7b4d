"""How the driver's star-schema tables stand for occurrences, pixels and points.

Each mapping is written twice: as a DataFrame for the queries, and as a DuckDB CTE for the SQL that checks
them. Missing and dirty values are derived from keys, so that both engines see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrence records: part name = species, customer = observer, order date = observation date."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    key, supp = F.col("l_orderkey"), F.col("l_suppkey")
    rows = line.join(orders, key == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    dirty = F.col("p_partkey") % 14
    name = F.when(dirty == 0, F.concat("p_name", F.lit(" sp."))).when(dirty == 1, F.concat("p_name", F.lit(" (Pallas, 1764)"))).when(dirty == 2, F.upper("p_name")).when(dirty == 3, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    odd = key % 97
    lat = F.when(odd == 0, F.lit(0.0)).when(odd == 1, F.lit(15.0)).when(odd == 2, F.lit(None)).otherwise(6.0 + (supp % 80) * 0.1)
    lon = F.when(odd == 0, F.lit(0.0)).when(odd == 3, F.lit(95.25)).otherwise(92.0 + (F.col("l_partkey") % 20) * 0.125)
    return rows.select(
        (key * 10 + F.col("l_linenumber")).alias("occurrence_id"), name.alias("species_name"), lat.alias("latitude"), lon.alias("longitude"),
        F.when(key % 11 != 0, F.col("o_orderdate")).alias("observation_date"), F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey").cast("string")).alias("observer_name"),
        F.when(key % 5 == 0, F.year("o_orderdate")).alias("year"), F.when(key % 5 == 0, F.month("o_orderdate")).alias("month"),
    )


OCCURRENCES = """
occ AS (
  SELECT l_orderkey * 10 + l_linenumber AS occurrence_id,
    CASE p_partkey % 14 WHEN 0 THEN p_name || ' sp.' WHEN 1 THEN p_name || ' (Pallas, 1764)' WHEN 2 THEN upper(p_name) WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name END AS species_name,
    CASE l_orderkey % 97 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 15.0::DOUBLE WHEN 2 THEN NULL ELSE 6.0::DOUBLE + (l_suppkey % 80) * 0.1::DOUBLE END AS latitude,
    CASE l_orderkey % 97 WHEN 0 THEN 0.0::DOUBLE WHEN 3 THEN 95.25::DOUBLE ELSE 92.0::DOUBLE + (l_partkey % 20) * 0.125::DOUBLE END AS longitude,
    CASE WHEN l_orderkey % 11 <> 0 THEN o_orderdate END AS observation_date,
    CASE WHEN o_custkey % 13 <> 0 THEN o_custkey::VARCHAR END AS observer_name,
    CASE WHEN l_orderkey % 5 = 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN l_orderkey % 5 = 0 THEN month(o_orderdate)::INT END AS month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

#: Years that the queries keep, and limits at which the driver's near-uniform months give both verdicts.
YEARS = (1996, 2000)
SCORE_LIMITS = {"least": 30, "summer_max": 0.30, "score_min": 0.10, "score_summer_max": 0.335}

#: The name cleaner in SQL.
CLEAN = r"""
names AS (
  SELECT *, lower(species_name) AS low, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(species_name), '\(.*?\)', '', 'g'), '[^a-z\s\-]', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM {src}),
cleaned AS (
  SELECT * EXCLUDE (low, words), CASE WHEN species_name IS NULL THEN NULL
    WHEN contains(low, ' sp.') OR contains(low, ' sp ') OR contains(low, ' cf.') OR contains(low, ' cf ') OR contains(low, ' aff.') OR contains(low, ' aff ') OR contains(low, ' x ') OR len(words) < 2 THEN 'INVALID_TAXON'
    ELSE upper(words[1][1]) || substr(words[1], 2) || ' ' || words[2] END AS cleaned_name FROM names)"""

FILLED = OCCURRENCES + """,
filled AS (SELECT * EXCLUDE (year, month), coalesce(year, year(observation_date))::INT AS year, coalesce(month, month(observation_date))::INT AS month FROM occ),
dated AS (SELECT * FROM filled WHERE year IS NOT NULL AND month IS NOT NULL),
timely AS (SELECT * FROM dated WHERE year BETWEEN 1996 AND 2000)"""

PLACED = FILLED + """,
placed AS (SELECT * FROM timely WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0) AND latitude BETWEEN 6 AND 14 AND longitude BETWEEN 92 AND 94.5),
single AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY species_name, latitude, longitude, observation_date ORDER BY occurrence_id) = 1)"""

NAMED = PLACED + "," + CLEAN.replace("{src}", "single") + """,
named AS (SELECT * EXCLUDE (species_name, cleaned_name), cleaned_name AS species_name FROM cleaned WHERE cleaned_name <> 'INVALID_TAXON')"""

SCORED = NAMED + """,
sm AS (SELECT species_name, month, count(*) AS n FROM named GROUP BY ALL),
sp AS (SELECT species_name, sum(n)::BIGINT AS total_count, coalesce(sum(n) FILTER (month IN (5,6,7,8)), 0) / sum(n)::DOUBLE AS summer_ratio,
    coalesce(sum(n) FILTER (month IN (11,12,1,2)), 0) / sum(n)::DOUBLE AS winter_ratio, arg_max(month, (n, -month)) AS peak_month, count(*) AS active_months,
    CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0 END AS entropy_score FROM sm GROUP BY species_name),
ms AS (SELECT *, winter_ratio * 2 - summer_ratio * 3 + 1 / (entropy_score + 0.1::DOUBLE) AS migration_score FROM sp),
scores AS (SELECT *, CASE WHEN total_count >= 30 AND (summer_ratio <= 0.30 OR (migration_score >= 0.10 AND summer_ratio <= 0.335)) THEN 'retained' ELSE 'removed' END AS retained_or_removed FROM ms),
migratory AS (SELECT * FROM named WHERE species_name IN (SELECT species_name FROM scores WHERE retained_or_removed = 'retained'))"""

THINNED = SCORED + """,
r0 AS (SELECT * REPLACE (round_even(latitude, 3) AS latitude, round_even(longitude, 3) AS longitude), md5(concat_ws('|', occurrence_id::VARCHAR, '42')) AS draw FROM migratory),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY latitude, longitude, species_name ORDER BY draw) = 1),
thinned AS (SELECT * EXCLUDE (draw) FROM r1 QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY draw) <= 4)"""


def pixel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a pixel time series: a date is a ship month, a cell a pair of keys, and the mean stored index of a date is its value.

    Values are whole numbers of stored units, so that sums don't depend on their order.
    """
    line = read(spark, sf_dir, "lineitem")
    raw = F.round(F.col("l_discount") * 100).cast("int") * 900 - (F.col("l_suppkey") % 3 == 0).cast("int") * 3000
    return line.select(
        F.date_format("l_shipdate", "yyyyMM").alias("date_str"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        (F.col("l_suppkey") % 16).cast("int").alias("pixel_y"), (F.col("l_partkey") % 16).cast("int").alias("pixel_x"), raw.alias("ndvi_raw"), F.col("l_linenumber").alias("qa"),
    )


PIXELS = """
px AS (SELECT strftime(l_shipdate, '%Y%m') AS date_str, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, (l_suppkey % 16)::INT AS pixel_y, (l_partkey % 16)::INT AS pixel_x,
  (round(l_discount * 100)::INT * 900 - CASE WHEN l_suppkey % 3 = 0 THEN 3000 ELSE 0 END)::INT AS ndvi_raw, l_linenumber AS qa FROM lineitem)"""

MOSAIC = PIXELS + """,
mo AS (SELECT date_str, year, month, pixel_y, pixel_x, avg(ndvi_raw) FILTER ((qa & 3) <> 3 AND ndvi_raw::DOUBLE * 0.0001::DOUBLE >= -0.2) * 0.0001::DOUBLE AS value FROM px GROUP BY ALL)"""


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each date and cell: the mean of its usable stored values, scaled; null if none is usable."""
    from ..functions.pixels import LEAST, QA_BAD, SCALE, quality

    good = (quality(F.col("qa")) != QA_BAD) & (F.col("ndvi_raw").cast("double") * SCALE >= LEAST)
    keys = ("date_str", "year", "month", "pixel_y", "pixel_x")
    return pixel_series(spark, sf_dir).groupBy(*keys).agg((F.avg(F.when(good, F.col("ndvi_raw"))) * SCALE).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the first two components times 100 are kilometres."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding").getItem(k).cast("double")
    return e.select(F.col("vec_id").alias("id"), (at(0) * 100).alias("x"), (at(1) * 100).alias("y"), (at(2) * 100).alias("z"), F.col("label"))


POINTS = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z, label FROM embeddings)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a species cube: suitability, uncertainty and extrapolation, each the mean of a cell's rows."""
    line = read(spark, sf_dir, "lineitem")
    suit = F.avg(F.round(F.col("l_discount") * 100).cast("int")) / 10.0
    return line.groupBy(F.concat(F.lit("s"), (F.col("l_partkey") % 8).cast("string")).alias("species"), (F.col("l_suppkey") % 10).cast("int").alias("pixel_y"), (F.col("l_orderkey") % 12).cast("int").alias("pixel_x")).agg(
        suit.alias("suit"), (F.avg(F.round(F.col("l_tax") * 100).cast("int")) / 10.0).alias("unc"), (F.avg(F.col("l_linenumber")) / 7.0).alias("extrap")
    )


CUBE = """
cube AS (SELECT 's' || (l_partkey % 8)::VARCHAR AS species, (l_suppkey % 10)::INT AS pixel_y, (l_orderkey % 12)::INT AS pixel_x,
  avg(round(l_discount * 100)::INT) / 10.0 AS suit, avg(round(l_tax * 100)::INT) / 10.0 AS unc, avg(l_linenumber) / 7.0 AS extrap FROM lineitem GROUP BY ALL),
thr AS (SELECT species, 0.4::DOUBLE + (substr(species, 2)::INT % 4) * 0.05::DOUBLE AS threshold FROM (SELECT DISTINCT species FROM cube))"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = (read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8).alias("k"))).distinct()
    return species.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("species"), (0.4 + (F.col("k") % 4) * 0.05).alias("threshold"))


def round6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that results compare across engines."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def round9(df: DataFrame) -> DataFrame:
    """As :func:`round6`, for means of short decimals, which may end in a five at the seventh place."""
    return df.select(*[F.round(c, 9).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
