"""Queries that write files from the driver's tables and read them back: CSV, JSON, Parquet, TIFF, model folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import to_null
from ..operators import training
from ..sources import occurrence as src
from ..sources import pixels, sinks
from ..sources.scratch import new_path
from .mapping import YEARS, read, round6
from .raster import _RASTER, H, W_, _raster
from .registry import query


def _write_text(spark: SparkSession, lines: DataFrame, header: str, path: str) -> None:
    """CSV lines under a header that is written as it stands; a file for the header's rows alone would hold no data, so each part begins with it."""
    head = spark.range(1).select(F.lit(header).alias("value"), F.lit(0).alias("k"))
    lines.select("value", F.lit(1).alias("k")).unionByName(head).coalesce(1).sortWithinPartitions("k", "value").select("value").write.option("lineSep", "\n").text(path)


def _csv_folder(spark: SparkSession, d: str) -> str:
    """Customers and suppliers as CSV with unlike, repeated, quoted and digit-ended headers; an empty file beside them. Text parts are named .txt, so they are moved to .csv."""
    folder = new_path(spark, "csv")
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    c = read(spark, d, "customer")
    first = F.concat_ws(",", "c_custkey", q(F.col("c_name")), F.lit("x"), q(F.concat("c_mktsegment", F.lit(", full"))), (F.col("c_nationkey") * 0.25).cast("string"), F.lit("92.5"), F.lit(""), F.col("c_custkey") % 7)
    _write_text(spark, c.select(first.alias("value")), 'gbifID,scientificName,species,"segment, full",decimalLatitude,Longitude,empty,note2', f"{folder}/a")
    s = read(spark, d, "supplier")
    second = F.concat_ws(",", "s_suppkey", q(F.col("s_name")), (F.col("s_nationkey") * 0.25).cast("string"), F.lit("99"), F.lit("93"))
    _write_text(spark, s.select(second.alias("value")), "id,taxon,LAT,lat,lon", f"{folder}/b")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("a", "b"):
        fs = hadoop.Path(folder).getFileSystem(conf)
        found = next(f.getPath() for f in fs.listStatus(hadoop.Path(f"{folder}/{part}")) if f.getPath().getName().startswith("part-"))
        fs.rename(found, hadoop.Path(f"{folder}/{part}.csv"))
        fs.delete(hadoop.Path(f"{folder}/{part}"), True)
    fs.create(hadoop.Path(f"{folder}/none.csv")).close()
    return folder


@query("csv_occurrences", """
SELECT c_custkey::VARCHAR AS occurrence_id, c_name AS species_name, c_mktsegment || ', full' AS segment, c_nationkey * 0.25::DOUBLE AS latitude, 92.5::DOUBLE AS longitude, (c_custkey % 7)::VARCHAR AS note2, 'a.csv' AS source_file FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL, s_nationkey * 0.25::DOUBLE, 93::DOUBLE, NULL, 'b.csv' FROM supplier""")
def csv_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Recursive discovery, header groups, repeated and quoted headers, aliases, the outer union and the lineage column."""
    df, _ = src.read_occurrences(spark, _csv_folder(spark, d))
    return df.select("occurrence_id", "species_name", F.col("segment, full").alias("segment"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "note2", "source_file")


@query("csv_schema_audit", """
SELECT * FROM (VALUES ('a.csv', 8, '', 'decimallatitude|empty|gbifid|longitude|note2|scientificname|segment, full|species'), ('b.csv', 5, 'duplicates: lat', 'id|lat|lon|taxon'), ('none.csv', 0, 'empty', '')) v(file, columns, note, names)""")
def csv_schema_audit(spark: SparkSession, d: str) -> DataFrame:
    _, audit = src.read_occurrences(spark, _csv_folder(spark, d))
    return spark.createDataFrame(audit, "file string, columns int, note string, names string")


@query("csv_projected", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderstatus AS status FROM orders")
def csv_projected(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV in two goes (overwrite, then append), and a scan of some of its columns with types; what doesn't parse is null."""
    path = new_path(spark, "report")
    price = F.when(F.col("o_orderkey") % 4 != 0, F.round("o_totalprice", 2).cast("string")).otherwise("n/a")
    rows = read(spark, d, "orders").select("o_orderkey", price.alias("price"), F.col("o_orderstatus").alias("status"), F.lit("unused").alias("other"))
    sinks.write_report(rows.where("status = 'F'"), path)
    sinks.write_report(rows.where("status <> 'F'"), path, append=True)
    return src.read_projected(spark, path, {"o_orderkey": "bigint", "price": "double", "status": "string"})


@query("csv_inferred", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "report")
    sinks.write_report(read(spark, d, "supplier"), path)
    return round6(src.read_inferred(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal"))


@query("parquet_round_trip", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written with partition columns; a second writer that skips what exists, and a third that overwrites."""
    path, o = new_path(spark, "table"), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_table(o.limit(1), path, by=["o_orderstatus"])
    sinks.write_table(o, path, by=["o_orderstatus"])
    sinks.write_table(o.limit(1), path, by=["o_orderstatus"], skip_existing=True)
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "o_orderstatus", "o_custkey")


@query("json_manifest", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS observers, max(o_totalprice) AS highest, 'v1' AS version FROM orders")
def json_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "manifest")
    counts = F.struct(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("observers"), F.max("o_totalprice").alias("highest"))
    sinks.write_manifest(read(spark, d, "orders").agg(counts.alias("counts")).select("counts", F.lit("v1").alias("version")), path)
    return pixels.read_json(spark, path).select("counts.orders", "counts.observers", "counts.highest", "version")


@query("reference_grid", "SELECT 'EPSG:4326' AS epsg, 24 AS xs, 24 AS ys, 92.0::DOUBLE AS origin_x, -0.4::DOUBLE AS step_y")
def reference_grid(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "grid")
    geo = F.array(*[F.lit(x) for x in (92.0, 0.1, 0.0, 14.0, 0.0, -0.4)])
    sinks.write_manifest(spark.range(1).select(F.lit("WGS84").alias("proj"), F.lit("EPSG:4326").alias("epsg"), geo.alias("geo"), F.lit(W_).alias("xs"), F.lit(H).alias("ys")), path)
    return pixels.read_grid(spark, path).select("epsg", "xs", "ys", F.col("geo")[0].alias("origin_x"), F.col("geo")[5].alias("step_y"))


def _small_files(spark: SparkSession, names: list[str]) -> str:
    folder = new_path(spark, "files")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in names:
        at = hadoop.Path(f"{folder}/{n}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(0)  # Spark passes over empty files
        out.close()
    return folder


@query("tile_discovery", "SELECT 'A' || (2000 + r_regionkey)::VARCHAR || '001' AS date_str, 2 AS tiles FROM region")
def tile_discovery(spark: SparkSession, d: str) -> DataFrame:
    keys = [r.r_regionkey for r in read(spark, d, "region").select("r_regionkey").collect()]  # a row a region
    folder = _small_files(spark, [f"{t}/MOD.A{2000 + k}001.{t}.hdf" for k in keys for t in ("h1", "h2")] + ["h1/notes.txt"])
    return pixels.tiles_by_date(spark, folder).groupBy("date_str").agg(F.count(F.lit(1)).cast("int").alias("tiles"))


@query("layer_discovery", "SELECT 's' || r_regionkey::VARCHAR || '_suitability.tif' AS file FROM region")
def layer_discovery(spark: SparkSession, d: str) -> DataFrame:
    keys = [r.r_regionkey for r in read(spark, d, "region").select("r_regionkey").collect()]  # a row a region
    folder = _small_files(spark, [f"s{k}_{w}.tif" for k in keys for w in ("suitability", "uncertainty")])
    return pixels.layer_files(spark, folder, "_suitability.tif").select(F.element_at(F.split("path", "/"), -1).alias("file"))


@query("subdataset_lookup", "SELECT * FROM (VALUES ('ndvi', 'sds1'), ('RELIABILITY', 'sds2'), ('albedo', NULL)) v(keyword, found)")
def subdataset_lookup(spark: SparkSession, d: str) -> DataFrame:
    listed = [("sds1", "250m 16 days NDVI"), ("sds2", "pixel reliability"), ("sds3", "250m NDVI quality")]
    return spark.createDataFrame([(k, pixels.pick_subdataset(listed, k)) for k in ("ndvi", "RELIABILITY", "albedo")], "keyword string, found string")


@query("tiff_round_trip", f"WITH {_RASTER} SELECT 'cells' AS layer, pixel_y, pixel_x, value FROM ra")
def tiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A raster scattered into a tiled, compressed file with nodata, and read back as the cells that have a value."""
    folder = new_path(spark, "tiff")
    cells = _raster(spark, d).select(F.lit("cells").alias("layer"), "pixel_y", "pixel_x", "value")
    pixels.write_tiffs(cells.where("value IS NOT NULL"), folder, H, W_, [92.0, 0.1, 0.0, 14.0, 0.0, -0.4], tile=16)
    return pixels.read_tiff_layers(spark, folder)


@query("sentinel_round_trip", f"WITH {_RASTER} SELECT count(*) AS cells, count(value) AS valid, sum(value) AS total FROM ca")
def sentinel_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nulls become the sentinel for a sink, and null again when read."""
    out = sinks.sentinel(_raster(spark, d), ["value"]).withColumn("value", to_null(F.col("value"), -9999.0))
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), F.sum("value").alias("total"))


@query("markdown_dossier", """WITH a AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT 2 + row_number() OVER (ORDER BY status) AS k, '| ' || status || ' | ' || n || ' |' AS line FROM a)
SELECT line FROM l UNION ALL SELECT * FROM (VALUES ('# Orders'), (''), ('| status | n |'), ('|---|---|')) v(line)""")
def markdown_dossier(spark: SparkSession, d: str) -> DataFrame:
    report = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("status")
    return spark.createDataFrame([(x,) for x in sinks.markdown(report, "Orders").rstrip("\n").split("\n")], "line string")


@query("error_log", "SELECT 's' || r_regionkey::VARCHAR AS species, 'failed' AS error, (r_regionkey % 2)::INT AS run FROM region")
def error_log(spark: SparkSession, d: str) -> DataFrame:
    """Errors of two runs in one log: the second is appended."""
    path, r = new_path(spark, "log"), F.col("r_regionkey")
    for run in (0, 1):
        sinks.write_report(read(spark, d, "region").where(r % 2 == run).select(F.concat(F.lit("s"), r.cast("string")).alias("species"), F.lit("failed").alias("error"), F.lit(run).alias("run")), path, append=run > 0)
    return spark.read.option("header", True).schema("species string, error string, run int").csv(path)


@query("feature_manifest", """SELECT * FROM (VALUES ('ndvi_mean', 'MODIS MOD13Q1', '500m', 'Yearly Mean'), ('static_elevation', 'SRTM 30m', '30m->500m', 'Bilinear Warp'), ('static_slope', 'SRTM 30m', '30m', 'Native DEMProcessing (Slope)'),
('static_terrain_roughness', 'SRTM 30m', '30m', 'Native DEMProcessing (TRI)'), ('static_dist_coast', 'NDVI Landmask', '500m', 'EDT (Inland Directed)'), ('coastal_zone_flag', 'Derived', '500m', 'Dist < 5km')) v(feature, source, res, method)""")
def feature_manifest(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fuse import feature_manifest as manifest

    return manifest(spark)


@query("saved_models", "SELECT 'Calidris alba' AS species, k::INT AS fold, count(*) AS cells FROM embeddings, range(0, 4) r(k) GROUP BY ALL")
def saved_models(spark: SparkSession, d: str) -> DataFrame:
    """Fold models written, loaded again and run over all cells: how many scores within (0, 1) each fold gives."""
    from .ecosystem import FEATURES, _training

    rows, folder = _training(spark, d), new_path(spark, "models")
    training.spatial_cv(rows, FEATURES, "vec_id", save_to=folder, species="Calidris alba")
    cells = rows.withColumns({"pixel_y": F.col("vec_id"), "pixel_x": F.lit(0)})
    scores = training.ensemble_scores(spark, cells, FEATURES, folder, "Calidris alba").where("score > 0 AND score < 1")
    return scores.groupBy(F.lit("Calidris alba").alias("species"), "fold").agg(F.count(F.lit(1)).alias("cells"))


@query("workflow_attrition", f"""WITH c AS (SELECT upper(r[1]) || substr(r, 2) AS species_name, l_orderkey % 60 * 0.1::DOUBLE + 6 AS latitude, 92 + l_partkey % 20 * 0.125::DOUBLE AS longitude, o_orderdate::DATE AS seen, l_orderkey * 10 + l_linenumber AS id
  FROM (SELECT *, ['anas crecca', 'calidris alba', 'corvus'][l_suppkey % 3 + 1] AS r FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT * FROM c WHERE year(seen) BETWEEN {YEARS[0]} AND {YEARS[1]}), p AS (SELECT * FROM t WHERE latitude <= 10), s AS (SELECT DISTINCT species_name, latitude, longitude, seen FROM p), n AS (SELECT * FROM s WHERE contains(species_name, ' ')),
g AS (SELECT least(4, count(DISTINCT species_name)) AS k FROM n GROUP BY round_even(latitude, 3), round_even(longitude, 3))
SELECT * FROM (SELECT '1_Ingestion' AS step, (SELECT count(*) FROM c) AS records UNION ALL SELECT '2_FeatureDensity', (SELECT count(*) FROM c) UNION ALL SELECT '3_Temporal', (SELECT count(*) FROM t) UNION ALL SELECT '4_Spatial', (SELECT count(*) FROM p)
UNION ALL SELECT '4.5_Duplicates', (SELECT count(*) FROM s) UNION ALL SELECT '5_Taxonomy', (SELECT count(*) FROM n) UNION ALL SELECT '6_Migratory', (SELECT count(*) FROM n) UNION ALL SELECT '7_Thinning', (SELECT sum(k)::BIGINT FROM g))""")
def workflow_attrition(spark: SparkSession, d: str) -> DataFrame:
    """The occurrence workflow from CSV files to its attrition report, all steps in their order."""
    from .workflows import occurrence_workflow

    folder = new_path(spark, "workflow")
    line = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.element_at(F.array(*map(F.lit, ("Anas crecca", "Calidris alba", "Corvus"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name.alias("scientificName"), (F.col("l_orderkey") % 60 * 0.1 + 6).alias("decimalLatitude"), (92 + F.col("l_partkey") % 20 * 0.125).alias("decimalLongitude"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("eventDate"), F.col("o_custkey").alias("recordedBy"),
    )
    rows.write.option("header", True).csv(f"{folder}/in")
    occurrence_workflow(spark, f"{folder}/in", f"{folder}/out", years=YEARS, box=(6.0, 10.0, 92.0, 94.5), score={"least": 1, "summer_max": 1.0})
    return spark.read.option("header", True).csv(f"{folder}/out/species_attrition_tracking").select("step", F.col("records").cast("long").alias("records"))


@query("clean_folder", "SELECT 1 AS runs, count(*) AS records FROM nation")
def clean_folder(spark: SparkSession, d: str) -> DataFrame:
    """A report written twice holds one run's rows."""
    path = new_path(spark, "report")
    for run in (0, 1):
        sinks.write_report(read(spark, d, "nation").withColumn("run", F.lit(run)), path)
    return spark.read.option("header", True).csv(path).agg(F.count_distinct("run").cast("int").alias("runs"), F.count(F.lit(1)).alias("records"))

