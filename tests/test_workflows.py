import random

import pytest
from pyspark.sql import functions as F

from kestrelgrid.operators import training
from kestrelgrid.plans import workflows


def test_occurrence_files_to_presences(spark, tmp_path):
    rnd = random.Random(1)
    lines = ["decimalLatitude,decimalLongitude,scientificName,eventDate,recordedBy,notes"]
    for k in range(400):
        lines.append(f"{7 + rnd.random():.4f},{92 + rnd.random():.4f},Calidris alba,2010-{rnd.choice((1, 2, 11, 12)):02d}-{rnd.randint(1, 28):02d},o{k % 5},")
        lines.append(f"{7 + rnd.random():.4f},{92 + rnd.random():.4f},Corvus corax,2011-{rnd.randint(5, 8):02d}-{rnd.randint(1, 28):02d},o{k % 7},")
    lines += ["7.5,92.5,Calidris alba,2010-01-05,o1,"] * 3 + ["0,0,Calidris alba,2010-01-05,o1,", "8,93,Anas sp.,2010-01-05,o1,", "8,93,Calidris alba,1990-01-05,o1,"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines))
    out = workflows.occurrence_workflow(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = out.groupBy("species_name").count().collect()
    assert [r.species_name for r in got] == ["Calidris alba"]
    steps = {r.step: int(r.records) for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "species_attrition_tracking")).collect()}
    assert steps["1_Ingestion"] == 806 and steps["3_Temporal"] == 805 and steps["4_Spatial"] == 804 and steps["4.5_Duplicates"] == 802 and steps["5_Taxonomy"] == 801
    assert spark.read.parquet(str(tmp_path / "out" / "presences")).count() == steps["7_Thinning"]


def test_tiles_to_yearly_layers(spark, tmp_path):
    rows = [(f"A2010{doy:03d}", f"t{t}", y, x, 3000 + 100 * t + doy, q) for doy in range(1, 366, 16) for t in (1, 2) for y in range(3) for x in range(3) for q in ([3] if (t, x) == (2, 0) else [0])]
    px = spark.createDataFrame(rows, "date_str string, tile string, pixel_y int, pixel_x int, ndvi_raw int, qa int")
    years = workflows.index_workflow(px, str(tmp_path), 9)
    got = {(r.pixel_y, r.pixel_x): r for r in years.collect()}
    assert len(got) == 9
    assert got[0, 1].ndvi_mean - got[0, 0].ndvi_mean == pytest.approx(0.01)
    assert got[0, 0].ndvi_valid_count == 23
    assert spark.read.parquet(str(tmp_path / "yearly_layers")).select("layer").distinct().count() == 14


def test_matrix_to_ecosystem(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for k in range(240):
        a = rnd.random()
        species, target = ("Calidris alba", 1) if k % 3 == 0 else ("BACKGROUND", 0)
        rows.append((k, species, target, ["N", "M", "S", "X"][k % 4], a + target, rnd.random()))
    rows.append((999, "Rare bird", 1, "N", 1.0, 0.5))
    matrix = spark.createDataFrame(rows, "row_id long, species_name string, target int, spatial_fold string, ndvi_mean double, ndvi_std double")
    grid = spark.range(30).select(F.lit(0).alias("pixel_y"), F.col("id").cast("int").alias("pixel_x"), (F.col("id") / 12).alias("ndvi_mean"), F.when(F.col("id") != 4, F.col("id") / 30).alias("ndvi_std"), F.lit(20).alias("ndvi_valid_count"), F.lit(10.0).alias("static_elevation"))
    out = workflows.model_workflow(spark, matrix, grid, ["ndvi_mean", "ndvi_std"], "row_id", str(tmp_path), choose=lambda n: training.Tier(2, 2, 0.3)).orderBy("pixel_x").collect()
    assert len(out) == 30
    assert out[-1].mean_suit > 0.5 > out[0].mean_suit
    assert {r.hotspot for r in out} <= {0, 1}
    assert out[-1].mean_extrap == 0.5 and out[10].mean_extrap == 0.0
