import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions import coords, pixels
from kestrelgrid.operators import stack, stencil
from kestrelgrid.plans.catalog import ORACLES, QUERIES


def table(spark, a):
    data = [(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if not np.isnan(a[y, x])]
    return spark.createDataFrame(data, "pixel_y int, pixel_x int, value double")


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r.pixel_y, r.pixel_x] = r[column]
    return out


def padded(a, n):
    return np.pad(a, n, mode="symmetric")


@pytest.fixture(scope="module")
def raster():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, (9, 7)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    return a


def test_focal_reflects_edges_and_fills_holes(spark, raster):
    p = padded(raster, 1)
    win = np.stack([p[i : i + 9, j : j + 7] for i in range(3) for j in range(3)])
    got = stencil.focal(table(spark, raster), 9, 7)
    np.testing.assert_allclose(array(got, "focal_mean", raster.shape), np.nanmean(win, axis=0))
    np.testing.assert_allclose(array(got, "focal_std", raster.shape), np.nanstd(win, axis=0), atol=1e-12)


@pytest.mark.parametrize("sigma", [0.8, 3.0])
def test_gaussian_blur(spark, raster, sigma):
    a, w = np.nan_to_num(raster), np.array(stencil.gaussian_kernel(sigma))
    r = len(w) // 2
    blur = lambda m: np.stack([np.convolve(np.pad(row, r, mode="symmetric"), w, "valid") for row in m])
    want = blur(blur(a.T).T)
    np.testing.assert_allclose(array(stencil.gaussian_blur(table(spark, raster), sigma, 9, 7), "value", a.shape), want, atol=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_distance_transform_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    cells = [(int(y), int(x), bool(rng.random() < 0.1)) for y in range(12) for x in range(15) if rng.random() < 0.7]
    feats = [(y, x) for y, x, f in cells if f]
    got = stencil.distance_transform(spark.createDataFrame(cells, "pixel_y int, pixel_x int, feature boolean"), scale=2.0).collect()
    assert len(got) == len(cells)
    for r in got:
        assert r.distance == pytest.approx(2 * min(math.hypot(r.pixel_y - y, r.pixel_x - x) for y, x in feats))


def test_distance_without_features_is_null(spark):
    got = stencil.distance_transform(spark.createDataFrame([(0, 0, False)], "pixel_y int, pixel_x int, feature boolean")).collect()
    assert [r.distance for r in got] == [None]


def test_components_equal_a_flood_fill(spark):
    rng = np.random.default_rng(4)
    on = rng.random((14, 14)) < 0.55
    want, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on), strict=True):
        if not want[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 14 and 0 <= b < 14 and on[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    cells = spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(on), strict=True)], "pixel_y int, pixel_x int")
    got = {(r.pixel_y, r.pixel_x): r.component for r in stencil.label_components(cells).collect()}
    assert got == {(int(y), int(x)): int(want[y, x]) for y, x in zip(*np.nonzero(on), strict=True)}


def test_slope_of_a_plane(spark):
    a = np.add.outer(np.arange(6) * 30.0, np.zeros(5))
    got = stencil.slope(table(spark, a), 30.0, 30.0).collect()
    assert len(got) == 12
    assert all(r.value == pytest.approx(45.0) for r in got)


def test_bilinear_takes_centres_and_between(spark):
    src = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, 20.0), (1, 1, 30.0)], "pixel_y int, pixel_x int, value double")
    t = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 1, 1.0, 1.0), (5, 5, 9.0, 9.0)], "pixel_y int, pixel_x int, sy double, sx double")
    assert {(r.pixel_y, r.pixel_x): r.value for r in stack.warp_bilinear(src, t).collect()} == {(0, 0): 0.0, (0, 1): 15.0}


def test_yearly_masks(spark):
    """Spread and extremes outlive a negative mean; two dates or a weak year clear everything; cv above three goes."""
    dates = [(f"A2010{m:02d}", 2010, m) for m in range(1, 13)] + [(f"A2011{m:02d}", 2011, m) for m in range(1, 4)]
    cell = {0: lambda m: -0.1 * m, 1: lambda m: 0.3 if m < 3 else None, 2: lambda m: 0.3 + 0.01 * m, 3: lambda m: 0.04}
    data = [(d, y, m, 0, x, f(m)) for d, y, m in dates for x, f in cell.items()]
    s = spark.createDataFrame(data, "date_str string, year int, month int, pixel_y int, pixel_x int, value double")
    got = {(r.year, r.pixel_x): r for r in stack.yearly_stack(s, expected=12).collect()}
    assert got[2010, 0].ndvi_mean is None and got[2010, 0].ndvi_valid_count is None and got[2010, 0].ndvi_min == pytest.approx(-1.2)
    assert got[2010, 1].ndvi_std is None and got[2010, 1].ndvi_mean is None
    assert got[2010, 2].ndvi_monsoon_mean == pytest.approx(0.375) and got[2010, 2].ndvi_peak_seasonality == pytest.approx(0.385 - 0.335)
    assert got[2010, 3].ndvi_cv is None and got[2010, 3].ndvi_mean == pytest.approx(0.04)
    assert all(got[2011, x].ndvi_std is None for x in cell)


def test_coverage_ladder_edges(spark):
    cases = {(499, 1e6): "EXPECTED_EMPTY", (500, 1e6): "SKIPPED_VERY_LOW", (0, 1e6): "EXPECTED_EMPTY", (9_999, 1e6): "SKIPPED_VERY_LOW", (10_000, 1e6): "LOW_COVERAGE_USED", (49_999, 1e6): "LOW_COVERAGE_USED", (50_000, 1e6): "MEDIUM_COVERAGE", (99_999, 1e6): "MEDIUM_COVERAGE", (100_000, 1e6): "HIGH_COVERAGE"}
    df = spark.createDataFrame(list(cases), "n long, t double")
    assert {(r.n, r.t): r.s for r in df.withColumn("s", pixels.coverage_status(F.col("n"), F.col("t"))).collect()} == cases


def test_grid_gate(spark):
    schema = "name string, epsg string, geo array<double>, xs int, ys int"
    ref = spark.createDataFrame([("r", "4326", [0.0, 1.0], 5, 5)], schema)
    g = spark.createDataFrame([("ok", "4326", [0.0, 1.0 + 1e-7], 5, 5), ("shape", "4326", [0.0, 1.0], 6, 5), ("epsg", "1", [0.0, 1.0], 5, 5), ("geo", "4326", [0.1, 1.0], 5, 5)], schema)
    assert [r.name for r in stack.aligned(g, ref).collect()] == ["ok"]


@pytest.mark.parametrize(("lon", "lat", "east", "north"), [(93.0, 0.0, 500_000.0, 0.0), (92.75, 11.67, 472_742.0, 1_290_115.0), (93.9, 7.0, 599_403.0, 773_861.0)])
def test_utm_known_points(spark, lon, lat, east, north):
    e, n = coords.utm46(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(east, abs=60)
    assert r.n == pytest.approx(north, abs=400)


def test_utm_scale_on_the_central_meridian(spark):
    """One metre of meridian arc is 0.9996 m north: the quarter meridian of WGS84 is 10,001,965.729 m."""
    _, n = coords.utm46(F.lit(93.0), F.lit(90.0 - 1e-9))
    assert spark.range(1).select(n.alias("n")).first().n == pytest.approx(0.9996 * 10_001_965.729, abs=0.01)


def test_pixel_index_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-0.5,), (0.9,), (2.7,), (float("inf"),), (None,)], "v double")
    assert [r.i for r in df.select(coords.pixel_index(F.col("v"), 0.0, 1.0).alias("i")).collect()] == [0, 0, 2, None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "v double")
    assert [r.c for r in df.select(pixels.clip(F.col("v"), 0.0, 1.0).alias("c")).collect()] == [None, 1.0, 0.0]


#: Two cells: rows of one (orderkey, linenumber), nulls in each column, line 2 alone; a cell of line 2 and a cell of null quantities.
LINES = [(5, 1, 1, 3, 10.0), (9, 1, 1, 2, 11.0), (7, 1, 1, 4, None), (6, 1, 1, 5, 45.0), (6, 13, 13, 5, 42.0), (6, 1, 1, 5, 50.0), (None, 1, 1, 1, 9.0), (8, 1, 1, None, 8.0), (-1, 2, 1, 1, -3.0), (-1, 2, 1, 1, -2.0), (3, 3, 1, 2, 1.0), (3, 4, 1, 1, None), (None, 5, 1, 1, 4.0), (1, None, 1, 1, 6.0), (1, None, 1, 1, 7.0)]
LINE_SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"


@pytest.mark.parametrize("cuts", [(0, 15), (0, 5, 15), (0, 4, 5, 9, 15)])
def test_tile_mosaic_of_equal_keys_and_nulls_equals_its_sql(spark, tmp_path, cuts):
    """Of equal keys the row that stands first in the files wins, as ``arg_max`` in one thread has it, in one file or several."""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(LINES[a:b], LINE_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet/part={k}")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*/*.parquet')")
    want = con.sql(ORACLES["tile_mosaic"]).fetchall()
    assert (1, 1, 45.0) in want and len(want) == 5
    assert sorted(map(tuple, QUERIES["tile_mosaic"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_mosaic_orders_without_overflow(spark):
    far = [(0, -(2**63), 0, 1.0), (0, 2**63 - 1, 9, 2.0), (0, 2**63 - 1, 3, 3.0), (1, -(2**63), 8, 5.0), (1, -(2**63), 7, 4.0)]
    df = spark.createDataFrame([(*r, "f") for r in far], "cell int, tile long, row long, value double, file string")
    assert sorted(map(tuple, stack.mosaic(df, ["cell"], "tile", ("file", "row")).collect())) == [(0, 3.0), (1, 4.0)]


def test_tile_mosaic_of_repeated_tables_with_shifted_keys_equals_its_sql(spark, tmp_path):
    """sf0.01 holds two rows of one largest key in a cell; four copies are more than one row group."""
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql("CREATE VIEW once AS SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet'")
    con.sql(f"COPY (SELECT l_orderkey + i * (SELECT max(l_orderkey) + 1 FROM once) AS l_orderkey, * EXCLUDE (l_orderkey) FROM range(4) t(i), once) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = sorted(map(tuple, QUERIES["tile_mosaic"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLES["tile_mosaic"]).fetchall())


@pytest.mark.parametrize("files", [["a b.parquet", "a!b.parquet", "a$b.parquet"], ["a^b.parquet", "a+c.parquet", "a+b.parquet", "a_b.parquet"], ["a%b.parquet", "a$b.parquet", "aéb.parquet", "a{b.parquet", "azb.parquet"], ["k=REG AIR/x.parquet", "k=REG/x.parquet", "k=REG/x y.parquet"]])
def test_tile_mosaic_takes_files_in_the_order_of_its_sql(spark, tmp_path, files):
    """Blanks and other characters are encoded in a file's path; a folder's files stand together, after those of a shorter name."""
    con = duckdb.connect()
    con.sql("SET threads = 1")
    top = tmp_path / "lineitem.parquet"
    cells = itertools.combinations(range(len(files)), 2)  # a cell for any two files, each with a row of the largest key
    rows = [(f, cell) for cell, two in enumerate(cells) for f in two]
    for f, file in enumerate(files):
        (top / file).parent.mkdir(parents=True, exist_ok=True)
        con.sql(f"COPY (SELECT 7::BIGINT AS l_orderkey, c::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey, 1 AS l_linenumber, {f}::DOUBLE AS l_quantity FROM (SELECT unnest({[c for g, c in rows if g == f]}) AS c)) TO '{top / file}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{top}/**/*.parquet')")
    assert sorted(map(tuple, QUERIES["tile_mosaic"](spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLES["tile_mosaic"]).fetchall())
