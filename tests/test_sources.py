import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelgrid.operators import ecosystem, fuse, training
from kestrelgrid.sources import occurrence as src
from kestrelgrid.sources import pixels, sinks


def test_unlike_headers_become_one_table(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("decimalLatitude, LAT ,species,eventDate,empty\n7.5,1,Anas crecca,2010-01-02,\n8.5,2,Anas acuta,,\n")
    (tmp_path / "two.csv").write_text("Latitude,Longitude,scientific_name\n,93,Corvus corax\n")
    (tmp_path / "three.csv").write_text("Latitude,Longitude,scientific_name\n9,94,Corvus corone\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("lat,lon\n")
    df, audit = src.read_occurrences(spark, str(tmp_path))
    rows = {r.species_name: r for r in df.collect()}
    assert rows["Anas crecca"].latitude == "7.5"
    assert rows["Anas crecca"].source_file == "one.csv"
    assert rows["Corvus corone"].latitude == "9"
    assert rows["Corvus corax"].latitude is None
    assert "empty" not in df.columns
    assert {n: note for n, _, note, _ in audit} == {"one.csv": "", "two.csv": "", "three.csv": "", "none.csv": "empty", "head.csv": "empty"}


def test_repeated_quoted_and_digit_ended_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffdecimalLatitude,decimalLatitude,decimalLongitude,species,note,note2,"place, full",NOTE\n7.5,1,93.5,Anas crecca,n1,n2,"x, y",n3\n')
    df, audit = src.read_occurrences(spark, str(tmp_path))
    r = df.first().asDict()
    assert r == {"latitude": "7.5", "longitude": "93.5", "species_name": "Anas crecca", "note": "n1", "note2": "n2", "place, full": "x, y", "source_file": "a.csv"}
    assert audit == [("a.csv", 8, "duplicates: decimallatitude, note", "decimallatitude|decimallongitude|note|note2|place, full|species")]
    assert "note2" in src.column_union(audit)


def test_an_empty_first_alias_hides_a_filled_second_one(spark):
    df = spark.createDataFrame([(None, "b")], "decimallatitude string, lat string")
    assert src.harmonise(df).columns == []


def tiff(a, nodata=None, tile=None, deflate=False, differences=False):
    h, w = a.shape
    kind = {"f": 3, "i": 2, "u": 1}[a.dtype.kind]
    bw, bh = (tile, tile) if tile else (w, h)
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            b = np.zeros((bh, bw), a.dtype)
            part = a[y : y + bh, x : x + bw]
            b[: part.shape[0], : part.shape[1]] = part
            if differences:
                b[:, 1:] = np.diff(b, axis=1)
            raw = b.astype(a.dtype.newbyteorder("<")).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    data, starts = b"", []
    for b in blocks:
        starts.append(8 + len(data))
        data += b
    extra_at, extra, tags = 8 + len(data), b"", {256: (4, [w]), 257: (4, [h]), 258: (3, [a.itemsize * 8]), 259: (3, [8 if deflate else 1]), 317: (3, [2 if differences else 1]), 339: (3, [kind])}
    tags |= {322: (4, [bw]), 323: (4, [bh]), 324: (4, starts), 325: (4, [len(b) for b in blocks])} if tile else {273: (4, starts), 278: (4, [h]), 279: (4, [len(b) for b in blocks])}
    if nodata is not None:
        tags[42113] = (2, list(f"{nodata}\0".encode()))
    fmt, entries = {2: "B", 3: "H", 4: "I"}, b""
    for tag, (t, v) in sorted(tags.items()):
        packed = struct.pack(f"<{len(v)}{fmt[t]}", *v)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, t, len(v), extra_at + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, t, len(v)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", extra_at + len(extra)) + data + extra + struct.pack("<H", len(tags)) + entries + b"\0" * 4


@pytest.mark.parametrize("options", [{}, {"tile": 4}, {"deflate": True}, {"tile": 4, "deflate": True}])
@pytest.mark.parametrize("kind", ["<f4", "<i2"])
def test_tiff_layers(spark, tmp_path, options, kind):
    a = np.arange(30).reshape(5, 6).astype(kind)
    a[1, 2] = -99
    if kind == "<i2":
        options = options | {"differences": True}
    (tmp_path / "dem.tif").write_bytes(tiff(a, -99, **options))
    got = {(r.pixel_y, r.pixel_x): r.value for r in pixels.read_tiff_layers(spark, str(tmp_path)).collect()}
    assert got == {(y, x): float(a[y, x]) for y in range(5) for x in range(6) if a[y, x] != -99}


@pytest.mark.parametrize("n", [0, 1, 5, 300, 5_000, 70_000])
def test_lzw_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), b"ab" * n, bytes(n), rng.integers(0, 3, n).astype(np.uint8).tobytes()):
        assert pixels.lzw_decode(pixels.lzw_encode(data)) == data


def test_lzw_of_the_format_s_example():
    """7 7 7 8 8 7 7 6 6 as nine-bit codes: clear, 7, 258, 8, 8, 258, 6, 6, end."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert pixels.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert pixels.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def test_tiles_by_date(spark, tmp_path):
    for n in ("MOD.A2010001.h1.hdf", "MOD.A2010001.h2.hdf", "MOD.A2010017.h1.hdf"):
        (tmp_path / n).write_bytes(b"x")
    got = pixels.tiles_by_date(spark, str(tmp_path)).groupBy("date_str").count().collect()
    assert {r.date_str: r["count"] for r in got} == {"A2010001": 2, "A2010017": 1}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "k int, v double")
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    sinks.write_table(df, str(tmp_path / "t"), by=["k"])
    sinks.write_table(df.limit(0), str(tmp_path / "t"), skip_existing=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_manifest(df.select(F.struct("k").alias("s")).limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().s.k == 1
    assert [r.v for r in sinks.sentinel(df, ["v"]).orderBy("k").collect()] == [-9999.0, 0.5]
    assert sinks.markdown(df, "x").count("|") > 8


def test_fusing_by_id_alone_fans_out(spark):
    dyn = spark.createDataFrame([(1, 7), (0, 7)], "target int, original_row_id long")
    land = spark.createDataFrame([(1, 7, 1.0), (0, 7, 2.0)], "target int, original_row_id long, e double")
    assert fuse.fuse(dyn, land).count() == 2
    assert fuse.fuse(dyn, land, compat=True).count() == 4


def test_synthesis_of_absent_species_and_constant_layers(spark):
    cube = spark.createDataFrame([("a", 0, 0, 0.9, 0.1, 0.0), ("b", 0, 0, None, 0.1, 0.0), ("a", 0, 1, 0.1, 0.1, 0.0), ("b", 0, 1, 0.8, 0.1, 0.0), ("b", 1, 1, None, None, None)], "species string, pixel_y int, pixel_x int, suit double, unc double, extrap double")
    th = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "species string, threshold double")
    cells = ecosystem.synthesis(cube, th)
    got = {(r.pixel_y, r.pixel_x): r for r in cells.collect()}
    assert set(got) == {(0, 0), (0, 1)}
    assert got[0, 0].support == 1 and got[0, 0].binary_richness == 1
    assert got[0, 0].agreement == pytest.approx(1 - np.std([1, 0]))
    assert {r.priority for r in ecosystem.priority(ecosystem.stability(cells)).collect()} == {0.0}


def test_folds_keep_groups_whole_and_even(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)) for _ in range(n)], "g string")
    got = training.assign_folds(df, "g", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4, 4, 4] or sorted(r["count"] for r in got) == [3, 4, 4, 5]


def test_spatial_cv_separates_an_easy_target_and_not_permuted_labels(spark):
    df = spark.range(160).select("id", (F.col("id") % 2).cast("int").alias("target"), (F.floor(F.col("id") / 2) % 4).cast("string").alias("spatial_fold"), (F.col("id") % 2 + F.rand(1) * 0.2).alias("f0"))
    df = spark.createDataFrame(df.collect(), df.schema)
    one = training.spatial_cv(df.where("id < 160"), ["f0"], "id", t=training.Tier(2, 3, 0.3))
    assert one.agg(F.min("auc")).first()[0] > 0.95


def test_tiff_written_and_read(spark, tmp_path):
    layers = spark.createDataFrame([("a", 0, 0, 1.5), ("a", 1, 2, -2.25), ("b", 0, 1, 7.0), ("b", 9, 9, 1.0)], "layer string, pixel_y int, pixel_x int, value double")
    for r in pixels.tiff_layers(layers, 2, 3, [92.0, 0.1, 0.0, 14.0, 0.0, -0.1]).collect():
        (tmp_path / f"{r.layer}.tif").write_bytes(r.content)
    got = {(r.layer, r.pixel_y, r.pixel_x, r.value) for r in pixels.read_tiff_layers(spark, str(tmp_path)).collect()}
    assert got == {("a", 0, 0, 1.5), ("a", 1, 2, -2.25), ("b", 0, 1, 7.0)}


def test_tiled_files_with_transform_and_code(spark, tmp_path):
    layers = spark.createDataFrame([("a", y, x, y * 10.5 + x / 3) for y in range(7) for x in range(9) if (y, x) != (2, 2)], "layer string, pixel_y int, pixel_x int, value double")
    geo = [92.0, 0.1, 0.0, 14.0, 0.0, -0.2]
    pixels.write_tiffs(layers, f"file://{tmp_path}/out", 7, 9, geo, tile=4)
    assert pixels.geo_of((tmp_path / "out" / "a.tif").read_bytes()) == (geo, 4326)
    got = {(r.pixel_y, r.pixel_x): r.value for r in pixels.read_tiff_layers(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.pixel_y, r.pixel_x): pytest.approx(r.value, rel=1e-6) for r in layers.collect()}


def test_small_helpers(spark):
    from kestrelgrid.functions.names import impact_direction
    from kestrelgrid.functions.pixels import in_range
    from kestrelgrid.operators.stats import downcast, row_ids

    assert pixels.pick_subdataset([("x", "pixel reliability"), ("y", "16 days NDVI")], "ndvi") == "y"
    assert pixels.pick_subdataset([("x", "other")], "ndvi") is None
    df = spark.createDataFrame([(30, 1.5, "Negative x"), (10, None, "Positive"), (1 << 40, 9.0, None)], "k long, v double, s string")
    assert {r.k: r.original_row_id for r in row_ids(df, "k").collect()} == {10: 0, 30: 1, 1 << 40: 2}
    assert dict(downcast(df).dtypes) == {"k": "bigint", "v": "float", "s": "string"}
    assert dict(downcast(df.where("k < 100")).dtypes)["k"] == "int"
    assert [(r.a, r.b) for r in df.select(in_range(F.col("v"), 0, 5).alias("a"), impact_direction(F.col("s")).alias("b")).collect()] == [(True, -1), (False, 1), (False, 1)]
