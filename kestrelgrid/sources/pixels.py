"""Rasters as pixel tables: a row (layer, pixel_y, pixel_x, value) for each cell that has a value."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_SCHEMA = "proj string, epsg string, geo array<double>, xs int, ys int"
_TIFF_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a reference grid from its JSON file."""
    return spark.read.schema(GRID_SCHEMA).option("multiLine", True).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def tiles_by_date(spark: SparkSession, folder: str, suffix: str = ".hdf") -> DataFrame:
    """(date_str, path) of tile files; the date is the second dot-separated part of the file name. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.split(name, r"\.").getItem(1).alias("date_str"), "path")


def layer_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Paths of the files that end in ``suffix``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    size = {1: "B", 2: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in size:
            continue
        fmt = f"{order}{count}{size[kind]}"
        where = at + 10 + 12 * k
        if struct.calcsize(fmt) > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        out[tag] = struct.unpack_from(fmt, data, where)
    return order, out


#: Codes of TIFF's LZW that clear the table and end the data, and the most bits of a code; fixed values of the format.
_CLEAR, _END, _MOST_BITS = 256, 257, 12


def lzw_decode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < _MOST_BITS:
                width += 1
        last = entry
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def fresh() -> None:
        nonlocal table, width
        put(_CLEAR)
        table, width = {bytes([k]): k for k in range(256)}, 9

    fresh()
    run = b""
    for byte in data:
        longer = run + bytes([byte])
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = len(table) + 2
        if len(table) + 2 == (1 << width):
            width += 1
        if len(table) + 2 >= (1 << _MOST_BITS) - 2:
            fresh()
        run = bytes([byte])
    if run:
        put(table[run])
        table[run + b"?"] = 0
        if len(table) + 2 == (1 << width) and width < _MOST_BITS:
            width += 1
    put(_END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decode_tiff(data: bytes) -> tuple[np.ndarray, float | None]:
    """Band one of a baseline TIFF and its nodata value: strips or tiles, uncompressed, LZW or deflate, plain or with the differences of whole numbers or of floats' bytes."""
    order, t = _tags(data)
    w, h = t[256][0], t[257][0]
    kind = np.dtype(order + _TIFF_TYPES[t.get(339, (1,))[0], t.get(258, (1,))[0]])
    packing, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    tiled = 324 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (w, t.get(278, (h,))[0])
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    out = np.empty((-(-h // bh) * bh, -(-w // bw) * bw), kind)
    across = -(-w // bw)
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        block = data[a : a + n]
        if packing in (8, 32946):
            block = zlib.decompress(block)
        elif packing == 5:
            block = lzw_decode(block)
        elif packing != 1:
            raise ValueError(f"TIFF compression {packing} isn't supported")
        if predictor == 3:  # a row's bytes are sorted by their weight, highest first, then differenced
            rows = np.cumsum(np.frombuffer(block, np.uint8).reshape(-1, bw * kind.itemsize), axis=1, dtype=np.uint8)
            rows = np.ascontiguousarray(rows.reshape(len(rows), kind.itemsize, bw).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, bw)
        else:
            rows = np.frombuffer(block, kind)
            rows = rows[: len(rows) // bw * bw].reshape(-1, bw)
            if predictor == 2:
                rows = np.cumsum(rows, axis=1, dtype=kind)
        y, x = k // across * bh, k % across * bw
        out[y : y + len(rows), x : x + bw] = rows
    nodata = bytes(t[42113]).rstrip(b"\0 ").decode() if 42113 in t else ""
    return out[:h, :w], float(nodata) if nodata else None


def read_tiff_layers(spark: SparkSession, folder: str, suffix: str = ".tif") -> DataFrame:
    """(layer, pixel_y, pixel_x, value) of every valid cell of the single-band TIFF files of a folder; nodata and NaN give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                band, nodata = decode_tiff(content.as_py())
                for y in range(len(band)):
                    v = band[y].astype(float)
                    good = np.isfinite(v) & (True if nodata is None else ~np.isclose(v, nodata))
                    x = np.flatnonzero(good)
                    if len(x):
                        name = path.rpartition("/")[2].removesuffix(suffix)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.full(len(x), y, np.int32)), pa.array(x.astype(np.int32)), pa.array(v[x])], ["layer", "pixel_y", "pixel_x", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "content").mapInArrow(run, "layer string, pixel_y int, pixel_x int, value double")


def pick_subdataset(found: list[tuple[str, str]], keyword: str) -> str | None:
    """The first (name, description) whose description holds ``keyword``; none if no one does."""
    return next((name for name, text in found if keyword.lower() in text.lower()), None)


def encode_tiff(band: np.ndarray, geo: list[float] | None = None, nodata: float | None = -9999.0, tile: int = 256, epsg: int | None = 4326) -> bytes:
    """A single-band tiled LZW TIFF of 32-bit floats with the float predictor, pixel scale, tie point, nodata and a geographic EPSG code; NaN is written as nodata."""
    a = np.asarray(band, "<f4")
    if nodata is not None:
        a = np.where(np.isnan(a), np.float32(nodata), a)
    h, w = a.shape
    across, down = -(-w // tile), -(-h // tile)
    whole = np.zeros((down * tile, across * tile), ">f4")
    whole[:h, :w] = a
    blocks = []
    for y in range(down):
        for x in range(across):
            block = np.ascontiguousarray(whole[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile])
            rows = block.view(np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, 4 * tile)
            blocks.append(lzw_encode(np.diff(rows, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()))
    starts = np.cumsum([8, *map(len, blocks[:-1])]).tolist()
    tags: dict[int, tuple[int, str, list]] = {
        256: (4, "I", [w]), 257: (4, "I", [h]), 258: (3, "H", [32]), 259: (3, "H", [5]), 262: (3, "H", [1]), 277: (3, "H", [1]), 284: (3, "H", [1]), 317: (3, "H", [3]),
        322: (4, "I", [tile]), 323: (4, "I", [tile]), 324: (4, "I", starts), 325: (4, "I", [len(b) for b in blocks]), 339: (3, "H", [3]),
    }
    if geo:
        tags |= {33550: (12, "d", [geo[1], -geo[5], 0.0]), 33922: (12, "d", [0.0, 0.0, 0.0, geo[0], geo[3], 0.0])}
    if geo and epsg:  # keys: version, then geographic model, pixels as areas, the code
        tags[34735] = (3, "H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, epsg])
    if nodata is not None:
        tags[42113] = (2, "B", list(f"{nodata:g}\0".encode()))
    data = b"".join(blocks)
    extra_at, extra, entries = 8 + len(data), b"", b""
    for tag, (kind, fmt, values) in sorted(tags.items()):
        packed = struct.pack(f"<{len(values)}{fmt}", *values)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", extra_at + len(extra)) + data + extra + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def geo_of(data: bytes) -> tuple[list[float] | None, int | None]:
    """The six numbers of a TIFF's transform, and its geographic or projected EPSG code, where it has them."""
    _, t = _tags(data)
    keys = t.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    geo = [t[33922][3], t[33550][0], 0.0, t[33922][4], 0.0, -t[33550][1]] if 33550 in t and 33922 in t else None
    return geo, codes.get(3072, codes.get(2048))


def tiff_layers(layers: DataFrame, height: int, width: int, geo: list[float] | None = None, nodata: float = -9999.0, tile: int = 256) -> DataFrame:
    """(layer, content): each layer of (layer, pixel_y, pixel_x, value) as the bytes of a TIFF. A task holds one raster."""

    def encode(pdf):
        import pandas as pd

        band = np.full((height, width), np.nan)
        band[pdf.pixel_y.to_numpy(int), pdf.pixel_x.to_numpy(int)] = pdf.value.to_numpy(float)
        return pd.DataFrame({"layer": [pdf.layer.iloc[0]], "content": [encode_tiff(band, geo, nodata, tile)]})

    inside = F.col("pixel_y").between(0, height - 1) & F.col("pixel_x").between(0, width - 1)
    return layers.where(inside).select("layer", "pixel_y", "pixel_x", "value").groupBy("layer").applyInPandas(encode, "layer string, content binary")


def write_tiffs(layers: DataFrame, folder: str, height: int, width: int, geo: list[float] | None = None, nodata: float = -9999.0, tile: int = 256) -> None:
    """A file <layer>.tif of every layer in ``folder``, on any file system that Spark knows; the driver passes on one encoded raster at a time."""
    spark = layers.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in tiff_layers(layers, height, width, geo, nodata, tile).toLocalIterator():
        at = hadoop(f"{folder}/{r.layer}.tif")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(r.content)
        finally:
            out.close()
