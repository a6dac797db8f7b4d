"""Occurrence files with unlike headers, read into one canonical table."""

from __future__ import annotations

import csv
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted raw headers (lower case, stripped) of each canonical column; fixed values of the input formats.
ALIASES: dict[str, tuple[str, ...]] = {
    "latitude": ("decimallatitude", "locationlat", "lat", "start_latitude"),
    "longitude": ("decimallongitude", "locationlon", "lon", "start_longitude"),
    "observation_date": ("eventdate", "observed_on", "time_observed_at", "date_time", "date", "timestamp"),
    "species_name": ("scientificname", "scientific_name", "species", "common_name", "taxon", "bird_name"),
    "occurrence_id": ("gbifid", "occurrenceid", "id", "catalog", "recordnumber"),
    "uncertainty_m": ("coordinateuncertaintyinmeters", "positional_accuracy", "accuracy"),
    "elevation_m": ("elevation", "altitude", "verbatimelevation", "depth"),
    "observer_name": ("recordedby", "user_login", "observer"),
}


def canonical_name(header: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> str:
    name = header.lower().strip()
    return next((to for to, names in aliases.items() if name in names), name)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below ``folder``, in path order, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().lower().endswith(suffix):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def harmonise(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, drop_empty: bool = True) -> DataFrame:
    """One source under canonical names: of columns with the same name the first stays, before and after renaming.

    Columns without any value are dropped after that, so an empty first alias hides a filled second one.
    That takes one pass that counts every column at once.
    """
    unique = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    first: dict[str, str] = {}
    seen: set[str] = set()
    for k, header in enumerate(df.columns):
        raw = header.lower().strip()
        if raw not in seen:
            seen.add(raw)
            first.setdefault(canonical_name(raw, aliases), f"c{k}")
    if drop_empty and first:
        filled = unique.agg(*[F.count(c).alias(c) for c in first.values()]).first()
        first = {to: c for to, c in first.items() if filled[c]}
    return unique.select(*[F.col(c).alias(to) for to, c in first.items()])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Outer union of sources by column name; columns whose types differ become strings."""
    kinds: dict[str, set[str]] = defaultdict(set)
    for f in frames:
        for name, kind in f.dtypes:
            kinds[name].add(kind)
    cast = lambda f: f.select(*[F.col(c).cast("string").alias(c) if len(kinds[c]) > 1 else F.col(c) for c in f.columns])
    out = cast(frames[0])
    for f in frames[1:]:
        out = out.unionByName(cast(f), allowMissingColumns=True)
    return out


def header_of(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """The names in a CSV file's first line as they are written, quotes and repeats included, and whether another line follows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        first, second = lines.readLine(), lines.readLine()
    finally:
        stream.close()
    return next(csv.reader([(first or "").removeprefix("\ufeff")]), []), second is not None


def read_occurrences(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, int, str, str]]]:
    """All CSV files below ``folder`` as one table of strings with ``source_file``, and an audit row (file, columns, note, names) of each.

    Headers are taken from the files themselves and columns by their place, so repeated names, names that end
    in digits and quoted commas stay apart until the first of each name is picked. Files with the same header
    are read by one scan; files without rows are skipped; a file that can't be read is noted and skipped.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    audit: list[tuple[str, int, str, str]] = []
    for path, size in list_files(spark, folder, ".csv"):
        name = path.rpartition("/")[2]
        try:
            header, more = header_of(spark, path) if size else ([], False)
            if not more:
                audit.append((name, 0, "empty", ""))
                continue
            raw = [c.lower().strip() for c in header]
            twice = sorted({c for c in raw if raw.count(c) > 1})
            audit.append((name, len(raw), f"duplicates: {', '.join(twice)}" if twice else "", "|".join(sorted(set(raw)))))
            groups[tuple(header)].append(path)
        except Exception as e:  # noqa: BLE001  a file that can't be read must not stop the others
            audit.append((name, 0, f"error: {str(e)[:200]}", ""))
    frames = []
    for header, paths in groups.items():
        schema = T.StructType([T.StructField(f"h{k}", T.StringType()) for k in range(len(header))])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"').csv(paths)
        frames.append(harmonise(rows.select("*", F.col("_metadata.file_name").alias("source_file")).toDF(*header, "source_file")))
    if not frames:
        raise ValueError(f"no occurrence rows below {folder}")
    return union_sources(frames), audit


def column_union(audit: list[tuple[str, int, str, str]]) -> list[str]:
    """The names of the columns of all files together."""
    return sorted({c for *_, names in audit for c in names.split("|") if c})


def read_projected(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV scan of some columns with given types; values that don't parse become null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in columns.items()])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A whole CSV report, with types from its values; a second scan finds them, so it is for reports and not for raw files."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
