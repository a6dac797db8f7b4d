"""Writers. Tables stay distributed; only reports are brought into one file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, append: bool = False) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, skip_existing: bool = False) -> None:
    """A table as Parquet; ``by``: partition columns; ``skip_existing``: leave a table that is there as it is."""
    out = df.write.mode("ignore" if skip_existing else "overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One row of nested structs as a JSON file."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sentinel(df: DataFrame, columns: list[str], value: float = -9999.0) -> DataFrame:
    """Nulls as the sentinel that raster formats use; only for a sink."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def metrics(df: DataFrame) -> DataFrame:
    """A one-row table turned into (metric, value) rows, values as text, for narratives and dossiers."""
    cols = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {cols}) AS (metric, value)")


def markdown(df: DataFrame, title: str) -> str:
    """A small report as a Markdown table."""
    rows = df.collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def manifest_text(values: dict) -> str:
    return json.dumps(values, indent=2, sort_keys=True, default=str)
