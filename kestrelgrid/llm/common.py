"""What the training-data operators share: words, the shared folder, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_path, materialise, new_path, shared_dir

#: A word is a run of characters other than space and \x09-\x0D. ``bytes.split()`` splits on exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are turned into Python objects at once. Spark itself ends an Arrow batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch),
#: whatever its rows; one longer text is a batch of its own. The session's settings stay as they are.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that handle each batch alone; slices batches so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield fn(batch.slice(at, BATCH_ROWS))

    return df.mapInArrow(run, schema)


__all__ = ["BATCH_ROWS", "WORD", "drop_path", "materialise", "new_path", "per_batch", "shared_dir", "table", "text_or_empty"]
