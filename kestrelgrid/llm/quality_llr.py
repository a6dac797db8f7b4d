"""Quality rules: base counts, then the log-likelihood ratio of two multinomials over hashed n-grams.

The trusted target and the raw corpus each give one multinomial over hashed byte n-grams, counted over
all their rows. A text's score is the mean over its n-grams of log p_target - log p_raw, so that length
does not matter, and every text is kept or not by one fixed threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, text_or_empty

#: Bytes of an n-gram, buckets of the hash (16 bits), weight of the smoothing in n-grams for each bucket.
N, BUCKETS, SMOOTH = 3, 1 << 16, 1.0
#: Buckets of a packed block, and tasks that share the first round of a block's sums.
BLOCK, SHARERS = 1024, 32
#: Bits of the sieve that spares most texts the join with the trusted keys.
SIEVE = 1 << 24
#: Texts score at least this to be kept.
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEAT = 50, 50
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def ngram_buckets(data: bytes) -> np.ndarray:
    """The bucket of every byte n-gram; runs of white space count as one space."""
    b = np.frombuffer(b" ".join(data.split()), np.uint8).astype(np.uint32)
    if len(b) < N:
        return np.empty(0, np.uint32)
    h = b[: len(b) - N + 1] * np.uint32(0x01000193)
    for k in range(1, N):
        h = (h ^ b[k : len(b) - N + 1 + k]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(16)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            end = 0
            for k, w in enumerate(windows):
                if w in often:
                    repeat += k + 3 - max(end, k)
                    end = k + 3
    return n, chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words


def ngram_totals(rows: DataFrame, column: str = "text") -> np.ndarray:
    """N-grams of all rows by bucket.

    A task sends its counts as BUCKETS / BLOCK packed blocks. Blocks with the same number are added up as they
    stream in, first by SHARERS tasks, each for its share of the map tasks, then by one; the driver gets at
    most BUCKETS sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(ngram_buckets(text.encode()))
                size += len(held[-1])
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        if total.any():
            blocks = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    parts = rows.select(text_or_empty(column)).mapInArrow(count, "block int, counts binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK))
    parts = parts.withColumn("sharer", F.spark_partition_id() % SHARERS).repartition("block", "sharer").select("block", "counts").mapInArrow(add, "block int, counts binary")
    for r in parts.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _slot(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SIEVE))


def trusted_rows(docs: DataFrame, trusted: DataFrame, key: str, column: str) -> DataFrame:
    """The texts of the rows whose key is in ``trusted``: the sieve lets few others reach the join, which then is exact."""
    keys = trusted.select(F.col(key).cast(docs.schema[key].dataType).alias("__k")).where("__k IS NOT NULL").distinct()
    slots = keys.select(_slot("__k").alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toPandas()
    bitmap = np.zeros(SIEVE // 64, "<i8")
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def may_be(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = batch.column(2).to_numpy(zero_copy_only=False)
        return batch.filter(pa.array((sent.value[slot >> 6] >> (slot & 63) & 1).astype(bool))).select([0, 1])

    rows = docs.select(F.col(key).alias("__k"), text_or_empty(column)).withColumn("__slot", _slot("__k"))
    rows = per_batch(rows, may_be, f"__k {keys.schema['__k'].dataType.simpleString()}, {column} string")
    return rows.join(keys.hint("shuffle_hash"), "__k", "left_semi").select(column)


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", column: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket, from all rows and from all trusted ones. ``trusted`` has the keys of the trusted rows.

    Rows with a null key are raw and never trusted; rows that repeat a trusted key are all trusted, keys that
    ``trusted`` repeats count once; null texts have no n-grams. Without trusted n-grams every ratio is 0.
    """
    raw, target = ngram_totals(docs, column), ngram_totals(trusted_rows(docs, trusted, key, column), column)
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def score(text: str, ratios: np.ndarray) -> float:
    """Mean log ratio of a text's n-grams; 0 if it has none."""
    at = ngram_buckets(text.encode())
    return float(ratios[at].mean()) if len(at) else 0.0


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept of every row.

    kept is false where the base rules fail, else whether llr >= ``threshold``. A null text is empty (no
    words, so the base rules fail); a text of any length is counted whole. Without a trusted row that has
    n-grams, every llr is 0. Null and repeated keys keep their rows, other columns are ignored, whatever
    their names, an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(log_ratios(docs, trusted, key, column))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ratios, out = table.value, []
        for text in batch.column(1).to_pylist():
            c = base_counts(text)
            out.append((*c, base_failed(c[0], c[4]), score(text, ratios)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kept = [not f and s >= threshold for f, s in zip(cols[5], cols[6], strict=True)]
        longs = [pa.array(c, pa.int64()) for c in cols[:5]]
        names = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
        return pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.float64()), pa.array(kept, pa.bool_())], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return per_batch(docs.select(docs[key].alias("key"), text_or_empty(column)), run, schema).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns and under all their names.

    Each row is judged by its text alone: null and repeated keys, nulls in other columns and columns of any
    name stay as they are. A null or empty text fails the base rules and goes; very long texts are judged
    whole; an empty table gives no rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted, key, column))
    place = docs.columns.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ratios, mask = table.value, []
        for text in batch.column(place).to_pylist():
            n, *_, repeat = base_counts(text or "")
            mask.append(not base_failed(n, repeat) and score(text or "", ratios) >= threshold)
        return batch.filter(pa.array(mask, pa.bool_()))

    return per_batch(docs, run, docs.schema)

