"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table of frequent pre-tokens and their token counts, tier two a bounded
cache in each worker that encodes a missing pre-token once. Which are frequent is counted over all texts;
only those counts are shuffled, a word and a number for each part of a task.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, text_or_empty
from .word_bpe import Cached, load

#: Words of the broadcast table; it changes speed, never a count.
TABLE_WORDS = 16_384
#: Distinct words, and characters in them, that a task counts before it hands its counts on and starts afresh.
HELD_WORDS, HELD_CHARS = 262_144, 16_777_216
MAX_TOKENS = 2_048


def frequent_lengths(docs: DataFrame, path: str, column: str = "text", words: int = TABLE_WORDS) -> dict[str, int]:
    """The ``words`` most frequent pre-tokens of all texts, and their token counts. Ties go to the smaller word.

    Every pre-token of every row counts: tasks hand on their counts whole, in parts of bounded size, and these
    are added up by word. ``words`` rows reach the driver at any corpus size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, chars = load(path), Counter(), 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                before = len(seen)
                seen.update(w for w in bpe.words(text.as_py()) if isinstance(w, str))
                if len(seen) > before:
                    chars += sum(map(len, islice(reversed(seen), len(seen) - before)))
                if len(seen) > HELD_WORDS or chars > HELD_CHARS:
                    yield counted()
                    seen, chars = Counter(), 0
        yield counted()

    counts = docs.select(text_or_empty(column)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(words).coalesce(1)  # a task merges the partitions' first words; a bare limit would have the driver do it
    bpe = load(path)
    return {r.word: len(bpe.word_ids(r.word)) for r in found.collect()}


class _TwoTier(dict):
    """The broadcast table; a word it lacks is looked up in the worker's cache."""

    def __init__(self, table: dict[str, int], path: str):
        super().__init__(table)
        bpe = load(path)
        self.rest = Cached(lambda w: len(bpe.word_ids(w)))

    def __missing__(self, word):
        return self.rest[word]


#: The tiers of the run that this worker serves, by the run's tag.
_TIERS: dict[str, _TwoTier] = {}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``max_tokens``) of every row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys keep their rows. Other
    columns are ignored, an empty table gives no rows, and texts of any length are counted whole.
    """
    spark = docs.sparkSession
    table, tag = spark.sparkContext.broadcast(frequent_lengths(docs, path, column)), uuid.uuid4().hex

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        if tag not in _TIERS:
            _TIERS.clear()
            _TIERS[tag] = _TwoTier(table.value, path)
        look, bytes_, tokens = _TIERS[tag].__getitem__, [], []
        for text in batch.column(1).to_pylist():
            bytes_.append(len(text.encode()))
            tokens.append(sum(map(look, bpe.words(text))))
        n = pa.array(tokens, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.int64()), n, pa.array([t > max_tokens for t in tokens], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(docs.select(docs[key].alias("key"), text_or_empty(column)), count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)

