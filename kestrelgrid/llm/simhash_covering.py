"""SimHash near-duplicates by covering locality-sensitive hashing.

Radius r uses 2^(r+1)-1 bit masks. Bit i of the fingerprint has a code word c(i) of r+1 bits, and mask v
holds bit i if <c(i), v> = 1 over GF(2). Any r differing bits leave some non-zero v orthogonal to all
their code words, so that mask covers none of them and the two fingerprints meet in table v: no pair
within the radius is missed. Equal fingerprints are one class before any table is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialise, per_batch, text_or_empty

WIDTH, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Fingerprints of a bucket that one task holds and compares; a larger bucket is divided among tasks by an exact rule.
DIRECT = 4_096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's shingles, each counted as often as it occurs; 0 if there are no words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``key`` and fp (the fingerprint as a signed long) of every row's whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["key", "fp"])

    return per_batch(docs.select(F.col(key).cast("long").alias("key"), text_or_empty(column)), run, "key long, fp long").withColumnRenamed("key", key)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of the covering family. Code words go round all non-zero values, so every mask keeps about half the bits."""
    size = 1 << (radius + 1)
    word = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (word[i] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links of at most ``radius`` bits join among distinct fingerprints.

    The search goes from node to node, each step comparing one fingerprint with all that no step has reached.
    """
    out, left = [], np.arange(len(fps))
    stack: list[int] = []
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
        here = stack.pop()
        near = np.bitwise_count(fps[left] ^ fps[here]) <= radius
        found = left[near].tolist()
        out += [(here, x) for x in found]
        stack += found
        left = left[~near]
    return out


def _divided(free: int, radius: int) -> list[int]:
    """What may still differ after each of radius + 1 blocks of the free bits is fixed; some block holds none of a link's bits."""
    places = [i for i in range(BITS) if free >> i & 1]
    return [free & ~sum(1 << i for i in places[k :: radius + 1]) for k in range(radius + 1)]


def _search(rows: DataFrame, radius: int, direct: int) -> DataFrame:
    """One round over buckets: rows (free, part, fp, rep) -> edges (a, b), and rows to divide again (free, fp, rep).

    A bucket is what agrees outside ``free``. Sorted partitions bring buckets one after the other. At most
    ``direct`` rows of a bucket are held: a larger one streams on to the next round, each row once for each
    way to divide it, where more tasks share it. Once no more than ``radius`` bits are free, all of a bucket
    is linked, and its rows are joined to its first as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over, head = None, [], None, None

        def edges(a, b) -> pa.RecordBatch:
            n = len(a)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none], ["a", "b", "free", "fp", "rep"])

        def on(fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
            none = pa.nulls(len(fp), pa.int64())
            for f in over:
                yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(fp), _signed(f), np.int64)), pa.array(fp.view(np.int64)), pa.array(rep)], ["a", "b", "free", "fp", "rep"])

        def close() -> Iterator[pa.RecordBatch]:
            if over is None and held:
                fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
                pairs = _forest(fp, radius)
                if pairs:
                    yield edges([int(rep[x]) for x, _ in pairs], [int(rep[y]) for _, y in pairs])

        for batch in batches:
            if not batch.num_rows:
                continue
            free, part, fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp = fp.view(np.uint64)
            edge = np.concatenate(([0], np.flatnonzero((np.diff(free) != 0) | (np.diff(part) != 0)) + 1, [len(free)]))
            size = np.diff(edge)
            inner = np.arange(len(size))
            inner = (inner > 0) & (inner < len(size) - 1)  # the first and last may go on in other batches
            two = edge[:-1][inner & (size == 2)]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            if near.any():
                yield edges(rep[two][near], rep[two + 1][near])
            for i in np.flatnonzero(~inner | (size > 2)).tolist():
                at, to = edge[i], edge[i + 1]
                now = (int(free[at]), int(part[at]))
                if now != key:
                    yield from close()
                    key, held, over, head = now, [], None, None
                mine = now[0] & (1 << BITS) - 1
                if mine.bit_count() <= radius:
                    head = rep[at] if head is None else head
                    yield edges(np.full(to - at, head), rep[at:to])
                elif over is not None:
                    yield from on(fp[at:to], rep[at:to])
                else:
                    held.append((fp[at:to], rep[at:to]))
                    if sum(len(h[0]) for h in held) > direct:
                        over = _divided(mine, radius)
                        for h in held:
                            yield from on(*h)
                        held = []
        yield from close()

    rows = rows.select("free", "part", "fp", "rep").repartition("free", "part").sortWithinPartitions("free", "part", "fp")
    return rows.mapInArrow(run, "a long, b long, free long, fp long, rep long")


def links(classes: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Edges (a, b) between representatives: together they connect all that links of at most ``radius`` bits connect.

    ``classes`` has distinct fingerprints: fp long, rep long. A bucket yields at most a spanning forest, never
    all its pairs. Rounds go on while there are buckets to divide; each fixes more bits, so they end.
    """
    free = F.explode(F.array(*[F.lit(_signed(~m & (1 << BITS) - 1)) for m in covering_masks(radius)]))
    rows, out = classes.select(free.alias("free"), "fp", "rep"), None
    while True:
        found, _ = materialise(_search(rows.withColumn("part", F.col("fp").bitwiseAND(F.bitwise_not("free"))), radius, direct), "links")
        edges = found.where("a <> b").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        rows = found.where("a IS NULL").select("free", "fp", "rep").distinct()
        if not rows.take(1):
            return out.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest key reachable over links of at most ``radius`` differing bits, the row's
    own included. A null text has no words: fingerprint zero, linked like any other. Rows with a null key
    get their fingerprint and the component of its class, but no component is named after them (null if
    all its keys are null). Repeated rows stay; texts of any length are read whole; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    own, _ = materialise(fingerprints(docs, key, column, width, seed).select(F.col(key).alias("key"), "fp"), "fingerprints")
    classes, _ = materialise(own.groupBy("fp").agg(F.min("key").alias("rep")), "classes")
    named = classes.where("rep IS NOT NULL")
    comps, _ = materialise(connected_components(links(named, radius)), "components")
    whole = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    whole, _ = materialise(whole, "component_of")
    out = own.join(whole, "fp", "left")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_row(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Exactly one row of every group of fingerprints joined by links of at most ``radius`` bits; all columns of ``docs``.

    A group is made by texts alone: rows with a null key are in it, and rows that share a key may be in different
    ones. The row with the smallest key stays, null last; among rows of that key, the least digest of all columns;
    of rows alike in every column, one. Null and empty texts are one group, as none has words; very long texts are
    read whole; columns may have any names; an empty table gives no rows.
    """
    digest = F.md5(F.to_json(F.struct(*[docs[c] for c in docs.columns])).cast("binary"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["digest", "key", "fp"])

    own = per_batch(docs.select(digest.alias("digest"), F.col(key).cast("long").alias("key"), text_or_empty(column)), run, "digest string, key long, fp long")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "digest")).alias("first")
    classes, _ = materialise(own.groupBy("fp").agg(first), "classes")
    comps, _ = materialise(connected_components(links(classes.select("fp", F.col("fp").alias("rep")), radius)), "components")
    groups = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    kept = docs.withColumn("__digest", digest).join(groups.select(F.col("first.digest").alias("__digest")), "__digest", "left_semi")
    return kept.dropDuplicates(["__digest"]).select(*docs.columns)
