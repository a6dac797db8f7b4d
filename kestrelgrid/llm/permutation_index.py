"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Shards of the index post their vectors in one
inverted file for each pivot, with the pivot's place in the vector's order. A query goes through the files
of its own nearest pivots, adding up what gives the footrule distance of the two orders over these; the
vectors nearest by it are scored exactly.

The pivots are a bounded sample (PIVOTS vectors); every vector is indexed. Of n vectors a query scores about
RERANK * sqrt(n) exactly, at every n by this one rule: what the orders leave undecided is a falling share of
a growing table. Queries are broadcast in blocks of a bounded size and each block is searched in all shards,
so vectors are not shuffled and equal vectors don't gather in one task. A task keeps only the best of each
query of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Pivots; how many of them a vector's order has, at most an eighth; how many files a query reads, at most half of these.
PIVOTS, PREFIX, READ = 1_024, 128, 64
#: Vectors that a query scores exactly, for each root of a vector in the table.
RERANK = 10.0
#: Vectors of a shard; queries of a broadcast block on average.
SHARD, QUERY_BLOCK = 8_192, 8_192
SEED = 42


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (largest inner product; equal ones by pivot number)."""
    far = -(x @ pivots.T)
    if prefix < far.shape[1]:
        near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
    else:
        near = np.broadcast_to(np.arange(prefix), (len(x), prefix))
    order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1).astype(np.int16)


def _usable(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles; rows without an id don't."""
    v = F.col(column).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(good)


def build_index(rows: DataFrame, pivots: np.ndarray, prefix: int, shard: int = SHARD) -> DataFrame:
    """Packed shards, one a row: n, ids (int64), vectors (float64) and orders (int16), by ascending id, then vector. Rows alike are packed once."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
            if len(np.unique(ids)) == len(ids):
                by_id = np.argsort(ids)
            else:  # by id, then component by component
                by_id = np.lexsort((*x.T[::-1], ids))
                again = (np.diff(ids[by_id]) == 0) & (np.diff(x[by_id], axis=0) == 0).all(axis=1)
                by_id = by_id[np.concatenate(([True], ~again))]
            ids, x = ids[by_id], x[by_id]
            orders = _orders(x, pivots, prefix)
            cols = [pa.array([len(ids)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, x, orders)]]
            return pa.RecordBatch.from_arrays(cols, ["n", "ids", "vectors", "orders"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))
            if sum(len(h[0]) for h in held) >= shard:
                yield pack()
                held = []
        if held:
            yield pack()

    return rows.mapInArrow(run, "n int, ids binary, vectors binary, orders binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each id once: by falling score, then id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


class Shard:
    """The inverted files of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.x, self.prefix = ids, x, orders.shape[1]
        self.single = len(np.unique(ids)) == len(ids)
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.edges = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.row, self.place = (by_pivot // self.prefix).astype(np.int64), (by_pivot % self.prefix).astype(np.int64)

    def search(self, query_id: int, q: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates for one query: its id isn't one. ``order``: the pivots whose files it reads.

        A vector's order has ``prefix`` pivots and a query's fewer; a pivot that an order lacks counts as at
        place ``prefix``, so their footrule distance is a constant less 2 (prefix - the later place) for
        each pivot they share.
        """
        n = len(self.ids)
        parts = [slice(self.edges[p], self.edges[p + 1]) for p in order.tolist()]
        rows = np.concatenate([self.row[s] for s in parts])
        gain = np.concatenate([self.prefix - np.maximum(self.place[s], at) for at, s in enumerate(parts)])
        near = np.bincount(rows, gain, n).astype(np.int64)
        rank = near * n - np.arange(n)  # ties to smaller ids, which stand first
        want = min(n, max(k + 1, ceil(share * n)))  # a shard gives k others at least, if it has them
        while True:
            chosen = np.argpartition(-rank, want - 1)[:want] if want < n else np.arange(n)
            chosen = chosen[self.ids[chosen] != query_id]
            if want == n or len(chosen) >= k and (self.single or len(np.unique(self.ids[chosen])) >= k):
                break
            want = min(n, 2 * want)  # repeated ids stood in the way
        # a row's sum depends on the row alone, so equal vectors get equal scores
        scores = (self.x[chosen] * q).sum(axis=1)
        if self.single and len(chosen) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= cut
            chosen, scores = chosen[keep], scores[keep]
        return _best(self.ids[chosen], scores, k)


def nearest(df: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, read: int = READ, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every``, its ``k`` nearest found.

    Nearness is the inner product in double precision; ties go to smaller ids; a key is no candidate of its
    own query. Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
    another length than most (ties to the shorter) and those with a null key. Of rows that repeat a key
    each is a candidate, the key counts once with its best score, and as a query it stands for the least of
    its vectors, component by component. Other columns are ignored, whatever their names; a column of texts
    plays no part. No usable vector gives no rows.
    """
    spark = df.sparkSession
    rows = _usable(df, key, column)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == width.w)
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id", "v").limit(2 * pivots).collect()
    p = np.array(list(dict.fromkeys(tuple(r.v) for r in sample))[:pivots])
    prefix = max(1, min(prefix, len(p) // 8))
    read = max(1, min(read, prefix // 2))
    index, _ = materialise(build_index(rows, p, prefix), "index")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries, _ = materialise(queries, "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    share = rerank / sqrt(width["count"])
    out = new_path(spark, "nearest")
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toPandas()
        search_block(index, block.id.to_numpy(np.int64), np.array(block.v.tolist(), dtype=float).reshape(-1, width.w), p, prefix, read, k, share).write.mode("append").parquet(out)
    return spark.read.schema(result).parquet(out)


def search_block(index: DataFrame, ids: np.ndarray, q: np.ndarray, p: np.ndarray, prefix: int, read: int, k: int, share: float) -> DataFrame:
    """The k nearest of one bounded block of queries over all shards: each task's best, then the best of these."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((ids, q, _orders(q, p, read)))
    width, n_pivots = p.shape[1], len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, orders = sent.value
        best: list = [None] * len(ids)
        for batch in batches:
            for n, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, x, o = (np.frombuffer(b, t) for b, t in zip(packed, (np.int64, np.float64, np.int16), strict=True))
                shard = Shard(own, x.reshape(n, width), o.reshape(n, prefix), n_pivots)
                for i in range(len(ids)):
                    got = shard.search(int(ids[i]), q[i], orders[i], k, share)
                    best[i] = got if best[i] is None else _best(np.concatenate((best[i][0], got[0])), np.concatenate((best[i][1], got[1])), k)
        for at in range(0, len(ids), 1_024):
            some = [(i, *best[i]) for i in range(at, min(len(ids), at + 1_024)) if best[i] is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[[s[0] for s in some]], [len(s[1]) for s in some])), pa.array(np.concatenate([s[1] for s in some])), pa.array(np.concatenate([s[2] for s in some]))], ["query_id", "vec_id", "score"])

    found = index.select("n", "ids", "vectors", "orders").mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
