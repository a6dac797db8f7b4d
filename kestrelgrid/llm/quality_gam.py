"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a small tree over that feature's bins, many
times round; pairs of features then get trees over their joint bins in the same way. Every tree is a
step function of bins, so their sum is one lookup table for each feature and pair, and scoring is a
vectorised addition of looked-up values.

The model is fitted on the driver from at most SAMPLE labelled rows, chosen by a hash of their keys; the
bound holds at any corpus size, and every row is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, text_or_empty
from .quality_llr import base_counts

#: Labelled rows the model is fitted on at most.
SAMPLE = 20_000
#: Bins of a feature alone and in a pair; rounds over features and over pairs; pairs; step; L2 weight; cuts of a tree.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2, CUTS = 32, 8, 120, 60, 6, 0.15, 1.0, 3
CUTOFF = 0.3
FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "punctuation", "pipes", "bangs", "dup_lines", "repeats", "distinct", "stays", "line_words", "non_ascii", "short_words", "ends")
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER, _DIGIT, _PUNCT = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:?\"'()-")


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all are finite, also of an empty one."""
    data = text.encode()
    n, chars, symbols, dup, repeat = base_counts(text)
    less = lambda cut: len(data) - len(data.translate(None, cut))
    words, w, c = data.split(), max(n, 1), max(chars, 1)
    lines = data.count(b"\n") + 1
    distinct = len(set(words))
    stays = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    upper, lower, ascii_ = less(_UPPER), less(_LOWER), len(data) - sum(len(x) for x in (data.translate(None, bytes(range(128))),))
    return [
        float(np.log1p(n)), chars / w, symbols / c, upper / max(upper + lower, 1), less(_DIGIT) / c, less(_PUNCT) / c, data.count(b"|") / w, data.count(b"!") / w,
        dup / lines, repeat / w, distinct / w, stays / w, float(np.log1p(n / lines)), 1 - ascii_ / max(len(data), 1), sum(len(x) < 4 for x in words) / w, float(data.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


@dataclass
class Gam:
    """Cut points of each feature, its table; cut points of pairs, their tables."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        for i, j, t in self.pairs:
            total += t[at[i], at[j]]
        return 1 / (1 + np.exp(-total))


def _cut_points(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A shallow tree over ordered bins: CUTS greedy splits, then the Newton step of each leaf."""
    edges = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    for _ in range(CUTS):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), int(k[at])))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = -RATE * (cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut on each of two axes (four leaves), and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    if n < 2 or m < 2:
        return np.zeros(g.shape), 0.0
    quads = lambda c: (q := c[1:n, 1:m], c[1:n, m:] - q, c[n:, 1:m] - q, c[n:, m:] - c[1:n, m:] - c[n:, 1:m] + q)
    gain = sum(_gain(a, b) for a, b in zip(quads(cg), quads(ch), strict=True)) - _gain(cg[n, m], ch[n, m])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -RATE * g[rows, cols].sum() / (h[rows, cols].sum() + L2)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of features ``x`` and labels ``y`` (0 or 1); without both labels, their smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, width = float(np.log(share / (1 - share))), x.shape[1]
    if len(set(y.tolist())) < 2:
        return Gam(base, [np.empty(0)] * width, [np.zeros(1)] * width, [np.empty(0)] * width, [])
    cuts = [_cut_points(x[:, j], BINS) for j in range(width)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            step = _step(np.bincount(at[j], p - y, size), np.bincount(at[j], p * (1 - p), size))
            tables[j] += step
            total += step[at[j]]
    pair_cuts = [_cut_points(x[:, j], PAIR_BINS) for j in range(width)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-total)), (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        cell = at[i] * shape[1] + at[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    ranked = sorted(((_pair_step(*sums(i, j))[1], i, j) for i in range(width) for j in range(i + 1, width)), key=lambda r: (-r[0], r[1], r[2]))
    pairs = [(i, j, np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            step, _gained = _pair_step(*sums(i, j))
            t += step
            total += step[at[i], at[j]]
    return Gam(base, cuts, tables, pair_cuts, pairs)


def held_out(key: str = "doc_id"):
    """Rows from which no label is learned: crc32 of the key as text divisible by 5. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled rows that aren't held out, in an order that does not depend on partitions.

    A key with several labels counts once, with the smallest, and one with several texts with the least
    features. The chosen keys are at most ``sample``, so
    their broadcast has a proven bound; the table of texts is not shuffled.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    chosen = usable.groupBy(F.col(key).alias("__k")).agg(F.min(label).cast("int").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(sample)
    spark = docs.sparkSession
    kept = spark.createDataFrame(chosen.collect(), chosen.schema)
    rows = docs.select(docs[key].alias("__k"), text_or_empty(column)).join(F.broadcast(kept), "__k")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index(column)
        vectors = [features(t) for t in batch.column(k).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("__y")), pa.array(vectors, pa.list_(pa.float64()))], ["k", "y", "x"])

    kind = kept.schema["__k"].dataType.simpleString()
    got = per_batch(rows, run, f"k {kind}, y int, x array<double>").groupBy("k", "y").agg(F.min("x").alias("x")).toPandas().sort_values("k")
    return (np.array(got.x.tolist(), dtype=float).reshape(-1, len(FEATURES)), got.y.to_numpy(dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality", cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """``key``, held_out, score (0 to 1) and predicted (1 if score >= ``cutoff``) of every row's whole text.

    Scores depend on the text alone, so rows with equal texts tie; a null text is empty, a text of any length
    is scored whole. Without usable labels every score is 0.5. Null and repeated keys keep their rows, other
    columns are ignored, whatever their names, an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*training_rows(docs, labels, key, column, label, sample)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(2).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        s = model.value.score(x)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= cutoff).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), held_out(key).alias("held_out"), text_or_empty(column))
    return per_batch(rows, run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def keep_predicted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality", cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that :func:`score_documents` predicts to be 1, with all their columns and under all their names.

    Each row is judged by its text alone: null and repeated keys and nulls in other columns stay as they
    are, null texts count as empty, very long ones are scored whole; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, key, column, label, sample)))
    place = docs.columns.index(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t or "") for t in batch.column(place).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(model.value.score(x) >= cutoff))

    return per_batch(docs, run, docs.schema)
