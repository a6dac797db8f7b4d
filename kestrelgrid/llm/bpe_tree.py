"""BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved until the leaves are short. Leaves are encoded independently of each
other: those of a very long text by the library's threads side by side, the others through one cache of
word ids, as Spark's tasks are parallel already. Going up the tree, each join is mended: a
window around it is encoded, and grows until its tokens agree with the left half's on its left side
and with the right half's on its right side; what stands between is then the window's.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, text_or_empty
from .word_bpe import Cached, WordBpe, load

#: Characters of a leaf, first reach of a window to either side, and tokens in a row that must agree on each side.
LEAF, WINDOW, AGREE = 8_192, 24, 2
#: Leaves from which on a text's leaves go to the library's threads at once. Threads shorten a long text's time where cores
#: are free, but take about five times the CPU time of the cache; shorter texts are left to Spark's tasks.
SIDE_BY_SIDE = 16


def _clear_cut(spans: list[tuple[int, int]], k: int) -> bool:
    """Whether token k shares no character with its neighbours, so that its span stands for it alone."""
    a, b = spans[k]
    return a < b and (k == 0 or spans[k - 1][1] <= a) and (k + 1 == len(spans) or spans[k + 1][0] >= b)


def _agreeing(ids, spans, shift, matched: range, window: dict, own_ids, own_spans):
    """The first run of AGREE tokens within ``matched`` that the window has at the same place; (index there, index in the window)."""
    run = 0
    for k in matched:
        at = window.get((spans[k][0] + shift, spans[k][1] + shift, ids[k]))
        run = run + 1 if at is not None and _clear_cut(spans, k) and _clear_cut(own_spans, at) else 0
        if run == AGREE:
            return k - AGREE + 1, at - AGREE + 1
    return None


def join(bpe: WordBpe, text: str, left: list[int], right: list[int], lo: int, mid: int, hi: int, window: int = WINDOW) -> list[int]:
    """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    encode = lambda s: bpe.tokenizer.encode(s, add_special_tokens=False)
    while True:
        a, b = max(lo, mid - window), min(hi, mid + window)
        whole = encode(text[a:b])
        ids, spans = whole.ids, whole.offsets
        if a == lo and b == hi:
            return ids
        at = {(s, e, i): k for k, ((s, e), i) in enumerate(zip(spans, ids, strict=True))}
        if a == lo:
            from_left = (0, 0, 0)
        else:
            part = encode(text[a:mid])
            same = 0
            while same < min(len(part.ids), len(left)) and part.ids[-1 - same] == left[-1 - same]:
                same += 1
            n = len(part.ids)
            hit = _agreeing(part.ids, part.offsets, 0, range(n - same, n), at, ids, spans)
            from_left = hit and (len(left) - (n - hit[0]), hit[1], hit[0])
        if b == hi:
            to_right = (len(right), len(ids))
        else:
            part = encode(text[mid:b])
            same = 0
            while same < min(len(part.ids), len(right)) and part.ids[same] == right[same]:
                same += 1
            hit = _agreeing(part.ids, part.offsets, mid - a, range(same), at, ids, spans)
            to_right = hit and (hit[0], hit[1])
        if from_left and to_right and from_left[1] <= to_right[1]:
            return left[: from_left[0]] + ids[from_left[1] : to_right[1]] + right[to_right[0] :]
        window *= 2


def encode_tree(bpe: WordBpe, text: str, leaf_ids, leaf: int = LEAF, side_by_side: int = SIDE_BY_SIDE) -> list[int]:
    """Ids of a whole text. ``leaf_ids`` encodes a short text."""
    if len(text) <= leaf:
        return leaf_ids(text)
    parts = 1 << ((len(text) - 1) // leaf).bit_length()
    edges = [len(text) * k // parts for k in range(parts + 1)]
    leaves = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    if parts >= side_by_side:
        level = [e.ids for e in bpe.tokenizer.encode_batch_fast(leaves, add_special_tokens=False)]
    else:
        level = [leaf_ids(s) for s in leaves]
    while len(level) > 1:
        level = [join(bpe, text, level[k], level[k + 1], edges[k], edges[k + 1], edges[k + 2]) for k in range(0, len(level), 2)]
        edges = edges[::2]
    return level[0]


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self._ids = Cached(self.bpe.word_ids)
        t = self.bpe.tokenizer
        size = max(t.get_vocab(with_added_tokens=True).values()) + 1
        self.names = [t.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        if t.decoder is not None:
            raise ValueError("only files without a decoder are supported")

    def leaf_ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._ids.__getitem__, self.bpe.words(text))))

    def encode(self, text: str) -> list[int]:
        return encode_tree(self.bpe, text, self.leaf_ids)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins the tokens by a space."""
        return " ".join(map(self.names.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ids (array<int>) and decoded (string) of every row's whole text; a null text is empty and has no ids.

    Null and repeated keys keep their rows, very long texts are encoded whole, other columns are ignored, whatever
    their names, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(docs.select(docs[key].alias("key"), text_or_empty(column)), run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (ids in decimal, joined by a space) and decoded_sha256 (UTF-8), as of :func:`encode_documents`.

    Digests are made where the ids are, so that ids and decoded texts don't leave the worker. Rows as there.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        out: tuple[list, list, list] = ([], [], [])
        for text in batch.column(1).to_pylist():
            ids = c.encode(text)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(" ".join(map(c.numbers.__getitem__, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(docs.select(docs[key].alias("key"), text_or_empty(column)), run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
