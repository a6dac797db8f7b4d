import hashlib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kestrelgrid.llm import bpe_tree, queries, token_counts, word_bpe

from ..oracle import DATA
from .cases import documents

PATH = queries.TOKENIZER
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_of_hard_rows_equal_the_library(spark):
    df = documents(spark)
    got = sorted(token_counts.token_counts(df, PATH).collect(), key=str)
    assert got == sorted([type(got[0])(doc_id=r.doc_id, n_bytes=len((r.text or "").encode()), n_tokens=len(ids(r.text)), over_limit=len(ids(r.text)) > 2048) for r in df.collect()], key=str)


def test_count_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, DATA).collect()}
    assert {k: (r.n_tokens, r.over_limit) for k, r in got.items()} == {k: (len(ids(t)), len(ids(t)) > 2048) for k, t in texts.items()}


def test_a_small_table_and_cache_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 3)
    assert len(token_counts.frequent_lengths(documents(spark), PATH, words=3)) <= 3
    cache = word_bpe.Cached(len, limit=2)
    assert [cache[w] for w in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1]
    assert len(cache) <= 2


def test_the_table_counts_every_text(spark):
    """Words that stand in one text of 70,000 each are all in the table."""
    rare = [f"rare{chr(97 + k)}" for k in range(20)]
    df = spark.range(70_000).selectExpr("id AS doc_id", "CASE WHEN id % 3500 = 0 THEN concat('rare', char(97 + int(id / 3500))) ELSE 'often' END AS text")
    assert set(token_counts.frequent_lengths(df, PATH)) == {"often", *rare}


def test_the_table_ranks_by_the_counts_of_all_partitions(spark):
    """A word that two others precede in each partition, but none in the sum."""
    texts = [(p, " ".join(["most"] * 5 + [f"own{'abcd'[p]}"] * 6 + [f"other{'abcd'[p]}"] * 7)) for p in range(4)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(texts, 4), "doc_id long, text string")
    assert set(token_counts.frequent_lengths(df, PATH, words=2)) == {"most", "othera"}


def test_counts_handed_on_in_parts_are_whole(spark, monkeypatch):
    df = documents(spark)
    want = token_counts.frequent_lengths(df, PATH, words=50)
    monkeypatch.setattr(token_counts, "HELD_WORDS", 3)
    assert token_counts.frequent_lengths(df, PATH, words=50) == want
    monkeypatch.setattr(token_counts, "HELD_WORDS", 10**9)
    monkeypatch.setattr(token_counts, "HELD_CHARS", 5)
    assert token_counts.frequent_lengths(df, PATH, words=50) == want


def test_empty_table(spark):
    df = documents(spark).limit(0)
    assert token_counts.token_counts(df, PATH).count() == 0
    assert bpe_tree.encoding_digests(df, PATH).count() == 0


def test_encoding_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_tree(spark, DATA).collect()}
    assert got == {k: (len(ids(t)), sha(" ".join(map(str, ids(t)))), sha(LIBRARY.decode(ids(t), skip_special_tokens=False))) for k, t in texts.items()}


def test_encoding_hard_rows(spark):
    df = documents(spark)
    got = sorted([(r.doc_id, list(r.ids), r.decoded) for r in bpe_tree.encode_documents(df, PATH).collect()], key=str)
    assert got == sorted([(r.doc_id, ids(r.text), LIBRARY.decode(ids(r.text), skip_special_tokens=False)) for r in df.collect()], key=str)


CODEC = bpe_tree.codec(PATH)


@pytest.mark.parametrize("leaf", [3, 17, 200])
def test_tree_of_unsplit_runs(leaf):
    rnd = random.Random(leaf)
    for alphabet in ("ab", "thaniero", "é́a", "'ls", "<|endoftext|>", "日本x", "1½a", "a "):
        text = "".join(rnd.choice(alphabet) for _ in range(900))
        assert bpe_tree.encode_tree(CODEC.bpe, text, CODEC.leaf_ids, leaf) == ids(text)
        assert bpe_tree.encode_tree(CODEC.bpe, text, CODEC.leaf_ids, leaf, side_by_side=2) == ids(text)


def test_leaves_side_by_side_of_a_very_long_text():
    text = "Thation onthe erst. " * 60_000
    assert len(text) // bpe_tree.LEAF > bpe_tree.SIDE_BY_SIDE
    assert CODEC.encode(text) == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_tree_of_any_text(text, leaf):
    assert bpe_tree.encode_tree(CODEC.bpe, text, CODEC.leaf_ids, leaf) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2100), max_size=60))
def test_words_are_the_librarys(text):
    assert CODEC.leaf_ids(text) == ids(text)


def test_every_assigned_code_point_is_split_as_the_library_does():
    every = [chr(c) for c in range(0x110000) if c < 0x2100 or unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    around = lambda c: (c, f":{c}", f"a{c}b", f"A{c}{c}'S")
    alone = [t for c in every[:0x2100] for t in around(c)]
    # beyond the fast pattern's characters the contexts of many stand in one text, parted by spaces
    packed = [" ".join(t for c in every[at : at + 256] for t in around(c)) for at in range(0, len(every), 256)]
    for text, found in zip(alone + packed, LIBRARY.encode_batch_fast(alone + packed, add_special_tokens=False), strict=True):
        assert CODEC.leaf_ids(text) == found.ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(word_bpe._STRAY + "aÉ:1' "), max_size=30).map("".join))
def test_capitals_whose_small_letters_are_beyond_the_fast_pattern(text):
    assert CODEC.leaf_ids(text) == ids(text)
