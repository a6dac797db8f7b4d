import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrelgrid.llm import chat_format as chat

PIECES = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "user", "assistant", "im_end|>", "<\\|", "é", " "]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_any_conversation_parses_back(turns):
    out = "".join(chat.render_turn(r, t) for r, t in turns)
    assert [x[:2] for x in chat.parse(out)] == turns
    assert out.count("<|im_start|>") == out.count("<|im_end|>") == len(turns)


def test_plain_turns_are_not_escaped():
    assert chat.render_turn("user", "a < b | c \\ d") == "<|im_start|>user\na < b | c \\ d<|im_end|>\n"
    assert chat.render_turn("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u<|im_end|>\nhi<|im_end|>\n", "<|im_start|>u\n<|im_start|>v\nhi<|im_end|>\n"])
def test_the_grammar_refuses_others(bad):
    with pytest.raises(chat.GrammarError):
        list(chat.parse(bad))


def rows(spark, data=None):
    data = data if data is not None else [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "also"), (2, None, None, None), (2, 0, "assistant", ""), (None, 3, "assistant", "<|im_end|>é"), (3, 0, "system\n", "x" * 50_000), (1, 0, "user", "one"),
    ]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"rendered": F.lit("x"), "start": F.lit("x")})


def test_hard_rows(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.read_back(rows(spark)).collect()}
    assert (got[1].n_turns, got[1].turns_sha256) == (4, sha("user\none\nuser\none\nassistant\nalso\nassistant\ntwo\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (7, sha("alsotwo"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (2, sha("\n\nassistant\n\n"), sha(""))
    assert (got[None].loss_chars, got[None].formatted_chars) == (11, 12 + 10 + 12 + 11)
    assert got[3].n_turns == 1
    assert chat.read_back(rows(spark).limit(0)).count() == 0


def test_loss_mask_marks_the_assistants_texts(spark):
    out = {}
    for r in chat.format_conversations(rows(spark)).orderBy("conv_id", "start").collect():
        text, spans = out.get(r.conv_id, ("", []))
        assert r.start == len(text)
        out[r.conv_id] = (text + r.rendered, spans + ([(r.loss_start, r.loss_end)] if r.loss_start is not None else []))
    text, spans = out[1]
    assert [text[a:b] for a, b in spans] == ["also", "two"]
    assert [x[:2] for x in chat.parse(text)][0] == ("user", "one")
