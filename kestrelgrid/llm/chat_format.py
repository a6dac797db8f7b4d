"""Chat formatting whose output a deterministic parser reads back.

A turn is rendered, parsed by the grammar below and compared with its source; content that does not
come back identical is escaped and tried again.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A role has no line feed, and neither role nor text holds a control string. In text, an escape adds one
backslash to every ``<``, backslashes, ``|``; reading takes one away. Text without such a sequence stays
as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
_CONTROL = re.compile(re.escape(START) + "|" + re.escape(END))
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(s: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted string from ``at`` on: role and text as they were before escaping, and where the text stands."""
    while at < len(s):
        if not s.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        body = s.find("\n", at + len(START))
        if body < 0:
            raise GrammarError(f"no role ends after {at}")
        if _CONTROL.search(s, at + len(START), body):
            raise GrammarError(f"a control string in the role at {at}")
        end = _CONTROL.search(s, body + 1)
        if not end or end[0] != END or not s.startswith("\n", end.end()):
            raise GrammarError(f"the turn at {at} has no end")
        yield unescape_role(s[at + len(START) : body]), unescape(s[body + 1 : end.start()]), body + 1, end.start()
        at = end.end() + 1


def render_turn(role: str, text: str) -> str:
    """A turn that parses back to exactly ``role`` and ``text``: as it is if it does, else with the conflicting part escaped."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        out = render(r, t)
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except GrammarError:
            pass
    raise GrammarError(f"no rendering of a turn of {role!r} parses back to it")


def render_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, rendered) of every row, rendered and read back where the row is.

    Null roles and texts are empty. A null turn stands before the others of its conversation; rows with
    equal turns are ordered by their rendered form; a null conversation id is a conversation of its own.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [render_turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["conv_id", "turn", "rendered"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return per_batch(rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text")), run, "conv_id long, turn long, rendered string")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted output in order: a row for each turn with conv_id, start (code points before it), rendered, and the loss mask.

    loss_start and loss_end are the code points, within the conversation, of an assistant's text; null for
    other roles. Rows of a conversation stand together in order, so that its text is the concatenation of
    ``rendered``; a conversation is read turn by turn and never held as a whole.
    """
    turns = render_turns(rows, conv, turn, role, text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, first = None, 0, True
        for batch in batches:
            out: list[tuple] = []
            for conv_id, rendered in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first or conv_id != here:
                    here, at, first = conv_id, 0, False
                ((who, _, a, b),) = parse(rendered)
                out.append((conv_id, at, rendered, at + a if who == LOSS_ROLE else None, at + b if who == LOSS_ROLE else None))
                at += len(rendered)
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "start", "rendered", "loss_start", "loss_end"])

    return turns.mapInArrow(run, "conv_id long, start long, rendered string, loss_start long, loss_end long")


def read_back(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, parsed from the formatted output.

    Digests are carried from turn to turn within a sorted partition: all turns of a conversation, and all rows
    without a conversation id, go through one task, one turn at a time. Very long texts are whole cells there.
    Null roles and texts are empty, repeated turns all count, other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    turns = format_conversations(rows, conv, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def close() -> list[tuple]:
            return [] if state is None else [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])]

        for batch in batches:
            out: list[tuple] = []
            for conv_id, start, rendered, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start == 0:
                    out += close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for who, said, _, _ in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{who}\n{said}\n".encode())
                if a is not None:
                    masked = unescape(rendered[a - start : b - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(rendered)
            yield made(out)
        yield made(close())

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
