"""Chat formatting with a grammar round trip.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Each written turn is read back by a deterministic parser; if the
recovered turn is not the source, the conflicting content is escaped (one backslash more in `<|`, `<\\|`, ...) and the
turn written again, until they are identical. Turns are self-delimiting, so a conversation is the concatenation of its
written turns, and one of any length streams through with one turn in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n((?:(?!<\|).)*)" + re.escape(END) + r"\n", re.S)


def write_turn(role: str, text: str) -> str:
    """The written turn: as it is if it reads back as the source, else escaped."""
    plain = f"{START}{role}\n{text}{END}\n"
    if read_turns(plain) == [(role, text)]:
        return plain
    safe_role = _CONTROL.sub(r"<\\\1|", role).replace("\\", "\\b").replace("\n", "\\n")
    return f"{START}{safe_role}\n{_CONTROL.sub(r'<\\\1|', text)}{END}\n"


def _role(written: str) -> str:
    return _ESCAPED.sub(r"<\1|", re.sub(r"\\([bn])", lambda m: "\\" if m[1] == "b" else "\n", written))


def turn_spans(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the written text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield _role(m[1]), _ESCAPED.sub(r"<\1|", m[2]), m.start(2), m.end(2)
        at = m.end()


def read_turns(formatted: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, text) for role, text, _, _ in turn_spans(formatted)]
    except ValueError:
        return None


def _ordered(turns: DataFrame) -> DataFrame:
    """Each conversation whole in one partition, sorted, so that a task streams through it turn by turn."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, seq, at = object(), 0, 0
    for batch in batches:
        out = []
        for conv, role, text in zip(batch["conv_id"].array, batch["role"], batch["text"], strict=True):
            key = None if pd.isna(conv) else int(conv)
            if key != last:
                last, seq, at = key, 0, 0
            written = write_turn(role, text)
            # Nothing is trusted: what was written must read back as the source.
            if (back := list(turn_spans(written))) and (len(back) != 1 or back[0][:2] != (role, text)):
                raise ValueError("a turn does not survive the round trip")
            _, _, lo, hi = back[0]
            out.append((key, seq, written, role == "assistant", at + lo, at + hi))
            seq, at = seq + 1, at + len(written)
        frame = pd.DataFrame(out, columns=["conv_id", "seq", "piece", "in_loss", "start", "end"])
        yield frame.astype({"conv_id": "Int64"})


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in order: conv_id, seq, piece, in_loss, start, end.

    The pieces of a conversation, joined by seq, are its formatted text; start and end bound the turn's text in it by
    code points, and the loss mask covers the spans with in_loss (assistant turns). Null texts and roles are empty; a
    null conv_id is a conversation of its own; rows that tie on turn are ordered by role and text, repeated rows are
    turns of their own. An empty table gives an empty result; extra columns are ignored.
    """
    schema = columns(conv_id="long", seq="long", piece="string", in_loss="boolean", start="long", end="long")
    return _ordered(turns).mapInPandas(_write, schema)


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def close(s):
        return (s["conv"], s["turns"], s["sha"].hexdigest(), s["loss"], s["loss_sha"].hexdigest(), s["chars"])

    for batch in batches:
        done = []
        for conv, piece, in_loss, start, end in zip(batch["conv_id"].array, batch["piece"], batch["in_loss"], batch["start"], batch["end"], strict=True):
            key = None if pd.isna(conv) else int(conv)
            if state is None or key != state["conv"]:
                if state is not None:
                    done.append(close(state))
                state = {"conv": key, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}
            for role, text, _, _ in turn_spans(piece):
                state["turns"] += 1
                state["sha"].update(f"{role}\n{text}\n".encode())
            if in_loss:
                span = _ESCAPED.sub(r"<\1|", piece[start - state["chars"] : end - state["chars"]])
                state["loss"] += len(span)
                state["loss_sha"].update(span.encode())
            state["chars"] += len(piece)
        if done:
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
    if state is not None:
        yield pd.DataFrame([close(state)], columns=names).astype({"conv_id": "Int64"})


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from the pieces of `format_turns` as they lie (ordered, each whole in a partition).

    n_turns, turns_sha256 (role, \\n, text, \\n of each recovered turn), loss_chars and loss_sha256 (all text under the
    loss mask, unescaped), formatted_chars.
    """
    schema = columns(conv_id="long", n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long")
    return pieces.mapInPandas(_read_back, schema)
