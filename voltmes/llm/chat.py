r"""Chat formatting with a template that a deterministic parser reads back.

A turn is ``### role: text</turn>`` and a line break. In roles and texts a backslash before ``\``, ``#``, ``<`` or ``:`` stands
for that character alone, and the strings ``### ``, ``</turn>`` and, in roles, ``: `` must not stand free. A turn is first
written as it is; if the parser doesn't give it back, its control strings are escaped; if that doesn't do (the text has
backslashes before such characters), the backslashes are doubled first, after which every text comes back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of output that are handed on together.
ROWS = 256
_FREE = r"[^\\#<:]|\\[\s\S]|#(?!## )|<(?!/turn>)"
_TURN = re.compile(rf"### ((?:{_FREE}|:(?! ))*+): ((?:[^\\#<]|\\[\s\S]|#(?!## )|<(?!/turn>))*+)</turn>\n")
_ESCAPED = re.compile(r"\\([\\#<:])")
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("conv", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS)])


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _written(text: str, level: int, role: bool = False) -> str:
    if level > 1:
        text = text.replace("\\", "\\\\")
    if level:
        text = text.replace("### ", "\\### ").replace("</turn>", "\\</turn>")
        if role:
            text = text.replace(":", "\\:")
    return text


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted conversation, or None if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            return None
        turns.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant's texts in it, in code points."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        for level in range(3):
            head, body = f"### {_written(role, level, True)}: ", _written(text, level)
            turn = f"{head}{body}</turn>\n"
            if parse(turn) == [(role, text)]:
                break
        else:
            raise ValueError("a turn doesn't come back")
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts.append(turn)
        at += len(turn)
    formatted = "".join(parts)
    if parse(formatted) != turns:
        raise ValueError("a conversation doesn't come back")
    return formatted, loss


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss) for each conversation; ``loss`` are the spans that count, (start, end) in code points.

    Turns go in the order of ``turn``, null first, ties by role and text; repeated rows stay. Null roles and texts are
    empty, rows with a null conversation make up one of their own. Rows are sorted, not gathered: a task holds one
    conversation at a time. Other columns are not read.
    """
    turns = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, turns = None, []
        for batch in batches:
            for key, *pair in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and key != current:
                    out.append((current, *render(turns)))
                    turns = []
                    if len(out) >= ROWS:
                        yield _batch(out)
                        out = []
                current = key
                turns.append(tuple(pair))
        if turns:
            out.append((current, *render(turns)))
        if out:
            yield _batch(out)

    found = dealt.mapInArrow(formatted, "conv long, formatted string, loss array<struct<start long, end long>>")
    return found.withColumnRenamed("conv", conv)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, texts, spans = zip(*rows)
    loss = [[{"start": a, "end": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(loss, _LOSS)], schema=_OUT)


def digests(formatted: Column | str, loss: Column | str) -> Column:
    """struct<n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars>, read back from a formatted conversation."""

    @F.arrow_udf("struct<n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long>")
    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        found = []
        for text, marked in zip(texts, spans):
            text, marked = text.as_py(), marked.as_py()
            turns = parse(text)
            if turns is None:
                raise ValueError("not a formatted conversation")
            counted = "".join(unescape(text[s["start"]:s["end"]]) for s in marked)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            found.append({
                "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(counted),
                "loss_sha256": hashlib.sha256(counted.encode()).hexdigest(), "formatted_chars": len(text)})
        return pa.array(found, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                          ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return of(formatted, loss)
