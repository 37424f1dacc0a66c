"""Chat formatting by incremental black-box rendering.

A template is only asked to render lists of turns. Successive turn prefixes are rendered; where an output extends
the one before it, what it adds is the span of the new turn, and where it does not, the template rewrites history,
which is reported, and the span is what lies behind the common part of both. Inside its span a text is located by
rendering the same turns with two one-character probes as the last text: the outputs differ in that character alone.

The template at hand marks turns with control strings and escapes these (and the escape character) inside texts, so
formatted text reads back exactly.

Defined results: rows are ordered by turn, ties by role and text, nulls first; a null text or role is empty; roles
other than the three known ones render like users; a row without a conversation id belongs to the conversation
null; repeated rows are turns of their own; an empty table gives no rows; conversation ids are integers (others are
cast, and what can't be raises); other columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime

Turn = tuple[str, str]
#: Fixed values of the template: its control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
PROBES = ("\ue000", "\ue001")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """text without any control string in it."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@lru_cache(1024)
def _piece(role: str, text: str) -> str:
    """A turn of render(); every prefix renders its turns again."""
    return f"{escape(text)}</s>" if role == "assistant" else f"[INST] {escape(role)}\n{escape(text)} [/INST]"


def render(turns: list[Turn]) -> str:
    """<s>[INST] role, line feed, text [/INST] for asking turns, text</s> for the assistant's."""
    return "<s>" + "".join([_piece(r, t) for r, t in turns])


def read_turn(span: str) -> Turn:
    """The turn that a span of formatted text holds."""
    if span.startswith("[INST] ") and span.endswith(" [/INST]"):
        role, _, text = span[7:-8].partition("\n")
        return unescape(role), unescape(text)
    if not span.endswith("</s>"):
        raise ValueError("not a turn")
    return "assistant", unescape(span[:-4])


def _common(a: str, b: str) -> int:
    """Length of what both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _prefixes(turns: list[Turn], template: Callable[[list[Turn]], str]) -> dict:
    """locate() by rendering every prefix whole."""
    out = template([])
    spans, texts, rewritten = [], [], False
    for i in range(len(turns)):
        new = template(turns[: i + 1])
        common = len(out) if new.startswith(out) else _common(out, new)
        if common < len(out):
            rewritten = True
            spans = [s if s and s[1] <= common else None for s in spans]
        spans.append((common, len(new)))
        a, b = (template([*turns[:i], (turns[i][0], p)]) for p in PROBES)
        head = _common(a, b)
        tail = len(a) - head - 1
        texts.append((head, len(new) - tail) if a[head:][:1] == PROBES[0] and head >= common else None)
        out = new
    return {"formatted": out, "spans": spans, "texts": texts, "rewritten": rewritten}


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> dict:
    """The formatted text, each turn's span and text span in it (code points), and whether history was rewritten.

    Every prefix is rendered whole and held against the one before it, however long the conversation is."""
    return _prefixes(turns, template)


_TEXTS, _SPANS = pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))
SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("roles", _TEXTS),
        ("texts", _TEXTS),
        ("turn_spans", _SPANS),
        ("loss_spans", _SPANS),
        ("loss_text", pa.string()),
        ("rewrites_history", pa.bool_()),
    ]
)
DDL = (
    "conv_id long, formatted string, roles array<string>, texts array<string>, turn_spans array<array<long>>, "
    "loss_spans array<array<long>>, loss_text string, rewrites_history boolean"
)


def format_turns(
    conv_id: int | None,
    turns: list[Turn],
    template: Callable[[list[Turn]], str] = render,
    read: Callable[[str], Turn] = read_turn,
    undo: Callable[[str], str] = unescape,
) -> dict:
    """One conversation's row; what it says of turns and loss is read back from the formatted text."""
    at = locate(turns, template)
    out, ok = at["formatted"], not at["rewritten"]
    back = [read(out[a:b]) for a, b in at["spans"]] if ok else []
    loss = [t for (role, _), t in zip(turns, at["texts"], strict=True) if role == "assistant" and t] if ok else []
    return {
        "conv_id": conv_id,
        "formatted": out,
        "roles": [r for r, _ in back],
        "texts": [t for _, t in back],
        "turn_spans": [list(s) for s in at["spans"]] if ok else [],
        "loss_spans": [list(s) for s in loss],
        "loss_text": "".join(undo(out[a:b]) for a, b in loss),
        "rewrites_history": not ok,
    }


def _format(template, read, undo):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, started, rows, size = None, [], False, [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if started and c != conv:
                    rows.append(format_turns(conv, turns, template, read, undo))
                    size += len(rows[-1]["formatted"])
                    turns = []
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
                conv, started = c, True
                turns.append((role or "", text or ""))
        if started:
            rows.append(format_turns(conv, turns, template, read, undo))
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


def format_chats(
    rows: DataFrame, *, template: Callable[[list[Turn]], str] = render, read: Callable[[str], Turn] = read_turn,
    undo: Callable[[str], str] = unescape,
) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): formatted text, turns as read back, their spans, the
    spans under the loss mask and their text, and whether the template rewrites history (then without spans)."""
    rows = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    dealt = rows.repartition(runtime.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(template, read, undo), DDL)
