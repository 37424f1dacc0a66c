"""Packing of documents into token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows. Full stretches of a long document close a window of their own;
what is left of it goes to the open window with the least room that holds it. When none has room, the fullest
window is emitted: with padding if its room is `max_pad` or less, else filled up with the head of the document, the
rest of which is placed again. At the end each partition hands its open windows on; these leftovers are packed again
in the same way, `FAN_IN` partitions at a time, until one group is left, and that emits its windows.

A document's tokens are those of a word-level vocabulary file plus an end id. Words are encoded once per process and
then looked up by hash; they end where the tokenizer ends a token in any context, so the ids equal those of the whole
text.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
pieces; ids of null documents stay null; ids are integers (others are cast, and what can't be raises); other columns
of the input, whatever their names, take no part. Sequence ids are unique but not dense.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit

FAN_IN = 64
_BREAKS = textkit._class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
_LETTER = textkit._class((0x41, 0x5A), (0x61, 0x7A))
#: ASCII signs but |
_SIGN = textkit._class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
#: Different words a process remembers before it starts anew.
WORDS_HELD = 2_000_000


class Encoder:
    """Token ids of whole texts, by words, which are remembered for as long as the process lives."""

    _own: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), np.array([end_id], np.uint32)
        self.clear()

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        if (path, end_id) not in cls._own:
            cls._own[path, end_id] = cls(path, end_id)
        return cls._own[path, end_id]

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, first word of each text). Words end at the four blanks, and between an ASCII letter
        and an ASCII sign, where the tokenizer always ends a token (special tokens have | behind their letters)."""
        special = b"<|" in data.tobytes()
        if not special and len(data):
            # A-Z count as a-z but before a non-ASCII character, which could combine with the letter.
            plain = np.append(data[1:] < 0x80, True)
            data = np.where(plain, textkit.LOWER[data], data)
        start, end, word_off = textkit.spans(data, off, ~_BREAKS)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
        cut = cut[~np.isin(cut, off)] if len(cut) else cut
        at = np.searchsorted(start, cut, "right")
        before = np.searchsorted(cut, start[np.minimum(word_off[:-1], max(len(start) - 1, 0))]) if len(start) else np.zeros(len(off) - 1, np.int64)
        total = np.append(np.where(word_off[:-1] < len(start), before, len(cut)), len(cut))
        return data, np.insert(start, at, cut), np.insert(end, at - 1, cut), word_off + total

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts of a column, each with its end id."""
        data, start, end, word_off = self.words(*textkit.flat(column))
        keys, first, of = np.unique(textkit.byte_sums(data).hash(start, end), return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_HELD:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            coded = self.tok.encode_batch(
                [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)],
                add_special_tokens=False,
            )
            ids = [c.ids for c in coded]
            size = np.array([len(i) for i in ids], np.int64)
            place = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
            self.ids = np.concatenate([self.ids, np.array([x for i in ids for x in i], np.uint32)])
            self.keys, self.first, self.size = (np.insert(x, at[new], y) for x, y in ((self.keys, keys[new]), (self.first, place), (self.size, size)))
            at = np.searchsorted(self.keys, keys)
        first, size = self.first[at][of], self.size[at][of]
        total = np.concatenate([[0], np.cumsum(size)])[word_off]
        ids = self.ids[textkit.expand(first, size)]
        return np.insert(ids, total[1:], self.end[0]), total + np.arange(len(total))


class Packer:
    """The open windows of one partition. Pieces are (document, start, tokens of the document, ids)."""

    def __init__(self, length: int, windows: int, max_pad: int, level: int, part: int):
        self.length, self.windows, self.max_pad = length, windows, max_pad
        self.next, self.base = 0, (level << 56) | (part << 32)
        self.open: list[list] = []  # [room, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list, leftover: bool = False) -> None:
        seq, at = self.base + self.next, 0
        self.next += 1
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.out.append((doc, start, len(ids), zlib.crc32(raw), total, seq, at, raw if leftover else None))
            at += len(ids)

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, total, ids[: self.length])])
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            best = min((w for w in self.open if w[0] >= len(ids)), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [self.length, []])
            if best is not None:
                best[0] -= len(ids)
                best[1].append((doc, start, total, ids))
                if not best[0]:
                    self.close(best)
                return
            full = min(self.open, key=lambda w: w[0])
            if full[0] > self.max_pad:
                full[1].append((doc, start, total, ids[: full[0]]))
                ids, start = ids[full[0] :], start + full[0]
            self.close(full)

    def close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1])

    def finish(self, last: bool) -> None:
        """Hands the open windows on; the last packer of all merges them and emits them as they are then."""
        rest, self.open = sorted(self.open, key=lambda w: w[0]), []
        if last:
            self.windows = 1
            for _, pieces in rest:
                for p in pieces:
                    self.add(*p)
            rest, self.open = self.open, []
        for _, pieces in rest:
            self.emit(pieces, leftover=not last)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 8
        self.out = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, SCHEMA.types, strict=True)], schema=SCHEMA)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_docs(tokenizer: str, end_id: int, id_col: str, text_col: str, length: int, windows: int, max_pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end_id)
        packer = Packer(length, windows, max_pad, 0, TaskContext.get().partitionId())
        for batch in textkit.chunks(batches, text_col):
            ids, off = encoder.encode(batch.column(text_col))
            for doc, a, b in zip(batch.column(id_col).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                packer.add(doc, 0, b - a, ids[a:b])
            yield packer.batch()
        packer.finish(last=False)
        yield packer.batch()

    return run


def _pack_again(level: int, last: bool, length: int, windows: int, max_pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["_group"] != group:
                    if packer:
                        packer.finish(last)
                    out, group = packer, r["_group"]
                    packer = Packer(length, windows, max_pad, level, group)
                    packer.out = out.out if out else []
                packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
            yield packer.batch()
        if packer:
            packer.finish(last)
            yield packer.batch()

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1,
    length: int = 2048, windows: int = 32, max_pad: int = 16,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where every stretch of every
    document's tokens lies. `tokenizer` is the path of a vocabulary file that all executors have."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = runtime.staged(rows.mapInArrow(_pack_docs(tokenizer, end_id, "doc_id", "text", length, windows, max_pad), DDL), "pieces")
    done, level = [placed.where("ids is null")], 0
    group = F.shiftright(F.col("sequence_id"), 32).bitwiseAND((1 << 24) - 1)
    parts = docs.sparkSession.sparkContext.defaultParallelism
    left, groups = placed.where("ids is not null"), placed.agg(F.coalesce(F.max(group), F.lit(0))).first()[0] + 1
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        dealt = left.withColumn("_group", F.floor(group / FAN_IN)).repartition(min(groups, 16 * parts), "_group")
        dealt = dealt.sortWithinPartitions("_group", "sequence_id", "offset")
        again = dealt.mapInArrow(_pack_again(level, groups == 1, length, windows, max_pad), DDL)
        if groups == 1:
            done.append(again)
            break
        placed = runtime.staged(again, "pieces")
        done.append(placed.where("ids is null"))
        left = placed.where("ids is not null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("ids")
