"""Substring dedup by seed and extend.

Documents are joined on winnowed anchors: seeds of `SEED` words chosen so that any two equal stretches of `window`
words share one. A run of windows around an anchor that a smaller id has word for word is a repeat as it stands. Of
the runs of an anchor that differ somewhere, the smallest holder of each is extended from the anchor both ways against
those of smaller ids: hashes of the words up to each place before the anchor, and behind it, tell how far both agree,
and a match of `window` words or more is a maximal repeat within the run. Repeats that overlap merge.

An anchor with over `HOT_KINDS` different runs, such as that of a very common passage, would make too many pairs: its
windows, which reach one word further each, are held against the smallest id that has the same window, by hashes with
partial aggregation. So neither a passage in very many documents nor a group of copies is ever gathered.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null or empty text has none; a text's kept words come
back joined by one space; rows that share an id are one document's and never remove from one another; a row with a
null id neither removes nor loses anything; ids are integers; an empty table gives an empty table; input columns named like the added
ones are replaced, and k1, k2 and _marks are names of the operator's own: such columns don't come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import anchors, runtime, textkit

SEED = 8
#: Different runs of an anchor that meet in pairs.
HOT_KINDS = 64
#: Runs, and pairs of runs, that are extended at once.
ROWS = 4000
PAIRS = 40_000


def words(column) -> tuple[textkit.Sums, np.ndarray]:
    data, off = textkit.flat(column)
    start, end, word_off = textkit.spans(data, off, textkit.NONSPACE)
    return textkit.Sums(textkit.byte_sums(data).hash(start, end), 1), word_off


CONTEXTS = "k1 long, k2 long, start long, place long, anchor long, content long, hot boolean, left binary, right binary"


def _contexts(window: int):
    """What the runs beside a text are extended by: hashes of the words up to each place on both sides of the anchor,
    or, of a hot anchor, a row for each window with its hash as content."""
    names = [f.split()[0] for f in CONTEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, "text"):
            sums, off = words(batch.column("text"))
            lists = batch.column("runs")
            n = np.array([len(x) for x in lists.to_pylist()], np.int64)
            start, count, anchor, content, place, hot = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            doc = np.repeat(np.arange(len(n)), n)
            few = np.flatnonzero(~hot)
            key = batch.select(["k1", "k2"]).take(pa.array(doc[few]))
            base = off[doc[few]] + place[few]
            sides = []
            for reach, at, way in ((place - start, base, -1), (start + count - 1 + window - place - SEED, base + SEED, 1)):
                reach = reach[few]
                step = textkit.expand(np.ones(len(few), np.int64), reach)
                at = np.repeat(at, reach)
                h = sums.hash(at - step, at) if way < 0 else sums.hash(at, at + step)
                sides.append(textkit.binary_rows(h, np.concatenate([[0], np.cumsum(reach)]) * 8))
            columns = (pa.array(x[few]) for x in (start, place, anchor, content, hot))
            yield pa.record_batch([*key.columns, *columns, *sides], names)
            some = np.flatnonzero(hot)
            doc = np.repeat(doc[some], count[some])
            at, anchor = textkit.expand(start[some], count[some]), np.repeat(anchor[some], count[some])
            h = sums.hash(off[doc] + at, off[doc] + at + window).view(np.int64)
            for i in range(0, len(at), 50_000):
                part = slice(i, i + 50_000)
                key = batch.select(["k1", "k2"]).take(pa.array(doc[part]))
                columns = (pa.array(x[part]) for x in (at, at, anchor, h, np.ones(len(at), bool)))
                yield pa.record_batch([*key.columns, *columns, *(pa.nulls(key.num_rows, pa.binary()) for _ in "lr")], names)

    return run


def _reach(sides: list[bytes], room: int) -> np.ndarray:
    """A row of hashes for each side, filled up with values that agree with no other's."""
    out = textkit.mix(np.arange(len(sides) * room, dtype=np.uint64)).reshape(len(sides), room)
    size = np.array([len(x) // 8 for x in sides], np.int64)
    out[np.repeat(np.arange(len(sides)), size), textkit.expand(np.zeros(len(sides), np.int64), size)] = np.frombuffer(b"".join(sides), np.uint64)
    return out


def _extend(window: int):
    """Marks of the repeats among the runs of an anchor, from rows in the order of their anchors and ids."""

    def close(held: list[dict]) -> pa.RecordBatch:
        anchor, content, k1, k2, place = (np.array([r[c] for r in held], np.int64) for c in ("anchor", "content", "k1", "k2", "place"))
        # One document may have the same run at several places: it is extended once.
        _, kind, of = np.unique(np.stack([anchor, content]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        order = np.lexsort((k1[kind], anchor[kind]))
        kind, of = kind[order], np.argsort(order)[of]
        left, right = (_reach([held[i][c] for i in kind.tolist()], window - SEED) for c in ("left", "right"))
        cut = textkit.runs(anchor[kind])
        before = np.arange(len(kind)) - np.repeat(cut[:-1], np.diff(cut))
        marks: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        ends = np.cumsum(before)
        i = 0
        while i < len(kind):
            # As many runs as PAIRS pairs allow, each with those of its anchor that have smaller ids.
            stop = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(i, stop), before[i:stop])
            y = textkit.expand(np.arange(i, stop) - before[i:stop], before[i:stop])
            x, y = (v[k1[kind[x]] > k1[kind[y]]] for v in (x, y))
            far = [(side[x] == side[y]).sum(axis=1) for side in (left, right)]
            long = far[0] + far[1] + SEED >= window
            marks.append(np.unique(np.stack([x[long], *(f[long] for f in far)], axis=1), axis=0))
            i = stop
        found = np.concatenate(marks)
        # Every place of a run gets its marks.
        rows = np.argsort(of, kind="stable")
        at = np.searchsorted(of[rows], np.arange(len(kind) + 1))
        count = (at[1:] - at[:-1])[found[:, 0]]
        row = rows[textkit.expand(at[found[:, 0]], count)]
        l, r = (np.repeat(found[:, c], count) for c in (1, 2))
        return pa.record_batch([pa.array(x) for x in (k1[row], k2[row], place[row] - l, place[row] + SEED + r)], ["k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= ROWS and r["anchor"] != held[-1]["anchor"]:
                    yield close(held)
                    held = []
                held.append(r)
        if held:
            yield close(held)

    return run


def _cut(text_col: str):
    def cut(batch: pa.RecordBatch, marks: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
        data, off = textkit.flat(batch.column(text_col))
        start, end, word_off = textkit.spans(data, off, textkit.NONSPACE)
        gone = np.zeros(len(start), bool)
        for i, (a, b) in enumerate(marks):
            if len(a):
                gone[textkit.expand(word_off[i] + a, b - a)] = True
        of = np.repeat(np.arange(batch.num_rows), np.diff(word_off))
        n_removed = np.bincount(of[gone], minlength=batch.num_rows)
        s, e, of = start[~gone], end[~gone], of[~gone]
        size = e - s + 1  # each word with a blank behind it
        out = np.append(data, np.uint8(32))[textkit.expand(s, size)]
        out[np.cumsum(size) - 1] = 32
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        drop = (np.cumsum(size) - 1)[last]
        chars = np.bincount(of, size, batch.num_rows).astype(np.int64) - (np.bincount(of, minlength=batch.num_rows) > 0)
        kept = textkit.binary_rows(np.delete(out, drop), np.concatenate([[0], np.cumsum(chars)])).cast(pa.string())
        spans = pa.array(
            [[{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)] for a, b in marks],
            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
        )
        return {text_col: kept, "n_words": pa.array(np.diff(word_off)), "n_removed": pa.array(n_removed), "removed_spans": spans}

    return cut


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50) -> DataFrame:
    """docs without the words of repeats: text_col holds the kept words, and n_words, n_removed and removed_spans
    (maximal, in words) are added."""
    docs = runtime.without(docs, "n_words", "n_removed", "removed_spans", "k1", "k2", "_marks")
    keyed = anchors.keyed(docs, id_col, text_col)
    texts = keyed.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select("k1", "k2", F.col(text_col).alias("text"))
    every = runtime.staged(anchors.find_runs(texts, words, window, SEED), "runs")
    runs = runtime.swept(anchors.shared(every), "shared-runs")
    runtime.forget(every)
    first = runtime.staged(runs.groupBy("anchor", "content").agg(F.min("k1").alias("first")), "kinds")
    several = first.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1")
    several = runtime.staged(several.select("anchor", (F.col("_n") > HOT_KINDS).alias("hot")), "several")
    known = runs.join(first, ["anchor", "content"])
    known = runtime.swept(known.join(several, "anchor", "left"), "known-runs")
    runtime.forget(runs, first)
    whole = known.where("k1 > first").select("k1", "k2", *anchors.stretch(F.col("start"), F.col("count"), window))
    open_runs = known.where("k1 = first and hot is not null")
    beside = anchors.beside_texts(texts, open_runs, "anchor", "content", "place", "hot")
    contexts = runtime.swept(beside.mapInArrow(_contexts(window), CONTEXTS), "contexts")
    dealt = contexts.where("not hot").repartition(runtime.partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "k1")
    extended = dealt.mapInArrow(_extend(window), "k1 long, k2 long, a long, b long")
    ext = contexts.where("hot")
    least = ext.groupBy("anchor", "content").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first < last").drop("last")
    least = runtime.staged(least, "least")
    hot = ext.join(least, ["anchor", "content"]).where("k1 > first").select("k1", "k2", *anchors.stretch(F.col("start"), F.lit(1), window))
    marks = runtime.swept(whole.unionByName(extended).unionByName(hot), "marks")
    runtime.forget(known, contexts)
    added = {"n_words": "long", "n_removed": "long", "removed_spans": "array<struct<start:long,end:long>>"}
    return anchors.marked(keyed, marks, text_col, _cut(text_col), added)
