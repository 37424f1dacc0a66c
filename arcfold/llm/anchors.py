"""Winnowed anchors: which stretches of a corpus can repeat at all, found in one scan.

A window of fixed length has as its anchor the seed with the smallest hash in it (the leftmost of equals), so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a run; a run is known by its
anchor's hash and the hash of all its text. Runs whose anchor no other run has cannot repeat and are gone; the others
are few. Texts are found again by (k1, k2), the id and a hash of the text, so rows that share an id don't mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit
from arcfold.llm.textkit import U64

RUNS = "k1 long, k2 long, start long, count long, anchor long, content long, place long"


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def window_runs(sums: textkit.Sums, off: np.ndarray, window: int, seed: int, reach: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, first start, windows, anchor hash, content hash, place of the anchor) of every run of the texts between
    offsets. The content is what lies within `reach` units (by default a window) of a window's start."""
    start, doc = textkit.windows(off, window)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    at = np.arange(int(off[-1]) - seed + 1)
    h = (sums.sums[at + seed] - sums.sums[at]) * sums.inverse(at)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    low = sliding_minimum((h & U64(0xFFFFFFFF00000000)) | at.astype(np.uint64), window - seed + 1)
    place = (low[start] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    first, count, of = start[new], np.diff(np.append(new, len(start))), doc[new]
    content = sums.hash(first, np.minimum(first + count + (reach or window) - 1, off[of + 1]))
    return of, first - off[of], count, sums.hash(place[new], place[new] + seed), content, place[new] - off[of]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the key of each text."""
    return docs.withColumns({"k1": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "k2": F.xxhash64(F.col(text_col), F.col(id_col).isNull())})


def find_runs(
    texts: DataFrame, units: Callable[[pa.Array], tuple[textkit.Sums, np.ndarray]], window: int, seed: int, reach: int | None = None
) -> DataFrame:
    """The runs of (k1, k2, text); `units` gives the hashed units of a batch and the offsets of its texts in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, "text"):
            doc, start, count, anchor, content, place = window_runs(*units(batch.column("text")), window, seed, reach)
            key = batch.select(["k1", "k2"]).take(pa.array(doc))
            out = [*key.columns, *(pa.array(x.view(np.int64)) for x in (start, count, anchor, content, place))]
            yield pa.record_batch(out, ["k1", "k2", "start", "count", "anchor", "content", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(run, RUNS)


def shared(runs: DataFrame) -> DataFrame:
    """Runs whose anchor more than one run has. The anchors are a table first: only a join of plain shuffles can be
    split where one anchor has very many runs."""
    often = runs.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return runs.join(runtime.staged(often, "anchors"), "anchor")


def beside_texts(texts: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """(k1, k2, text) of the texts that have runs, with these columns of the runs as arrays."""
    lists = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "count", *columns)).alias("runs"))
    return texts.select("k1", "k2", "text").join(lists, ["k1", "k2"])


def spans(marks: DataFrame) -> DataFrame:
    """Marks (k1, k2, a, b, kind) gathered by text."""
    return marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "kind")).alias("_marks"))


Cut = Callable[..., dict[str, pa.Array]]


def marked(docs: DataFrame, marks: DataFrame, text_col: str, cut: Cut, added: dict[str, str], kinds: int = 1) -> DataFrame:
    """docs (with k1 and k2) rewritten by `cut`, which gets a batch and, for each kind of marks, the merged marks of
    each of its texts."""
    names = [c for c in docs.columns if c not in ("k1", "k2")]
    types = {f.name: "string" if f.name == text_col else f.dataType.simpleString() for f in docs.schema.fields} | added
    out = [*names, *added]
    if "kind" not in marks.columns:
        marks = marks.withColumn("kind", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, text_col):
            lists = batch.column("_marks")
            flat = lists.flatten()
            a, b, kind = (x.to_numpy(zero_copy_only=False) for x in flat.flatten()) if len(flat) else (np.zeros(0, np.int64),) * 3
            n = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            of = np.repeat(np.arange(len(n)), n)
            per = []
            for k in range(kinds):
                own = kind == k
                cuts = np.searchsorted(of[own], np.arange(len(n) + 1))
                x, y = a[own], b[own]
                per.append([textkit.merge(x[i:j], y[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            new = cut(batch, *per)
            yield pa.record_batch([new[c] if c in new else batch.column(c) for c in out], out)

    return docs.join(spans(marks), ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in out))


def stretch(start: Column, count: Column, window: int) -> list[Column]:
    """The mark of all windows of a run."""
    return [start.alias("a"), (start + count + (window - 1)).alias("b")]

