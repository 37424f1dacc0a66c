"""Suffix-array dedup by two-stage sorting.

Winnowed anchors deal the windows of `report` bytes to blocks in which all equal windows meet, and drop those that
cannot repeat. Runs of windows that are equal as a whole, with what lies within `window` bytes of them, are one kind:
its first run is sorted for all of them, as a string that is there several times. The suffixes of a block are sorted in two stages:
those smaller than their successor directly, by eight bytes at a time in groups that still tie (and longer stretches
at once where all of a group agree), the others by scanning the buckets of first bytes in order and putting each
suffix behind its successor's place. Common prefixes of neighbours then tell which windows occur again: those of
`window` bytes are removed, those of `report` bytes (shorter passages that repeat) are only reported.

An anchor with over `HOT_RUNS` different runs, such as that of a very common passage, is split: its runs are cut to
stretches of `CORE` windows at places counted from the anchor, and dealt by the bytes all these windows have in
common, so they meet only where they can be equal.

Defined results: texts are UTF-8 bytes; null is empty; matches lie within one text each, equal windows of one text
count, and so do those of repeated rows; bytes left of a cut character stay as they are, so kept text is binary; a
null id takes part; ids are integers; an empty table gives an empty table; input columns named like the added ones are
replaced, and k1, k2 and _marks are names of the operator's own: such columns don't come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import anchors, runtime, textkit

SEED = 32
HOT_RUNS = 256
CORE = 16
#: Bytes of text that are sorted together; one anchor's may be more.
BLOCK = 1 << 20
#: Bytes that a tied group may skip at once.
LEAP = 64


#: Masks of the first k bytes of eight, and what the hash takes for each byte (and, first, the end of a string).
HEADS = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
VALUES = textkit.mix(np.arange(1, 258, dtype=np.uint64))


class Suffixes:
    """The sorted suffixes of some strings, right in their first `depth` bytes: all of them, or the first counts[i] of
    each and those that these are induced from."""

    def __init__(self, strings: list[bytes], depth: int, counts: np.ndarray | None = None):
        self.depth = depth
        raw = b"".join(strings)
        size = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(size) + np.arange(len(size))  # of a 0 behind each string
        self.text = np.zeros(len(raw) + len(size), np.int16)
        self.own = np.ones(len(self.text), bool)
        self.own[ends] = False
        self.text[self.own] = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
        self.end = np.repeat(ends, size + 1)
        n = len(self.text)
        # Eight bytes from each place on, in sorting order; past the end of a string zeros.
        padded = np.zeros(n + 8, np.uint8)
        padded[:n][self.own] = np.frombuffer(raw, np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
        self.eight = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64) & HEADS[np.minimum(self.end - np.arange(n), 8)]
        self.sums = textkit.Sums(VALUES[self.text])
        self._smaller()
        self.wanted = np.ones(n, bool)
        if counts is not None:
            starts = ends - size
            # A larger suffix hangs on its successor, down to the next smaller one.
            at = np.where(self.small, np.arange(n), n - 1)
            hold = np.minimum.accumulate(at[::-1])[::-1]
            step = np.zeros(n + 1, np.int64)
            some = np.asarray(counts) > 0
            np.add.at(step, starts[some], 1)
            np.add.at(step, hold[starts[some] + np.asarray(counts)[some] - 1] + 1, -1)
            self.wanted = np.cumsum(step)[:n] > 0
        self.order = self._induce(self._direct(np.flatnonzero(self.small & self.wanted)))

    def _smaller(self) -> None:
        """Finds which suffixes are smaller than their successors; equal bytes follow the next that differs."""
        step = np.sign(np.diff(self.text.astype(np.int32), append=-1))
        at = np.where(step != 0, np.arange(len(step)), len(step))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        self.small = step[nxt] > 0

    def _key(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bytes at these places, and how many of them lie within the string (so that an end sorts first)."""
        at = np.minimum(at, len(self.text) - 1)
        return self.eight[at], np.minimum(self.end[at] - at, 8)

    def _direct(self, at: np.ndarray) -> np.ndarray:
        key, left = self._key(at)
        order = np.lexsort((left, key))
        at, key, left = at[order], key[order], left[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1])
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        group, deep = np.cumsum(new)[tied], np.full(len(tied), 8)
        tied, group, deep = self._alive(at, tied, group, deep)
        while len(tied):
            p = at[tied] + deep
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(head, len(tied)))
            last = len(self.text)
            q = np.minimum(p + LEAP, last)
            inside = q <= self.end[at[tied]]
            h = self.sums.hash(np.minimum(p, last), q)
            same = np.logical_and.reduceat((h == np.repeat(h[head], size)) & inside, head)
            deep = deep + np.where(np.repeat(same, size), LEAP, 0)
            work = np.flatnonzero(~np.repeat(same, size))
            if len(work):
                key, left = self._key(np.minimum(at[tied[work]] + deep[work], self.end[at[tied[work]]]))
                order = np.lexsort((left, key, group[work]))
                at[tied[work]] = at[tied[work]][order]
                key, left, g = key[order], left[order], group[work]
                new = np.ones(len(work), bool)
                new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (g[1:] != g[:-1])
                fresh = group.astype(np.float64)
                fresh[work] = g + np.cumsum(new) / (len(work) + 2.0)
                group = np.cumsum(np.append(True, fresh[1:] != fresh[:-1]))
                deep[work] += 8
            tied, group, deep = self._alive(at, tied, group, deep)
        return at

    def _alive(self, at: np.ndarray, tied: np.ndarray, group: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tied suffixes whose order still matters: groups of two or more, not yet deep enough, not past their end."""
        if not len(tied):
            return tied, group, deep
        twin = np.append(False, group[1:] == group[:-1])
        keep = (twin | np.append(twin[1:], False)) & (deep < self.depth) & (at[tied] + deep <= self.end[at[tied]])
        return tied[keep], group[keep], deep[keep]

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        """All suffixes, from those sorted directly: in each bucket the larger ones come first."""
        first = self.text[direct]
        cut = np.searchsorted(first, np.arange(258))
        pending: list[list[np.ndarray]] = [[] for _ in range(258)]
        out: list[np.ndarray] = []

        def push(done: np.ndarray, c: int) -> np.ndarray:
            """Deals the larger predecessors to their buckets; gives those of this bucket."""
            p = done[done > 0] - 1
            p = p[~self.small[p] & self.wanted[p]]
            t = self.text[p]
            here = p[t == c]
            p, t = p[t > c], t[t > c]
            order = np.argsort(t, kind="stable")
            p, t = p[order], t[order]
            at = textkit.runs(t)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if len(t) else ():
                pending[t[a]].append(p[a:b])
            return here

        last = len(self.text) - 1
        if self.wanted[last] and not self.small[last]:
            pending[self.text[last]].append(np.array([last]))
        for c in range(258):
            level = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
            while len(level):  # repeats of one byte induce within their own bucket
                out.append(level)
                level = push(level, c)
            small = direct[cut[c] : cut[c + 1] if c < 257 else len(direct)]
            out.append(small)
            push(small, c)
        return np.concatenate(out)

    def common(self) -> np.ndarray:
        """Bytes that each suffix in order has in common with the one before it, up to depth."""
        a, b = self.order[:-1], self.order[1:]
        room = np.minimum(np.minimum(self.end[a] - a, self.end[b] - b), self.depth)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(room >= LEAP)
        while len(live):  # whole leaps first
            p, q = a[live] + out[live], b[live] + out[live]
            live = live[self.sums.hash(p, p + LEAP) == self.sums.hash(q, q + LEAP)]
            out[live] += LEAP
            live = live[out[live] + LEAP <= room[live]]
        live = np.flatnonzero(out < room)
        while len(live):
            x = self.eight[a[live] + out[live]] ^ self.eight[b[live] + out[live]]
            equal = np.where(x == 0, 8, 0)
            diff = np.flatnonzero(x)
            if len(diff):
                equal[diff] = (63 - np.floor(np.log2(x[diff].astype(np.float64))).astype(np.int64)) // 8
                # A float may round a value up to the next power of two, never past a byte that is equal.
                bad = diff[(x[diff] >> (np.uint64(56) - np.uint64(8) * equal[diff].astype(np.uint64).clip(0, 7))) == 0]
                equal[bad] += 1
            out[live] += equal
            live = live[(x == 0) & (out[live] < room[live])]
        return np.append(0, np.minimum(out, room))[: len(self.order)]


def occurrences(strings: list[bytes], counts: np.ndarray, sizes: tuple[int, ...], copies: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """For each size and string, which of the string's first counts[i] places begin a stretch of that many bytes that
    begins at another of these places too. Strings marked in `copies` are there several times: each suffix of a copy
    would lie right beside the first's and have all of it in common, so it is not sorted again."""
    s = Suffixes(strings, max(sizes), counts)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in strings])])[:-1]
    asked = textkit.expand(starts, counts)
    wanted = np.zeros(len(s.text), bool)
    wanted[asked] = True
    at = np.flatnonzero(wanted[s.order])
    places = s.order[at]
    # Between two places that are asked for, the least common prefix on the way is theirs.
    common = np.minimum.reduceat(s.common(), at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int64)
    most = np.zeros(len(s.text), np.int64)
    most[places[1:]] = common
    most[places[:-1]] = np.maximum(most[places[:-1]], common)
    if copies is not None:
        own = asked[np.repeat(copies, counts)]
        most[own] = s.end[own] - own
    return [[most[a : a + n] >= size for a, n in zip(starts.tolist(), counts.tolist(), strict=True)] for size in sizes]


def repeated(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur again in any of the strings."""
    return occurrences(strings, np.array([max(0, len(x) - window + 1) for x in strings]), (window,))[0]


def units(column) -> tuple[textkit.Sums, np.ndarray]:
    data, off = textkit.flat(column)
    return textkit.byte_sums(data), off


FINE = "k1 long, k2 long, start long, count long, anchor long, content long, twice boolean, of_anchor long, of_content long, shift long"


def _split(report: int, window: int):
    """Runs of hot anchors cut to stretches of CORE windows, dealt by the bytes these have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, "text"):
            sums, off = units(batch.column("text"))
            lists = batch.column("runs").to_pylist()
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = [r for x in lists for r in x]
            columns = ("start", "count", "anchor", "content", "place", "twice")
            start, count, anchor, kind, place, twice = (np.array([r[c] for r in flat], np.int64) for c in columns)
            # Windows by their distance to the anchor: those with one quotient share the bytes of a core.
            no, lowest = (place - start) // CORE, (place - start - count + 1) // CORE
            n = no - lowest + 1
            q = np.repeat(no, n) - textkit.expand(np.zeros(len(n), np.int64), n)
            of = np.repeat(np.arange(len(n)), n)
            first = np.maximum(place[of] - q * CORE - (CORE - 1), start[of])
            stop = np.minimum(place[of] - q * CORE + 1, start[of] + count[of])
            core, base = place[of] - q * CORE, off[doc[of]]
            h = sums.hash(base + core, base + core - (CORE - 1) + report)
            key = textkit.mix(h ^ textkit.mix(anchor[of].view(np.uint64) + q.astype(np.uint64)))
            content = sums.hash(base + first, np.minimum(base + stop - 1 + window, off[doc[of] + 1]))
            keys = batch.select(["k1", "k2"]).take(pa.array(doc[of]))
            new = (first, stop - first, key.view(np.int64), content.view(np.int64), twice[of] > 0, anchor[of], kind[of], first - start[of])
            yield pa.record_batch([*keys.columns, *map(pa.array, new)], [f.split()[0] for f in FINE.split(", ")])

    return run


PIECES = "start long, count long, anchor long, content long, twice boolean, piece binary"


def _strings(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, "text"):
            data, off = textkit.flat(batch.column("text"))
            raw = data.tobytes()
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                end = int(off[i + 1])
                text = [raw[off[i] + r["start"] : min(off[i] + r["start"] + r["count"] + window - 1, end)] for r in runs]
                columns = [pa.array([r[c] for r in runs], pa.int64()) for c in ("start", "count", "anchor", "content")]
                columns += [pa.array([r["twice"] for r in runs], pa.bool_()), pa.array(text, pa.binary())]
                yield pa.record_batch(columns, [f.split()[0] for f in PIECES.split(", ")])

    return run


SOLVED = "anchor long, content long, kind int, a long, b long"


def _solve(window: int, report: int):
    """Marks of what occurs again, counted from the start of each run, from pieces in the order of their anchors. Kind
    0 is windows, kind 1 reported ones."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def close(held: list[dict]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        counts, copies = np.array([r["count"] for r in held], np.int64), np.array([r["twice"] for r in held], bool)
        solved = occurrences([r["piece"] for r in held], counts, (window, report), copies)
        for kind, (size, found) in enumerate(zip((window, report), solved, strict=True)):
            for r, again in zip(held, found, strict=True):
                if again.any():
                    at = np.flatnonzero(again)
                    a, b = textkit.merge(at, at + size)
                    new = ([r["anchor"]] * len(a), [r["content"]] * len(a), [kind] * len(a), a.tolist(), b.tolist())
                    for c, v in zip(rows, new, strict=True):
                        c.extend(v)
        return pa.record_batch([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if held and size >= BLOCK and r["anchor"] != anchor:
                    yield close(held)
                    held, size = [], 0
                anchor = r["anchor"]
                held.append(r)
                size += len(r["piece"])
        if held:
            yield close(held)

    return run


Marks = list[tuple[np.ndarray, np.ndarray]]


def _spans(marks: Marks) -> pa.Array:
    rows = [[{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)] for a, b in marks]
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _cut(text_col: str):
    def cut(batch: pa.RecordBatch, marks: Marks, reported: Marks) -> dict[str, pa.Array]:
        data, off = textkit.flat(batch.column(text_col))
        gone = np.zeros(len(data), bool)
        for i, (a, b) in enumerate(marks):
            if len(a):
                gone[textkit.expand(off[i] + a, b - a)] = True
        removed = np.concatenate([[0], np.cumsum(gone)])[off]
        kept = textkit.binary_rows(data[~gone], off - removed)
        again = pa.array([int((b - a).sum()) for a, b in reported], pa.int64())
        out = {"kept": kept, "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(removed)), "n_repeated": again}
        return out | {"removed_spans": _spans(marks), "repeated_spans": _spans(reported)}

    return cut


ADDED = {
    "kept": "binary",
    "n_bytes": "long",
    "n_removed": "long",
    "n_repeated": "long",
    "removed_spans": "array<struct<start:long,end:long>>",
    "repeated_spans": "array<struct<start:long,end:long>>",
}


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 400, report: int = 256) -> DataFrame:
    """docs with kept (the bytes that stay), n_bytes, n_removed and removed_spans (maximal, in bytes). Bytes covered
    by a string of `window` bytes that starts anywhere else too are removed, in all places. Those covered by such a
    string of `report` bytes are counted and listed in n_repeated and repeated_spans."""
    if not SEED + CORE <= report <= window:
        raise ValueError(f"report is {SEED + CORE} to window bytes")
    spark = docs.sparkSession
    docs = runtime.without(docs, *ADDED, "k1", "k2", "_marks")
    keyed = anchors.keyed(docs, id_col, text_col)
    texts = keyed.where(F.col(text_col).isNotNull()).select("k1", "k2", F.col(text_col).alias("text"))
    every = runtime.staged(anchors.find_runs(texts, units, report, SEED, window), "runs")
    runs = runtime.swept(anchors.shared(every), "shared-runs")
    runtime.forget(every)
    one = [F.first(c).alias(c) for c in ("k1", "k2", "start", "count")]
    kinds = runs.groupBy("anchor", "content").agg((F.count("*") > 1).alias("twice"), F.first("place").alias("place"), *one)
    kinds = runtime.staged(kinds, "kinds")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_RUNS).select("anchor", F.lit(True).alias("hot"))
    kinds = runtime.staged(kinds.join(runtime.staged(many, "hot-anchors"), "anchor", "left"), "kinds")
    cols = ("k1", "k2", "start", "count", "anchor", "content", "twice")
    pieces, fine = kinds.where("hot is null").select(*cols), None
    hot = kinds.where("hot")
    if not hot.isEmpty():
        finer = anchors.beside_texts(texts, hot, "anchor", "content", "place", "twice").mapInArrow(_split(report, window), FINE)
        every = runtime.staged(finer, "fine-runs")
        often = every.groupBy("anchor").agg(((F.count("*") > 1) | F.max("twice")).alias("often")).where("often").drop("often")
        fine = runtime.swept(every.join(runtime.staged(often, "anchors"), "anchor"), "fine-shared-runs")
        runtime.forget(every)
        more = fine.groupBy("anchor", "content").agg(((F.count("*") > 1) | F.max("twice")).alias("twice"), *one)
        pieces = pieces.unionByName(more.select(*cols))
    strings = anchors.beside_texts(texts, pieces, "anchor", "content", "twice").mapInArrow(_strings(window), PIECES)
    dealt = strings.repartition(runtime.partitions(spark), "anchor").sortWithinPartitions("anchor")
    solved = runtime.swept(dealt.mapInArrow(_solve(window, report), SOLVED), "solved")
    if fine is not None:
        # What was found in a stretch of a run holds for all runs of its kind.
        place = fine.select("anchor", "content", "of_anchor", "of_content", "shift")
        again = solved.join(place, ["anchor", "content"])
        again = again.select(
            F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), "kind",
            (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"),
        )
        solved = runtime.staged(solved.unionByName(again), "solved")
    marks = runs.join(solved, ["anchor", "content"]).select(
        "k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"), "kind",
    )
    marks = runtime.swept(marks, "marks")
    runtime.forget(runs, kinds)
    return anchors.marked(keyed, marks, text_col, _cut(text_col), ADDED, kinds=2)
