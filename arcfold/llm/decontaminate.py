"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` words (a shorter item is one window). A window is the set of its
shingles (runs of `shingle` words), and a document holds a window if it contains all of them in order. Shingles are
ordered by how often the corpus has them; as containment must be whole, the necessary prefix of a window is its one
rarest shingle, and windows whose rarest shingle never occurs are gone at once. Document shingles meet that index;
the shingle's place in the window bounds where the window can start and end; the hash of the whole run and then
the words themselves decide.

The benchmark is dealt to blocks of about `block_bytes` bytes of text; each block's index travels with the tasks, and
the documents pass the blocks one after the other, carrying what they have been hit by, so no shuffle is needed at
any benchmark size. The index holds each word of a block once, and windows as places among these words: some ten
times the block's bytes in all, and `MOST_INDEX` bytes at most (a block beyond that is dealt again).

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; null and empty texts
have no words, no hits and are clean; items without words match nothing; items with equal texts all count; a null
item id is skipped; repeated rows get equal results; an empty benchmark leaves every document clean; input columns
named like the added ones are replaced, and _hit, _items, _words and _n are names of the operator's own: such columns
don't come back.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit

ADDED = ("n_words", "n_hit", "items", "contaminated")
#: Bytes of index that travel with the tasks at once.
MOST_INDEX = 64 << 20


class Words:
    """The words of a batch of texts, and hashes of runs of them."""

    def __init__(self, column):
        data, self.off = textkit.flat(column)
        self.low = textkit.LOWER[data]
        self.start, self.end, self.word_off = textkit.spans(self.low, self.off, textkit.ALNUM)
        self.sums = textkit.Sums(textkit.byte_sums(self.low).hash(self.start, self.end), 1)
        self.raw: bytes | None = None

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, doc = textkit.windows(self.word_off, n)
        return at, doc, self.sums.hash(at, at + n)

    def words(self, a: int, n: int) -> bytes:
        if self.raw is None:
            self.raw = self.low.tobytes()
        return b" ".join([self.raw[s:e] for s, e in zip(self.start[a : a + n].tolist(), self.end[a : a + n].tolist(), strict=True)])


class WindowSet:
    """The distinct windows of some items, as places among their words, before their shingles are ordered by rarity."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        w = Words(pa.array([t for _, t in items], pa.string()))
        self.names, self.shingle, n = [i for i, _ in items], shingle, np.diff(w.word_off)
        length = w.end - w.start + 1  # each word with a blank behind it
        self.at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        text = np.append(w.low, np.uint8(32))[textkit.expand(w.start, length)]
        text[self.at[1:] - 1] = 32
        self.text = text.tobytes()
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        start, item = textkit.expand(w.word_off[:-1], count), np.repeat(np.arange(len(items)), count)
        size = np.minimum(n, window)[item]
        again = textkit.Sums(textkit.byte_sums(w.low, 1).hash(w.start, w.end), 2)
        h1, h2 = w.sums.hash(start, start + size), again.hash(start, start + size)
        order = np.lexsort((item, size, h2, h1))
        h1, h2, start, size, item = (x[order] for x in (h1, h2, start, size, item))
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (size[1:] != size[:-1])
        self.hash, self.start, self.size = h1[new], start[new].astype(np.int32), size[new].astype(np.int32)
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        self.item = item[once].astype(np.int32)
        self.first_item = np.append(np.flatnonzero(new[once]), len(self.item)).astype(np.int32)
        #: Shingles by their length: their places among the words (a whole short window is one), and hashes.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({int(k) for k in np.unique(np.minimum(shingle, self.size))}):
            at, of, h = w.grams(k)
            own = n[of] == k if k < shingle else n[of] >= k
            self.grams[k] = (at[own], h[own])

    def shingles(self) -> dict[int, np.ndarray]:
        return {k: np.unique(h) for k, (_, h) in self.grams.items()}


class PrefixIndex:
    """Rarest shingle of each window -> the window and the shingle's place in it."""

    def __init__(self, ws: WindowSet, frequency: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.names, self.text, self.at = ws.names, ws.text, ws.at
        self.hash, self.start, self.size, self.item, self.first_item = ws.hash, ws.start, ws.size, ws.item, ws.first_item
        self.parts = {}
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for k, (at, h) in ws.grams.items():
            known, counts = frequency.get(k, none)
            seen = np.zeros(len(h), np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                seen = np.where(known[i] == h, counts[i], 0)
            # By word place; the first shingle of a window lies at the place of its first word.
            number = np.zeros(len(self.at), np.int64)
            number[at] = np.arange(len(at))
            of = np.flatnonzero(np.minimum(ws.shingle, self.size) == k)
            first, places = number[self.start[of]], self.size[of] - k + 1
            best, least, place = h[first], seen[first], np.zeros(len(of), np.int32)
            for j in range(1, int(places.max(initial=0))):
                i = np.minimum(first + j, len(h) - 1)
                less = (j < places) & ((seen[i] < least) | ((seen[i] == least) & (h[i] < best)))
                best, least, place = np.where(less, h[i], best), np.where(less, seen[i], least), np.where(less, j, place)
            some = np.flatnonzero(least > 0)
            some = some[np.argsort(best[some], kind="stable")]
            cut = textkit.runs(best[some])
            keys = best[some][cut[:-1]] if len(some) else np.zeros(0, np.uint64)
            self.parts[k] = (textkit.Lookup(keys), cut.astype(np.int32), of[some].astype(np.int32), place[some].astype(np.int32))

    def nbytes(self) -> int:
        arrays = [self.at, self.hash, self.start, self.size, self.item, self.first_item]
        for lookup, *rest in self.parts.values():
            arrays += [lookup.keys, lookup.flags, *rest]
        return len(self.text) + sum(map(len, self.names)) + sum(a.nbytes for a in arrays)

    def words(self, window: int) -> bytes:
        a = self.start[window]
        return self.text[self.at[a] : self.at[a + self.size[window]] - 1]

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.item[self.first_item[window] : self.first_item[window + 1]]]

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence."""
        found = []
        for k, (lookup, cut, of, place) in self.parts.items():
            at, doc, h = w.grams(k)
            hit, key = lookup.find(h)
            count = (cut[key + 1] - cut[key]).astype(np.int64)
            entry = textkit.expand(cut[key].astype(np.int64), count)
            at, doc = np.repeat(at[hit], count), np.repeat(doc[hit], count)
            start, n = at - place[entry], self.size[of[entry]]
            fits = (start >= w.word_off[doc]) & (start + n <= w.word_off[doc + 1])
            start, doc, win, n = start[fits], doc[fits], of[entry][fits], n[fits]
            same = w.sums.hash(start, start + n) == self.hash[win]
            for s, d, x in zip(start[same].tolist(), doc[same].tolist(), win[same].tolist(), strict=True):
                if w.words(s, int(self.size[x])) == self.words(x):
                    found.append((d, s, x))
        out = np.array(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]


def _count(shingles_bc, text_col: str):
    schema = pa.schema([("k", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {k: textkit.Lookup(h) for k, h in shingles_bc.value.items()}
        seen = {k: np.zeros(len(x.keys), np.int64) for k, x in lookups.items()}
        for batch in textkit.chunks(batches, text_col):
            w = Words(batch.column(text_col))
            for k, x in lookups.items():
                seen[k] += np.bincount(x.find(w.grams(k)[2])[1], minlength=len(x.keys))
        for k, x in lookups.items():
            some = np.flatnonzero(seen[k])
            yield pa.record_batch(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(x.keys[some].view(np.int64)), pa.array(seen[k][some])],
                schema=schema,
            )

    return run


def _mark(index_bc, text_col: str, state: list[str]):
    """Adds one block's hits to the packed bits and the items that a document carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PrefixIndex = index_bc.value
        for batch in textkit.chunks(batches, text_col):
            w = Words(batch.column(text_col))
            doc, start, win = index.matches(w)
            n_words = np.diff(w.word_off)
            hit = np.zeros(int(w.word_off[-1]), bool)
            hit[textkit.expand(start, index.size[win].astype(np.int64))] = True
            items: dict[int, set[str]] = defaultdict(set)
            for d, x in zip(doc.tolist(), win.tolist(), strict=True):
                items[d].update(index.items(x))
            bits, lists, n_hit = (batch.column(c).to_pylist() for c in ("_hit", "_items", "_n"))
            for d in sorted(items):
                own = hit[w.word_off[d] : w.word_off[d + 1]]
                if bits[d]:
                    own = own | np.unpackbits(np.frombuffer(bits[d], np.uint8), count=len(own)).astype(bool)
                n_hit[d] = int(own.sum())
                bits[d], lists[d] = np.packbits(own).tobytes(), sorted({*lists[d], *items[d]})
            new = {
                "_hit": pa.array(bits, pa.binary()), "_items": pa.array(lists, pa.list_(pa.string())),
                "_words": pa.array(n_words), "_n": pa.array(n_hit, pa.int64()),
            }
            yield pa.record_batch([new[c] if c in new else batch.column(c) for c in state], state)

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    *,
    window: int = 13,
    shingle: int = 3,
    one_in: int = 20,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), items (array of the ids of items that
    occur, as sorted strings) and contaminated (at least one word in `one_in` is hit)."""
    spark = docs.sparkSession
    docs = runtime.without(docs, *ADDED, "_hit", "_items", "_words", "_n")
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"),
    ).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.withColumns({
        "_hit": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>"), "_words": F.lit(0).cast("long"),
        "_n": F.lit(0).cast("long"),
    })
    schema, state = out.schema, out.columns
    dealt = F.pmod(F.xxhash64("item"), F.lit(blocks))
    done = 0
    for b in range(blocks):
        todo = [[(r[0], r[1]) for r in (items.where(dealt == b) if blocks > 1 else items).toLocalIterator()]]
        while todo:
            part = todo.pop()
            ws = WindowSet(part, window, shingle)
            if ws.hash.nbytes * 5 > MOST_INDEX and len(part) > 1:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            sent = spark.sparkContext.broadcast(ws.shingles())
            counted = docs.select(text_col).mapInArrow(_count(sent, text_col), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
            rows = counted.toArrow() if len(ws.hash) else None
            frequency = {}
            for k in ws.grams if rows is not None else ():
                own = rows.filter(pc.equal(rows["k"], k))
                h, n = own["h"].to_numpy().view(np.uint64), own["n"].to_numpy()
                order = np.argsort(h)
                frequency[k] = (h[order], n[order])
            index = spark.sparkContext.broadcast(PrefixIndex(ws, frequency))
            out = out.mapInArrow(_mark(index, text_col, state), schema)
            done += 1
            if done % 4 == 0:
                out = runtime.staged(out, "decontaminate")
    out = out.withColumns({"n_words": F.col("_words"), "n_hit": F.col("_n"), "items": F.col("_items")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).drop("_hit", "_items", "_words", "_n")
