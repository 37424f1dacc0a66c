"""Line dedup by sharded minimal perfect hashing.

1. Every task hashes its lines (128 bits) and pre-aggregates (documents, largest id) per key; one shuffle of 32-byte
   rows adds them up.
2. All distinct hashes are dealt to shards of about `SHARD_KEYS` keys, and each shard becomes one row: a minimal
   perfect hash function, and arrays of 32-bit fingerprints, 16-bit counts (as far as these go) and largest ids in
   its order. The most frequent keys form a shard of their own, which travels with the tasks: those that at least one
   in `hot_keys` of all incidences has, so there are `hot_keys` of them at most. So no other shard is probed by very
   many lines of one key.
3. Documents probe the arrays: what the shard of frequent keys does not know travels to its own shard, as packed rows
   of a batch's probes. The count that a probe finds decides, and the numbers of dropped lines come back.

Lines are split at "\\n". A key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case.
Defined results: a null or empty text is one empty line and comes back as ""; keys shorter than `min_chars` code
points stay; each row counts as a document, so repeated rows count again, and all rows of the largest id keep the
line; rows that share an id but not their text are told apart by a hash of it; a text whose lines all go becomes "";
an empty table gives an empty table; input columns named like the added ones are replaced, and _nos, _key, row_id and
row_key are names of the operator's own: such columns don't come back; a row with a null id keeps all its lines and
is not counted; ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit
from arcfold.llm.textkit import U64

SHARD_KEYS = 200_000
#: Counts of the arrays go up to here.
MOST_COUNT = (1 << 16) - 1
#: Distinct keys a task holds before it hands over what it has added up.
HELD_KEYS = 500_000


class PerfectHash:
    """A minimal perfect hash over distinct uint64 values: bit levels where only keys alone in their cell
    stay, and ranks counted per 64-bit word. About 3.5 bits a key."""

    def __init__(self, keys: np.ndarray | None = None):
        self.levels: list[tuple[int, int]] = []
        words: list[np.ndarray] = []
        base = 0
        while keys is not None and len(keys):
            cells = max(64, -(-2 * len(keys) // 64) * 64)
            at = self._cell(keys, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.levels.append((base, cells))
            base += cells
            keys = keys[~alone[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self._rank()

    def _rank(self) -> None:
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (textkit.mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(cells)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below the key count for every key of the set; for others such a number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (base, cells) in enumerate(self.levels):
            bit = base + self._cell(keys[left], level, cells)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.words[word] >> low) & U64(1) == 1
            below = np.bitwise_count(self.words[word[here]] & ((U64(1) << low[here]) - U64(1)))
            out[left[here]] = self.ranks[word[here]] + below
            left = left[~here]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(x for pair in self.levels for x in pair)], np.int64)
        return head.tobytes() + self.words.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        out = cls()
        head = np.frombuffer(raw, np.int64, 2 * n, 8)
        out.levels = [(int(a), int(b)) for a, b in head.reshape(-1, 2)]
        out.words = np.frombuffer(raw, np.uint64, offset=8 * (2 * n + 1))
        out._rank()
        return out


class Shard:
    """What one shard's row holds, ready to probe."""

    def __init__(self, row: dict):
        self.mph = PerfectHash.load(row["mph"])
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint16)
        self.largest = np.frombuffer(row["largest"], np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which probes are keys, and the count and largest id of each that is."""
        at = self.mph.index(h1)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h2[known].astype(np.uint32)
        return known, self.counts[at[known]], self.largest[at[known]]


def lines(batch: pa.RecordBatch, text: str, min_chars: int) -> dict[str, np.ndarray]:
    """Every line of a batch: row, span, key hashes, and whether its key is long enough."""
    data, off = textkit.flat(batch.column(text))
    nl = np.flatnonzero(data == 10)
    of = np.searchsorted(off, nl, "right") - 1
    row = np.concatenate([np.arange(batch.num_rows), of])
    start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = off[row + 1].copy()
    same = np.flatnonzero(row[1:] == row[:-1])
    end[same] = start[same + 1] - 1
    dense = np.flatnonzero(textkit.NONSPACE[data])
    a, b = np.searchsorted(dense, start), np.searchsorted(dense, end)
    full = a < b
    s, e = start.copy(), start.copy()
    s[full], e[full] = dense[a[full]], dense[b[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = np.flatnonzero(points[e] - points[s] >= min_chars)
    low = textkit.LOWER[data]
    s, e = s[long], e[long]
    return {"row": row, "start": start, "end": end, "long": long, "h1": textkit.byte_sums(low).hash(s, e), "h2": textkit.byte_sums(low, 1).hash(s, e)}


def _ids(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(column).cast(pa.int64())
    return col.fill_null(0).to_numpy(zero_copy_only=False), ~col.is_null().to_numpy(zero_copy_only=False)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h1, h2, n, top = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h2, h1))
    h1, h2, n, top = h1[order], h2[order], n[order], top[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    at = np.flatnonzero(new)
    return h1[at], h2[at], np.add.reduceat(n, at), np.maximum.reduceat(top, at)


def _count(id_col: str, text_col: str, min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("top", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            parts = _added(held)
            held.clear()
            for i in range(0, len(parts[0]), 20_000):
                yield pa.record_batch([pa.array(x[i : i + 20_000].view(np.int64)) for x in parts], schema=schema)

        for batch in textkit.chunks(batches, text_col):
            x = lines(batch, text_col, min_chars)
            ids, known = _ids(batch, id_col)
            row = x["row"][x["long"]]
            order = np.lexsort((row, x["h2"], x["h1"]))
            h1, h2, row = x["h1"][order], x["h2"][order], row[order]
            keep = np.ones(len(h1), bool)
            keep[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
            keep &= known[row]
            if keep.any():
                held.append(_added([(h1[keep], h2[keep], np.ones(int(keep.sum()), np.int64), ids[row[keep]])]))
            if sum(len(p[0]) for p in held) > HELD_KEYS:
                merged = _added(held)
                held[:] = [merged]
                if len(merged[0]) > HELD_KEYS // 2:
                    yield from out()
        if held:
            yield from out()

    return run


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40) -> DataFrame:
    """(h1, h2, n, top) of each line key: in how many documents it is, and the largest id of these."""
    part = docs.select(id_col, text_col).mapInArrow(_count(id_col, text_col, min_chars), "h1 long, h2 long, n long, top long")
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


ARRAYS = ("mph", "fingerprints", "counts", "largest")


def _build(table: pa.Table) -> pa.Table:
    h1 = table["h1"].to_numpy().view(np.uint64)
    # Two keys with one h1 are one in 2**64; the smaller h2 stays, whatever the order of arrival.
    order = np.lexsort((table["h2"].to_numpy(), h1))
    order = order[np.concatenate([[True], h1[order][1:] != h1[order][:-1]])]
    mph = PerfectHash(h1[order])
    put = np.empty(len(order), np.int64)
    put[mph.index(h1[order])] = order
    h2, n, top = (table[c].to_numpy()[put] for c in ("h2", "n", "top"))
    cells = [mph.dump(), h2.astype(np.uint32).tobytes(), np.minimum(n, MOST_COUNT).astype(np.uint16).tobytes(), top.tobytes()]
    schema = pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in ARRAYS)])
    return pa.table({"shard": table["shard"][:1]} | {n: [c] for n, c in zip(ARRAYS, cells, strict=True)}, schema=schema)


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash function and the arrays in its order."""
    dealt = counts.withColumn("shard", F.pmod(F.shiftright("h1", 7), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build, "shard int, mph binary, fingerprints binary, counts binary, largest binary")


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1.view(np.int64) >> 7) % shards).astype(np.int32)


def _rewrite(batch: pa.RecordBatch, text_col: str, x: dict[str, np.ndarray], drop: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The batch with the marked lines cut out of its texts."""
    data, off = textkit.flat(batch.column(text_col))
    raw = data.tobytes()
    n_lines = np.bincount(x["row"], minlength=batch.num_rows)
    n_dropped = np.bincount(x["row"][drop], minlength=batch.num_rows)
    first = np.searchsorted(x["row"], np.arange(batch.num_rows + 1))
    texts = []
    for i in range(batch.num_rows):
        if not n_dropped[i]:
            texts.append(raw[off[i] : off[i + 1]])
        else:
            keep = np.flatnonzero(~drop[first[i] : first[i + 1]]) + first[i]
            texts.append(b"\n".join([raw[a:b] for a, b in zip(x["start"][keep].tolist(), x["end"][keep].tolist(), strict=True)]))
    new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
    return pa.record_batch([new[c] if c in new else batch.column(c) for c in names], names)


PROBES = ("ids", "keys", "nos", "p1", "p2")
#: Rows of both kinds: a shard's arrays (kind 0), and a batch's probes of that shard.
DEALT = "shard int, kind int, " + ", ".join(f"{n} binary" for n in (*ARRAYS, *PROBES))


def _probes(hot_bc, shards: int, id_col: str, text_col: str, min_chars: int):
    """Packed probes: a row per batch and shard. A row of docs is known by its id and the hash of its text, _key."""
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in (*ARRAYS, *PROBES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Shard(hot_bc.value) if hot_bc.value else None
        for batch in textkit.chunks(batches, text_col):
            x = lines(batch, text_col, min_chars)
            ids, known = _ids(batch, id_col)
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            row = x["row"][x["long"]]
            no = x["long"] - np.searchsorted(x["row"], row)
            shard = _shard_of(x["h1"], shards)
            asks = known[row] & ~(hot.probe(x["h1"], x["h2"])[0] if hot else np.zeros(len(row), bool))
            order = np.argsort(shard, kind="stable")
            order = order[asks[order]]
            cut = textkit.runs(shard[order])
            rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            packed = (ids[row], keys[row], no.astype(np.int64), x["h1"], x["h2"].astype(np.uint32))
            out = [pa.array([int(shard[r[0]]) for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32())]
            out += [pa.nulls(len(rows), pa.binary()) for _ in ARRAYS]
            out += [pa.array([v[r].tobytes() for r in rows], pa.binary()) for v in packed]
            yield pa.record_batch(out, schema=schema)

    return run


def _answers(min_docs: int):
    """(row id, key of its text, numbers of its dropped lines) from a shard's arrays and the probes behind them."""
    schema = pa.schema([("row_id", pa.int64()), ("row_key", pa.int64()), ("nos", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if not r["kind"]:
                    now, shard = r["shard"], Shard(r)
                    continue
                if r["shard"] != now:  # no key of this shard has been counted
                    continue
                ids, keys, nos = (np.frombuffer(r[n], np.int64) for n in ("ids", "keys", "nos"))
                hit, n, top = shard.probe(np.frombuffer(r["p1"], np.uint64), np.frombuffer(r["p2"], np.uint32))
                at = np.flatnonzero(hit)[(n >= min_docs) & (top != ids[hit])]
                cut = np.union1d(textkit.runs(ids[at]), textkit.runs(keys[at]))
                first = at[cut[:-1]]
                gone = pa.array([nos[at[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(ids[first]), pa.array(keys[first]), gone], schema=schema)

    return run


def _cut(hot_bc, id_col: str, text_col: str, min_chars: int, min_docs: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Shard(hot_bc.value) if hot_bc.value else None
        for batch in textkit.chunks(batches, text_col):
            x = lines(batch, text_col, min_chars)
            ids, known = _ids(batch, id_col)
            drop = np.zeros(len(x["row"]), bool)
            if hot:
                row = x["row"][x["long"]]
                hit, n, top = hot.probe(x["h1"], x["h2"])
                at = np.flatnonzero(hit)
                drop[x["long"][at[(n >= min_docs) & (top != ids[row[at]]) & known[row[at]]]]] = True
            first = np.searchsorted(x["row"], np.arange(batch.num_rows))
            for i, nos in enumerate(batch.column("_nos").to_pylist()):
                drop[[first[i] + k for k in nos or ()]] = True
            yield _rewrite(batch, text_col, x, drop, names)

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5,
    hot_keys: int = 65_536,
) -> DataFrame:
    """docs without its frequent lines, which stay in the largest id alone: text_col holds the kept lines, n_lines
    and n_dropped are added."""
    if not 0 < min_docs <= MOST_COUNT:
        raise ValueError(f"min_docs is 1 to {MOST_COUNT}")
    spark = docs.sparkSession
    docs = runtime.without(docs, "n_lines", "n_dropped", "_nos", "_key", "row_id", "row_key")
    counts = runtime.swept(line_counts(docs, id_col, text_col, min_chars=min_chars), "line-counts")
    keys, incidences = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(min_docs, incidences // hot_keys + 1)
    row = next(iter(line_index(counts.where(F.col("n") >= least), 1).drop("shard").collect()), None)
    hot = spark.sparkContext.broadcast(row and row.asDict())
    shards = max(1, math.ceil(keys / SHARD_KEYS))
    index = line_index(counts.where(F.col("n") < least), shards).withColumn("kind", F.lit(0))
    index = index.select("shard", "kind", *ARRAYS, *(F.lit(None).cast("binary").alias(n) for n in PROBES))
    probes = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_key")).mapInArrow(_probes(hot, shards, id_col, text_col, min_chars), DEALT)
    dealt = index.unionByName(probes).repartition(runtime.partitions(spark), "shard").sortWithinPartitions("shard", "kind")
    drops = dealt.mapInArrow(_answers(min_docs), "row_id long, row_key long, nos array<long>")
    drops = runtime.swept(drops.groupBy("row_id", "row_key").agg(F.flatten(F.collect_list("nos")).alias("_nos")), "dropped-lines")
    runtime.forget(counts)
    fields = [f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, "n_lines long", "n_dropped long"])
    names = [*docs.columns, "n_lines", "n_dropped"]
    same = (docs[id_col] == drops["row_id"]) & (F.xxhash64(docs[text_col]) == drops["row_key"])
    out = docs.join(drops, same, "left").drop(drops["row_id"], drops["row_key"])
    return out.mapInArrow(_cut(hot, id_col, text_col, min_chars, min_docs, names), schema)
