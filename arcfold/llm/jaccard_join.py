"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles. Those with equal sets form a class, by a 128-bit digest, and one of them is joined.

1. Shingles travel packed, by hash bucket, to where their document frequency is counted; those that one document
   alone has stay behind. A shingle that is frequent within a task is pre-aggregated there. Frequencies count up to
   `FREQUENT`, so all others are equally frequent, and hash order decides between them.
2. A document orders its shingles by rarity. How many it must share with a partner depends on the partner's size, so
   it is indexed once for each band of sizes (a factor of `BAND` apart) that a partner may have. Its prefix for a band
   holds as many shingles as such a partner may lack, plus one; shingles of its own count as lacking. A document with
   more of these than a band allows is not indexed there, which takes most documents.
3. Shingles of at most `RARE` documents are a class of single tokens; frequent ones fall into hash classes of pairs,
   and prefixes extend by what a pair costs: a prefix ends when its single tokens, and the tokens of each pair class
   but one, are as many as the shingles a partner may lack, plus one. So documents that link share a single token or
   a pair of one class.
4. The center of a signature's group is the member with the fewest shingles of its own. A document meets the most
   central one of all its groups' centers, and exact sizes of intersections decide: near copies become one component
   in linear time. Only where a group still has several components, and members that met different centers, do they
   meet the group's own center too. Two documents of a group thus have the same component or a center in common.
5. Two documents that did not both link to their common center may still link to one another. What most members of
   a center have is their core, and a member is its difference from the core: the shingles it has beyond it, and
   those it lacks of it. What two documents share follows from what their differences share, and so does how much
   that must be (see `signatures`): differences are joined just as sets are, by the same prefixes and bands, with
   their own star first. Those so light that they link without a token in common meet the lightest of them. Only
   documents that are still in different components meet in pairs then.

Every pair of documents over the threshold is either found by 4 or 5 or lies within one component by then.

Defined results: words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a text of fewer words than a shingle is one
shingle; null texts and texts without words have no shingles and link with nothing; repeated rows are equal
documents; rows that share an id are one document with several sets, which links wherever one of them does; a null id
belongs to no component (null) but its shingles count; ids are integers (others are cast, and what can't be raises);
an empty table gives an empty table; other columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit
from arcfold.operators.components import components
from arcfold.llm.textkit import U64

FREQUENT = 64
RARE = 4
#: Sizes of partners are told apart by bands this factor wide.
BAND = 1.05
#: Shingles a task packs at once, documents it packs at once (their numbers have 16 bits), and shingles of a bucket
#: on average.
FLUSH = 2_000_000
MOST_DOCS = 50_000
BUCKET = 131_072
#: Ids of copies that are broadcast at most: 8 bytes each.
BROADCAST_IDS = 1_000_000
LOW = U64((1 << 48) - 1)


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a batch, in hash order, and how many each text has."""
    data, off = textkit.flat(column)
    low = textkit.LOWER[data]
    start, end, word_off = textkit.spans(low, off, textkit.NONSPACE)
    sums = textkit.Sums(textkit.byte_sums(low).hash(start, end), 1)
    at, doc = textkit.windows(word_off, size)
    words = np.diff(word_off)
    short = np.flatnonzero((words > 0) & (words < size))
    h = np.concatenate([sums.hash(at, at + size), sums.hash(word_off[short], word_off[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((doc, h)) if len(short) else np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return doc, h, np.bincount(doc, minlength=len(words))


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's set, whatever its order."""
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(n + 1))
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2127599BF4325C37):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(h[order] ^ U64(salt)))])
        out.append((c[cut[1:]] - c[cut[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, "text"):
            doc, h, n = shingles(batch.column("text"), size)
            s1, s2 = digests(doc, h, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2)], ["doc_id", "n", "s1", "s2"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


PACKED = "bucket long, batch long, lo binary, hi binary, local binary, docs binary, sizes binary"


def _pack(size: int, bits: int):
    """Shingles by bucket. bucket >= 0: incidences of a batch, or (local null) shingles that are frequent in it;
    bucket < 0: the batch's documents and sizes, with its incidences of those frequent shingles."""
    names = ("bucket", "batch", "lo", "hi", "local", "docs", "sizes")
    schema = pa.schema([(n, pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)])

    def split(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)

    def by_bucket(batch: int, h: np.ndarray, local: np.ndarray | None) -> Iterator[dict]:
        cut = np.searchsorted(split(h), np.arange((1 << bits) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            t = h[cut[k] : cut[k + 1]]
            yield {
                "bucket": k, "batch": batch, "lo": t.astype(np.uint32).tobytes(),
                "hi": (t >> U64(32)).astype(np.uint16).tobytes(),
                "local": None if local is None else local[cut[k] : cut[k + 1]].tobytes(),
            }

    def flush(batch: int, parts: list) -> Iterator[pa.RecordBatch]:
        h, local = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        docs, sizes = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        order = np.argsort(h, kind="stable")
        h, local = h[order], local[order].astype(np.uint16)
        cut = textkit.runs(h)
        often = np.diff(cut) >= FREQUENT
        hot = np.repeat(often, np.diff(cut))
        token = (split(h[hot]).astype(np.uint64) << U64(48)) | (h[hot] & LOW)
        rows: list[dict] = [{
            "bucket": -1 - batch, "batch": batch, "lo": token.tobytes(), "local": local[hot].tobytes(),
            "docs": docs.tobytes(), "sizes": sizes.tobytes(),
        }]
        for source in (by_bucket(batch, h[~hot], local[~hot]), by_bucket(batch, h[cut[:-1][often]], None)):
            for r in source:
                rows.append(r)
                if len(rows) == 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, docs, tokens = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in _pieces(textkit.chunks(batches, "text"), MOST_DOCS // 5):
            doc, h, n = shingles(batch.column("text"), size)
            new = (n > 0) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            keep = new[doc]
            place = np.cumsum(new) - 1 + docs
            held.append((h[keep], place[doc[keep]], batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[new], n[new].astype(np.int32)))
            docs, tokens = docs + int(new.sum()), tokens + int(keep.sum())
            if tokens >= FLUSH or docs >= MOST_DOCS:
                yield from flush(part << 24 | no, held)
                no, held, docs, tokens = no + 1, [], 0, 0
        if docs:
            yield from flush(part << 24 | no, held)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, what more than one document has, with frequencies up to FREQUENT. Reads rows in bucket order."""
    names = ("batch", "token", "df", "local", "docs", "sizes")
    schema = pa.schema([(n, pa.int64() if n == "batch" else pa.binary()) for n in names])
    out: list[dict] = []

    def close(bucket: int, rows: list[dict]) -> None:
        token = [np.frombuffer(r["lo"], np.uint32).astype(np.uint64) | (np.frombuffer(r["hi"], np.uint16).astype(np.uint64) << U64(32)) for r in rows]
        every = np.concatenate(token)
        weight = np.repeat([1 if r["local"] is not None else FREQUENT for r in rows], [len(t) for t in token])
        order = np.argsort(every, kind="stable")
        cut = textkit.runs(every[order])
        df = np.empty(len(every), np.int64)
        df[order] = np.repeat(np.minimum(np.add.reduceat(weight[order], cut[:-1]), FREQUENT), np.diff(cut))
        at = 0
        for r, t in zip(rows, token, strict=True):
            own = df[at : at + len(t)]
            at += len(t)
            some = own > 1
            if r["local"] is not None and some.any():
                out.append({
                    "batch": r["batch"], "token": ((U64(bucket) << U64(48)) | t[some]).tobytes(),
                    "df": own[some].astype(np.uint8).tobytes(),
                    "local": np.frombuffer(r["local"], np.uint16)[some].tobytes(),
                })

    bucket, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] < 0:
                n = len(r["lo"]) // 8
                out.append({
                    "batch": r["batch"], "token": r["lo"], "df": np.full(n, FREQUENT, np.uint8).tobytes(),
                    "local": r["local"], "docs": r["docs"], "sizes": r["sizes"],
                })
                continue
            if r["bucket"] != bucket:
                if held:
                    close(bucket, held)
                bucket, held = r["bucket"], []
            held.append(r)
        done, out[:] = out[:], []
        yield pa.RecordBatch.from_pylist(done, schema)
    if held:
        close(bucket, held)
    yield pa.RecordBatch.from_pylist(out, schema)


CANDIDATES = "key long, doc_id long, n long, own long, rare long, tokens binary"


def least_shared(n, num: int, den: int):
    """Shingles that a set of n must share with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def _candidates(num: int, den: int):
    """Documents that may have a partner, with their shared shingles in order of rarity and how many of these are
    rare. Reads rows in batch order."""
    names = ("key", "doc_id", "n", "own", "rare", "tokens")
    schema = pa.schema([(c, pa.binary() if c == "tokens" else pa.int64()) for c in names])

    def close(rows: list[dict]) -> pa.RecordBatch:
        head = next(r for r in rows if r["docs"] is not None)
        docs, n = np.frombuffer(head["docs"], np.int64), np.frombuffer(head["sizes"], np.int32).astype(np.int64)
        columns = (("token", np.uint64), ("df", np.uint8), ("local", np.uint16))
        token, df, local = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in columns)
        own = n - np.bincount(local, minlength=len(docs))
        some = own < n - least_shared(n, num, den) + 1
        keep = some[local]
        token, df, local = token[keep], df[keep], local[keep]
        order = np.lexsort((token, df, local))
        token, df, local = token[order], df[order], local[order]
        at = np.flatnonzero(some)
        rare = np.bincount(local[df <= RARE], minlength=len(docs))
        cut = np.searchsorted(local, np.append(at, len(docs)))
        cut[-1] = len(local)
        rank = np.minimum(own * 1023 // np.maximum(n, 1), 1023)
        key = (rank << 53) | (textkit.mix(docs.view(np.uint64)) >> U64(11)).astype(np.int64)
        tokens = textkit.binary_rows(token, cut * 8)
        return pa.record_batch([*(pa.array(x[at]) for x in (key, docs, n, own, rare)), tokens], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["batch"] != now and held:
                    yield close(held)
                    held = []
                now = r["batch"]
                held.append(r)
        if held:
            yield close(held)

    return run


def _edges() -> np.ndarray:
    """Where bands of weights begin: the whole numbers first, then a factor of BAND apart."""
    out = [0, 1]
    while out[-1] < 1 << 56:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


EDGES = _edges()


def _band(weight: int) -> int:
    return int(np.searchsorted(EDGES, weight, "right")) - 1


def signatures(
    weight: int,
    gap: int,
    low: int,
    tokens: np.ndarray,
    rare: int,
    num: int,
    den: int,
    *,
    unit: float,
    salt: int = 0,
    bands: Iterable[int] | None = None,
) -> np.ndarray:
    """What a difference is indexed by: single tokens and pairs of its prefix, for each band of partners' weights.

    A difference from a core of c shingles that lacks l of them and has o others weighs den * l + num * o, and its
    gap is (den - num) * c. What x and y share of their sets is c - l(x) - l(y) and what their differences share, so
    they link if and only if their differences share at least (weight(x) + weight(y) - gap) / (num + den) tokens. A
    set is its difference from the empty core. `tokens` are those that other documents have too, in one order for
    all, the first `rare` of them rare; `low` is the least weight of the partners that are asked for, if they may
    be lighter otherwise, `bands` are those in which there are any, if that is known, and `unit` is what a token
    weighs on average."""
    total, d, out = num + den, len(tokens), [np.zeros(0, np.uint64)]
    # A partner has as many tokens as they share, each of which weighs num at least.
    low = max(low, -(-num * (weight - gap) // den), 0)
    high = total * d + gap - weight
    if not d or high < low:
        return out[0]
    mine = _band(weight)
    hashes = textkit.mix(tokens ^ U64(0x5851F42D4C957F2D))
    first, last = _band(low), _band(high)
    for band in range(first, last + 1) if bands is None else sorted(b for b in bands if first <= b <= last):
        need = max(1, -(-(weight + max(int(EDGES[band]), low) - gap) // total))
        if need > d:
            break
        a, b = min(mine, band), max(mine, band)
        both = int(EDGES[a] + EDGES[b])
        sure = max(1, -(-(both - gap) // total))  # what both of a pair know that they share
        classes = min(round((both / (2 * unit) - (both - gap) / total) / 3), sure - 1)
        mark = U64(((a << 32 | b) * 0x9E3779B97F4A7C15 + salt) % (1 << 64))
        if classes < 1:
            out.append(textkit.mix(tokens[: d - need + 1] ^ mark))
            continue
        kind = (hashes % U64(classes)).astype(np.int64)
        kind[:rare] = -1
        gain = np.ones(d, np.int64)
        gain[np.unique(kind, return_index=True)[1]] = 0
        gain[kind < 0] = 1
        stop = int(np.searchsorted(np.cumsum(gain), d - need + 1)) + 1
        t, kind = tokens[:stop], kind[:stop]
        out.append(textkit.mix(t[kind < 0] ^ mark))
        order = np.lexsort((t, kind))
        order = order[kind[order] >= 0]
        t, cut = t[order], textkit.runs(kind[order])
        at = np.arange(len(t))
        left = np.repeat(cut[1:], np.diff(cut)) - 1 - at
        out.append(textkit.mix(textkit.mix(np.repeat(t, left) ^ mark) + t[textkit.expand(at + 1, left)]))
    return np.concatenate(out)


def _sign(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "n", "rare", "tokens")]
            keys, sigs = [], [np.zeros(0, np.uint64)]
            for key, n, rare, tokens in zip(*columns, strict=True):
                sigs.append(signatures(num * n, 0, 0, np.frombuffer(tokens, np.uint64), rare, num, den, unit=num))
                keys.append(np.full(len(sigs[-1]), key))
                if sum(map(len, keys)) > 100_000:
                    yield _pairs_of(sigs, keys)
                    keys, sigs = [], [np.zeros(0, np.uint64)]
            yield _pairs_of(sigs, keys)

    def _pairs_of(sigs: list, keys: list) -> pa.RecordBatch:
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        return pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(key)], ["sig", "key"])

    return run


MET = "lead long, key long, a long, b long, weight long, gap long, linked boolean, rare long, outs long, tokens binary"


def _verify(num: int, den: int):
    """Exact differences of documents from what their center has that others have too: first the `outs` tokens beyond
    that, then those that a document lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            last, core = None, np.zeros(0, np.uint64)
            columns = (batch.column(c).to_pylist() for c in ("ta", "tb", "own_a", "n", "rare"))
            for ta, tb, own, n, rare in zip(*columns, strict=True):
                if ta is not last:
                    last, core = ta, np.sort(np.frombuffer(ta, np.uint64))
                t = np.frombuffer(tb, np.uint64)
                at = np.minimum(np.searchsorted(core, t), max(len(core) - 1, 0))
                both = core[at] == t if len(core) else np.zeros(len(t), bool)
                has = np.zeros(len(core), bool)
                has[at[both]] = True
                shared = int(both.sum())
                weight, gap, central = den * (len(core) - shared) + num * (n - shared), (den - num) * len(core), num * own
                rest = np.concatenate([t[~both], core[~has]])
                # The center's own shingles are its difference from the core.
                out.append((weight, gap, weight + central <= gap, int((~both[:rare]).sum()), len(t) - shared, rest.tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            keep = [batch.column(c) for c in ("lead", "key", "a", "b")]
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch([*keep, *new], [f.split()[0] for f in MET.split(", ")])

    return run


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles alone: both sides grow with the corpus, and skewed keys can be split."""
    return left.join(right.hint("merge"), on, how)


def _meet(pairs: DataFrame, cands: DataFrame, num: int, den: int) -> DataFrame:
    """Verified pairs of keys (lead, key)."""
    left = cands.select(F.col("key").alias("lead"), F.col("doc_id").alias("a"), F.col("own").alias("own_a"), F.col("tokens").alias("ta"))
    right = cands.select("key", F.col("doc_id").alias("b"), "n", "rare", F.col("tokens").alias("tb"))
    both = _merge(_merge(pairs, right, "key"), left, "lead").where("a <> b")
    return both.select("lead", "key", "a", "b", "own_a", "n", "rare", "ta", "tb").mapInArrow(_verify(num, den), MET)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, members, token, lack) of every token of the differences."""
    for batch in batches:
        raw = [np.frombuffer(r, np.int64) for r in batch.column("tokens").to_pylist()]
        outs = batch.column("outs").to_numpy(zero_copy_only=False)
        size = np.array([len(r) for r in raw], np.int64)
        base = batch.select(["lead", "members"]).take(pa.array(np.repeat(np.arange(len(raw)), size)))
        place = textkit.expand(np.zeros(len(raw), np.int64), size)
        every = np.concatenate([np.zeros(0, np.int64), *raw])
        yield pa.record_batch([*base.columns, pa.array(every), pa.array(place >= np.repeat(outs, size))], ["lead", "members", "token", "lack"])


MEMBERS = "lead long, key long, b long, component long, linked boolean, weight long, band long, gap long, rare long, tokens binary"


def _recentered(num: int, den: int):
    """Differences from the core: tokens in which most members differ from the center change sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ("lead", "key", "b", "component", "linked")
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("weight", "gap", "rare", "outs", "tokens", "join", "leave"))
            for weight, gap, rare, outs, raw, join, leave in zip(*columns, strict=True):
                t = np.frombuffer(raw, np.uint64)
                o, lacks = t[:outs], t[outs:]
                own = weight - den * len(lacks) - num * outs
                join, leave = (np.array(x or [], np.int64).view(np.uint64) for x in (join, leave))
                old_o, old_l = ~np.isin(o, join), ~np.isin(lacks, leave)
                more_l, more_o = join[~np.isin(join, o)], leave[~np.isin(leave, lacks)]
                # Tokens that changed sides come last, in one order for all.
                tokens = np.concatenate([o[old_o], lacks[old_l], np.sort(np.concatenate([more_l, more_o]))])
                weight = own + num * (int(old_o.sum()) + len(more_o)) + den * (int(old_l.sum()) + len(more_l))
                gap += (den - num) * (len(join) - len(leave))
                out.append((weight, _band(weight), gap, int(old_o[:rare].sum()), tokens.tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in keep), *new], [f.split()[0] for f in MEMBERS.split(", ")])

    return run


TERMS = "sig long, lead long, key long, weight long, gap long, room long, component long"


def _sign_differences(num: int, den: int):
    """Signatures of differences among the members of one center, for partners in other components."""
    names = [f.split()[0] for f in TERMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, count, room = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            columns = ("lead", "weight", "gap", "linked", "rare", "tokens", "near", "far")
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for lead, weight, gap, linked, rare, raw, near, far in rows:
                tokens = np.frombuffer(raw, np.uint64)
                salt = int(textkit.mix(np.array([lead], np.int64).view(np.uint64))[0])
                # Those linked to the center are one component already.
                bands = set(far) if linked else {*near, *far}
                own = signatures(weight, gap, gap - weight + 1, tokens, rare, num, den, unit=(num + den) / 2, salt=salt, bands=bands)
                # Pairs that need no token in common meet under one signature, where none is counted on.
                light = np.array([salt] if weight <= gap else [], np.uint64)
                sigs += [own, light]
                room += [np.full(len(own), len(tokens)), np.zeros(len(light), np.int64)]
                count.append(len(own) + len(light))
            of = pa.array(np.repeat(np.arange(batch.num_rows), count))
            base = [batch.column(c).take(of) for c in ("lead", "key", "weight", "gap")]
            tail = [pa.array(np.concatenate(room)), batch.column("component").take(of)]
            yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), *base, *tail], names)

    return run


def _verify_differences(num: int, den: int):
    """Which pairs of differences from one center share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("ta", "tb", "wa", "wb", "gap"))
            for ta, tb, wa, wb, gap in zip(*columns, strict=True):
                both = np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True)
                keep.append(wa + wb - gap <= (num + den) * len(both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document. Two documents link when their sets of shingles of `size`
    words have at least `percent` hundredths of their union in common; component_id is the smallest id that links
    reach."""
    num, den = percent, 100
    spark = docs.sparkSession
    parts = runtime.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = runtime.staged(rows.mapInArrow(_sets(size), "doc_id long, n long, s1 long, s2 long"), "digests")
    total = digest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, (total // BUCKET).bit_length())
    classes = digest.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    classes = runtime.staged(classes.where("copies > 1").drop("copies"), "large-classes")
    sets = _merge(digest, classes, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("class", "doc_id").alias("class"))
    sets = runtime.staged(sets, "classes")
    runtime.forget(digest, classes)

    # One document of each class goes on. Few enough others to broadcast spare the texts a shuffle.
    held = sets.where("n > 0 and doc_id is not null").groupBy("doc_id")
    held = held.agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max(F.col("doc_id") == F.col("class")).alias("stays"))
    held = runtime.staged(held.where("lo <> hi or not stays"), "copies")
    copies = held.where("not stays").select("doc_id")
    few = copies.count() <= BROADCAST_IDS
    rest = rows.join(F.broadcast(copies), "doc_id", "left_anti") if few else _merge(rows, copies, "doc_id", "left_anti")
    packed = rest.mapInArrow(_pack(size, bits), PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = packed.mapInArrow(_count, "batch long, token binary, df binary, local binary, docs binary, sizes binary")
    shared = shared.repartition(parts, "batch").sortWithinPartitions("batch")
    cands = runtime.swept(shared.mapInArrow(_candidates(num, den), CANDIDATES), "candidates")

    # Documents of several sets are links between these already.
    several = _merge(sets, held.where("lo <> hi").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    sigs = runtime.staged(cands.mapInArrow(_sign(num, den), "sig long, key long"), "signatures")
    leads = sigs.groupBy("sig").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead <> last").drop("last")
    grouped = runtime.swept(_merge(sigs, leads, "sig"), "groups")
    runtime.forget(sigs)
    first = runtime.staged(grouped.groupBy("key").agg(F.min("lead").alias("first")), "centers")
    stars = first.where("first <> key").select(F.col("first").alias("lead"), "key")
    met = runtime.staged(_meet(stars, cands, num, den), "met")
    found = components(met.where("linked").select("a", "b").unionByName(several))
    found = runtime.staged(found, "components")

    # Groups that are not one component yet, though not all of their members met the same center.
    info = _with_component(_merge(first, cands.select("key", "doc_id"), "key"), "doc_id", found).select("key", "first", "component")
    ends = [f(c).alias(f"{n}_{c}") for c in ("first", "component") for n, f in (("lo", F.min), ("hi", F.max))]
    spread = _merge(grouped, info, "key").groupBy("sig").agg(*ends)
    spread = runtime.staged(spread.where("lo_first <> hi_first and lo_component <> hi_component").select("sig"), "spread")
    if not spread.isEmpty():
        other = _merge(grouped, spread, "sig").where("lead <> key").select("lead", "key").distinct()
        other = _merge(other, stars, ["lead", "key"], "left_anti")
        more = runtime.staged(_meet(other, cands, num, den), "met")
        found = _joined(found, more.where("linked").select("a", "b"))
        met = met.unionByName(more)
    runtime.forget(grouped)
    found = _beside_centers(met, found, num, den)
    out = _merge(sets, found.withColumnRenamed("id", "class"), "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component)


def _beside_centers(met: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """found, with the links among members of a center where these are several components: their differences from the
    center, and then from what most members have, are joined."""
    member = runtime.staged(_with_component(met.select("lead", "key", "b"), "b", found).drop("b"), "members")
    mixed = member.groupBy("lead").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    mixed = runtime.staged(mixed.where("lo <> hi").select("lead", "members"), "mixed")
    if mixed.isEmpty():
        return found
    member = runtime.swept(_merge(met, _merge(member, mixed, "lead"), ["lead", "key"]), "differences")
    tokens = member.select("lead", "members", "outs", "tokens").mapInArrow(_token_rows, "lead long, members long, token long, lack boolean")
    most = tokens.groupBy("lead", "members", "token", "lack").agg(F.count("*").alias("n")).where("2 * n > members")
    sides = [F.collect_list(F.when(c, F.col("token"))).alias(n) for n, c in (("join", ~F.col("lack")), ("leave", F.col("lack")))]
    most = most.groupBy("lead").agg(*sides)
    member = _merge(member, runtime.staged(most, "cores"), "lead", "left").mapInArrow(_recentered(num, den), MEMBERS)
    member = runtime.swept(member, "differences")
    # The bands of a center's members, linked to it or not: as many at most as there are bands.
    bands = [F.collect_set(F.when(c, F.col("band"))).alias(n) for n, c in (("near", F.col("linked")), ("far", ~F.col("linked")))]
    bands = runtime.staged(member.groupBy("lead").agg(*bands), "bands")
    terms = runtime.staged(_merge(member, bands, "lead").mapInArrow(_sign_differences(num, den), TERMS), "terms")
    # The center of a group is its lightest member; the group's others meet it first.
    center = F.min(F.struct("weight", "key")).getField("key").alias("center")
    apart = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    groups = runtime.staged(terms.groupBy("sig").agg(center, *apart).where("lo <> hi").select("sig", "center"), "groups")
    if groups.isEmpty():
        return found
    terms = runtime.staged(_merge(terms, groups, "sig"), "terms")
    star = terms.where("center <> key").select("lead", F.col("center").alias("x"), F.col("key").alias("y")).distinct()
    found = _joined(found, _meet_differences(star, member, num, den))
    # What is still apart meets in pairs.
    now = _with_component(member.select("lead", "key", "b"), "b", found).select("lead", "key", F.col("component").alias("now"))
    terms = _merge(terms, now, ["lead", "key"]).select("sig", "lead", "key", "weight", "gap", "room", F.col("now").alias("component"))
    groups = runtime.staged(terms.groupBy("sig").agg(*apart).where("lo <> hi").select("sig"), "groups")
    if groups.isEmpty():
        return found
    terms = runtime.staged(_merge(terms, groups, "sig"), "terms")
    x, y = terms.alias("x"), terms.select("sig", "key", "weight", "room", "component").alias("y").hint("merge")
    near = F.col("x.weight") + F.col("y.weight") - F.col("x.gap") <= F.least("x.room", "y.room") * (num + den)
    differ = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, differ & near).select("lead", F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct()
    return _joined(found, _meet_differences(runtime.staged(pairs, "pairs"), member, num, den))


def _with_component(df: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """df with the component of the documents in the column doc: their own id if no link is known."""
    df = _merge(df, found.withColumnRenamed("id", doc), doc, "left")
    return df.withColumn("component", F.coalesce("component", doc))


def _meet_differences(pairs: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs of members (lead, x, y)."""
    left = member.select("lead", F.col("key").alias("x"), F.col("b").alias("a"), F.col("weight").alias("wa"), "gap", F.col("tokens").alias("ta"))
    right = member.select("lead", F.col("key").alias("y"), "b", F.col("weight").alias("wb"), F.col("tokens").alias("tb"))
    both = _merge(_merge(pairs, left, ["lead", "x"]), right, ["lead", "y"]).where("a <> b")
    return both.select("a", "b", "wa", "wb", "gap", "ta", "tb").mapInArrow(_verify_differences(num, den), "a long, b long")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of the ids of found and of links, whose components the links join. Only links between
    different components go through the rounds."""
    a, b = (found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c")) for c in ("a", "b"))
    new = _merge(_merge(links, a, "a", "left"), b, "b", "left")
    new = new.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).where("a <> b").distinct()
    new = runtime.staged(new, "new-links")
    if new.isEmpty():
        return found
    moved = runtime.staged(components(new).withColumnRenamed("component", "to"), "moved")
    old = _merge(found, moved.withColumnRenamed("id", "component"), "component", "left")
    old = old.select("id", F.coalesce("to", "component").alias("component"))
    lone = _merge(moved, found.select("id"), "id", "left_anti").select("id", F.col("to").alias("component"))
    return runtime.staged(old.unionByName(lone), "components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that link, directly or not, to one with a smaller id. Rows that repeat the kept id stay, and
    so do all columns, whatever their names."""
    gone = similar_sets(docs, id_col, text_col, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
