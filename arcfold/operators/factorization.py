"""Matrix factorization of (user, item, rating): ALS, SGD and SVD++, with the superstep counts of the vertex programs
(step 1 starts users, 2 items, then users and items alternate up to `iterations`), in float32.

SGD and SVD++ take a vertex's ratings one after the other. Tasks hold many vertices at once and go through the first
rating of all of them, then the second of all, and so on; the ratings of one vertex are in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.functions.javarandom import JavaRandom
from arcfold.plans.lineage import forget, staged

f32 = np.float32
SCALE = f32(0.01)


def _start(seed: int | None, dim: int) -> Callable[[int], list[float]]:
    """Initial factors by id. With a seed all ids start alike, as in the reference; without, each by its own hash."""
    return lambda i: [float(SCALE * r.next_float()) for r in [JavaRandom(seed if seed is not None else int(i) * 0x9E3779B1)] for _ in range(dim)]


def _init(ratings: DataFrame, side: str, seed: int | None, dim: int) -> DataFrame:
    make = _start(seed, dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "factors": [make(i) for i in f["id"]]})

    return ratings.select(F.col(side).cast("long").alias("id")).distinct().mapInPandas(run, "id long, factors array<float>")


def _beside(ratings: DataFrame, side: str, other: str, vectors: DataFrame) -> DataFrame:
    """(id, sender, rating, factors of the sender)"""
    return ratings.select(F.col(side).alias("id"), F.col(other).alias("sender"), "rating").join(vectors.withColumnRenamed("id", "sender"), "sender")


#: Ratings that a task handles at once; one vertex may have more.
ROWS = 50_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ROWS rows that hold all rows of their ids, from rows in the order of ids."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield t.slice(0, cut)
                held, n = t.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Turns:
    """The vertices of a table, and which of their rows come first, second and so on."""

    def __init__(self, table: pa.Table):
        ids = table["id"].to_numpy()
        cut = np.concatenate([[0][: len(ids)], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).astype(np.int64)
        size = np.diff(cut)
        order = np.argsort(-size, kind="stable")
        self.first, self.size, self.table = cut[:-1][order], size[order], table
        self.ids = ids[self.first]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of vertices that have a next row, those rows); the vertices with most rows come first."""
        have = np.searchsorted(-self.size, -np.arange(1, int(self.size.max(initial=0)) + 1), "right")
        for k, n in enumerate(have.tolist()):
            yield n, self.first[:n] + k

    def rows(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy().astype(f32, copy=False)

    def vectors(self, name: str) -> np.ndarray:
        column = self.table[name].combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(f32, copy=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    """A list column of the rows of x."""
    off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.ndim > 1 else 0))
    return pa.ListArray.from_arrays(off, pa.array(x.ravel()))


def _by_id(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of an id in one partition, in order. Dealt by the id itself, the shuffle would be taken for that of a
    join before it, which adaptive execution may turn into a broadcast."""
    return rows.repartition(F.xxhash64("id")).sortWithinPartitions("id", *order)


def _with_own(rows: DataFrame, own: DataFrame) -> DataFrame:
    """_by_id() of the rows (id, sender, ...) and, before those of its id, the vertex's own state (id, ...) as a row
    without a sender: one shuffle, and the state goes along once and not with every row."""
    rows = rows.where("id is not null").unionByName(own, allowMissingColumns=True)
    return _by_id(rows, "sender")


def _apart(table: pa.Table) -> tuple[_Turns, _Turns, np.ndarray]:
    """Of a table of _with_own(): the turns of the senders' rows, the owns, and which own is each turn's vertex's."""
    is_own = pc.is_null(table["sender"])
    turns, owns = _Turns(table.filter(pc.invert(is_own))), _Turns(table.filter(is_own))
    first = np.argsort(owns.ids, kind="stable")
    return turns, owns, owns.first[first[np.searchsorted(owns.ids, turns.ids, sorter=first)]] if len(turns.ids) else np.zeros(0, np.int64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _solve(rows: DataFrame, dim: int, lam: float) -> DataFrame:
    """(id, factors) that solve (M Mt + lambda n I) u = M r. A task adds up the matrices of its ids as their rows pass,
    in order; an id of very many rows takes no more memory. (Adding up before the shuffle sends dim times as much where
    a task meets few rows of an id.)"""

    def solved(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a = x[:, : dim * dim].reshape(-1, dim, dim) + (lam * x[:, -1])[:, None, None] * np.eye(dim)
        u = np.linalg.solve(a, x[:, dim * dim : -1, None])[:, :, 0]
        return pa.record_batch([pa.array(ids), _lists(u.astype(f32))], ["id", "factors"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.zeros(0, np.int64), np.zeros((0, dim * dim + dim + 1))
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            m = b.column("factors").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            r = b.column("rating").to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.concatenate([(m[:, :, None] * m[:, None, :]).reshape(len(m), -1), m * r[:, None], np.ones((len(m), 1))], axis=1)
            cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            ids, sums = ids[cut], np.add.reduceat(x, cut, axis=0)
            if len(last) and ids[0] == last[0]:
                sums[0] += held[0]
            elif len(last):
                yield solved(last, held)
            if len(ids) > 1:
                yield solved(ids[:-1], sums[:-1])
            last, held = ids[-1:], sums[-1:].copy()
        if len(last):
            yield solved(last, held)

    return _by_id(rows.select("id", "rating", "factors")).mapInArrow(solve, "id long, factors array<float>")


def rmse(ratings: DataFrame, users: DataFrame, items: DataFrame) -> float:
    x = ratings.join(users.toDF("user", "p"), "user").join(items.toDF("item", "q"), "item")
    dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    got = x.agg(F.sqrt(F.avg((dot - F.col("rating")) ** 2))).first()[0]
    return float(got) if got is not None else 0.0


def _alternate(
    ratings: DataFrame, dim: int, iterations: int, target: float, seed: int | None,
    step: Callable[[str, str, DataFrame, DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    ratings = ratings.select(F.col("user").cast("long"), F.col("item").cast("long"), F.col("rating").cast("float")).persist()
    state = {s: staged(_init(ratings, s, seed, dim), f"{s}s") for s in ("user", "item")}
    for k in range(3, iterations + 1):
        side, other = ("user", "item") if k % 2 else ("item", "user")
        new = staged(step(side, other, ratings, state), f"{side}s")
        old, state[side] = state[side], new
        forget(old)
        if target > 0 and rmse(ratings, state["user"], state["item"]) < target:
            break
    ratings.unpersist()
    return state["user"], state["item"]


def als(
    ratings: DataFrame, *, dim: int = 50, lam: float = 0.01, iterations: int = 10, rmse_target: float = -1.0,
    seed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(id, factors) of users and of items, each side solved against the other in turn."""
    return _alternate(
        ratings, dim, iterations, rmse_target, seed,
        lambda side, other, r, state: _solve(_beside(r, side, other, state[other]), dim, lam),
    )


def sgd(
    ratings: DataFrame, *, dim: int = 50, lam: float = 0.01, gamma: float = 0.005, min_rating: float = 0.0,
    max_rating: float = 5.0, iterations: int = 10, rmse_target: float = -1.0, tolerance: float = -1.0,
    seed: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(id, factors) of users and of items: each vertex goes down the gradient of one rating after the other, in the
    order of the senders. With a tolerance, vertices that moved by no more stop sending, so their neighbours hear only
    from the others."""
    lam, gamma = f32(lam), f32(gamma)
    quiet: dict[str, DataFrame | None] = {"user": None, "item": None}

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            turns, owns, own = _apart(table)
            if not len(turns.ids):
                continue
            u, seen = turns.vectors("factors"), turns.rows("rating")
            value = owns.vectors("factors")[own]
            old = value.copy()
            for n, row in turns:
                err = np.clip(_dot(value[:n], u[row]), f32(min_rating), f32(max_rating)) - seen[row]
                value[:n] += (value[:n] * lam + u[row] * err[:, None]) * -gamma
            moved = np.sqrt(((value - old) ** 2).sum(axis=1)) > tolerance
            yield pa.record_batch([pa.array(turns.ids), _lists(value), pa.array(moved)], ["id", "factors", "moved"])

    def step(side: str, other: str, r: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
        rows = _beside(r, side, other, state[other])
        if quiet[other] is not None:
            rows = rows.join(quiet[other].withColumnRenamed("id", "sender"), "sender", "left_anti")
        new = staged(_with_own(rows, state[side]).mapInArrow(update, "id long, factors array<float>, moved boolean"), "updates")
        if tolerance > 0:
            quiet[side] = staged(state[side].select("id").join(new.where("moved").select("id"), "id", "left_anti"), "quiet")
        return new.select("id", "factors").unionByName(state[side].join(new.select("id"), "id", "left_anti"))

    return _alternate(ratings, dim, iterations, rmse_target, seed, step)


def svdpp(
    ratings: DataFrame, *, dim: int = 50, factor_lambda: float = 0.01, factor_gamma: float = 0.005,
    bias_lambda: float = 0.01, bias_gamma: float = 0.005, min_rating: float = 0.0, max_rating: float = 5.0,
    iterations: int = 10, rmse_target: float = -1.0, seed: int | None = None, textbook: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(id, baseline, factors) of users and (id, baseline, factors, weight) of items.

    By default updates go the way of the reference, up the error and with half the mean rating; `textbook` goes down
    the error with the whole mean."""
    fl, fg, bl, bg = f32(factor_lambda), f32(factor_gamma), f32(bias_lambda), f32(bias_gamma)
    lo, hi, sign = f32(min_rating), f32(max_rating), f32(-1 if textbook else 1)
    ratings = ratings.select(F.col("user").cast("long"), F.col("item").cast("long"), F.col("rating").cast("float")).persist()
    total, n_edges = ratings.agg(F.sum(F.col("rating").cast("double")), F.count("*")).first()
    mean = f32(total / (n_edges * (1 if textbook else 2))) if n_edges else f32(0)

    def start(kind: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for i in frame["id"]:
                    r = JavaRandom(seed if seed is not None else int(i) * 0x9E3779B1)
                    draws = [float(SCALE * r.next_float()) for _ in range(dim * (2 if kind == "item" else 1))]
                    rows.append((i, float(r.next_float()), *((draws[::2], draws[1::2]) if kind == "item" else (draws, []))))
                yield pd.DataFrame(rows, columns=["id", "baseline", "factors", "weight"])

        return run

    state_ddl = "id long, baseline float, factors array<float>, weight array<float>"
    state = {s: staged(ratings.select(F.col(s).alias("id")).distinct().mapInPandas(start(s), state_ddl), f"{s}s") for s in ("user", "item")}

    step_ddl = "id long, item long, baseline float, factors array<float>, weight array<float>, error double"

    def users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Users against all their items: their new states, and a step for each item."""
        names = [f.split()[0] for f in step_ddl.split(", ")]
        for table in _whole(batches):
            t, owns, own = _apart(table)
            if not len(t.ids):
                continue
            base, p = owns.rows("baseline")[own], owns.vectors("factors")[own]
            q, y, bi, seen = t.vectors("factors"), t.vectors("weight"), t.rows("baseline"), t.rows("rating")
            weights = np.zeros((len(t.ids), dim), f32)
            for n, row in t:
                weights[:n] += y[row]
            root = np.sqrt(t.size).astype(f32)[:, None]
            spread, weight_step = weights * (f32(1.0) / root), np.zeros((len(t.ids), dim), f32)
            for n, row in t:
                err = (np.clip(mean + base[:n] + bi[row] + _dot(q[row], p[:n] + spread[:n]), lo, hi) - seen[row]) * sign
                base[:n] += bg * (err - bl * base[:n])
                p[:n] += p[:n] * (-fl * fg) + q[row] * (err * fg)[:, None]
                weight_step[:n] += q[row] * err[:, None]
            weight_step *= fg / root
            yield pa.record_batch(
                [
                    pa.array(t.ids), pa.nulls(len(t.ids), pa.int64()), pa.array(base), _lists(p),
                    _lists(np.zeros((len(t.ids), 0), f32)), pa.array(np.zeros(len(t.ids))),
                ],
                names,
            )
            of = np.empty(t.table.num_rows, np.int64)
            for n, row in t:
                of[row] = np.arange(n)
            err = (np.clip(mean + base[of] + bi + _dot(q, (p + spread)[of]), lo, hi) - seen) * sign
            columns = [t.table["id"].combine_chunks(), t.table["sender"].combine_chunks(), pa.array(bg * err)]
            columns += [_lists((spread + p)[of] * (fg * err)[:, None]), _lists(weight_step[of]), pa.array(err.astype(np.float64) ** 2)]
            out = pa.record_batch(columns, names)
            for i in range(0, out.num_rows, 10_000):
                yield out.slice(i, 10_000)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items and the steps their users sent."""
        for table in _whole(batches):
            t, owns, own = _apart(table)
            if not len(t.ids):
                continue
            base, q, y = owns.rows("baseline")[own], owns.vectors("factors")[own], owns.vectors("weight")[own]
            b, fs, ws = t.rows("baseline"), t.vectors("factors"), t.vectors("weight")
            for n, row in t:
                base[:n] = (base[:n] + b[row]) - bg * bl * base[:n]
                q[:n] += q[:n] * (-fg * fl) + fs[row]
                y[:n] += y[:n] * (-fg * fl) + ws[row]
            yield pa.record_batch([pa.array(t.ids), pa.array(base), _lists(q), _lists(y)], ["id", "baseline", "factors", "weight"])

    steps = None
    for k in range(3, iterations + 1):
        if k % 2:
            rows = ratings.select(
                F.col("user").alias("id"), F.col("item").alias("sender"), "rating",
            ).join(state["item"].withColumnRenamed("id", "sender"), "sender")
            both = staged(_with_own(rows, state["user"]).mapInArrow(users, step_ddl), "svdpp")
            state["user"] = both.where("item is null").select("id", "baseline", "factors", "weight")
            steps = both.where("item is not null").select(F.col("item").alias("id"), F.col("id").alias("sender"), "baseline", "factors", "weight")
            if rmse_target > 0 and (both.agg(F.sum("error")).first()[0] / n_edges) ** 0.5 < rmse_target:
                break
        else:
            state["item"] = staged(_with_own(steps, state["item"]).mapInArrow(items, state_ddl), "svdpp")
    ratings.unpersist()
    return state["user"].drop("weight"), state["item"]


def svdpp_predict(
    pairs: DataFrame, users: DataFrame, items: DataFrame, mean: float, *, min_rating: float = 0.0,
    max_rating: float = 5.0,
) -> DataFrame:
    """(user, item, prediction): clip(mean + both baselines + product of factors), without the implicit term."""
    x = pairs.join(users.select(F.col("id").alias("user"), F.col("baseline").alias("bu"), F.col("factors").alias("p")), "user")
    x = x.join(items.select(F.col("id").alias("item"), F.col("baseline").alias("bi"), F.col("factors").alias("q")), "item")
    dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    return x.select(
        "user", "item",
        F.greatest(F.lit(min_rating), F.least(F.lit(max_rating), F.lit(mean) + F.col("bu") + F.col("bi") + dot)).alias("prediction"),
    )
