"""Summaries of edge streams: what is kept after each batch, and how it takes in the next one.

merge(state, batch) gives the new state, both as DataFrames; transform(state) the result. A transient summary forgets
its state with every batch (or window of it).
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.operators.basic import triangles
from arcfold.operators.components import components
from arcfold.plans.lineage import staged
from arcfold.streaming.edge_stream import EdgeStream
from arcfold.streaming.runner import Fold


class Summary:
    transient = False

    def merge(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def transform(self, state: DataFrame) -> DataFrame:
        return state

    def over(self, edges: DataFrame, *, window: str | None = None) -> DataFrame:
        """The result over a bounded stream; with a window, of each window of ts in turn on top of those before."""
        if window is None:
            return self.transform(self.merge(None, edges))
        dealt = edges.withColumn("_w", F.window("ts", window).start)
        state = None
        for (w,) in dealt.select("_w").distinct().orderBy("_w").collect():
            state = staged(self.merge(None if self.transient else state, dealt.where(F.col("_w") == F.lit(w)).drop("_w")), "summary")
        return self.transform(state)

    def run(self, stream: EdgeStream, path: str | None = None) -> DataFrame | None:
        """The result once all present input of a stream is read. With a path (a folder that all executors see) the
        state outlives the session: a later run over the same stream goes on from there."""
        fold = Fold((lambda _, b: self.merge(None, b)) if self.transient else self.merge, path)
        state = fold.run(stream.edges)
        return None if state is None else self.transform(state)


class ConnectedComponents(Summary):
    """(id, component): components of all edges so far; a component is known by its smallest id."""

    def merge(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        if state is not None:
            new = new.unionByName(state.select(F.col("id").alias("a"), F.col("component").alias("b")))
        loops = new.where("a = b").select(F.col("a").alias("id")).distinct()
        found = components(new)
        return found.unionByName(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component")))


class Bipartiteness(Summary):
    """(component, id, sign, bipartite): ids of two signs such that edges join different ones, the smallest id of a
    component having sign true; or, once an odd cycle has closed, one row that says so, for ever.

    It is the components of the double cover: each edge joins either end with the other's opposite, and a component
    has an odd cycle if and only if it joins a vertex with its own opposite. Ids keep 62 bits."""

    def merge(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        plus = lambda c, k: F.shiftleft(F.col(c).cast("long"), 1) + k
        pairs = F.array(
            F.struct(plus("src", 0).alias("a"), plus("dst", 1).alias("b")),
            F.struct(plus("src", 1).alias("a"), plus("dst", 0).alias("b")),
        )
        new = batch.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
        if state is not None:
            new = new.unionByName(state.select(F.col("id").alias("a"), F.col("component").alias("b")))
        return components(new)

    def transform(self, state: DataFrame) -> DataFrame:
        rows = state.select(F.shiftright("id", 1).alias("id"), (F.col("id") % 2 == 0).alias("plus"), "component")
        each = rows.groupBy("id").agg(
            F.min(F.when(F.col("plus"), F.col("component"))).alias("p"),
            F.min(F.when(~F.col("plus"), F.col("component"))).alias("m"),
        )
        odd = each.agg(F.coalesce(F.bool_or(F.col("p") == F.col("m")), F.lit(False)).alias("odd"))
        good = each.crossJoin(F.broadcast(odd)).where("not odd")
        good = good.select(
            F.shiftright(F.least("p", "m"), 1).alias("component"), "id", (F.col("p") < F.col("m")).alias("sign"),
            F.lit(True).alias("bipartite"),
        )
        bad = odd.where("odd").select(
            F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("boolean").alias("sign"), F.lit(False).alias("bipartite"),
        )
        return good.unionByName(bad)


class Triangles(Summary):
    """(id, count): triangles closed so far by vertex, and all of them under -1."""

    def merge(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return (new if state is None else state.unionByName(new)).distinct()

    def transform(self, state: DataFrame) -> DataFrame:
        return triangles(state)


class Spanner(Summary):
    """(src, dst): of the edges in their order (ts, then seq), those whose ends were not joined by a kept path of at
    most k hops. Each edge depends on all before it, so one task sees them in turn; it holds the spanner, not the
    stream."""

    def __init__(self, k: int = 3):
        self.k = k

    def merge(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        k = self.k
        order = [c for c in ("ts", "seq") if c in batch.columns]
        rows = batch.select(F.lit(1).alias("part"), *(F.col(c) for c in order), F.col("src").cast("long"), F.col("dst").cast("long"))
        if state is not None:
            kept = state.select(F.lit(0).alias("part"), *(F.lit(None).cast(dict(batch.dtypes)[c]).alias(c) for c in order), "src", "dst")
            rows = kept.unionByName(rows)

        def run(frames: Iterable[pd.DataFrame]):
            graph = AdjacencyGraph()
            for f in frames:
                new = []
                for part, a, b in zip(f["part"], f["src"], f["dst"], strict=True):
                    if part == 0 or not graph.within(a, b, k):
                        graph.add_edge(a, b)
                        new.append((a, b))
                yield pd.DataFrame(new, columns=["src", "dst"])

        return rows.repartition(1).sortWithinPartitions("part", *order, "src", "dst").select("part", "src", "dst").mapInPandas(run, "src long, dst long")


class DisjointSet:
    """Union-find by rank with path compression, for sets that fit one process."""

    def __init__(self, elements: Iterable[Hashable] = ()):
        self.parent: dict[Hashable, Hashable] = {}
        self.rank: dict[Hashable, int] = {}
        for e in elements:
            self.make(e)

    def make(self, e: Hashable) -> None:
        self.parent.setdefault(e, e)
        self.rank.setdefault(e, 0)

    def find(self, e: Hashable) -> Hashable | None:
        if e not in self.parent:
            return None
        root = e
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[e] != root:
            self.parent[e], e = root, self.parent[e]
        return root

    def union(self, a: Hashable, b: Hashable) -> None:
        self.make(a)
        self.make(b)
        x, y = self.find(a), self.find(b)
        if x == y:
            return
        if self.rank[x] < self.rank[y]:
            x, y = y, x
        self.parent[y] = x
        self.rank[x] += self.rank[x] == self.rank[y]

    def merge(self, other: DisjointSet) -> None:
        for e, p in other.parent.items():
            self.union(e, p)

    def size(self) -> int:
        return len(self.parent)

    def roots(self) -> set[Hashable]:
        return {self.find(e) for e in self.parent}


class AdjacencyGraph:
    """An undirected graph in one process. Edges are only added, so what was once found near stays near: pairs joined by
    two hops are remembered, MET of them at most, so that a hub's many neighbours are not met anew for each edge."""

    MET = 1_000_000

    def __init__(self):
        self.near: dict[Hashable, set[Hashable]] = {}
        self.met: set[tuple[Hashable, Hashable]] = set()

    def add_edge(self, a: Hashable, b: Hashable) -> None:
        self.near.setdefault(a, set()).add(b)
        self.near.setdefault(b, set()).add(a)

    def within(self, a: Hashable, b: Hashable, k: int) -> bool:
        """Whether a path of at most k hops joins a and b. Both ends are gone out from, the one with fewer vertices
        first, until two hops are left between them."""
        near = self.near
        if a not in near or b not in near:
            return False
        if a == b:
            return True
        if k < 1:
            return False
        if b in near[a]:
            return True
        if k == 1:
            return False
        one, two, seen_one, seen_two = [a], [b], {a}, {b}
        for _ in range(k - 2):
            if sum(len(near[x]) for x in one) > sum(len(near[y]) for y in two):
                one, two, seen_one, seen_two = two, one, seen_two, seen_one
            one = set().union(*(near[x] for x in one)) - seen_one
            if not seen_two.isdisjoint(one):
                return True
            seen_one |= one
        return any(self._meet(x, y) for x in one for y in two)

    def _meet(self, x: Hashable, y: Hashable) -> bool:
        """Whether two different vertices are joined by at most two hops."""
        if (x, y) in self.met or y in self.near[x]:
            return True
        if self.near[x].isdisjoint(self.near[y]):
            return False
        if len(self.met) >= self.MET:
            self.met.clear()
        self.met.add((x, y))
        return True

    def merge(self, other: AdjacencyGraph, k: int) -> None:
        """Takes in the edges of another spanner that this one does not span."""
        for a in sorted(other.near):
            for b in sorted(other.near[a]):
                if a <= b and not self.within(a, b, k):
                    self.add_edge(a, b)

    def size(self) -> int:
        return len(self.near)
