"""A graph is two DataFrames: vertices (id, value) and edges (src, dst, value).

Ids are unique and so is (src, dst); self-loops are allowed. Every operation gives a new Graph or DataFrame and runs
nothing. Functions of the caller take and give Columns, so they stay in generated code; where the reference passes
an iterable, the callback gets an array Column, or, better at scale, an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.functions.reducers import Reducer, reduce_column
from arcfold.plans.lineage import partitions

IN, OUT, BOTH = "IN", "OUT", "BOTH"
#: Groups of ids a task, for functions over pandas frames.
BUCKETS = 16


def ends(direction: str) -> tuple[str, str]:
    """(the end that edges are grouped at, the neighbour's end)."""
    if direction == OUT:
        return "src", "dst"
    if direction == IN:
        return "dst", "src"
    raise NotImplementedError(f"direction {direction} is not supported here")


def _slices(rows: pd.DataFrame, key: str, columns: list[str], whole: list[str]) -> Iterator[tuple[Any, pd.DataFrame]]:
    """(id, its rows) of rows in the order of ids. Whole numbers and booleans come with a column that says where they
    are null; only a frame with such a null has floats or objects in their place."""
    ids = rows[key].to_numpy()
    gone = {c: g for c in whole if (g := rows[f"_no_{c}"].to_numpy()).any()}
    rows = rows[columns]
    cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = rows.iloc[a:b].copy()
        part.index = pd.RangeIndex(b - a)
        for c, g in gone.items():
            if g[a:b].any():
                part[c] = part[c].astype(object).where(~g[a:b], None) if part[c].dtype == bool else part[c].astype("float64").where(~g[a:b])
        yield ids[a], part


def _stacked(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """One frame of many; where they differ in a column's type, every cell keeps its own."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return pd.DataFrame()
    names = list(frames[0].columns)
    if any(set(f.columns) != set(names) for f in frames):
        raise ValueError("frames of different columns")
    out = {}
    for c in names:
        cells = [f[c] for f in frames]
        out[c] = pd.concat(cells if len({x.dtype for x in cells}) == 1 else [x.astype(object) for x in cells], ignore_index=True)
    return pd.DataFrame(out)


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self):
        for df, need in ((self.vertices, ("id", "value")), (self.edges, ("src", "dst", "value"))):
            if missing := set(need) - set(df.columns):
                raise ValueError(f"missing columns {sorted(missing)} in {df.columns}")
        v, e = dict(self.vertices.dtypes), dict(self.edges.dtypes)
        if not v["id"] == e["src"] == e["dst"]:
            raise TypeError(f"ids differ in type: {v['id']}, {e['src']}, {e['dst']}")

    # Building

    @staticmethod
    def from_edges(edges: DataFrame, init: Callable[[Column], Column] = lambda i: i) -> Graph:
        """Vertices are the endpoints of the edges, with init(id) as value."""
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(ids.withColumn("value", init(F.col("id"))), edges)

    @property
    def types(self) -> dict[str, str]:
        """Types of ids, vertex values and edge values."""
        v, e = dict(self.vertices.dtypes), dict(self.edges.dtypes)
        return {"id": v["id"], "vertex": v["value"], "edge": e["value"]}

    def edges_by_source(self) -> DataFrame:
        """Edges dealt by their source."""
        return self.edges.repartition("src")

    def edges_by_target(self) -> DataFrame:
        """Edges dealt by their target."""
        return self.edges.repartition("dst")

    def dealt(self, partitions: int) -> Graph:
        """The graph with vertices and out-edges dealt alike by id, so that joins of the two need no shuffle."""
        return Graph(self.vertices.repartition(partitions, "id"), self.edges.repartition(partitions, "src"))

    def edges_grouped_by_source(self) -> DataFrame:
        return self._grouped("src")

    def edges_grouped_by_target(self) -> DataFrame:
        return self._grouped("dst")

    def _grouped(self, end: str) -> DataFrame:
        return self.edges.groupBy(F.col(end).alias("id")).agg(F.collect_set(F.struct("src", "dst", "value")).alias("edges"))

    # Maps and filters

    def map_vertices(self, f: Callable[[Column, Column], Column]) -> Graph:
        """value := f(id, value)"""
        return replace(self, vertices=self.vertices.select("id", f(F.col("id"), F.col("value")).alias("value")))

    def map_edges(self, f: Callable[[Column, Column, Column], Column]) -> Graph:
        """value := f(src, dst, value)"""
        return replace(self, edges=self.edges.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("value")).alias("value")))

    def filter_on_vertices(self, p: Callable[[Column, Column], Column]) -> Graph:
        """Vertices with p, and edges whose ends both have it."""
        v = self.vertices.where(p(F.col("id"), F.col("value")))
        e = self.edges.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(v, e.select("src", "dst", "value"))

    def filter_on_edges(self, p: Callable[[Column, Column, Column], Column]) -> Graph:
        return replace(self, edges=self.edges.where(p(F.col("src"), F.col("dst"), F.col("value"))))

    def subgraph(self, vertex: Callable[[Column, Column], Column], edge: Callable[[Column, Column, Column], Column]) -> Graph:
        return self.filter_on_edges(edge).filter_on_vertices(vertex)

    def undirected(self) -> Graph:
        """Every edge both ways; where both ways exist already, each keeps its own value."""
        e = self.edges.select("src", "dst", "value", F.lit(0).alias("_back"))
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value", F.lit(1).alias("_back"))
        return replace(self, edges=e.unionByName(back).groupBy("src", "dst").agg(F.min_by("value", "_back").alias("value")))

    # Joins

    def join_with_vertices(self, table: DataFrame, f: Callable[[Column, Column], Column]) -> Graph:
        """value := f(value, table's value) where table (id, value) has the id."""
        return replace(self, vertices=self._joined(self.vertices, table, ["id"], ["id"], f))

    def join_with_edges(self, table: DataFrame, f: Callable[[Column, Column], Column]) -> Graph:
        """The same by (src, dst)."""
        return replace(self, edges=self._joined(self.edges, table, ["src", "dst"], ["src", "dst"], f))

    def join_with_edges_on_source(self, table: DataFrame, f: Callable[[Column, Column], Column]) -> Graph:
        """Edge values from a table (id, value) at their sources."""
        return replace(self, edges=self._joined(self.edges, table, ["src"], ["id"], f))

    def join_with_edges_on_target(self, table: DataFrame, f: Callable[[Column, Column], Column]) -> Graph:
        return replace(self, edges=self._joined(self.edges, table, ["dst"], ["id"], f))

    @staticmethod
    def _joined(rows: DataFrame, table: DataFrame, own: list[str], keys: list[str], f: Callable[[Column, Column], Column]) -> DataFrame:
        right = table.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col("value").alias("_other"), F.lit(True).alias("_met"))
        new = F.when(F.col("_met"), f(F.col("value"), F.col("_other"))).otherwise(F.col("value"))
        return rows.join(right, own, "left").select(*(c if c != "value" else new.alias("value") for c in rows.columns))

    # Aggregations

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every vertex; 0 without edges."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        n = self.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def group_reduce_on_edges(self, f: Callable[[Column, Column], Column], direction: str = OUT) -> DataFrame:
        """(id, f(vertex value, array of its edges)) of every vertex; the array is empty without edges."""
        end, _ = ends(direction)
        lists = self.edges.groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "value"))).alias("_list"))
        return self._listed(lists, f)

    def group_reduce_on_neighbors(self, f: Callable[[Column, Column], Column], direction: str = OUT) -> DataFrame:
        """(id, f(vertex value, array of (src, dst, value, neighbor))) of every vertex; neighbor is the value there."""
        end, _ = ends(direction)
        lists = self._beside_neighbors(direction).groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "value", "neighbor"))).alias("_list"))
        return self._listed(lists, f)

    def _listed(self, lists: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
        empty = F.array().cast(dict(lists.dtypes)["_list"])
        return self.vertices.join(lists, "id", "left").select("id", f(F.col("value"), F.coalesce("_list", empty)).alias("value"))

    def group_apply_on_edges(self, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, direction: str = OUT) -> DataFrame:
        """What f(vertex, its edges) gives for every vertex, as one frame of `schema`: both are pandas frames, the
        first of one row (id, value). For functions that no Column expresses; a vertex's edges are in one task."""
        end, _ = ends(direction)
        return self._applied(self.edges.select("src", "dst", "value"), end, f, schema)

    def group_apply_on_neighbors(self, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, direction: str = OUT) -> DataFrame:
        """The same with (src, dst, value, neighbor); neighbor is the vertex value there."""
        end, _ = ends(direction)
        return self._applied(self._beside_neighbors(direction).select("src", "dst", "value", "neighbor"), end, f, schema)

    def _applied(self, rows: DataFrame, end: str, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """Groups are handed to Python by buckets of many ids, as a group costs milliseconds. The number of tasks is
        fixed: adaptive execution would go by bytes and put all these calls in few of them."""
        n = partitions(self.vertices.sparkSession)

        def dealt(df: DataFrame, key: str) -> tuple[DataFrame, list[str], list[str]]:
            whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "boolean")]
            empty = {c: F.lit(False if dict(df.dtypes)[c] == "boolean" else 0).cast(dict(df.dtypes)[c]) for c in whole}
            cells = [F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in df.columns]
            out = df.select(*cells, *(F.isnull(c).alias(f"_no_{c}") for c in whole), F.pmod(F.xxhash64(key), F.lit(n * BUCKETS)).alias("_bucket"))
            return out.repartition(n, "_bucket").groupBy("_bucket"), df.columns, whole

        v, v_columns, v_whole = dealt(self.vertices, "id")
        e, e_columns, e_whole = dealt(rows, end)

        def run(vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            mine = {k: part for k, part in _slices(edges.sort_values(["src", "dst"], kind="stable").sort_values(end, kind="stable"), end, e_columns, e_whole)}
            none, out = edges.iloc[:0][e_columns], []
            for k, vertex in _slices(vertices.sort_values("id", kind="stable"), "id", v_columns, v_whole):
                out.append(f(vertex, mine.pop(k) if k in mine else none.copy()))
            return _stacked(out)

        return v.cogroup(e).applyInPandas(run, schema)

    def aggregate_edges(
        self, aggregate: Callable[[Column, Column, Column], Column], direction: str = OUT,
        finish: Callable[[Column, Column], Column] = lambda _, a: a,
    ) -> DataFrame:
        """group_reduce_on_edges() with an aggregate of (src, dst, value), which combines before the shuffle; finish
        gets the vertex value and the aggregate, null without edges."""
        end, _ = ends(direction)
        part = self.edges.groupBy(F.col(end).alias("id")).agg(aggregate(F.col("src"), F.col("dst"), F.col("value")).alias("_agg"))
        return self.vertices.join(part, "id", "left").select("id", finish(F.col("value"), F.col("_agg")).alias("value"))

    def aggregate_neighbors(
        self, aggregate: Callable[[Column, Column], Column], direction: str = OUT,
        finish: Callable[[Column, Column], Column] = lambda _, a: a,
    ) -> DataFrame:
        """The same over (edge value, neighbour's value)."""
        end, _ = ends(direction)
        part = self._beside_neighbors(direction).groupBy(F.col(end).alias("id")).agg(aggregate(F.col("value"), F.col("neighbor")).alias("_agg"))
        return self.vertices.join(part, "id", "left").select("id", finish(F.col("value"), F.col("_agg")).alias("value"))

    def reduce_on_edges(self, reducer: Reducer, direction: str = OUT) -> DataFrame:
        """(id, value) of the vertices that have such edges: their values reduced."""
        end, _ = ends(direction)
        return self.edges.groupBy(F.col(end).alias("id")).agg(reduce_column(reducer, F.col("value")).alias("value"))

    def reduce_on_neighbors(self, reducer: Reducer, direction: str = OUT) -> DataFrame:
        """(id, value) of the vertices that have neighbours: their values reduced."""
        end, _ = ends(direction)
        return self._beside_neighbors(direction).groupBy(F.col(end).alias("id")).agg(reduce_column(reducer, F.col("neighbor")).alias("value"))

    def _beside_neighbors(self, direction: str) -> DataFrame:
        _, other = ends(direction)
        return self.edges.join(self.vertices.select(F.col("id").alias(other), F.col("value").alias("neighbor")), other)
