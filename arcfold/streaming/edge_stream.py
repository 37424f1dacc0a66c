"""Edge streams: a streaming (or bounded) DataFrame of (src, dst, value, ts), seen once.

Running results are aggregations in update or complete mode. distinct() and windows bound their state by a watermark on
ts, 24 hours unless told otherwise. Results by vertex (vertices, degrees, aggregates, neighbourhoods) are running totals
over all of the stream: their state holds each vertex, or each distinct neighbour, once.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from arcfold.functions.reducers import Reducer, fold_column, reduce_column
from arcfold.graph import BOTH, IN, OUT

DELAY = "24 hours"


@dataclass(frozen=True)
class EdgeStream:
    edges: DataFrame
    delay: str = DELAY

    def _with(self, edges: DataFrame) -> EdgeStream:
        return replace(self, edges=edges)

    def _late(self) -> DataFrame:
        return self.edges.withWatermark("ts", self.delay) if self.edges.isStreaming else self.edges

    def _rest(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    # Transformations

    def map_edges(self, f: Callable[[Column, Column, Column], tuple[Column, Column, Column]]) -> EdgeStream:
        """f gives new ends and a new value."""
        src, dst, value = f(F.col("src"), F.col("dst"), F.col("value"))
        rest = [c for c in self._rest() if c != "value"]
        return self._with(self.edges.select(src.alias("src"), dst.alias("dst"), value.alias("value"), *rest))

    def filter_edges(self, p: Callable[[Column, Column, Column], Column]) -> EdgeStream:
        return self._with(self.edges.where(p(F.col("src"), F.col("dst"), F.col("value"))))

    def filter_vertices(self, p: Callable[[Column], Column]) -> EdgeStream:
        """Edges whose ends both have p."""
        return self._with(self.edges.where(p(F.col("src")) & p(F.col("dst"))))

    def reverse(self) -> EdgeStream:
        return self._with(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *self._rest()))

    def undirected(self) -> EdgeStream:
        """Every edge and its reverse."""
        both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
        return self._with(self.edges.select(both, *self._rest()).select("e.src", "e.dst", *self._rest()))

    def union(self, other: EdgeStream) -> EdgeStream:
        return self._with(self.edges.unionByName(other.edges))

    def distinct(self) -> EdgeStream:
        """The first of edges with equal ends, within the watermark on a stream."""
        if self.edges.isStreaming:
            return self._with(self._late().dropDuplicatesWithinWatermark(["src", "dst"]))
        return self._with(self.edges.dropDuplicates(["src", "dst"]))

    def vertices(self) -> DataFrame:
        """Both ends of every edge, each id once."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).dropDuplicates(["id"])

    # Running aggregates

    def number_of_edges(self) -> DataFrame:
        return self.edges.groupBy().agg(F.count("*").alias("count"))

    def number_of_vertices(self) -> DataFrame:
        return self.vertices().groupBy().agg(F.count("*").alias("count"))

    def degrees(self) -> DataFrame:
        """(id, degree): each end of each edge counts."""
        return self._counted(F.explode(F.array("src", "dst")))

    def in_degrees(self) -> DataFrame:
        return self._counted(F.col("dst"))

    def out_degrees(self) -> DataFrame:
        return self._counted(F.col("src"))

    def _counted(self, end: Column) -> DataFrame:
        return self.edges.select(end.alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

    def aggregate(self, edge_mapper: Callable[[Column, Column, Column], Column], vertex_aggregate: Callable[[Column], Column]) -> DataFrame:
        """(id, value): edges are mapped to arrays of (id, value), whose values are aggregated by id."""
        rows = self.edges.select(F.explode(edge_mapper(F.col("src"), F.col("dst"), F.col("value"))).alias("v")).select("v.id", "v.value")
        return rows.groupBy("id").agg(vertex_aggregate(F.col("value")).alias("value"))

    def global_aggregate(self, edge_mapper: Callable[[Column, Column, Column], Column], aggregate: Callable[[Column, Column], Column]) -> DataFrame:
        """(value): the same over all of (id, value). In update mode a row comes with every batch; changed() keeps those
        that differ."""
        rows = self.edges.select(F.explode(edge_mapper(F.col("src"), F.col("dst"), F.col("value"))).alias("v")).select("v.id", "v.value")
        return rows.groupBy().agg(aggregate(F.col("id"), F.col("value")).alias("value"))

    def build_neighborhood(self, directed: bool = True) -> DataFrame:
        """(id, neighbors): the sorted ids that edges of each source have led to so far."""
        edges = self.edges if directed else self.undirected().edges
        return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))

    def neighborhood_rows(self, directed: bool = True, order: tuple[str, ...] = ("ts",)) -> DataFrame:
        """(src, dst, neighbors) for every edge: the sorted ids that edges of its source have led to, up to and with
        this one. The ids of a source are the state of a stream, which grows with its distinct edges."""
        edges = self.edges if directed else self.undirected().edges
        edges = edges.select("src", "dst", *order)
        if not edges.isStreaming:
            so_far = Window.partitionBy("src").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return edges.select("src", "dst", F.array_sort(F.collect_set("dst").over(so_far)).alias("neighbors"))
        ids = dict(edges.dtypes)["dst"]

        def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            known = list(state.get[0]) if state.exists else []
            seen, rows = set(known), []
            for dst in pd.concat(list(frames)).sort_values(list(order))["dst"]:
                if dst not in seen:
                    seen.add(dst)
                    bisect.insort(known, dst)
                rows.append((key[0], dst, list(known)))
            state.update((known,))
            yield pd.DataFrame(rows, columns=["src", "dst", "neighbors"])

        out = f"src {ids}, dst {ids}, neighbors array<{ids}>"
        return edges.groupBy("src").applyInPandasWithState(run, out, f"neighbors array<{ids}>", "append", "NoTimeout")

    # Windows

    def slice(self, size: str, slide: str | None = None, direction: str = OUT) -> WindowedStream:
        """Edges in windows of ts, tumbling or hopping, grouped at their source (OUT), target (IN) or both."""
        stream = {OUT: lambda: self, IN: self.reverse, BOTH: self.undirected}[direction]()
        return WindowedStream(stream._late(), F.window("ts", size, slide) if slide else F.window("ts", size))


@dataclass(frozen=True)
class WindowedStream:
    edges: DataFrame
    window: Column

    def _grouped(self):
        return self.edges.groupBy(self.window.alias("window"), F.col("src").alias("id"))

    def reduce_on_edges(self, reducer: Reducer) -> DataFrame:
        """(window, id, value)"""
        return self._grouped().agg(reduce_column(reducer, F.col("value")).alias("value"))

    def fold_neighbors(self, init: Column, f: Callable[[Column, Column], Column], order: list[str] | None = None) -> DataFrame:
        """(window, id, value): f(accumulator, (id, neighbor, value)) over the edges in order of ts, and of more
        columns where given."""
        fields = {"id": F.col("src"), "neighbor": F.col("dst"), "value": F.col("value")}
        return self._grouped().agg(fold_column([F.col(c) for c in ["ts", *(order or [])]], fields, init, f).alias("value"))


def changed(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for one-row results such as global_aggregate(): hands a row on only if it differs from
    the one before."""
    last: list[list] = [[]]

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.take(1)
        if rows and rows != last[0]:
            last[0] = rows
            sink(batch)

    return run
