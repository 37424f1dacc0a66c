"""Vertex programs in supersteps (bulk-synchronous).

A vertex is one row (id, value, out-edges, inbox); a superstep maps rows to rows of new value, new edges and outbox,
so only messages shuffle, and vertices without mail that voted to halt are not run. What vertices aggregate is added
up per partition before it reaches the driver, a row per partition. Every step's state is a table in the shared
folder. Algorithms with a closed form have one of their own; this is the way for all others.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.functions.reducers import Reducer, reduce_column
from arcfold.graph import Graph
from arcfold.operators.aggregators import Aggregator
from arcfold.plans.lineage import forget, staged


#: Vertices whose new rows a task holds at once.
ROWS = 1000


class Aggregates:
    """Reads the last step's values by name and collects this step's."""

    def __init__(self, registry: dict[str, tuple[Aggregator, bool]], last: dict[str, Any]):
        self.registry, self.last = registry, last
        self.new = {n: a.zero for n, (a, _) in registry.items()}

    def get(self, name: str) -> Any:
        return self.last[name]

    def aggregate(self, name: str, value: Any) -> None:
        self.new[name] = self.registry[name][0].merge(self.new[name], value)


class Master:
    """What master_compute may do: read and set aggregates, and halt."""

    def __init__(self, values: dict[str, Any]):
        self.values, self.halted = values, False

    def get(self, name: str) -> Any:
        return self.values[name]

    def set(self, name: str, value: Any) -> None:
        self.values[name] = value

    def halt(self) -> None:
        self.halted = True


class Vertex:
    """A vertex in a superstep. `edges` maps targets to values and shows changes at once."""

    def __init__(self, id_: Any, value: Any, edges: dict[Any, Any], aggregates: Aggregates):
        self.id, self.value, self.edges, self._aggregates = id_, value, edges, aggregates
        self.new_value, self.halted = value, False
        self.outbox: list[tuple[Any, Any]] = []
        self.contributions: dict[str, Any] = {}

    def set_value(self, value: Any) -> None:
        """The value of the next superstep on; None leaves it."""
        if value is not None:
            self.new_value = value

    def send(self, target: Any, message: Any) -> None:
        self.outbox.append((target, message))

    def add_edge(self, target: Any, value: Any) -> None:
        self.edges[target] = value

    def remove_edge(self, target: Any) -> None:
        self.edges.pop(target, None)

    def set_edge_value(self, target: Any, value: Any) -> None:
        """Only where the edge is there."""
        if target in self.edges:
            self.edges[target] = value

    def vote_to_halt(self) -> None:
        self.halted = True

    def aggregate(self, name: str, value: Any) -> None:
        """One contribution a name and superstep: the last counts."""
        self.contributions[name] = value

    def get_aggregated(self, name: str) -> Any:
        return self._aggregates.get(name)


class VertexProgram(ABC):
    #: Spark types of vertex values, edge values and messages.
    vertex_type = "double"
    edge_type = "double"
    message_type = "double"
    #: What every vertex finds in its inbox at superstep 0, if anything.
    initial_message: Any = None
    #: A reducer of messages (see functions.reducers): with one, a vertex finds one message, and a hub's mail is
    #: combined before the shuffle.
    combiner: Reducer | None = None

    def aggregators(self) -> dict[str, tuple[Aggregator, bool]]:
        """name: (reducer, persistent). A persistent one goes on from the last step's value."""
        return {}

    def master_compute(self, superstep: int, master: Master) -> None:
        """Runs on the driver before each superstep."""

    def configure(self, configs: dict[str, Any]) -> None:
        """Runs on the driver before the first superstep, with the configs of the run."""

    def close(self) -> None:
        """Runs on the driver after the last superstep, also after an error."""

    def pre_superstep(self, superstep: int, aggregates: Aggregates) -> None:
        """Runs once per partition."""

    def post_superstep(self, superstep: int, aggregates: Aggregates) -> None:
        """Runs once per partition."""

    @abstractmethod
    def compute(self, superstep: int, vertex: Vertex, messages: list[Any]) -> None:
        """Runs for each vertex that has mail or did not vote to halt."""


def _stepper(program: VertexProgram, registry: dict, last: dict, superstep: int):
    """A superstep of one partition: rows to rows, and one row more with what the partition aggregated."""
    columns = ["id", "value", "edges", "halted", "outbox", "aggregates"]

    def plain(m: Any) -> Any:
        return m.asDict() if hasattr(m, "asDict") else m

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agg = Aggregates(registry, last)
        program.pre_superstep(superstep, agg)
        for f in (f.iloc[k : k + ROWS] for f in frames for k in range(0, len(f), ROWS)):
            rows = []
            for i, value, edges, halted, inbox in zip(f["id"], f["value"], f["edges"], f["halted"], f["inbox"], strict=True):
                v = Vertex(i, value, {e["dst"]: e["value"] for e in (edges if edges is not None else ())}, agg)
                mail = [] if inbox is None else list(inbox)
                if mail or not halted:
                    program.compute(superstep, v, [plain(m["msg"]) for m in mail])
                    for name, x in v.contributions.items():
                        agg.aggregate(name, x)
                else:
                    v.halted = True
                rows.append((
                    i, v.new_value, [{"dst": d, "value": x} for d, x in v.edges.items()], v.halted,
                    [{"id": t, "sender": i, "msg": m} for t, m in v.outbox], None,
                ))
            yield pd.DataFrame(rows, columns=columns)
        program.post_superstep(superstep, agg)
        yield pd.DataFrame([(None, None, [], True, [], pickle.dumps(agg.new))], columns=columns).astype({"id": "object"})

    return run


class PregelRun:
    """A run's state: CREATED, RUNNING, COMPLETED (no vertex has work, or the iterations are over), HALTED (by the
    master) or ERROR."""

    def __init__(self, graph: Graph, program: VertexProgram, *, partitions: int | None = None, configs: dict[str, Any] | None = None):
        self.program, self.state, self.superstep, self.graph = program, "CREATED", -1, graph
        self.configs = dict(configs or {})
        program.configure(self.configs)
        self.registry = program.aggregators()
        self.aggregates = {n: a.zero for n, (a, _) in self.registry.items()}
        self.partitions = partitions or graph.vertices.sparkSession.sparkContext.defaultParallelism
        ids = graph.types["id"]
        self.row = f"id {ids}, value {program.vertex_type}, edges array<struct<dst:{ids},value:{program.edge_type}>>"
        self.out = f"{self.row}, halted boolean, outbox array<struct<id:{ids},sender:{ids},msg:{program.message_type}>>, aggregates binary"

    def run(self, max_iterations: int | None = None) -> PregelRun:
        """Supersteps 0 to max_iterations, or until no vertex has work."""
        self.state = "RUNNING"
        try:
            self._run(max_iterations)
        except BaseException:
            self.state = "ERROR"
            raise
        finally:
            self.program.close()
        return self

    def _inbox(self) -> Column:
        """What a vertex finds: its messages in the order of their senders, or one that the combiner makes of them."""
        if self.program.combiner is not None:
            one = reduce_column(self.program.combiner, F.col("msg"))
            return F.array(F.struct(F.min("sender").alias("sender"), one.cast(self.program.message_type).alias("msg")))
        by_sender = lambda a, b: F.when(a["sender"] < b["sender"], -1).when(a["sender"] > b["sender"], 1).otherwise(0)
        return F.array_sort(F.collect_list(F.struct("sender", "msg")), by_sender)

    def _run(self, max_iterations: int | None) -> None:
        g, p = self.graph, self.program
        lists = g.edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("dst", "value")).alias("edges"))
        rows = g.vertices.select("id", "value").join(lists, "id", "left").select("id", "value", "edges", F.lit(False).alias("halted")).to(g.vertices.sparkSession.createDataFrame([], f"{self.row}, halted boolean").schema)
        mail = None
        if p.initial_message is not None:
            ids, message = g.types["id"], p.initial_message

            def deliver(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    yield pd.DataFrame({"id": f["id"], "sender": f["id"], "msg": [message] * len(f)})

            mail = rows.select("id").mapInPandas(deliver, f"id {ids}, sender {ids}, msg {p.message_type}")
        while max_iterations is None or self.superstep < max_iterations:
            master = Master(self.aggregates)
            p.master_compute(self.superstep + 1, master)
            if master.halted:
                self.state = "HALTED"
                break
            self.superstep += 1
            state = rows.withColumn("inbox", F.lit(None).cast(f"array<struct<sender:{g.types['id']},msg:{p.message_type}>>"))
            if mail is not None:
                inbox = mail.groupBy("id").agg(self._inbox().alias("inbox"))
                state = rows.join(inbox, "id", "left")
            state = state.repartition(self.partitions, "id").sortWithinPartitions("id")
            done = staged(state.mapInPandas(_stepper(p, self.registry, dict(self.aggregates), self.superstep), self.out), "pregel")
            parts = [pickle.loads(r[0]) for r in done.where("aggregates is not null").select("aggregates").collect()]
            for n, (a, persistent) in self.registry.items():
                value = self.aggregates[n] if persistent else a.zero
                for part in parts:
                    value = a.merge(value, part[n])
                self.aggregates[n] = value
            forget(rows)
            rows = done.where("aggregates is null").select("id", "value", "edges", "halted")
            rows._arcfold_path = done._arcfold_path
            mail = done.where("aggregates is null").select(F.explode("outbox").alias("m")).select("m.*")
            if rows.where("not halted").isEmpty() and mail.join(rows.select("id"), "id", "left_semi").isEmpty():
                break
        self.rows = rows
        if self.state == "RUNNING":
            self.state = "COMPLETED"

    def result(self) -> DataFrame:
        """(id, value)"""
        return self.rows.select("id", "value")

    def edges(self) -> DataFrame:
        """(src, dst, value) as the program left them."""
        return self.rows.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.dst", "e.value")


def pregel(graph: Graph, program: VertexProgram, max_iterations: int | None = None, **options) -> PregelRun:
    return PregelRun(graph, program, **options).run(max_iterations)
