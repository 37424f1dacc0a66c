"""Runs of the packaged algorithms by id: import, prepare, create, run, status, configs, result, delete."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.operators import basic, components, factorization, ranking, traversal
from arcfold.operators.pregel import PregelRun, VertexProgram
from arcfold.plans.lineage import forget, shared_dir, written
from arcfold.sources import text


class BadRequest(ValueError):
    """A parameter is missing or makes no sense."""


def _need(configs: dict, name: str, kind: type) -> Any:
    value = configs.get(name)
    if value is None or value == "":
        raise BadRequest(f"missing {name}")
    try:
        value = kind(value)
    except ValueError as e:
        raise BadRequest(f"{name}: {e}") from e
    if isinstance(value, float) and math.isnan(value):
        raise BadRequest(f"{name} is not a number")
    return value


def _pagerank(g: Graph, c: dict, n: int | None) -> DataFrame:
    source = _need(c, "srcVertexId", int) if c.get("srcVertexId") is not None else None
    out = ranking.pagerank(
        g, 1 << 20 if n is None else n, tolerance=_need(c, "tolerance", float),
        reset_probability=_need(c, "resetProbability", float), source=source,
    )
    return out.select("id", F.struct("rank", "delta").alias("value"))


def _labels(g: Graph, c: dict, n: int | None) -> DataFrame:
    if n is None:
        raise BadRequest("label propagation needs a number of iterations")
    return components.label_propagation(g, n)


#: What the service uses where a request names none.
SVDPP = {"dim": 2, "bias_lambda": 0.005, "bias_gamma": 0.01, "factor_lambda": 0.005, "factor_gamma": 0.01, "min_rating": 0.0, "max_rating": 5.0}


def _svdpp(g: Graph, c: dict, n: int | None) -> DataFrame:
    options = {k: type(v)(c.get(k, v)) for k, v in SVDPP.items()}
    ratings = g.edges.select(F.col("src.id").alias("user"), F.col("dst.id").alias("item"), F.col("value").alias("rating"))
    iterations = int(c["iterations"]) if c.get("iterations") is not None else (10 if n is None else n)
    users, items = factorization.svdpp(
        ratings, seed=int(c["random.seed"]) if c.get("random.seed") not in (None, "") else None, iterations=iterations,
        **options,
    )
    end = lambda df, kind: df.select(
        F.struct(F.lit(kind).cast("tinyint").alias("type"), "id").alias("id"),
        F.struct("baseline", "factors").alias("value"),
    )
    return end(users, 0).unionByName(end(items, 1))


#: Algorithm by name: (graph, configs, iterations) -> (id, value).
ALGORITHMS: dict[str, Callable[[Graph, dict, int | None], DataFrame]] = {
    "bfs": lambda g, c, n: traversal.bfs(g, _need(c, "srcVertexId", int), max_iterations=n),
    "lcc": lambda g, c, n: basic.clustering_coefficient(g),
    "lp": _labels,
    "mssp": lambda g, c, n: traversal.mssp_maps(g, [int(x) for x in str(_need(c, "landmarkVertexIds", str)).split(",")], max_iterations=n),
    "pagerank": _pagerank,
    "sssp": lambda g, c, n: traversal.sssp(g, _need(c, "srcVertexId", int), max_iterations=n),
    "svdpp": _svdpp,
    "wcc": lambda g, c, n: components.wcc(g),
}
REQUIRED = {"bfs": ["srcVertexId"], "sssp": ["srcVertexId"], "mssp": ["landmarkVertexIds"], "pagerank": ["tolerance", "resetProbability"]}


@dataclass
class Run:
    algorithm: str
    graph: Graph
    configs: dict[str, Any]
    program: VertexProgram | None = None
    state: str = "CREATED"
    superstep: int = -1
    running_time: float = 0.0
    table: DataFrame | None = None
    aggregates: dict[str, str] = field(default_factory=dict)


class Service:
    """The registry of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.runs, self.graphs = spark, {}, {}

    def import_graph(
        self, name: str, edges: str, vertices: str | None = None, *, id_parser: text.Parser = "long",
        vertex_parser: text.Parser = "long", edge_parser: text.Parser = "long", ratings: bool = False,
    ) -> Graph:
        """Text files to tables in the shared folder; without vertices the edges' ends are taken."""
        e = text.read_ratings(self.spark, edges) if ratings else text.read_edges(self.spark, edges, id_parser, edge_parser)
        v = text.read_vertices(self.spark, vertices, id_parser, vertex_parser) if vertices else Graph.from_edges(e).vertices
        path = f"{shared_dir(self.spark)}/graph-{uuid.uuid4().hex}"
        v.write.parquet(f"{path}/vertices")
        e.write.parquet(f"{path}/edges")
        self.graphs[name] = Graph(self.spark.read.parquet(f"{path}/vertices"), self.spark.read.parquet(f"{path}/edges"))
        return self.graphs[name]

    def prepare(self, name: str, partitions: int = 50) -> Graph:
        """The graph with vertices and out-edges dealt alike by id, and kept so."""
        g = self.graphs[name]
        dealt = g.dealt(partitions)
        self.graphs[name] = Graph(dealt.vertices.persist(), dealt.edges.persist())
        return self.graphs[name]

    def create(self, algorithm: str | VertexProgram, graph: str, configs: dict[str, Any] | None = None) -> str:
        """A run of an algorithm by its name, or of a vertex program."""
        if isinstance(algorithm, VertexProgram):
            if graph not in self.graphs:
                raise BadRequest(f"unknown graph {graph}")
            run_id = uuid.uuid4().hex[:8]
            self.runs[run_id] = Run(type(algorithm).__name__, self.graphs[graph], dict(configs or {}), algorithm)
            return run_id
        if algorithm not in ALGORITHMS:
            raise BadRequest(f"unknown algorithm {algorithm}")
        if graph not in self.graphs:
            raise BadRequest(f"unknown graph {graph}")
        for name in REQUIRED.get(algorithm, ()):
            _need(configs or {}, name, str)
            if name in ("tolerance", "resetProbability"):
                _need(configs or {}, name, float)
        run_id = uuid.uuid4().hex[:8]
        self.runs[run_id] = Run(algorithm, self.graphs[graph], dict(configs or {}))
        return run_id

    def run(self, run_id: str, iterations: int | None = None) -> dict:
        r = self._get(run_id)
        r.state, began = "RUNNING", time.time()
        try:
            if r.program:
                steps = PregelRun(r.graph, r.program, configs=r.configs)
                try:
                    table, end = steps.run(iterations).result(), steps.state
                finally:
                    r.superstep, r.aggregates = steps.superstep, {k: str(v) for k, v in steps.aggregates.items()}
            else:
                # Closed forms write a table a step; these are counted.
                with written() as names:
                    table, end = ALGORITHMS[r.algorithm](r.graph, r.configs, iterations), "COMPLETED"
                r.superstep = max((names.count(n) for n in set(names)), default=1) - 1
            path = f"{shared_dir(self.spark)}/run-{run_id}-{uuid.uuid4().hex}"
            table.write.parquet(path)
            forget(*([r.table] if r.table is not None else []))
            r.table, r.state = self.spark.read.schema(table.schema).parquet(path), end
            r.table._arcfold_path = path
        except BaseException:
            r.state = "ERROR"
            raise
        finally:
            r.running_time = time.time() - began
        return self.status(run_id)

    def status(self, run_id: str) -> dict:
        """superstep is the last one, from 0 (-1 before the run); aggregates are those of a vertex program."""
        r = self._get(run_id)
        return {
            "id": run_id, "algorithm": r.algorithm, "state": r.state, "superstep": r.superstep,
            "runningTime": r.running_time, "aggregates": dict(r.aggregates),
        }

    def configs(self, run_id: str) -> dict:
        return dict(self._get(run_id).configs)

    def result(self, run_id: str, key: str | None = None) -> DataFrame:
        """(key, value) as strings, of one key if given."""
        table = self._get(run_id).table
        if table is None:
            raise BadRequest(f"run {run_id} has no result")
        typed = dict(table.dtypes)["id"].startswith("struct")
        out = table.select(
            (text.show_rating_id(F.col("id")) if typed else F.col("id").cast("string")).alias("key"),
            F.col("value").cast("string").alias("value"),
        )
        return out if key is None else out.where(F.col("key") == key)

    def delete(self, run_id: str) -> None:
        """Forgets a run and removes its table."""
        r = self._get(run_id)
        if r.table is not None:
            forget(r.table)
        del self.runs[run_id]

    def health(self) -> dict[str, str]:
        """Whether the session answers and the shared folder can be written."""
        path = f"{shared_dir(self.spark)}/health-{uuid.uuid4().hex}"
        try:
            self.spark.range(1).write.parquet(path)
            return {"session": "UP", "sharedFolder": "UP"}
        except Exception as e:  # noqa: BLE001
            return {"session": "UP", "sharedFolder": f"DOWN: {e}"}

    def _get(self, run_id: str) -> Run:
        if run_id not in self.runs:
            raise KeyError(f"no run {run_id}")
        return self.runs[run_id]
