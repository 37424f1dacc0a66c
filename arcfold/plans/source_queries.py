"""Registered queries of readers, writers, change logs, vertex programs' edges and aggregators, and the service: each
takes a table through text files, logs or a run and back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.__main__ import main
from arcfold.functions.javarandom import JavaRandom
from arcfold.graph import Graph
from arcfold.operators import aggregators, factorization, traversal
from arcfold.operators.pregel import Vertex, VertexProgram, pregel
from arcfold.plans.graph_queries import ORACLES, QUERIES, SPREAD, WCC, E, S, V, _rounds, _settled, graph, query, rounded, stream
from arcfold.plans.lineage import shared_dir
from arcfold.service import Service
from arcfold.sources import datasets, logs, text
from arcfold.streaming import summaries
from arcfold.streaming.runner import drained

__all__ = ["ORACLES", "QUERIES"]


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Text files


@query(f"WITH {V} SELECT id, CASE WHEN id % 10 > 0 THEN value END AS value FROM v")
def text_vertices(spark, d):
    """Every tenth vertex has no value."""
    path = folder(spark, "vertices")
    text.write_vertices(graph(spark, d).map_vertices(lambda i, v: F.when(i % 10 > 0, v)).vertices, path)
    return text.read_vertices(spark, path)


@query(f"WITH {E} SELECT src, dst, value FROM e")
def text_edges(spark, d):
    path = folder(spark, "edges")
    text.write_edges(graph(spark, d).edges, path)
    return text.read_edges(spark, path, "long", "double")


@query(f"WITH {E} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, floor(value) AS value FROM e")
def text_edges_own_parser(spark, d):
    """Ids as strings, values by a parser of the caller's."""
    path = folder(spark, "edges")
    text.write_edges(graph(spark, d).edges, path)
    return text.read_edges(spark, path, "string", lambda field: F.floor(field.cast("double")).cast("double"))


@query(f"WITH {E} SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(value AS FLOAT) AS value FROM e")
def text_edges_small_types(spark, d):
    path = folder(spark, "edges")
    text.write_edges(graph(spark, d).edges, path)
    return text.read_edges(spark, path, "integer", "float")


RATINGS = (
    "SELECT CAST(l_suppkey AS BIGINT) AS user_id, CAST(l_partkey AS BIGINT) AS item_id, CAST(sum(l_linenumber) AS FLOAT) AS rating"
    " FROM lineitem GROUP BY ALL"
)


def whole_ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating), the rating a whole number."""
    x = datasets.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("user"), F.col("l_partkey").cast("long").alias("item"))
    return x.agg(F.sum("l_linenumber").cast("float").alias("rating"))


@query(f"SELECT 0 AS user_type, user_id, '(' || item_id || ', 1)' AS item, rating FROM ({RATINGS})")
def text_ratings(spark, d):
    path = folder(spark, "ratings")
    text.write_edges(whole_ratings(spark, d).toDF("src", "dst", "value"), path)
    out = text.read_ratings(spark, path)
    back = text.parse_rating_id(text.show_rating_id(F.col("src")))
    return out.select(
        back["type"].cast("int").alias("user_type"), back["id"].alias("user_id"),
        text.show_rating_id(F.col("dst")).alias("item"), F.col("value").alias("rating"),
    )


@query(f"WITH {E} SELECT src, dst, value FROM e")
def import_edges(spark, d):
    """Through the command line, with a ready-made importer's types."""
    source, target = folder(spark, "edges"), folder(spark, "edges-table")
    text.write_edges(graph(spark, d).edges, source)
    main(["import", "-ef", source, "-et", target, "-p", "long_double", "-np", "4"])
    return spark.read.parquet(target)


@query(f"SELECT user_id, item_id, rating FROM ({RATINGS})")
def import_ratings(spark, d):
    source, target = folder(spark, "ratings"), folder(spark, "ratings-table")
    text.write_edges(whole_ratings(spark, d).toDF("src", "dst", "value"), source)
    main(["import", "-rf", source, "-et", target, "-np", "4"])
    return spark.read.parquet(target).select(F.col("src.id").alias("user_id"), F.col("dst.id").alias("item_id"), F.col("value").alias("rating"))


# Change logs


@query(
    "SELECT CAST(o_custkey AS BIGINT) AS id, arg_max(o_totalprice, o_orderkey) AS value FROM orders"
    " GROUP BY o_custkey HAVING arg_max(o_totalprice, o_orderkey) >= 50000"
)
def change_log_table(spark, d):
    """The last order of each customer counts; one under 50000 deletes its key. The log is written in two parts."""
    path = folder(spark, "log")
    price = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("value")
    log = datasets.table(spark, d, "orders").select(
        F.col("o_custkey").cast("long").alias("id"), price, F.col("o_orderkey").cast("long").alias("offset"),
    )
    for part in (0, 1):
        logs.write_log(log.where(F.col("offset") % 2 == part), path)
    return logs.latest(logs.read_log(spark, path), ["id"])


@query("SELECT CAST(user_id AS BIGINT) AS id, count(*) AS n FROM events GROUP BY user_id")
def change_log_stream(spark, d):
    path = folder(spark, "log")
    log = datasets.event_edges(spark, d).select("src", "seq")
    logs.write_log(log, path)
    return drained(logs.stream_log(spark, path, log.schema, maxFilesPerTrigger=2).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")))


@query("SELECT i AS id, i * i AS value FROM range(20) x(i)")
def stream_of_collection(spark, d):
    rows = [(i, i * i) for i in range(20)]
    return drained(logs.stream_from_collection(spark, rows, "id long, value long", folder(spark, "collection"), per_batch=5), "append")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS value FROM nation")
def collection_of_table(spark, d):
    """A small table as a dictionary, and back."""
    names = logs.map_from_table(datasets.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("value"),
    ))
    return logs.table_from_collection(spark, names.items(), "id long, value string")


# Graphs


@query(f"WITH {E} SELECT src AS id, CAST(1 AS BIGINT) AS parts, count(*) AS n FROM e GROUP BY src")
def dealt_edges(spark, d):
    """All edges of a source lie in one partition."""
    e = graph(spark, d).dealt(7).edges.withColumn("part", F.spark_partition_id())
    return e.groupBy(F.col("src").alias("id")).agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n"))


@query(f"WITH {E} SELECT dst AS id, CAST(1 AS BIGINT) AS parts, count(*) AS n FROM e GROUP BY dst")
def edges_by_target(spark, d):
    e = graph(spark, d).edges_by_target().withColumn("part", F.spark_partition_id())
    return e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT o_custkey AS c, l_suppkey AS s, sum(l_quantity) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),"
    " n AS (SELECT count(*) AS n FROM customer) SELECT CAST(s + n AS BIGINT) AS id, count(*) AS degree, round(sum(value), 2) AS weight FROM s, n GROUP BY s + n"
)
def supply_degrees(spark, d):
    """Suppliers of the bipartite graph of customers and their suppliers."""
    e = datasets.supply_edges(spark, d)
    g = Graph.from_edges(e.withColumn("value", F.col("value").cast("double")))
    both = g.aggregate_edges(lambda s, t, v: F.struct(F.count("*").alias("degree"), F.round(F.sum(v), 2).alias("weight")), "IN")
    return both.where("value is not null").select("id", "value.degree", "value.weight")


@query(
    f"WITH {V}, {E} SELECT id, count(src) AS n, round(coalesce(sum(e.value) FILTER (WHERE dst > id), 0), 2) AS up FROM v LEFT JOIN e ON src = id"
    f" GROUP BY id"
)
def group_apply_on_edges(spark, d):
    def totals(vertex: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        up = np.nansum(edges["value"].to_numpy()[edges["dst"].to_numpy() > vertex["id"].iloc[0]])
        return pd.DataFrame({"id": vertex["id"], "n": [len(edges)], "up": [round(float(up), 2)]})

    return rounded(graph(spark, d).group_apply_on_edges(totals, "id long, n long, up double"), "up", digits=2)


@query(f"WITH {V}, {E} SELECT id, coalesce(string_agg(src, ',' ORDER BY src), '') AS sources FROM v LEFT JOIN e ON dst = id GROUP BY id")
def group_apply_on_neighbors(spark, d):
    def sources(vertex: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": vertex["id"], "sources": [",".join(map(str, edges["neighbor"]))]})

    return graph(spark, d).group_apply_on_neighbors(sources, "id long, sources string", "IN")


@query(
    f"WITH {S} SELECT src, dst, array_to_string(list_sort(list_distinct(list(dst) OVER (PARTITION BY src ORDER BY ts, seq))), ',') AS neighbors"
    f" FROM s"
)
def stream_neighborhood_rows(spark, d):
    rows = drained(stream(spark, d).neighborhood_rows(order=("ts", "seq")), "append")
    return rows.select("src", "dst", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


# Vertex programs


class Edits(VertexProgram):
    """Drops light edges, doubles heavy ones, and leads back from every mail's sender; mail to no one is lost."""

    vertex_type, edge_type, message_type = "long", "double", "long"

    def compute(self, superstep: int, vertex: Vertex, messages: list) -> None:
        if superstep == 0:
            vertex.send(-1, vertex.id)
            for target, value in list(vertex.edges.items()):
                if value < 50_000:
                    vertex.remove_edge(target)
                elif value > 300_000:
                    vertex.set_edge_value(target, 2 * value)
                    vertex.send(target, vertex.id)
            vertex.set_edge_value(-1, 0.0)
        for sender in messages:
            vertex.add_edge(sender, -1.0)
        vertex.vote_to_halt()


@query(
    f"WITH {E}, h AS (SELECT dst AS src, src AS dst, -1.0 AS value FROM e WHERE value > 300000),"
    " k AS (SELECT src, dst, CASE WHEN value > 300000 THEN 2 * value ELSE value END AS value FROM e WHERE value >= 50000)"
    " SELECT src, dst, CAST(value AS DOUBLE) AS value FROM h UNION ALL SELECT src, dst, value FROM k ANTI JOIN h ON k.src = h.src AND k.dst = h.dst"
)
def pregel_edges(spark, d):
    run = pregel(graph(spark, d), Edits())
    if (run.state, run.superstep) != ("COMPLETED", 1):
        raise AssertionError(f"{run.state} after superstep {run.superstep}")
    return run.edges()


class Everything(VertexProgram):
    """One superstep through every reducer."""

    vertex_type, edge_type, message_type = "long", "double", "long"

    def aggregators(self):
        a = aggregators
        return {
            "long_sum": (a.LONG_SUM, False),
            "long_product": (a.LONG_PRODUCT, False),
            "long_min": (a.LONG_MIN_OF, False),
            "long_max": (a.LONG_MAX_OF, False),
            "double_sum": (a.DOUBLE_SUM, False),
            "double_product": (a.DOUBLE_PRODUCT, False),
            "double_min": (a.DOUBLE_MIN_OF, False),
            "double_max": (a.DOUBLE_MAX_OF, False),
            "boolean_and": (a.BOOLEAN_AND, False),
            "boolean_or": (a.BOOLEAN_OR, False),
            "double_list": (a.DOUBLE_LIST, False),
            "least_lists": (a.list_of_lists(2), False),
        }

    def compute(self, superstep: int, vertex: Vertex, messages: list) -> None:
        i, weight = int(vertex.id), float(sum(vertex.edges.values()))
        put = vertex.aggregate
        put("long_sum", i)
        put("long_product", 2 if i < 20 else 1)
        put("long_min", i - 5)
        put("long_max", i + 5)
        put("double_sum", i / 4)
        put("double_product", 1.5 if i < 8 else 1.0)
        put("double_min", weight)
        put("double_max", weight)
        put("boolean_and", i >= 0)
        put("boolean_or", i == 7)
        put("double_list", [1.0, float(i)])
        put("least_lists", [[float(i), 0.5]])
        vertex.vote_to_halt()


@query(
    f"WITH {V}, {E}, w AS (SELECT id, coalesce(sum(e.value), 0) AS weight FROM v LEFT JOIN e ON src = id GROUP BY id)"
    " SELECT CAST(sum(id) AS BIGINT) AS long_sum, CAST(1048576 AS BIGINT) AS long_product, min(id) - 5 AS long_min, max(id) + 5 AS long_max, sum(id) / 4 AS double_sum,"
    " power(1.5::DOUBLE, count(*) FILTER (WHERE id < 8)) AS double_product, min(weight) AS double_min, round(max(weight), 2) AS double_max,"
    " bool_and(id >= 0) AS boolean_and, bool_or(id = 7) AS boolean_or, count(*) || '.0,' || sum(id) || '.0' AS double_list, '0.0,0.5,1.0,0.5' AS least_lists FROM w"
)
def pregel_every_aggregator(spark, d):
    a = dict(pregel(graph(spark, d), Everything()).aggregates)
    a["double_list"] = ",".join(map(str, a["double_list"]))
    a["least_lists"] = ",".join(str(x) for row in a["least_lists"] for x in row)
    a["double_max"] = round(a["double_max"], 2)
    kinds = {int: "long", float: "double", bool: "boolean", str: "string"}
    return spark.createDataFrame([tuple(a.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in a.items()))


@query(
    f"WITH {V}, {E} SELECT v.id, CASE WHEN v.id = 0 THEN 0 WHEN src IS NOT NULL THEN 1 ELSE 9223372036854775807 END AS value FROM v LEFT"
    f" JOIN (SELECT * FROM e WHERE src = 0) ON dst = v.id"
)
def bfs_one_step(spark, d):
    """A number of iterations ends a run early."""
    return traversal.bfs(graph(spark, d), 0, max_iterations=1)


# The service


def _served(spark: SparkSession, d: str, algorithm, configs: dict | None = None, iterations: int | None = None) -> tuple[Service, str]:
    g, v, e = graph(spark, d), folder(spark, "vertices"), folder(spark, "edges")
    text.write_vertices(g.vertices, v)
    text.write_edges(g.edges, e)
    s = Service(spark)
    s.import_graph("orders", e, v, edge_parser="double")
    s.prepare("orders", 4)
    run = s.create(algorithm, "orders", configs)
    s.run(run, iterations)
    return s, run


@query(f"SELECT CAST(id AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value FROM ({WCC})")
def service_result(spark, d):
    s, run = _served(spark, d, "wcc")
    return s.result(run)


@query(f"SELECT CAST(id AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value FROM ({WCC}) WHERE id = 17")
def service_result_by_key(spark, d):
    s, run = _served(spark, d, "wcc")
    return s.result(run, "17")


@query(
    f"WITH {V} SELECT 'Everything' AS algorithm, 'COMPLETED' AS state, 0 AS superstep, (SELECT CAST(sum(id) AS VARCHAR)"
    f" FROM v) AS long_sum, '1' AS note, false AS known_after_delete, 'UP' AS health"
)
def service_status(spark, d):
    s, run = _served(spark, d, Everything(), {"note": "1"})
    status, note = s.status(run), s.configs(run)["note"]
    s.delete(run)
    row = (
        status["algorithm"], status["state"], status["superstep"], status["aggregates"]["long_sum"], note,
        run in s.runs, s.health()["sharedFolder"],
    )
    return spark.createDataFrame(
        [row],
        "algorithm string, state string, superstep int, long_sum string, note string, known_after_delete boolean, health string",
    )


# Matrix factorization


#: Half a step of ALS for two factors: the normal equations of each id, solved in closed form.
HALF = (
    "SELECT {id} AS id, CAST((c * x - b * y) / (a * c - b * b) AS FLOAT) AS u1, CAST((a * y - b * x) / (a * c - b * b) AS FLOAT) AS u2 FROM ("
    "SELECT {id}, sum(CAST(u1 AS DOUBLE) * u1) + 0.01 * count(*) AS a, sum(CAST(u1 AS DOUBLE) * u2) AS b, sum(CAST(u2 AS DOUBLE) * u2) + 0.01 * count(*) AS c,"
    " sum(CAST(u1 AS DOUBLE) * rating) AS x, sum(CAST(u2 AS DOUBLE) * rating) AS y FROM r JOIN {p} ON {other} = {p}.id GROUP BY {id})"
)
#: The first two draws of the seeded start, which all ids share.
START = factorization._start(0, 2)(0)


@query(
    f"WITH r AS ({RATINGS}), r0 AS (SELECT DISTINCT item_id AS id, CAST({START[0]!r} AS FLOAT) AS u1, CAST({START[1]!r} AS FLOAT) AS u2 FROM r),"
    f" r1 AS ({HALF.format(id='user_id', other='item_id', p='r0')}), r2 AS ({HALF.format(id='item_id', other='user_id', p='r1')})"
    " SELECT id, round(CAST(u1 AS DOUBLE), 3) AS f1, round(CAST(u2 AS DOUBLE), 3) AS f2 FROM r2"
)
def als_two_half_steps(spark, d):
    """Items after users and items were solved once each, with two factors."""
    items = factorization.als(whole_ratings(spark, d), dim=2, iterations=4, seed=0)[1]
    return rounded(
        items.select("id", F.col("factors")[0].cast("double").alias("f1"), F.col("factors")[1].cast("double").alias("f2")),
        "f1", "f2", digits=3,
    )


def _fold(fields: str, first: str, rest: str, step: str) -> str:
    """A left fold over a list of structs, in SQL."""
    names = [f.strip() for f in fields.split(",")]
    cast = lambda row: "{" + ", ".join(f"'{n}': CAST({x} AS FLOAT)" for n, x in zip(names, row.split(";"), strict=True)) + "}"
    return f"list_reduce(list_prepend({cast(first)}, {rest.replace('ROW', cast('; '.join(['0'] * (len(names) - 1)) + '; rating'))}), lambda s, x: {cast(step)})"


#: One vertex's ratings in the order of the others' ids.
_SEEN = "list(ROW ORDER BY item_id)"


def _sgd_sql() -> str:
    u, lam, gamma = START, "CAST(0.01 AS FLOAT)", "CAST(0.005 AS FLOAT)"
    err = f"(greatest(CAST(0 AS FLOAT), least(CAST(5 AS FLOAT), s.a * CAST({u[0]!r} AS FLOAT) + s.b * CAST({u[1]!r} AS FLOAT))) - x.r)"
    step = "; ".join(f"s.{n} - (s.{n} * {lam} + CAST({u[k]!r} AS FLOAT) * {err}) * {gamma}" for k, n in enumerate("ab"))
    fold = _fold("a, b, r", f"{u[0]!r}; {u[1]!r}; 0", _SEEN, step + "; 0")
    return f"SELECT id, round(CAST(v.a AS DOUBLE), 4) AS f1, round(CAST(v.b AS DOUBLE), 4) AS f2 FROM (SELECT user_id AS id, {fold} AS v FROM ({RATINGS}) GROUP BY user_id)"


@query(_sgd_sql())
def sgd_user_step(spark, d):
    """Users after they went through all their ratings once, with two factors."""
    users = factorization.sgd(whole_ratings(spark, d), dim=2, iterations=3, seed=0)[0]
    return rounded(
        users.select("id", F.col("factors")[0].cast("double").alias("f1"), F.col("factors")[1].cast("double").alias("f2")),
        "f1", "f2", digits=4,
    )


def _svdpp_sql() -> str:
    draws = JavaRandom(0)
    x = [float(factorization.SCALE * draws.next_float()) for _ in range(2)]
    p, bu = x, float(draws.next_float())
    draws = JavaRandom(0)
    x = [float(factorization.SCALE * draws.next_float()) for _ in range(4)]
    (q, y), bi = (x[::2], x[1::2]), float(draws.next_float())
    f = lambda v: f"CAST({v!r} AS FLOAT)"
    guess = f"s.m + s.base + {f(bi)} + ({f(q[0])} * (s.p1 + s.s1) + {f(q[1])} * (s.p2 + s.s2))"
    err = f"(greatest(CAST(0 AS FLOAT), least(CAST(5 AS FLOAT), {guess})) - x.r)"
    step = f"s.base + {f(0.005)} * ({err} - {f(0.01)} * s.base); "
    step += "; ".join(f"s.p{k + 1} + (s.p{k + 1} * -{f(0.00005)} + {f(q[k])} * ({err} * {f(0.005)}))" for k in (0, 1))
    fold = _fold(
        "base, p1, p2, s1, s2, m, r",
        f"{bu!r}; {p[0]!r}; {p[1]!r}; sqrt(count(*)) * {y[0]!r}; sqrt(count(*)) * {y[1]!r}; any_value(m); 0", _SEEN,
        step + "; s.s1; s.s2; s.m; 0",
    )
    return (
        f"WITH r AS ({RATINGS}), m AS (SELECT sum(CAST(rating AS DOUBLE)) / (2 * count(*)) AS m FROM r)"
        " SELECT id, round(CAST(v.base AS DOUBLE), 3) AS baseline, round(CAST(v.p1 AS DOUBLE), 3) AS f1, round(CAST(v.p2 AS DOUBLE), 3) AS f2"
        f" FROM (SELECT user_id AS id, {fold} AS v FROM r, m GROUP BY user_id)"
    )


@query(_svdpp_sql())
def svdpp_user_step(spark, d):
    users = factorization.svdpp(whole_ratings(spark, d), dim=2, iterations=3, seed=0)[0]
    out = users.select(
        "id", F.col("baseline").cast("double").alias("baseline"), F.col("factors")[0].cast("double").alias("f1"),
        F.col("factors")[1].cast("double").alias("f2"),
    )
    return rounded(out, "baseline", "f1", "f2", digits=3)


# Summaries


class LatestComponents(summaries.ConnectedComponents):
    """Components of the last window alone."""

    transient = True


@query(
    f"WITH {S}, w AS (SELECT *, time_bucket(INTERVAL 10 day, ts, TIMESTAMP '1970-01-01') AS w FROM s), x AS (SELECT src, dst FROM w WHERE w = (SELECT max(w) FROM w)),"
    " u AS (SELECT src AS a, dst AS b FROM x UNION SELECT dst, src FROM x), "
    + _rounds("SELECT DISTINCT a AS id, a AS n FROM u", 20, SPREAD)
    + f" SELECT id, n AS component FROM r20 WHERE {_settled(20)}"
)
def transient_components(spark, d):
    return LatestComponents().over(datasets.event_edges(spark, d), window="10 days").select("id", "component")
