"""The registered queries of the graph operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.graph import IN, OUT, Graph
from arcfold.operators import basic, clustering, components, factorization, matching, ranking, traversal
from arcfold.operators.aggregators import DOUBLE_SUM, LONG_MAX_OF, LONG_SUM
from arcfold.operators.pregel import Master, Vertex, VertexProgram, pregel
from arcfold.sources import datasets, generators
from arcfold.streaming import summaries
from arcfold.streaming.edge_stream import EdgeStream
from arcfold.streaming.runner import drained

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The order graph and its vertices as SQL views.
V = "v AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS value FROM customer)"
E = (
    "e AS (SELECT src, dst, min(p) AS value FROM (SELECT CAST(o_custkey AS BIGINT) AS src, CAST((o_orderkey * 7 + 3) % (SELECT count(*)"
    " FROM customer) AS BIGINT) AS dst, o_totalprice AS p FROM orders) WHERE src <> dst GROUP BY src, dst)"
)
S = "s AS (SELECT CAST(user_id AS BIGINT) AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, value, ts, event_id AS seq FROM events)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return datasets.order_graph(spark, sf_dir)


def trust_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The order graph both ways; one customer in 50 is trusted."""
    return graph(spark, sf_dir).undirected().map_vertices(lambda i, v: F.struct(F.lit(0.0).alias("rank"), (i % 50 == 0).alias("trusted")))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Tables

@query(f"WITH {V}, {E} SELECT id, count(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id")
def out_degrees(spark, d):
    return graph(spark, d).out_degrees()


@query(f"WITH {V}, {E} SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id")
def in_degrees(spark, d):
    return graph(spark, d).in_degrees()


@query(f"WITH {E} SELECT src, dst, value FROM e UNION ALL SELECT a.dst, a.src, a.value FROM e a ANTI JOIN e b ON a.src = b.dst AND a.dst = b.src")
def undirected(spark, d):
    return graph(spark, d).undirected().edges


@query(f"WITH {E} SELECT src, dst, value FROM e WHERE src % 3 > 0 AND dst % 3 > 0 AND value > 50000")
def subgraph(spark, d):
    return graph(spark, d).subgraph(lambda i, v: v % 3 > 0, lambda s, t, v: v > 50000).edges


@query(f"WITH {E} SELECT src, dst, value FROM e WHERE src % 7 = 1 AND dst % 7 = 1")
def filter_on_vertices(spark, d):
    return graph(spark, d).filter_on_vertices(lambda i, v: v % 7 == 1).edges


@query(f"WITH {E} SELECT src, dst, value FROM e WHERE value > 100000")
def filter_on_edges(spark, d):
    return graph(spark, d).filter_on_edges(lambda s, t, v: v > 100000).edges


@query(f"WITH {V} SELECT id, id * 2 + value AS value FROM v")
def map_vertices(spark, d):
    return graph(spark, d).map_vertices(lambda i, v: i * 2 + v).vertices


@query(f"WITH {E} SELECT src, dst, value / 100 + src AS value FROM e")
def map_edges(spark, d):
    return graph(spark, d).map_edges(lambda s, t, v: v / 100 + s).edges


@query(
    f"WITH {V}, t AS (SELECT n_nationkey AS id, n_regionkey AS r FROM nation) SELECT v.id,"
    f" CASE WHEN t.id IS NULL THEN value ELSE value + r END AS value FROM v LEFT JOIN t ON t.id = v.id"
)
def join_with_vertices(spark, d):
    t = datasets.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("value"))
    return graph(spark, d).join_with_vertices(t, lambda a, b: a + b).vertices


@query(f"WITH {E} SELECT src, dst, CASE WHEN src % 2 = 0 THEN value + src ELSE value END AS value FROM e")
def join_with_edges(spark, d):
    g = graph(spark, d)
    return g.join_with_edges(g.edges.where("src % 2 = 0").select("src", "dst", F.col("src").cast("double").alias("value")), lambda a, b: a + b).edges


@query(f"WITH {E} SELECT src, dst, CASE WHEN src % 2 = 0 THEN value + src ELSE value END AS value FROM e")
def join_with_edges_on_source(spark, d):
    g = graph(spark, d)
    return g.join_with_edges_on_source(g.vertices.where("id % 2 = 0"), lambda a, b: a + b).edges


@query(f"WITH {E} SELECT src, dst, CASE WHEN dst % 2 = 0 THEN value + dst ELSE value END AS value FROM e")
def join_with_edges_on_target(spark, d):
    g = graph(spark, d)
    return g.join_with_edges_on_target(g.vertices.where("id % 2 = 0"), lambda a, b: a + b).edges


@query(f"WITH {V}, {E} SELECT id, arg_min(dst, (e.value, dst)) AS value FROM v LEFT JOIN e ON src = id GROUP BY id")
def group_reduce_on_edges(spark, d):
    return graph(spark, d).aggregate_edges(lambda s, t, v: F.min_by(t, F.struct(v, t)))


@query(f"WITH {V}, {E} SELECT id, count(src) AS value FROM v LEFT JOIN e ON dst = id AND src > id GROUP BY id")
def group_reduce_on_edges_in(spark, d):
    return graph(spark, d).group_reduce_on_edges(lambda v, edges: F.size(F.filter(edges, lambda e: e["src"] > v)).cast("long"), IN)


@query(f"WITH {E} SELECT src AS id, min(value) AS value FROM e GROUP BY src")
def reduce_on_edges(spark, d):
    return graph(spark, d).reduce_on_edges("min", OUT)


@query(f"WITH {E} SELECT dst AS id, max(value) AS value FROM e GROUP BY dst")
def reduce_on_edges_in(spark, d):
    return graph(spark, d).reduce_on_edges(lambda a, b: F.greatest(a, b), IN)


@query(f"WITH {V}, {E} SELECT id, CAST(coalesce(sum(dst), 0) AS BIGINT) AS value FROM v LEFT JOIN e ON src = id GROUP BY id")
def group_reduce_on_neighbors(spark, d):
    return graph(spark, d).aggregate_neighbors(lambda v, n: F.sum(n), OUT, lambda v, a: F.coalesce(a, F.lit(0)))


@query(f"WITH {V}, {E} SELECT id, CAST(coalesce(max(src), -1) AS BIGINT) AS value FROM v LEFT JOIN e ON dst = id GROUP BY id")
def group_reduce_on_neighbors_in(spark, d):
    return graph(spark, d).group_reduce_on_neighbors(
        lambda v, n: F.coalesce(F.array_max(F.transform(n, lambda x: x["neighbor"])), F.lit(-1).cast("long")), IN,
    )


@query(f"WITH {E} SELECT src AS id, CAST(sum(dst) AS BIGINT) AS value FROM e GROUP BY src")
def reduce_on_neighbors(spark, d):
    return graph(spark, d).reduce_on_neighbors("sum", OUT)


@query(f"WITH {E} SELECT src AS id, count(*) AS n FROM e GROUP BY src")
def edges_grouped_by_source(spark, d):
    return graph(spark, d).edges_grouped_by_source().select("id", F.size("edges").cast("long").alias("n"))


@query(f"WITH {E} SELECT dst AS id, count(*) AS n FROM e GROUP BY dst")
def edges_grouped_by_target(spark, d):
    return graph(spark, d).edges_grouped_by_target().select("id", F.size("edges").cast("long").alias("n"))


@query(f"WITH {E} SELECT id, id + 1 AS value FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)")
def from_edges(spark, d):
    return Graph.from_edges(graph(spark, d).edges, lambda i: i + 1).vertices


@query("SELECT a AS src, b AS dst, CAST(1 AS BIGINT) AS value FROM range(25) x(a), range(25) y(b) WHERE a <> b")
def complete_graph(spark, d):
    return generators.complete_graph(spark, 25).edges


@query(
    "SELECT i AS src, i + s AS dst, CAST(1 AS BIGINT) AS value FROM range(100) x(i), (VALUES (10), (1)) y(s) WHERE"
    " CASE s WHEN 10 THEN i < 90 ELSE i % 10 < 9 END"
)
def grid_graph(spark, d):
    return generators.grid_graph(spark, 10, 10).edges


@query("SELECT i AS src, CAST(0 AS BIGINT) AS dst, CAST(1 AS BIGINT) AS value FROM range(1, 100) x(i)")
def star_graph(spark, d):
    return generators.star_graph(spark, 100).edges


# Algorithms

@query(f"WITH {V} SELECT count(*) AS count FROM v")
def vertex_count(spark, d):
    return basic.vertex_count(graph(spark, d))


@query(f"WITH {E} SELECT count(*) AS count FROM e")
def edge_count(spark, d):
    return basic.edge_count(graph(spark, d))


@query(
    f"WITH RECURSIVE {V}, {E}, b AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS n UNION SELECT e.dst, b.n + 1 FROM b"
    f" JOIN e ON e.src = b.id WHERE b.n < 12) SELECT v.id, coalesce(min(n), 9223372036854775807) AS value FROM v LEFT JOIN b ON b.id = v.id"
    f" GROUP BY v.id"
)
def bfs(spark, d):
    return traversal.bfs(graph(spark, d), 0)


def _rounds(start: str, rounds: int, step: str) -> str:
    """Unrolled rounds of relaxation."""
    out = [f"r0 AS ({start})"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS ({step.format(p=f'r{i - 1}')})")
    return ", ".join(out)


def _settled(rounds: int) -> str:
    """A condition that holds if the last round changed nothing, and raises otherwise."""
    more = f"SELECT * FROM r{rounds} EXCEPT SELECT * FROM r{rounds - 1}"
    return f"(SELECT CASE WHEN count(*) > 0 THEN error('more rounds are needed') ELSE true END FROM ({more}))"


@query(f"WITH {V}, {E}, " + _rounds("SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS n", 30,
    "SELECT id, min(n) AS n FROM (SELECT id, n FROM {p} UNION ALL SELECT e.dst, p.n + e.value FROM {p} p JOIN e ON e.src = p.id) GROUP BY id") +
    " SELECT v.id, round(coalesce(n, CAST('inf' AS DOUBLE)), 6) AS value FROM v LEFT JOIN r30 ON r30.id = v.id WHERE " + _settled(30))
def sssp(spark, d):
    return rounded(traversal.sssp(graph(spark, d), 0), "value")


@query(f"WITH {V}, {E}, " + _rounds(
    "SELECT id, id AS landmark, CAST(0 AS DOUBLE) AS n FROM v WHERE id IN (0, 5, 17)", 30,
    "SELECT id, landmark, min(n) AS n FROM (SELECT id, landmark, n FROM {p} UNION ALL SELECT e.dst, p.landmark, p.n + e.value FROM {p} p"
    " JOIN e ON e.src = p.id) GROUP BY id, landmark") +
    " SELECT v.id, l.landmark, round(coalesce(n, CAST('inf' AS DOUBLE)), 6) AS value FROM v CROSS"
    " JOIN (VALUES (CAST(0 AS BIGINT)), (5), (17)) l(landmark) LEFT JOIN r30 ON r30.id = v.id AND r30.landmark = l.landmark WHERE " + _settled(30))
def mssp(spark, d):
    return rounded(traversal.mssp(graph(spark, d), [0, 5, 17]), "value")


#: Smallest ids spread over the pairs (a, b) of u.
SPREAD = "SELECT id, min(n) AS n FROM (SELECT id, n FROM {p} UNION ALL SELECT u.b, p.n FROM {p} p JOIN u ON u.a = p.id) GROUP BY id"
WCC = (
    f"WITH {V}, {E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), "
    + _rounds("SELECT id, id AS n FROM v", 20, SPREAD)
    + f" SELECT id, n AS value FROM r20 WHERE {_settled(20)}"
)


@query(WCC)
def wcc(spark, d):
    return components.wcc(graph(spark, d))


LP = (
    "SELECT x.id, greatest(x.n, coalesce(m.n, x.n)) AS n FROM {p} x LEFT JOIN (SELECT id, arg_max(n, (c, n)) AS n"
    " FROM (SELECT e.dst AS id, p.n AS n, count(*) AS c FROM {p} p JOIN e ON e.src = p.id GROUP BY e.dst, p.n) GROUP BY id) m ON m.id = x.id"
)


@query(f"WITH {V}, {E}, " + _rounds("SELECT id, id AS n FROM v", 5, LP) + " SELECT id, n AS value FROM r5")
def label_propagation(spark, d):
    return components.label_propagation(graph(spark, d), 5)


PR = (
    "SELECT x.id, x.r + 0.85 * coalesce(m.s, 0) AS r, CASE WHEN m.s IS NULL THEN x.t ELSE x.r + 0.85 * m.s - x.r END AS t, m.s IS NOT NULL AS"
    " moved FROM {p} x LEFT JOIN (SELECT e.dst AS id, sum(p.t / g.n) AS s FROM {p} p JOIN e ON e.src = p.id JOIN g ON g.src = p.id"
    " WHERE p.moved AND p.t > 0.0001 GROUP BY e.dst) m ON m.id = x.id"
)
DEG = "g AS (SELECT src, count(*) AS n FROM e GROUP BY src)"


@query(f"WITH {V}, {E}, {DEG}, " + _rounds(
    "SELECT id, 0.15::DOUBLE AS r, 0.15::DOUBLE AS t, true AS moved FROM v", 9, PR) + " SELECT id, round(r, 6) AS rank FROM r9"
)
def pagerank(spark, d):
    return rounded(ranking.pagerank(graph(spark, d), 10, tolerance=0.0001, reset_probability=0.15).select("id", "rank"), "rank")


@query(f"WITH {V}, {E}, {DEG}, " + _rounds(
    "SELECT id, CASE id WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS r, CASE id WHEN 3 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS t, true AS moved"
    " FROM v", 5, PR.replace("sum(p.t / g.n)", "sum(CASE WHEN isinf(p.t) THEN 1.0 ELSE p.t END / g.n)")) + " SELECT id, round(r, 6) AS rank FROM r5"
)
def pagerank_personalized(spark, d):
    out = ranking.pagerank(graph(spark, d), 6, tolerance=0.0001, reset_probability=0.15, source=3)
    return rounded(out.select("id", "rank"), "rank")


@query(
    f"WITH {V}, {E}, n AS (SELECT src AS id, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT id, count(*) AS k FROM n"
    f" GROUP BY id), m AS (SELECT n.id, count(*) AS m FROM n JOIN e ON e.src = n.b JOIN n z ON z.id = n.id AND z.b = e.dst GROUP BY n.id)"
    f" SELECT v.id, round(CASE WHEN coalesce(k, 0) < 2 THEN 0 ELSE coalesce(m, 0)::DOUBLE / k / (k - 1) END, 6) AS value FROM v LEFT"
    f" JOIN c ON c.id = v.id LEFT JOIN m ON m.id = v.id"
)
def clustering_coefficient(spark, d):
    return rounded(basic.clustering_coefficient(graph(spark, d)), "value")


UNDIRECTED = "u AS (SELECT src, dst, value FROM e UNION ALL SELECT a.dst, a.src, a.value FROM e a ANTI JOIN e b ON a.src = b.dst AND a.dst = b.src)"


def _sybil_sql(most: int = 9) -> str:
    """As many steps as the logarithm of the vertices asks for, up to `most`."""
    step = (
        "SELECT x.id, CASE WHEN {i} <= k.steps THEN coalesce(s, 0) ELSE x.r END AS r FROM r{p} x CROSS JOIN k LEFT JOIN"
        " (SELECT e.dst AS id, sum(p.r * e.value / g.d) AS s FROM r{p} p JOIN u e ON e.src = p.id JOIN g ON g.src = p.id GROUP BY e.dst) m ON m.id = x.id"
    )
    rounds = ", ".join(f"r{i} AS ({step.format(i=i, p=i - 1)})" for i in range(1, most + 1))
    return (
        f"WITH {V}, {E}, {UNDIRECTED}, g AS (SELECT src, sum(value) AS d FROM u GROUP BY src),"
        " k AS (SELECT count(*)::DOUBLE / count(*) FILTER (WHERE id % 50 = 0) AS t, greatest(1, ceil(log10(count(*)))) AS steps FROM v),"
        f" r0 AS (SELECT id, CASE WHEN id % 50 = 0 THEN t ELSE 0 END AS r FROM v, k), {rounds}"
        f" SELECT r{most}.id, round(r / d * 1000, 6) AS rank, r{most}.id % 50 = 0 AS trusted FROM r{most} LEFT JOIN g ON g.src = r{most}.id"
    )


@query(_sybil_sql())
def sybilrank(spark, d):
    return rounded(ranking.sybilrank(trust_graph(spark, d)).withColumn("rank", F.col("rank") * 1000), "rank")


@query(f"WITH {E} SELECT src, dst, value FROM e UNION ALL SELECT a.dst, a.src, a.value FROM e a ANTI JOIN e b ON a.src = b.dst AND a.dst = b.src")
def reverse_edges(spark, d):
    return basic.reverse_edges(graph(spark, d)).edges


@query(
    f"WITH {E}, {UNDIRECTED}, c AS (SELECT src, count(*) AS n FROM u GROUP BY src), i AS (SELECT a.src, b.src AS dst, count(*) AS i FROM u a"
    f" JOIN u b ON a.dst = b.dst GROUP BY ALL) SELECT u.src, u.dst, round(coalesce(i, 0)::DOUBLE / (x.n + y.n - coalesce(i, 0)), 6) AS value"
    f" FROM u JOIN c x ON x.src = u.src JOIN c y ON y.src = u.dst LEFT JOIN i ON i.src = u.src AND i.dst = u.dst"
)
def jaccard_similarity(spark, d):
    return rounded(basic.jaccard(graph(spark, d).undirected()), "value")


@query(
    f"WITH {E}, g AS (SELECT src, ln(1.0 / count(*)) AS w FROM e GROUP BY src), s AS (SELECT e.src, e.dst, sum(w) AS s FROM e"
    f" JOIN e a ON a.dst = e.src JOIN e b ON b.dst = e.dst AND b.src = a.src JOIN g ON g.src = a.src GROUP BY ALL)"
    f" SELECT e.src, e.dst, round(coalesce(s, 0), 6) AS value FROM e LEFT JOIN s ON s.src = e.src AND s.dst = e.dst"
)
def adamic_adar(spark, d):
    return rounded(basic.adamic_adar(graph(spark, d).map_edges(lambda s, t, v: F.lit(0.0)))[1], "value")


@query(
    f"WITH {E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM u x"
    f" JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS count FROM (SELECT unnest([i, j, k, -1]) AS id FROM t)"
    f" GROUP BY id"
)
def triangle_count(spark, d):
    return basic.triangles(graph(spark, d).edges)


def _matching_rounds(n: int) -> str:
    """Unrolled rounds of proposals; rounds after the last match change nothing."""
    out = ["l0 AS MATERIALIZED (SELECT * FROM u)", "o0 AS MATERIALIZED (SELECT id, id % 3 AS room FROM v)"]
    for i in range(n):
        out += [
            f"a{i} AS MATERIALIZED (SELECT l.*, x.room FROM l{i} l JOIN o{i} x ON x.id = l.src JOIN o{i} y ON y.id = l.dst WHERE x.room > 0 AND y.room > 0)",
            f"w{i} AS MATERIALIZED (SELECT src, dst, value FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst DESC) AS k FROM a{i}) WHERE k <= room)",
            f"m{i} AS MATERIALIZED (SELECT a.* FROM w{i} a SEMI JOIN w{i} b ON a.src = b.dst AND a.dst = b.src)",
            f"l{i + 1} AS MATERIALIZED (SELECT a.src, a.dst, a.value FROM a{i} a ANTI JOIN m{i} m ON a.src = m.src AND a.dst = m.dst)",
            f"o{i + 1} AS MATERIALIZED (SELECT o.id, o.room - coalesce(n, 0) AS room FROM o{i} o LEFT JOIN (SELECT src, count(*) AS n FROM m{i} GROUP BY src) c ON c.src = o.id)",
        ]
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(n))


@query(f"WITH {V}, {E}, {UNDIRECTED}, " + _matching_rounds(24))
def b_matching(spark, d):
    g = graph(spark, d).undirected().map_vertices(lambda i, v: (i % 3).cast("int"))
    return matching.b_matching(g)


KM = (
    "SELECT cluster, list(m ORDER BY k) AS c FROM (SELECT cluster, k, avg(p[k]) AS m FROM (SELECT a.cluster, x.p, unnest(range(1, 65)) AS k"
    " FROM x JOIN (SELECT x.id, arg_min(r.cluster, (list_distance(x.p, r.c), r.cluster)) AS cluster FROM x, {p} r"
    " GROUP BY x.id) a ON a.id = x.id) GROUP BY cluster, k) GROUP BY cluster"
)


@query(
    "WITH x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings), " + _rounds(
    "SELECT CAST(id AS INTEGER) AS cluster, p AS c FROM x WHERE id < 10", 3, KM) +
    " SELECT x.id, arg_min(r.cluster, (list_distance(x.p, r.c), r.cluster)) AS cluster FROM x, r3 r GROUP BY x.id"
)
def kmeans(spark, d):
    p = datasets.points(spark, d)
    first = [list(r[0]) for r in p.where("id < 10").orderBy("id").select("point").collect()]
    return clustering.kmeans(p, k=10, iterations=3, centers=first)[0]


@query(None)
def semi_clustering(spark, d):
    return clustering.semi_clusters(graph(spark, d).undirected().map_edges(lambda s, t, v: v / 100000))


@query(None)
def als(spark, d):
    return factorization.als(datasets.ratings(spark, d), dim=8, iterations=6, seed=0)[0]


@query(None)
def sgd(spark, d):
    return factorization.sgd(datasets.ratings(spark, d), dim=8, iterations=6, seed=0)[0]


@query(None)
def svdpp(spark, d):
    return factorization.svdpp(datasets.ratings(spark, d), dim=8, iterations=6, seed=0)[0]


class Reach(VertexProgram):
    """Hops from a source, as a vertex program."""

    vertex_type, edge_type, message_type = "long", "double", "long"
    combiner = "min"

    def __init__(self, source: int):
        self.source = source

    def compute(self, superstep: int, vertex: Vertex, messages: list) -> None:
        best = 0 if superstep == 0 and vertex.id == self.source else min(messages, default=None)
        if best is not None and best < vertex.value:
            vertex.set_value(best)
            for t in vertex.edges:
                vertex.send(t, best + 1)
        vertex.vote_to_halt()


@query(ORACLES["bfs"])
def pregel_bfs(spark, d):
    g = graph(spark, d).map_vertices(lambda i, v: F.lit(traversal.UNREACHED))
    return pregel(g, Reach(0)).result()


class Totals(VertexProgram):
    """Three supersteps that add up: vertices, edge values and the largest id, halted by the master."""

    vertex_type, edge_type, message_type = "long", "double", "long"

    def aggregators(self):
        return {"vertices": (LONG_SUM, True), "weight": (DOUBLE_SUM, False), "largest": (LONG_MAX_OF, True)}

    def master_compute(self, superstep: int, master: Master) -> None:
        if superstep == 3:
            master.halt()

    def compute(self, superstep: int, vertex: Vertex, messages: list) -> None:
        vertex.aggregate("vertices", 1)
        vertex.aggregate("weight", float(sum(vertex.edges.values())))
        vertex.aggregate("largest", int(vertex.id))


@query(
    f"WITH {V}, {E} SELECT 3 * (SELECT count(*) FROM v) AS vertices, round((SELECT sum(value) FROM e), 2) AS weight, (SELECT max(id)"
    f" FROM v) AS largest"
)
def pregel_aggregators(spark, d):
    a = pregel(graph(spark, d), Totals()).aggregates
    return spark.createDataFrame([(a["vertices"], round(a["weight"], 2), a["largest"])], "vertices long, weight double, largest long")


# Streams

def stream(spark: SparkSession, sf_dir: str) -> EdgeStream:
    """The events as a stream of edges."""
    return EdgeStream(datasets.as_edges(datasets.stream_table(spark, sf_dir, "events")))


@query("SELECT count(*) AS count FROM events")
def stream_number_of_edges(spark, d):
    return drained(stream(spark, d).number_of_edges())


@query(f"WITH {S} SELECT count(*) AS count FROM (SELECT src FROM s UNION SELECT dst FROM s)")
def stream_number_of_vertices(spark, d):
    return drained(stream(spark, d).number_of_vertices(), "update")


@query(f"WITH {S} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id")
def stream_degrees(spark, d):
    return drained(stream(spark, d).degrees())


@query(f"WITH {S} SELECT src AS id, count(*) AS degree FROM s GROUP BY src")
def stream_out_degrees(spark, d):
    return drained(stream(spark, d).out_degrees())


@query(f"WITH {S} SELECT dst AS id, count(*) AS degree FROM s GROUP BY dst")
def stream_in_degrees(spark, d):
    return drained(stream(spark, d).in_degrees())


@query(f"WITH {S} SELECT DISTINCT id FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s)")
def stream_vertices(spark, d):
    return drained(stream(spark, d).vertices(), "append")


@query(f"WITH {S} SELECT dst + 1 AS src, src AS dst, value * 2 AS value FROM s WHERE value > 50 AND src > 10 AND dst > 10")
def stream_transforms(spark, d):
    x = stream(spark, d).filter_edges(lambda s, t, v: v > 50).filter_vertices(lambda i: i > 10).reverse()
    return drained(x.map_edges(lambda s, t, v: (s + 1, t, v * 2)).edges.select("src", "dst", "value"), "append")


@query(f"WITH {S} SELECT src AS id, count(*) AS degree FROM (SELECT src FROM s UNION ALL SELECT dst FROM s UNION ALL SELECT src FROM s) GROUP BY src")
def stream_union_undirected(spark, d):
    x = stream(spark, d)
    return drained(x.undirected().union(x).out_degrees())


@query(f"WITH {S} SELECT DISTINCT src, dst FROM s")
def stream_distinct(spark, d):
    x = EdgeStream(stream(spark, d).edges, "3650 days")
    return drained(x.distinct().edges.select("src", "dst"), "append")


@query(f"WITH {S} SELECT id, round(sum(w), 4) AS value FROM (SELECT src AS id, value AS w FROM s UNION ALL SELECT dst, -value FROM s) GROUP BY id")
def stream_aggregate(spark, d):
    pair = lambda i, v: F.struct(i.alias("id"), v.alias("value"))
    return rounded(drained(stream(spark, d).aggregate(lambda s, t, v: F.array(pair(s, v), pair(t, -v)), F.sum)), "value", digits=4)


@query(f"WITH {S} SELECT max(greatest(src, dst)) AS value FROM s")
def stream_global_aggregate(spark, d):
    pair = lambda i, v: F.struct(i.alias("id"), v.alias("value"))
    return drained(stream(spark, d).global_aggregate(lambda s, t, v: F.array(pair(s, v), pair(t, v)), lambda i, v: F.max(i)))


@query(f"WITH {S} SELECT src AS id, array_to_string(list_sort(list(DISTINCT dst)), ',') AS neighbors FROM s GROUP BY src")
def stream_neighborhood(spark, d):
    return drained(stream(spark, d).build_neighborhood()).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH {S} SELECT time_bucket(INTERVAL 1 day, ts) AS start, src AS id, max(value) AS value FROM s GROUP BY ALL")
def stream_slice_reduce(spark, d):
    return drained(stream(spark, d).slice("1 day").reduce_on_edges("max")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "id", "value",
    )


@query(
    f"WITH {S}, h AS (SELECT unnest([time_bucket(INTERVAL 12 hour, ts), time_bucket(INTERVAL 12 hour, ts) - INTERVAL 12 hour]) AS start, dst AS"
    f" id, src AS nbr, ts, seq FROM s) SELECT start, id, string_agg(nbr::VARCHAR, ',' ORDER BY ts, seq) AS value FROM h GROUP BY start, id"
)
def stream_slice_fold(spark, d):
    w = stream(spark, d).slice("1 day", "12 hours", IN)
    joined = lambda a, r: F.when(a == "", r["neighbor"].cast("string")).otherwise(F.concat_ws(",", a, r["neighbor"].cast("string")))
    return drained(w.fold_neighbors(F.lit(""), joined, ["seq"])).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "id", "value")


STREAM_COMPONENTS = (
    f"WITH {S}, u AS (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s), "
    + _rounds("SELECT DISTINCT a AS id, a AS n FROM u", 20, SPREAD)
    + f" SELECT id, n AS component FROM r20 WHERE {_settled(20)}"
)


@query(STREAM_COMPONENTS)
def stream_components(spark, d):
    return summaries.ConnectedComponents().run(stream(spark, d)).select("id", "component")


#: Components of the double cover: each id twice, and each edge from either copy to the other one of its end. An odd
#: cycle joins both copies of an id.
STREAM_BIPARTITENESS = (
    f"WITH {S}, u AS (SELECT 2 * src AS a, 2 * dst + 1 AS b FROM s UNION SELECT 2 * src + 1, 2 * dst FROM s"
    " UNION SELECT 2 * dst + 1, 2 * src FROM s UNION SELECT 2 * dst, 2 * src + 1 FROM s), "
    + _rounds("SELECT DISTINCT a AS id, a AS n FROM u", 24, SPREAD)
    + ", x AS (SELECT id // 2 AS id, min(n) FILTER (WHERE id % 2 = 0) AS p, min(n) FILTER (WHERE id % 2 = 1) AS m FROM r24 GROUP BY id // 2),"
    " odd AS (SELECT coalesce(bool_or(p = m), false) AS odd FROM x)"
    " SELECT least(p, m) // 2 AS component, id, p < m AS sign, true AS bipartite FROM x, odd WHERE NOT odd"
    f" UNION ALL SELECT NULL, NULL, NULL, false FROM odd WHERE odd AND {_settled(24)}"
)


@query(STREAM_BIPARTITENESS)
def stream_bipartiteness(spark, d):
    return summaries.Bipartiteness().run(stream(spark, d))


@query(
    f"WITH {S}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM s"
    f" WHERE src <> dst), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b)"
    f" SELECT id, count(*) AS count FROM (SELECT unnest([i, j, k, -1]) AS id FROM t) GROUP BY id"
)
def stream_triangles(spark, d):
    return summaries.Triangles().run(stream(spark, d))


@query(None)
def stream_spanner(spark, d):
    return summaries.Spanner(3).run(stream(spark, d))
