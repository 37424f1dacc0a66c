import pytest
from pyspark.sql import functions as F

from arcfold.graph import BOTH, IN, OUT, Graph
from arcfold.sources import generators, logs, text
from tests.graphs import E7, ll5, pairs


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "value").collect())


def test_degrees_and_isolated_vertices(spark):
    g = ll5(spark)
    assert pairs(g.out_degrees(), "id", "degree") == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1}
    assert pairs(g.in_degrees(), "id", "degree") == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2}
    lone = Graph(g.vertices.unionByName(spark.createDataFrame([(9, 9)], "id long, value long")), g.edges)
    assert pairs(lone.out_degrees(), "id", "degree")[9] == 0
    assert pairs(lone.group_reduce_on_edges(lambda v, e: F.size(e)))[9] == 0


def test_undirected_keeps_own_values(spark):
    g = ll5(spark)
    assert rows(g.undirected().edges) == sorted([*E7, *((b, a, v) for a, b, v in E7)])
    two = Graph(g.vertices, spark.createDataFrame([(1, 2, 5), (2, 1, 7), (3, 3, 1)], "src long, dst long, value long"))
    assert rows(two.undirected().edges) == [(1, 2, 5), (2, 1, 7), (3, 3, 1)]


def test_filters(spark):
    g = ll5(spark)
    assert rows(g.subgraph(lambda i, v: v > 2, lambda s, t, v: v > 34).edges) == [(3, 5, 35), (4, 5, 45)]
    f = g.filter_on_vertices(lambda i, v: v > 2)
    assert rows(f.edges) == [(3, 4, 34), (3, 5, 35), (4, 5, 45)] and f.vertices.count() == 3
    assert rows(g.filter_on_edges(lambda s, t, v: v > 34).edges) == [(3, 5, 35), (4, 5, 45), (5, 1, 51)]


def test_maps_and_joins(spark):
    g = ll5(spark)
    assert pairs(g.join_with_vertices(g.vertices, lambda a, b: a + b).vertices) == {i: 2 * i for i in range(1, 6)}
    assert pairs(g.join_with_vertices(g.vertices.where("id < 3"), lambda a, b: a + b).vertices) == {1: 2, 2: 4, 3: 3, 4: 4, 5: 5}
    assert rows(g.join_with_edges_on_source(g.vertices.where("id = 3"), lambda a, b: a + b).edges)[3:5] == [(3, 4, 37), (3, 5, 38)]
    assert (5, 1, 52) in rows(g.join_with_edges_on_target(g.vertices.where("id = 1"), lambda a, b: a + b).edges)
    assert rows(g.join_with_edges(g.edges, lambda a, b: a - b).edges) == [(a, b, 0) for a, b, _ in E7]
    assert g.map_vertices(lambda i, v: F.concat(i.cast("string"), v.cast("string"))).types["vertex"] == "string"
    assert rows(g.map_edges(lambda s, t, v: s + t + v).edges) == [(a, b, a + b + v) for a, b, v in E7]


def test_reductions(spark):
    g = ll5(spark)
    nearest = lambda v, e: F.array_min(F.transform(e, lambda x: F.struct(x["value"], x["dst"])))["dst"]
    assert pairs(g.group_reduce_on_edges(nearest)) == {1: 2, 2: 3, 3: 4, 4: 5, 5: 1}
    assert pairs(g.reduce_on_edges("min")) == pairs(g.reduce_on_edges(lambda a, b: F.least(a, b))) == {1: 12, 2: 23, 3: 34, 4: 45, 5: 51}
    want = {1: 5, 2: 3, 3: 9, 4: 5, 5: 1}
    total = lambda v, n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x["neighbor"])
    assert pairs(g.group_reduce_on_neighbors(total)) == pairs(g.reduce_on_neighbors("sum")) == want
    assert pairs(g.aggregate_neighbors(lambda v, n: F.sum(n), IN)) == {1: 5, 2: 1, 3: 3, 4: 3, 5: 7}
    for f in (lambda: g.reduce_on_edges("min", BOTH), lambda: g.group_reduce_on_neighbors(total, BOTH)):
        with pytest.raises(NotImplementedError):
            f()
    assert {r["id"]: len(r["edges"]) for r in g.edges_grouped_by_target().collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2}
    assert g.edges_by_source().count() == g.edges_by_target().count() == 7 and OUT == "OUT"


def test_schema_is_checked(spark):
    g = ll5(spark)
    with pytest.raises(ValueError):
        Graph(g.vertices.drop("value"), g.edges)
    with pytest.raises(TypeError):
        Graph(g.vertices.withColumn("id", F.col("id").cast("string")), g.edges)


def test_generators(spark):
    assert generators.complete_graph(spark, 5).edges.count() == 20 and generators.complete_graph(spark, 0).edges.count() == 0
    g = generators.grid_graph(spark, 3, 4)
    assert g.edges.count() == 17 and tuple(g.vertices.where("id = 6").first()["value"]) == (1, 2)
    assert rows(generators.star_graph(spark, 4).edges) == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]


def test_text(spark, tmp_path):
    (tmp_path / "v").write_text("1 10\n2 20\n 3\n")
    (tmp_path / "e").write_text("1 2 0.5\n2\t3 1\n3 1\n")
    assert pairs(text.read_vertices(spark, str(tmp_path / "v"))) == {1: 10, 2: 20, 3: None}
    assert sorted(tuple(r) for r in text.read_edges(spark, str(tmp_path / "e"), "long", "double").collect()) == [(1, 2, 0.5), (2, 3, 1.0), (3, 1, None)]
    r = text.read_ratings(spark, str(tmp_path / "e")).first()
    assert tuple(r["src"]) == (0, 1) and tuple(r["dst"]) == (1, 2)
    shown = text.read_ratings(spark, str(tmp_path / "e")).select(text.show_rating_id(F.col("dst")).alias("k"))
    assert shown.first()["k"] == "(2, 1)" and tuple(shown.select(text.parse_rating_id(F.col("k")).alias("i")).first()["i"]) == (1, 2)
    text.write_vertices(spark.createDataFrame([(1, 2)], "id long, value long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1 2"
    (tmp_path / "bad").write_text("x 1\n")
    with pytest.raises(Exception, match="CAST"):
        text.read_vertices(spark, str(tmp_path / "bad")).collect()


def test_logs(spark, tmp_path):
    log = logs.table_from_collection(spark, [(1, "a", 1), (1, "b", 3), (2, "c", 2), (2, None, 4)], "id long, value string, offset long")
    logs.write_log(log, str(tmp_path / "log"))
    assert pairs(logs.latest(logs.read_log(spark, str(tmp_path / "log")), ["id"])) == {1: "b"}
    assert logs.stream_log(spark, str(tmp_path / "log"), log.schema).isStreaming
    assert [r["id"] for r in logs.sorted_rows(log.select("id").distinct())] == [1, 2]


def test_functions_over_frames_are_called_by_buckets(spark):
    """With nulls in one vertex's rows the others keep whole numbers; a task is handed many vertices at once."""
    import pandas as pd

    vertices = spark.createDataFrame([(i, None if i == 7 else i) for i in range(2000)], "id long, value long")
    e = spark.createDataFrame([(i, j, None if j == 5 else (1 << 60) + j) for i in range(0, 2000, 2) for j in (3, i % 2, 5 if i == 8 else 4)], "src long, dst long, value long")

    def seen(vertex, edges):
        rows = list(edges["value"])
        edges["dst"] = 0
        return pd.DataFrame({"id": vertex["id"], "own": [str(vertex["value"][0])], "n": [len(edges)], "rows": [",".join(map(str, rows))]})

    out = Graph(vertices, e).group_apply_on_edges(seen, "id long, own string, n long, rows string")
    got = {r["id"]: (r["own"], r["n"], r["rows"]) for r in out.collect()}
    big = 1 << 60
    assert len(got) == 2000 and got[1] == ("1", 0, "") and got[7] == ("nan", 0, "")
    assert got[10] == ("10", 3, f"{big},{big + 3},{big + 4}")
    assert got[8] == ("8", 3, f"{float(big)},{float(big)},nan")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "REPARTITION_BY_NUM" in plan
