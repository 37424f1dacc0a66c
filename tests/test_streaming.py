import datetime as dt

from pyspark.sql import functions as F

from arcfold.sources import logs
from arcfold.streaming.edge_stream import EdgeStream, changed
from arcfold.streaming.runner import drained
from arcfold.streaming.summaries import AdjacencyGraph, Bipartiteness, ConnectedComponents, DisjointSet, Spanner, Triangles

T0 = dt.datetime(2024, 1, 1)


def batch(spark, pairs):
    rows = [(a, b, float(i), T0 + dt.timedelta(minutes=i), i) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src long, dst long, value double, ts timestamp, seq long")


def stream(spark, tmp_path, pairs, per_batch=2):
    df = batch(spark, pairs)
    return EdgeStream(logs.stream_from_collection(
        spark, df.collect(), df.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "in"),
        per_batch=per_batch,
    ))


def test_running_aggregates(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 2), (1, 3), (1, 2), (2, 3)])
    assert drained(s.number_of_edges()).first()[0] == 4
    assert drained(s.number_of_vertices(), "update").first()[0] == 3
    assert {r["id"]: r["degree"] for r in drained(s.degrees()).collect()} == {1: 3, 2: 3, 3: 2}
    assert sorted(map(tuple, drained(s.distinct().edges.select("src", "dst"), "append").collect())) == [(1, 2), (1, 3), (2, 3)]
    assert {r["id"]: list(r["neighbors"]) for r in drained(s.build_neighborhood(False)).collect()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    fold = s.slice("2 minutes").fold_neighbors(F.lit(""), lambda a, r: F.concat(a, r["neighbor"].cast("string")))
    assert {(r["id"], r["window"]["start"].minute): r["value"] for r in drained(fold).collect()} == {(1, 0): "23", (1, 2): "2", (2, 2): "3"}
    both = drained(s.slice("10 minutes", direction="BOTH").reduce_on_edges("sum"))
    assert {r["id"]: r["value"] for r in both.collect()} == {1: 3.0, 2: 5.0, 3: 4.0}


def test_changed_rows_only(spark):
    seen = []
    f = changed(lambda df: seen.append(df.first()[0]))
    for i, v in enumerate([1, 1, 2, 2, 1]):
        f(spark.createDataFrame([(v,)], "value long"), i)
    assert seen == [1, 2, 1]


def test_components(spark, tmp_path):
    pairs = [(1, 2), (1, 3), (2, 3), (1, 5), (6, 7), (8, 9), (4, 4)]
    want = {1: 1, 2: 1, 3: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8, 4: 4}
    for got in (ConnectedComponents().run(stream(spark, tmp_path, pairs)), ConnectedComponents().over(batch(spark, pairs), window="2 minutes")):
        assert {r["id"]: r["component"] for r in got.collect()} == want


def test_bipartiteness(spark, tmp_path):
    got = Bipartiteness().run(stream(spark, tmp_path, [(1, 2), (1, 3), (1, 4), (4, 5), (4, 7), (4, 9)]))
    assert {r["id"]: r["sign"] for r in got.collect()} == {i: i in (1, 5, 7, 9) for i in (1, 2, 3, 4, 5, 7, 9)}
    for odd in ([(1, 2), (2, 3), (3, 1), (4, 5), (5, 7), (4, 1)], [(3, 5), (2, 5), (3, 4), (1, 4), (1, 2)], [(1, 1)]):
        (row,) = Bipartiteness().over(batch(spark, odd)).collect()
        assert tuple(row) == (None, None, None, False)


def test_triangles(spark, tmp_path):
    pairs = [(1, 2), (2, 3), (2, 6), (5, 6), (1, 4), (5, 3), (3, 4), (3, 6), (1, 3)]
    got = Triangles().run(stream(spark, tmp_path, pairs))
    assert {r["id"]: r["count"] for r in got.collect()} == {-1: 4, 1: 2, 2: 2, 3: 4, 4: 1, 5: 1, 6: 2}


def test_spanner(spark, tmp_path):
    pairs = [(1, 4), (4, 7), (7, 8), (4, 8), (4, 5), (5, 6), (2, 3), (3, 4), (3, 6), (8, 9), (6, 8), (5, 9)]
    want = {(1, 4), (4, 7), (7, 8), (4, 5), (5, 6), (2, 3), (3, 4), (8, 9), (6, 8)}
    for got in (Spanner(3).run(stream(spark, tmp_path, pairs, 5)), Spanner(3).over(batch(spark, pairs))):
        assert {(r["src"], r["dst"]) for r in got.collect()} == want


def test_summaries_go_on_after_a_restart(spark, tmp_path):
    schema = "src long, dst long, value double, ts timestamp, seq long"
    state, source = f"file://{tmp_path}/state", str(tmp_path / "in")
    for k, (pairs, want) in enumerate([
        ([(1, 2), (3, 4)], {1: 1, 2: 1, 3: 3, 4: 3}), ([(4, 2), (5, 6)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}),
        ([], {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}),
    ]):
        if pairs:
            batch(spark, pairs).coalesce(1).write.mode("append").parquet(source)
        edges = EdgeStream(spark.readStream.schema(schema).parquet(source))
        got = ConnectedComponents().run(edges, state)
        assert {r["id"]: r["component"] for r in got.collect()} == want, k


class Latest(ConnectedComponents):
    transient = True


def test_transient_summaries_forget(spark, tmp_path):
    pairs = [(1, 2), (2, 3), (3, 4), (7, 8)]
    assert {r["id"]: r["component"] for r in Latest().run(stream(spark, tmp_path, pairs)).collect()} == {3: 3, 4: 3, 7: 7, 8: 7}
    assert {r["id"] for r in Latest().over(batch(spark, pairs), window="2 minutes").collect()} == {3, 4, 7, 8}


def test_disjoint_set_and_bounded_search():
    d, e = DisjointSet(), DisjointSet()
    for i in range(8):
        d.union(i, i + 2)
        e.union(i, i + 100)
    assert (d.size(), len(d.roots()), d.find(99)) == (10, 2, None)
    d.merge(e)
    assert (d.size(), len(d.roots())) == (18, 2)
    g = AdjacencyGraph()
    for a, b in [(1, 4), (4, 5), (5, 6), (4, 7), (7, 8)]:
        g.add_edge(a, b)
    kept = []
    for a, b in [(2, 3), (3, 4), (3, 6), (8, 9), (8, 6), (5, 9)]:
        if not g.within(a, b, 3):
            g.add_edge(a, b)
            kept.append((a, b))
    assert kept == [(2, 3), (3, 4), (8, 9), (8, 6)]


def test_bounded_search_does_not_walk_a_hubs_neighbours():
    class Counted(dict):
        looked = 0

        def __getitem__(self, key):
            self.looked += 1
            return super().__getitem__(key)

    g = AdjacencyGraph()
    for leaf in range(2, 3000):
        g.add_edge(leaf % 2, leaf)
    g.add_edge(0, 3)
    g.near = Counted(g.near)
    assert all(g.within(leaf, 1 - leaf % 2, 3) for leaf in range(2, 3000))
    assert not g.within(2, 5, 2) and g.within(2, 5, 4) and not g.within(2, 5000, 9)
    assert g.near.looked < 30 * 3000
