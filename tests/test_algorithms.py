import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.operators import basic, clustering, components, factorization, matching, ranking, traversal
from arcfold.operators.aggregators import LONG_SUM
from arcfold.operators.pregel import PregelRun, VertexProgram, pregel
from arcfold.sources import generators
from tests.graphs import CHAIN, E7, LCC7, RATINGS20_HEAD, TWO_CHAINS, both, edges, graph, pairs

INF = float("inf")


def close(got, want, digits=9):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=10**-digits), k


def test_shortest_paths(spark):
    assert pairs(traversal.bfs(graph(spark, TWO_CHAINS), 0)) == {i: i if i < 10 else (1 << 63) - 1 for i in range(21)}
    assert pairs(traversal.sssp(graph(spark, E7), 1)) == {1: 0.0, 2: 12.0, 3: 13.0, 4: 47.0, 5: 48.0}
    e = both([(1, 2, 1), (1, 5, 1), (2, 3, 1), (2, 5, 1), (3, 4, 1), (4, 5, 1), (4, 6, 1)])
    want = {1: {1: 0, 4: 2}, 2: {1: 1, 4: 2}, 3: {1: 2, 4: 1}, 4: {1: 2, 4: 0}, 5: {1: 1, 4: 1}, 6: {1: 3, 4: 1}}
    assert pairs(traversal.mssp_maps(graph(spark, e), [1, 4])) == want
    assert pairs(traversal.mssp(graph(spark, [(1, 2, 1)]).filter_on_edges(lambda s, t, v: v > 0), [2]), "id", "value") == {1: INF, 2: 0.0}


def test_components_and_labels(spark):
    assert pairs(components.wcc(graph(spark, TWO_CHAINS))) == {i: 0 if i < 10 else 10 for i in range(21)}
    assert set(pairs(components.wcc(generators.grid_graph(spark, 10, 10))).values()) == {0}
    assert pairs(components.wcc(graph(spark, [(1, 2, 1), (3, 2, 1)]))) == {1: 1, 2: 1, 3: 1}
    cliques = [(i + o, j + o, 1) for o in (0, 5) for i in range(5) for j in range(5)] + [(0, 5, 1)]
    assert pairs(components.label_propagation(graph(spark, cliques, "long"), 10)) == {i: 4 if i < 5 else 9 for i in range(10)}


def test_pagerank(spark):
    run = lambda g, n, **o: ranking.pagerank(g, n, tolerance=1e-4, reset_probability=0.15, **o)
    chain = graph(spark, CHAIN)
    assert sorted(pairs(run(chain, 2), "id", "rank").values()) == pytest.approx([0.15] + [0.2775] * 9)
    want, r = [], 0.0
    for _ in range(10):
        r = 0.15 + 0.85 * r
        want.append(r)
    assert sorted(pairs(run(chain, 11), "id", "rank").values()) == pytest.approx(want)
    assert sorted(pairs(run(chain, 4, source=4), "id", "rank").values()) == pytest.approx([0] * 6 + [0.614125, 0.7225, 0.85, 1.0])
    for r in run(generators.complete_graph(spark, 25), 31).collect():
        assert (r["rank"], r["delta"]) == (pytest.approx(0.9935138543444264), pytest.approx(0.0011446139392183863))
    last = run(generators.grid_graph(spark, 10, 10), 51).where("id = 99").first()
    assert (last["rank"], last["delta"]) == (pytest.approx(4.300040049243878), pytest.approx(0.008015528027588203))
    star = {r["id"]: (r["rank"], r["delta"]) for r in run(generators.star_graph(spark, 100), 3).collect()}
    assert star[0] == pytest.approx((12.7725, 12.6225)) and star[7] == pytest.approx((0.15, 0.15))


def test_sybilrank(spark):
    e = both([(1, 2, 5), (2, 4, 4), (4, 5, 3), (3, 5, 3), (1, 3, 2), (3, 7, 1), (6, 7, 3), (6, 9, 3), (8, 9, 2), (7, 8, 3)])
    g = graph(spark, e).map_vertices(lambda i, v: F.struct(F.lit(0.0).alias("rank"), i.isin(1, 2, 5).alias("trusted")))
    want = {1: 0.2380952380952381, 2: 0.23809523809523808, 3: 0.39285714285714285, 4: 0.4047619047619047, **dict.fromkeys(range(5, 10), 0.0)}
    close(pairs(ranking.sybilrank(g), "id", "rank"), want)


def test_closed_forms(spark):
    close(
        pairs(basic.clustering_coefficient(graph(spark, [(a, b, 1.0) for a, b in LCC7]))),
        {0: 0.5, 1: 1 / 3, 2: 1 / 3, 3: 0.08333333333333333, 4: 0.0, 5: 0.0},
    )
    assert basic.reverse_edges(graph(spark, TWO_CHAINS)).edges.count() == 38
    assert (basic.vertex_count(graph(spark, TWO_CHAINS)).first()[0], basic.edge_count(graph(spark, TWO_CHAINS)).first()[0]) == (21, 19)
    base = [(1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 4, 0), (2, 5, 0), (3, 4, 0), (4, 5, 0)]
    want = {(1, 2): 0.2, (1, 3): 0.25, (1, 4): 0.4, (2, 4): 0.4, (2, 5): 0.2, (3, 4): 0.2, (4, 5): 0.16666666666666666, (5, 6): 0.0}
    got = {(r["src"], r["dst"]): r["value"] for r in basic.jaccard(graph(spark, both([*base, (5, 6, 0)]))).collect()}
    close(got, {**want, **{(b, a): v for (a, b), v in want.items()}})
    far = {(r["src"], r["dst"]): r["value"] for r in basic.jaccard(graph(spark, both([*base, (5, 6, 0)])), distance=True).collect()}
    assert far[5, 6] == 1.7976931348623157e308 and far[1, 2] == pytest.approx(4.0)
    v, e = basic.adamic_adar(graph(spark, both(base)))
    close(pairs(v), {1: math.log(1 / 3), 2: math.log(1 / 3), 3: math.log(1 / 2), 4: math.log(1 / 4), 5: math.log(1 / 2)})
    want = {
        (1, 2): -1.3862943611198906, (1, 3): -1.3862943611198906, (2, 5): -1.3862943611198906,
        (1, 4): -1.791759469228055, (2, 4): -1.791759469228055, (3, 4): -1.0986122886681098,
        (4, 5): -1.0986122886681098,
    }
    close({(r["src"], r["dst"]): r["value"] for r in e.collect()}, {**want, **{(b, a): x for (a, b), x in want.items()}})


def test_b_matching(spark):
    e = edges(spark, both([(1, 2, 3.0), (1, 3, 1.0), (2, 4, 1.0), (2, 5, 1.0), (3, 5, 3.0), (4, 5, 2.0)]), "double")
    v = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1), (5, 3)], "id long, value int")
    got = {(r["src"], r["dst"]) for r in matching.b_matching(Graph(v, e)).collect()}
    assert got == {(a, b) for a, b in both([(1, 2), (2, 5), (3, 5), (4, 5)])}
    with pytest.raises(ValueError):
        matching.b_matching(Graph(v.withColumn("value", F.lit(-1)), e))


def test_kmeans(spark):
    points = [(2, 10), (2, 5), (8, 4), (5, 8), (7, 5), (6, 4), (1, 2), (4, 9)]
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(points)], "id long, point array<double>")
    got, centers = clustering.kmeans(df, centers=[list(map(float, points[i])) for i in (0, 1, 2)])
    assert [pairs(got, "id", "cluster")[i] for i in range(8)] == [0, 1, 2, 0, 2, 2, 1, 0]
    assert centers[1] == [1.5, 3.5] and len(clustering.kmeans(df, k=2)[1]) == 2
    far, kept = clustering.kmeans(df, centers=[[0.0, 0.0], [999.0, 999.0]])
    assert kept[1] == [999.0, 999.0] and set(pairs(far, "id", "cluster").values()) == {0}


def test_semi_clusters(spark):
    g = graph(spark, both([(1, 2, 1), (1, 3, 1), (2, 3, 2), (3, 4, 2), (3, 5, 1), (4, 5, 1)]))
    got = {r["id"]: [(
        tuple(c["vertices"]), c["score"], c["inner"], c["boundary"],
    ) for c in r["clusters"]] for r in clustering.semi_clusters(g, capacity=2).collect()}
    # The scores of the clusters that the golden lists.
    scores = {
        (1, 5): (-2, 0, 4), (1, 3): (-2, 1, 6), (2, 5): (-2.5, 0, 5), (2, 3): (-0.5, 2, 5), (3, 4): (-0.5, 2, 5),
        (3,): (0, 0, 6), (4, 5): (-0.5, 1, 3), (5,): (0, 0, 2),
    }
    seen = {c[0]: c[1:] for cs in got.values() for c in cs}
    assert got.keys() == {1, 2, 3, 4, 5} and all(i in c[0] for i, cs in got.items() for c in cs)
    assert len(seen.keys() & scores.keys()) > 2 and all(seen[k] == pytest.approx(scores[k]) for k in seen.keys() & scores.keys())


def ratings(spark, rows=RATINGS20_HEAD):
    return spark.createDataFrame(rows, "user long, item long, rating float")


def vectors(df):
    return {r["id"]: list(r["factors"]) for r in df.collect()}


def test_sgd_and_als(spark):
    users, items = factorization.sgd(ratings(spark), dim=2, iterations=5, seed=0)
    close(
        {("u", k): v for k, v in vectors(users).items()} | {("i", k): v for k, v in vectors(items).items()},
        {("u", 1): [0.007530, 0.008566], ("u", 2): [0.007827, 0.008902], ("i", 1): [0.007459, 0.008485], ("i", 2): [0.007534, 0.008570]},
        6,
    )
    users, items = factorization.als(ratings(spark), dim=2, iterations=5, seed=0)
    close(vectors(users), {1: [1.1009, 1.2520], 2: [2.4888, 2.8309]}, 2)
    assert factorization.rmse(ratings(spark), users, items) < 0.5
    assert vectors(factorization.sgd(ratings(spark), dim=2, iterations=6, seed=0, tolerance=1e-12)[0]).keys() == {1, 2}


def test_svdpp(spark):
    o = {"dim": 2, "bias_lambda": 0.005, "bias_gamma": 0.01, "factor_lambda": 0.005, "factor_gamma": 0.01, "seed": 0}
    users, items = factorization.svdpp(ratings(spark), iterations=6, **o)
    base = lambda df: {r["id"]: r["baseline"] for r in df.collect()}
    close(base(users), {1: 0.26593804, 2: 0.18473601}, 7)
    close(base(items), {1: 0.6420079, 2: 0.6016106}, 7)
    close(vectors(users), {1: [0.007494, 0.008374], 2: [0.006907, 0.008184]}, 6)
    close(vectors(items), {1: [0.007407, 0.002487], 2: [0.006642, 0.001807]}, 6)
    p = factorization.svdpp_predict(ratings(spark).select("user", "item"), users, items, 1.25).collect()
    assert len(p) == 4 and all(0 <= r["prediction"] <= 5 for r in p)
    book = factorization.svdpp(ratings(spark), iterations=20, textbook=True, **o)
    assert base(book[0])[2] > base(book[0])[1]


class Hooks(VertexProgram):
    vertex_type, edge_type, message_type = "long", "long", "long"

    def aggregators(self):
        return {"n": (LONG_SUM, False)}

    def pre_superstep(self, superstep, aggregates):
        aggregates.aggregate("n", 100_000)

    def post_superstep(self, superstep, aggregates):
        aggregates.aggregate("n", 10_000)

    def compute(self, superstep, vertex, messages):
        vertex.aggregate("n", 99)
        vertex.aggregate("n", 1)
        if superstep:
            vertex.set_value(vertex.get_aggregated("n"))
            vertex.vote_to_halt()


class Edits(VertexProgram):
    vertex_type, edge_type, message_type = "long", "long", "long"
    initial_message = 7

    def compute(self, superstep, vertex, messages):
        if superstep == 0:
            assert messages == [7]
            vertex.send(vertex.id + 1, vertex.id)
            vertex.set_edge_value(-1, 5)
        else:
            for m in messages:
                vertex.add_edge(m, 9)
            vertex.remove_edge(vertex.id + 1)
            vertex.set_value(len(vertex.edges))
        vertex.vote_to_halt()


def test_vertex_programs(spark):
    run = pregel(graph(spark, TWO_CHAINS, "long"), Hooks(), partitions=2)
    assert set(pairs(run.result()).values()) == {220021} and run.state == "COMPLETED" and run.superstep == 1
    run = pregel(graph(spark, [(1, 2, 1), (2, 3, 1)], "long"), Edits())
    assert sorted(tuple(r) for r in run.edges().collect()) == [(1, 2, 1), (2, 1, 9), (3, 2, 9)]
    assert pairs(run.result()) == {1: 1, 2: 1, 3: 1}
    assert pregel(graph(spark, TWO_CHAINS, "long"), Hooks(), 0).superstep == 0


class Least(Edits):
    """The least id that reaches a vertex, with combined mail."""

    initial_message, combiner = None, "min"
    configured, closed = None, 0

    def configure(self, configs):
        self.configured = configs

    def close(self):
        self.closed += 1

    def compute(self, superstep, vertex, messages):
        assert len(messages) <= 1
        best = min([vertex.value, *messages])
        if superstep == 0 or best < vertex.value:
            vertex.set_value(best)
            for t in vertex.edges:
                vertex.send(t, best)
        vertex.vote_to_halt()


def test_combined_mail_and_lifecycle(spark):
    program = Least()
    rows = [(i, 0, 1) for i in range(1, 40)] + [(0, i, 1) for i in range(40, 60)]
    run = PregelRun(graph(spark, rows, "long"), program, configs={"a": 1}).run()
    assert pairs(run.result()) == {i: (i if 0 < i < 40 else 0) for i in range(60)}
    assert (program.configured, program.closed) == ({"a": 1}, 1)


def test_hubs_make_few_wedges(spark):
    n = 100_000
    leaves = spark.range(1, n + 1)
    e = leaves.select(
        F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"),
    ).unionByName(leaves.select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
    g = Graph.from_edges(e.withColumn("value", F.lit(0.0)))
    assert basic.jaccard(g).agg(F.max("value"), F.count("*")).first() == (0.0, 2 * n)
    assert basic.adamic_adar(g)[1].agg(F.max("value"), F.count("*")).first() == (0.0, 2 * n)
    assert basic.clustering_coefficient(g).agg(F.max("value"), F.count("*")).first() == (0.0, n + 1)


def test_similarities_against_brute_force(spark):
    import random
    from itertools import product
    from math import log

    r = random.Random(4)
    e = sorted({(r.randrange(14), r.randrange(14)) for _ in range(60)})
    g = graph(spark, [(a, b, 2.0) for a, b in e])
    out, back = ({i: {y for x, y in es if x == i} for i in range(14)} for es in (e, [(b, a) for a, b in e]))
    near = {i: out[i] | back[i] for i in range(14)}
    ids = {i for p in e for i in p}
    want = {i: (sum((b, z) in e for b, z in product(near[i], near[i])) / len(near[i]) / (len(near[i]) - 1) if len(near[i]) > 1 else 0.0) for i in ids}
    close(pairs(basic.clustering_coefficient(g)), want, 9)
    got = {(x["src"], x["dst"]): x["value"] for x in basic.jaccard(g).collect()}
    close(got, {(a, b): len(out[a] & out[b]) / len(out[a] | out[b]) if (b, a) in e else 2.0 for a, b in e}, 9)
    got = {(x["src"], x["dst"]): x["value"] for x in basic.adamic_adar(g)[1].collect()}
    close(got, {(a, b): 2.0 + sum(log(1 / len(out[z])) for z in back[a] & back[b]) for a, b in e}, 9)


def test_vertices_of_many_sizes_go_on_together(spark, monkeypatch):
    import random

    r = random.Random(7)
    rows = sorted({(int(r.paretovariate(0.7)) % 9, r.randrange(12)) for _ in range(80)})
    rows = [(u, i, float(r.randrange(1, 6))) for u, i in rows]
    users, _ = factorization.sgd(ratings(spark, rows), dim=3, iterations=3, seed=1)
    start = np.array(factorization._start(1, 3)(0), np.float32)
    for u, got in vectors(users).items():
        value = start.copy()
        for _, _, seen in sorted(x for x in rows if x[0] == u):
            err = np.float32(min(max(value @ start, 0.0), 5.0)) - np.float32(seen)
            value = value + (value * np.float32(0.01) + start * err) * np.float32(-0.005)
        assert got == pytest.approx(value.tolist(), abs=1e-7)


def test_factorization_shuffles_rows_once(spark, monkeypatch):
    """A rating goes to its vertex in one row; sums over several batches of one id are those of all its rows."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return df.localCheckpoint()

    monkeypatch.setattr(factorization, "staged", kept)
    rows = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(6) for i in range(7)], "user long, item long, rating float")
    factorization.sgd(rows, dim=2, iterations=3, seed=0)
    factorization.svdpp(rows, dim=2, iterations=4, seed=0)
    assert [p.count("Join ") for n, p in plans if n in ("updates", "svdpp")] == [1, 1, 0]
    x = spark.createDataFrame([(i % 3, float(i % 4), [1.0 + i % 5, 2.0 - i % 2]) for i in range(60)], "id long, rating float, factors array<float>")
    solved = factorization._solve(x, 2, 0.01)
    assert solved._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    flat = lambda rows: {(r["id"], k): x for r in rows for k, x in enumerate(r["factors"])}
    whole = flat(solved.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert flat(factorization._solve(x, 2, 0.01).collect()) == pytest.approx(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similarities_meet_each_triangle_once(spark):
    """Against plain sets, with self-loops and edges of one way."""
    import random

    r = random.Random(3)
    e = sorted({(r.randrange(14), r.randrange(14)) for _ in range(70)})
    out = {i: {b for a, b in e if a == i} for i in range(14)}
    into = {i: {a for a, b in e if b == i} for i in range(14)}
    g = graph(spark, [(a, b, 0.5) for a, b in e])
    got = {(x["src"], x["dst"]): x["value"] for x in basic.jaccard(g).collect()}
    want = {(a, b): len(out[a] & out[b]) / (len(out[a]) + len(out[b]) - len(out[a] & out[b])) if (b, a) in set(e) else 0.5 for a, b in e}
    close(got, want)
    got = {(x["src"], x["dst"]): x["value"] for x in basic.adamic_adar(g)[1].collect()}
    close(got, {(a, b): 0.5 + sum(math.log(1 / len(out[z])) for z in into[a] & into[b]) for a, b in e})
    clique = edges(spark, [(a, b) for a in range(8) for b in range(8) if a != b])
    assert basic._thirds(clique).count() == 3 * math.comb(8, 3)


def test_supersteps_hold_few_new_rows_at_once():
    import pandas as pd

    from arcfold.operators.pregel import ROWS, _stepper

    class Nothing(VertexProgram):
        def compute(self, superstep, vertex, messages):
            vertex.vote_to_halt()

    n = 2 * ROWS + 5
    f = pd.DataFrame({"id": range(n), "value": [0.5] * n, "edges": [None] * n, "halted": [False] * n, "inbox": [None] * n})
    sizes = [len(x) for x in _stepper(Nothing(), {}, {}, 0)(iter([f]))]
    assert sizes == [ROWS, ROWS, 5, 1]
