"""Registered queries over small tables: every row of the input counts."""

import datetime as dt
import json

import pytest

from arcfold.plans import graph_queries
from arcfold.streaming.summaries import DisjointSet

T0 = dt.datetime(2024, 1, 1)


def events(spark, path, pairs):
    rows = [(i, T0 + dt.timedelta(minutes=i), a, float(i), json.dumps({"k": b})) for i, (a, b) in enumerate(pairs, 1)]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, value double, props string",
    ).coalesce(1).write.parquet(f"{path}/events.parquet")
    return lambda name: graph_queries.QUERIES[name](spark, str(path))


def orders(spark, path, customers, edges):
    """Tables whose order graph has these edges (src, dst, value)."""
    key = lambda dst, k: next(i for i in range(k * customers, (k + 1) * customers) if (i * 7 + 3) % customers == dst)
    spark.createDataFrame([(i,) for i in range(customers)], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(
        [(key(b, k), a, v) for k, (a, b, v) in enumerate(edges)],
        "o_orderkey long, o_custkey long, o_totalprice double",
    ).write.parquet(f"{path}/orders.parquet")
    return lambda name: graph_queries.QUERIES[name](spark, str(path))


def smallest(pairs, ids=()):
    d = DisjointSet(ids)
    for a, b in pairs:
        d.union(a, b)
    least = {}
    for i in sorted(d.parent):
        least.setdefault(d.find(i), i)
    return {i: least[d.find(i)] for i in d.parent}


def test_stream_summaries_take_every_event(spark, tmp_path):
    pairs = [(1, 4), (4, 7), (7, 8), (2, 3), (3, 12), (20, 21), (21, 22), (8, 9)]
    run = events(spark, tmp_path / "even", pairs)
    want = smallest(pairs)
    assert len(set(want.values())) == 3
    assert {r["id"]: r["component"] for r in run("stream_components").collect()} == want
    got = {r["id"]: (r["component"], r["sign"], r["bipartite"]) for r in run("stream_bipartiteness").collect()}
    assert {i: c[0] for i, c in got.items()} == want and all(c[2] for c in got.values())
    assert all(got[a][1] != got[b][1] for a, b in pairs) and all(got[i][1] for i in set(want.values()))


def test_stream_bipartiteness_sees_an_odd_cycle(spark, tmp_path):
    run = events(spark, tmp_path, [(1, 2), (2, 3), (3, 1), (7, 8)])
    assert [tuple(r) for r in run("stream_bipartiteness").collect()] == [(None, None, None, False)]


def test_stream_spanner_takes_every_event(spark, tmp_path):
    run = events(spark, tmp_path, [(1, 4), (4, 7), (7, 8), (4, 5), (5, 6), (2, 3), (3, 4), (3, 6), (8, 9), (6, 8), (5, 9)])
    assert {(r["src"], r["dst"]) for r in run("stream_spanner").collect()} == {(1, 4), (4, 7), (7, 8), (4, 5), (5, 6), (2, 3), (3, 4), (8, 9), (6, 8)}


def test_wcc_takes_every_order(spark, tmp_path):
    edges = [(0, 1, 300000.0), (1, 2, 100.0), (3, 4, 200000.0), (5, 4, 260000.0), (6, 7, 1.0)]
    want = smallest([e[:2] for e in edges], range(10))
    assert len(set(want.values())) == 5
    assert {r["id"]: r["value"] for r in orders(spark, tmp_path, 10, edges)("wcc").collect()} == want


def best_clusters(edges, customers, iterations=10, most=2, capacity=4, factor=0.5):
    """Semi-clusters by the definition: sets of vertices, each scored from all edges."""
    near = {i: {} for i in range(customers)}
    for a, b, v in edges:
        near[a][b] = near[b][a] = v / 100000

    def score(c):
        inner = sum(w for i in c for j, w in near[i].items() if j in c and i < j)
        boundary = sum(w for i in c for j, w in near[i].items() if j not in c)
        return (inner - factor * boundary) / (len(c) * (len(c) - 1) / 2) if len(c) > 1 else 0.0

    # Scores that differ by rounding alone would make the order of equals a matter of chance.
    best = lambda found: sorted(found, key=lambda c: (round(score(c), 9), sorted(c)))[-most:]
    own = {i: [frozenset([i])] for i in near}
    sent = dict(own)
    for _ in range(1, iterations):
        heard = {i: {c for j in near[i] for c in sent.get(j, ())} for i in near if any(j in sent for j in near[i])}
        with_me = {i: {c | {i} for c in cs if i in c or len(c) < capacity} for i, cs in heard.items()}
        own |= {i: best(cs) for i, cs in with_me.items()}
        sent = {i: best(heard[i] | with_me[i]) for i in heard}
    return {i: [(sorted(c), pytest.approx(score(c))) for c in cs] for i, cs in own.items()}


def test_semi_clustering_takes_every_order(spark, tmp_path):
    # A chain that gains towards its far end: good clusters take more than four steps to arrive.
    edges = [(i, i + 1, 1000.0 * (i + 1) ** 2 + 17.0 * i) for i in range(11)] + [(3, 0, 90000.0), (11, 9, 350000.0), (12, 13, 5.0)]
    want = best_clusters(edges, 15)
    got = {r["id"]: [(c["vertices"], c["score"]) for c in r["clusters"]] for r in orders(spark, tmp_path, 15, edges)("semi_clustering").collect()}
    assert got == want
    few = best_clusters(edges, 15, iterations=4)
    assert want != few


def test_sybilrank_takes_the_steps_of_its_vertices(spark, tmp_path):
    n, edges = 1003, [(i, i + 1, 100.0 + i) for i in range(12)] + [(50, 60, 10.0), (60, 61, 30.0), (61, 62, 20.0), (62, 63, 5.0), (63, 64, 5.0)]
    near = {}
    for a, b, v in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = v
    trusted = [i for i in range(n) if i % 50 == 0]
    trust = dict.fromkeys(trusted, n / len(trusted))
    for _ in range(4):  # ceil(log10(1003))
        new = {}
        for a, r in trust.items():
            for b, v in near.get(a, {}).items():
                new[b] = new.get(b, 0.0) + r * v / sum(near[a].values())
        trust = new
    want = {i: trust.get(i, 0.0) / sum(near[i].values()) * 1000 if i in near else None for i in range(n)}
    assert want[63] > 0 and want[64] == 0  # the fourth step reaches 63
    got = {r["id"]: (r["rank"], r["trusted"]) for r in orders(spark, tmp_path, n, edges)("sybilrank").collect()}
    assert {i: r[0] for i, r in got.items()} == {i: w if w is None else pytest.approx(w, abs=1e-5) for i, w in want.items()}
    assert {i for i, r in got.items() if r[1]} == set(trusted)
