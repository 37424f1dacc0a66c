import random
import re

import numpy as np
import pytest

from arcfold.llm import jaccard_join
from arcfold.operators import components
from tests.llm.brute import near_groups


def corpus(seed: int, copies: int):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passage = text(60)
    out = []

    def edited(base, edits):
        w = list(base)
        for _ in range(edits):
            p, kind = r.randrange(len(w)), r.random()
            if kind < 0.5:
                w[p] = r.choice(words)
            elif kind < 0.75:
                del w[p]
            else:
                w.insert(p, r.choice(words))
        return w

    for size in (9, 12, 30, 90, 400):
        base = text(size)
        out += [edited(base, r.randrange(0, 2 + size // 12)) for _ in range(copies if size == 90 else 12)]
    out += [text(r.randrange(20, 60)) + passage + text(r.randrange(0, 5)) for _ in range(40)]
    out += [text(r.randrange(1, 30)) for _ in range(40)]
    out += [["a", "b", "c"]] * 3 + [["a", "b", "c", "d"]] * 2 + [["A", "b", "c"]]
    chain = text(120)
    out += [chain[i : i + 60] for i in range(0, 60, 4)]
    return [" ".join(w).replace(" w1", "\t W1") if r.random() < 0.5 else "  ".join(w) for w in out]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5)])
def test_against_brute_force(spark, seed, parts):
    texts = corpus(seed, 150) + [None, "", "  \n"]
    ids = random.Random(seed).sample(range(-5000, 5000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(parts, "doc_id")
    want = near_groups(dict(zip(ids, texts, strict=True)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_sets(df).collect()}
    assert got == want


def test_more_copies_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    texts = corpus(3, 30) + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_sets(df).collect()}
    assert got == near_groups(dict(enumerate(texts)))


def test_large_arrow_batches(spark):
    n = 33_000  # pairs: more documents than 16 bits tell apart, in one batch
    words = "array_join(transform(sequence(0, 19), j -> concat('p', id div 2, 'w', j)), ' ')"
    df = spark.range(0, 2 * n, 1, 1).selectExpr("id AS doc_id", f"concat({words}, if(id % 2 = 1, ' end', '')) AS text")
    had = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    try:
        got = [tuple(r) for r in jaccard_join.similar_sets(df).select("doc_id", "component_id").collect()]
    finally:
        for k, v in had.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    assert len(got) == 2 * n and all(c == d - d % 2 for d, c in got)


def test_rows_that_share_an_id(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [
        (5, words("a", 30)), (5, words("b", 30)), (3, words("b", 30)), (9, words("a", 31)), (2, words("c", 30)),
        (4, words("c", 30)), (4, words("d", 30)), (6, words("d", 31)), (1, words("e", 9)),
    ]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (2, 2), (4, 2), (6, 2), (1, 1)}


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(5)
    for trial in range(300):
        n = int(r.integers(4, 120))
        core = np.sort(r.choice(1 << 40, n, replace=False).astype(np.uint64))
        x, y = (np.union1d(core[r.random(n) > e], r.choice(1 << 40, int(r.integers(0, 1 + n // 8))).astype(np.uint64)) for e in r.uniform(0, 0.15, 2))
        both = len(np.intersect1d(x, y))
        rare = lambda t: np.sort(t)[np.argsort(np.sort(t) % 3 > 0, kind="stable")]
        sig = [jaccard_join.signatures(80 * len(t), 0, 0, rare(t), int((t % 3 == 0).sum()), 80, 100, unit=80) for t in (x, y)]
        if 180 * both >= 80 * (len(x) + len(y)):
            assert len(np.intersect1d(*sig)), trial
        # The same as differences from the core.
        diff, weight, rares = [], [], []
        for t in (x, y):
            rest, lacks = np.setdiff1d(t, core), np.setdiff1d(core, t)
            diff.append(np.concatenate([rare(rest), lacks]))
            weight.append(100 * len(lacks) + 80 * len(rest))
            rares.append(int((rest % 3 == 0).sum()))
        need = -(-(sum(weight) - 20 * n) // 180)
        assert (len(np.intersect1d(*diff)) >= need) == (180 * both >= 80 * (len(x) + len(y)))
        if 0 < need <= len(np.intersect1d(*diff)):
            sig = [jaccard_join.signatures(w, 20 * n, 0, d, k, 80, 100, unit=90, salt=7) for w, d, k in zip(weight, diff, rares, strict=True)]
            assert len(np.intersect1d(*sig)), trial


def test_other_thresholds_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    texts = dict(enumerate(corpus(5, 40)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for size, percent in ((3, 60), (5, 95)):
        want = near_groups(texts, size, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_sets(df, size=size, percent=percent).collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (7, "A b c d e f", 0), (8, None, 0)],
        "doc_id long, text string, component_id int",
    )
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_sets(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("7", 2, 1), ("8", 0, 8), ("None", 2, None)]
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "8", "None"]
    assert jaccard_join.similar_sets(df.limit(0)).count() == 0
    long = " ".join(str(i) for i in range(30_000))
    two = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.similar_sets(two).collect()} == {1}


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (300, 250), (5, 5)]
    r.shuffle(edges)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}
    assert re.search("long|bigint", components.components(spark.createDataFrame([], "a long, b long")).dtypes[0][1])
