import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcfold.llm import anchors, queries, substring_dedup, suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def corpus(seed, words):
    r = random.Random(seed)
    text = lambda n: [r.choice(words) for _ in range(n)]
    passages = [text(n) for n in (55, 60, 90, 200)]
    out = []
    for _ in range(60):
        w = text(r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, 8)
            w += p[a : len(p) - r.randrange(0, 8)] + text(r.randrange(0, 40))
        out.append(w)
    out += [out[3]] * 4 + [out[5] + out[7]] + [["x"] * 120, ["x"] * 70, ["a", "b"] * 60]
    r.shuffle(out)
    return [" ".join(w) for w in out] + ["", None, " \n "]


@pytest.mark.parametrize("seed,parts,hot", [(1, 1, 64), (2, 5, 2)])
def test_substrings_against_brute_force(spark, monkeypatch, seed, parts, hot):
    monkeypatch.setattr(substring_dedup, "HOT_KINDS", hot)
    texts = corpus(seed, [f"w{i}" for i in range(400)] + ["é", "W1"])
    ids = random.Random(seed).sample(range(-900, 900), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(parts, "doc_id")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["text"])) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == brute.repeated_words(dict(zip(ids, texts, strict=True)))


def test_substrings_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (2, t, 0), (3, None, 0)], "doc_id long, text string, n_words int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [("1", 60, 0), ("1", 60, 0), ("2", 60, 60), ("3", 0, 0), ("None", 60, 0)]
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot,parts", [(256, 3), (1, 2)])
def test_suffixes_against_brute_force(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    texts = corpus(4, [f"w{i}é" for i in range(300)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, "doc_id")
    rows = suffix_dedup.dedup_suffixes(df).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed_spans"]), brute.sha(bytes(r["kept"]))) for r in rows}
    assert got == brute.repeated_bytes(dict(enumerate(texts)))
    shorter = brute.repeated_bytes(dict(enumerate(texts)), 256)
    assert {r["doc_id"]: (r["n_repeated"], len(r["repeated_spans"])) for r in rows} == {k: v[1:3] for k, v in shorter.items()}


def test_suffixes_odd_rows(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    df = spark.createDataFrame(
        [(1, t, 0), (1, t, 0), (2, "x" * 399, 0), (3, "y" * 401, 0), (None, "z" + t[:400], 0), (5, None, 0)],
        "doc_id long, text string, kept int",
    )
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.dedup_suffixes(df).collect())
    assert got == [("1", 500), ("1", 500), ("2", 0), ("3", 401), ("5", 0), ("None", 400)]
    assert suffix_dedup.dedup_suffixes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_suffixes(df, report=401)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from([
                b"a", b"ab", b"b", b"\x00", b"\xff", b"aaaaaaaaaaaa", b"abcabcabc",
                b"xyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzyxyzzy",
            ]),
            max_size=20,
        ).map(b"".join),
        min_size=1, max_size=5,
    ),
    st.integers(1, 90),
)
def test_suffix_order_and_windows(strings, window):
    s = suffix_dedup.Suffixes(strings, window)
    assert sorted(s.order.tolist()) == list(range(len(s.text)))
    suffix = lambda i: bytes((s.text[i : s.end[i]] - 1).astype(np.uint8))[:window]
    ordered = [suffix(i) for i in s.order.tolist()]
    assert ordered == sorted(ordered)
    common = s.common().tolist()
    for x, y, n in zip(ordered, ordered[1:], common[1:], strict=False):
        m = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert n == m
    every = [x[p : p + window] for x in strings for p in range(len(x) - window + 1)]
    for x, again in zip(strings, suffix_dedup.repeated(strings, window), strict=True):
        assert again.tolist() == [every.count(x[p : p + window]) > 1 for p in range(len(x) - window + 1)]


def test_sliding_minimum():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 40):
        for w in (1, 3, 5):
            x = r.integers(0, 50, n).astype(np.uint64)
            assert anchors.sliding_minimum(x, w).tolist() == [x[i : i + w].min() for i in range(max(0, n - w + 1))]


def test_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_suffix_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute.repeated_bytes(texts)
    assert {r["doc_id"]: r["n_repeated"] for r in rows} == {k: v[1] for k, v in brute.repeated_bytes(texts, 256).items()}
