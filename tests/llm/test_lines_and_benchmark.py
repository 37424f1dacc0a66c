import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from arcfold.llm import decontaminate, line_dedup, textkit
from tests.llm import brute


def line_corpus(seed):
    r = random.Random(seed)
    long = [f"Line {i} " + "".join(r.choice("abé ") for _ in range(40)) for i in range(30)]
    out = []
    for _ in range(60):
        lines = [r.choice(long) for _ in range(r.randrange(0, 6))] + ["short line", "", f"own {r.random()} " + "x" * 50]
        lines = [x.upper().replace("É", "é") if r.random() < 0.2 else x for x in lines]
        lines = [r.choice(["", " ", "\t", "\x0b"]) + x + r.choice(["", " ", "\r"]) for x in lines]
        r.shuffle(lines)
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", long[0], "\x1c" + long[0]]


def test_lines_against_brute_force(spark):
    for seed, hot in ((1, 1 << 16), (2, 1), (3, 12)):
        texts = line_corpus(seed)
        ids = random.Random(seed).sample(range(-500, 500), len(texts))
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"])) for r in line_dedup.dedup_lines(df, hot_keys=hot).collect()}
        assert got == brute.line_dedup(dict(zip(ids, texts, strict=True)))


def test_lines_of_repeated_ids_with_different_texts(spark):
    often, own = "k" * 40, [f"own {i} " + "x" * 50 for i in range(4)]
    # The rows of id 3 have the frequent line at different places, and two of them not at all.
    rows = [(3, f"{often}\n{own[0]}"), (3, f"{own[1]}\n{often}"), (3, f"{own[2]}\n{own[3]}\n{often}"), (3, own[0]), (3, None)]
    rows += [(i, often) for i in range(4, 9)] + [(8, often), (None, often)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([
        ("3", own[0], 2, 1), ("3", own[1], 2, 1), ("3", f"{own[2]}\n{own[3]}", 3, 1), ("3", own[0], 1, 0),
        ("3", "", 1, 0), *((str(i), "", 1, 1) for i in range(4, 8)), *[("8", often, 1, 0)] * 2, ("None", often, 1, 0),
    ])
    for hot in (1 << 16, 1):
        got = line_dedup.dedup_lines(df, hot_keys=hot).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == want


def test_lines_odd_rows(spark):
    line = "k" * 40
    df = spark.createDataFrame([(i, line, i) for i in range(5)] + [(4, line, 0), (None, line, 0)], "doc_id long, text string, N_lines long")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in got.collect())
    assert kept == [("0", ""), ("1", ""), ("2", ""), ("3", ""), ("4", line), ("4", line), ("None", line)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        mph = line_dedup.PerfectHash.load(line_dedup.PerfectHash(keys).dump())
        assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
        other = mph.index(r.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64))
        assert ((other >= -1) & (other < max(len(keys), 1))).all()


def benchmark_corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "ß1", "x2", "the", "of", "é"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(25)] + [(90, ""), (91, None), (None, "alpha Beta"), (92, "  --  ")]
    items += [(93, items[5][1]), (94, items[6][1].upper())]
    docs = [text(r.randrange(0, 60)) + " " + r.choice(items[:25])[1] + "; " + text(r.randrange(0, 60)) for _ in range(60)]
    return items, [*docs, None, "", "--", items[7][1]]


def test_contamination_against_brute_force(spark):
    for seed, block in ((1, 16 << 20), (2, 150)):
        items, docs = benchmark_corpus(seed)
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {r["doc_id"]: (
            r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"],
        ) for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()}
        assert got == brute.contamination(dict(enumerate(docs)), [i for i in items if i[0] is not None and i[1] is not None])


def test_benchmark_index_size_and_blocks(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(r.choice([3, 40, 200])))) for i in range(600)]
    ws = decontaminate.WindowSet(items, 13, 3)
    index = decontaminate.PrefixIndex(ws, {k: (h, np.ones(len(h), np.int64)) for k, h in ws.shingles().items()})
    size = sum(len(t) for _, t in items)
    assert index.nbytes() < 16 * size + (4 << 20)
    for x in range(0, len(index.hash), 997):
        text = index.words(x)
        assert all(text.decode() in t for i, t in items if i in index.items(x)) and index.items(x)
    docs = [(i, " ".join(r.choice(words) for _ in range(30)) + " " + items[i][1]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(df, bench, block_bytes=size // 6).collect()
    assert all(str(d["doc_id"]) in d["items"] for d in got)


def test_contamination_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5)], "doc_id long, text string, items long")
    bench = spark.createDataFrame([("q", "A, b!")], "item_id string, text string")
    got = sorted((str(r["doc_id"]), r["n_hit"], r["items"]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == [("1", 2, ["q"]), ("1", 2, ["q"]), ("None", 0, [])]
    assert {r["contaminated"] for r in decontaminate.decontaminate(df, bench.limit(0)).collect()} == {False}
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \té\n1-"), max_size=12) | st.none(), max_size=6))
def test_spans_and_hashes(texts):
    column = pa.array(texts, pa.string())
    data, off = textkit.flat(column)
    for table, pattern in ((textkit.NONSPACE, r"[^\x20\x09-\x0D]+"), (textkit.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        import re

        start, end, first = textkit.spans(data, off, table)
        want = [[m.encode() for m in re.findall(pattern, t or "")] for t in texts]
        got = [[data[a:b].tobytes() for a, b in zip(start[x:y], end[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
        assert got == want
        h = textkit.byte_sums(data).hash(start, end)
        words = [w for ws in want for w in ws]
        assert len(set(h.tolist())) == len(set(words)) and len({*zip(words, h.tolist(), strict=True)}) == len(set(words))


def test_small_helpers():
    a, b = textkit.merge(np.array([5, 1, 3, 10]), np.array([7, 3, 4, 12]))
    assert (a.tolist(), b.tolist()) == ([1, 5, 10], [4, 7, 12])
    assert textkit.expand(np.array([3, 9, 0]), np.array([2, 0, 3])).tolist() == [3, 4, 0, 1, 2]
    at, doc = textkit.windows(np.array([0, 2, 7, 7, 10]), 3)
    assert (at.tolist(), doc.tolist()) == ([2, 3, 4, 7], [1, 1, 1, 3])
    big = pa.record_batch({"text": pa.array(["x" * 10, None, "y" * 3, "z" * 30])})
    assert [c.num_rows for c in textkit.chunks(iter([big]), "text", 12)] == [2, 1, 1]


def test_sums_against_their_definition():
    values = np.random.default_rng(1).integers(0, 1 << 63, 2 * textkit.STEP + 77, dtype=np.uint64)
    for n in (0, 1, textkit.STEP - 1, textkit.STEP, textkit.STEP + 1, len(values)):
        for kind, base in enumerate(int(b) for b in textkit._BASES):
            start = np.array([0, n // 3, max(n - 2, 0), n])
            end = np.array([n, n // 2, n, n])
            sums = [sum(int(values[i]) * pow(base, i - a, 1 << 64) for i in range(a, b)) + b - a for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            want = textkit.mix(np.array([int(s) % (1 << 64) for s in sums], np.uint64))
            assert textkit.Sums(values[:n], kind).hash(start, end).tolist() == want.tolist()


def test_a_worker_keeps_little_after_counting_lines():
    code = """
import re
from pathlib import Path
import pyarrow.parquet as pq
from arcfold.llm import line_dedup
def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
batches = list(pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(1000))
before = held()
assert sum(b.num_rows for b in line_dedup._count("doc_id", "text", 40)(iter(batches)))
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(done.stdout.split()[-1]) < 60
