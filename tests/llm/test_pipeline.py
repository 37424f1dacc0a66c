import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from arcfold.llm import langid
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in raw.collect()}
    seen = []
    state = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == list(corpus_pipeline.COLUMNS) == raw.columns, name
        seen.append({r["doc_id"]: r["text"] for r in state.collect()})
    scored = {r["doc_id"]: r for r in langid.identify(raw).collect()}
    assert seen[0] == {k: t for k, t in docs.items() if scored[k]["lang_pred"] != "und" and scored[k]["score"] >= corpus_pipeline.LEAST_SCORE}
    assert len(seen[0]) > 0.95 * len(docs)
    dropped = brute.line_dedup(seen[0])
    assert {k: brute.sha(t) for k, t in seen[1].items()} == {k: v[2] for k, v in dropped.items() if k in seen[1]}
    assert all(dropped[k][1] > 0 for k in seen[0].keys() - seen[1].keys())
    groups = brute.near_groups(seen[1])
    assert seen[2] == {k: t for k, t in seen[1].items() if groups[k][1] == k}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination(seen[2], items)
    assert seen[3] == {k: t for k, t in seen[2].items() if not hit[k][4]}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, SF).collect()
    total = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in seen[3].items()}
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == total
    assert sum(p["length"] for p in pieces) == sum(total.values())


def test_registered_queries():
    known = entry.queries()
    assert {int(m[1]) for q in known if (m := re.match(r"op(\d+)_", q))} == set(range(1, 11)) and "pipeline" in known
    assert entry.oracle_sql().keys() <= known.keys()
