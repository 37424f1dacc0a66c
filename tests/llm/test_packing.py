import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arcfold.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
PARTS = [
    "the", "The", "IT'S", "it's", "'s", " ", "  ", "\n", "\t", "\x1c", " ", "é", "H̱", "é", "İ", ".", ",",
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "12", "!?", "…", "a.b", "ß", "Σ", "日本", "≮", "\x00",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=5))
def test_ids_equal_those_of_whole_texts(texts):
    ids, off = packing.Encoder.of(PATH, 1).encode(pa.array([*texts, None], pa.string()))
    for i, t in enumerate([*texts, ""]):
        assert ids[off[i] : off[i + 1]].tolist() == [*TOK.encode(t, add_special_tokens=False).ids, 1]


def whole(pieces, texts):
    """Checks pieces against the contract; gives the share of padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    for doc, text in texts.items():
        ids, at = [*TOK.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(docs.pop(doc), key=lambda p: p["start"]):
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and len(own) == p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += len(own)
        assert at == len(ids)
    assert not docs
    pad = total = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad / max(total, 1)


def test_query_is_whole_with_little_padding(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert whole(queries.op3_pack(spark, SF).collect(), texts) < 0.03


def test_many_partitions_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 4)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(40, "doc_id")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert whole(packing.pack(df, PATH, windows=4).collect(), texts) < 0.03


def test_odd_rows(spark):
    long = "word " * 9000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (4, " \n", 0)], "doc_id long, text string, start int")
    assert whole(packing.pack(df, PATH).collect(), {1: "", 2: "", 3: long, 4: ""}) < 0.3
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.union(df), PATH).collect()
    assert sum(p["length"] for p in twice if p["doc_id"] == 3) == 2 * 9001
    null = packing.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).collect()
    assert [(p["doc_id"], p["length"]) for p in null] == [(None, 3)]
