import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcfold.llm import chat, langid, queries, tiff, warc

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(
    st.binary(max_size=3000) | st.lists(st.sampled_from([b"ab", b"aaaaaaa", b"\x00" * 300, b"xyz"]), max_size=60).map(b"".join),
    st.sampled_from([tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.booleans(), st.booleans(),
)
def test_tiff_round_trip(raw, kind, tiled, predictor):
    payload = raw + b"\x00" * ((-len(raw)) % 64 if raw else 64)
    pages = list(tiff.read_tiff(tiff.write_tiff(payload, kind=kind, tiled=tiled, predictor=predictor, page_rows=10)))
    assert b"".join(p["pixels"] for p in pages) == payload
    assert [p["page"] for p in pages] == list(range(-(-len(payload) // 640)))


def test_lzw_over_many_tables():
    raw = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(b"")) == b""
    # The worked example of the format's specification.
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))[:3] == bytes([0x80, 0x01, 0xE0])


def test_tiff_width_not_of_tiles_and_bad_files():
    payload = bytes(range(250)) * 4
    (page,) = tiff.read_tiff(tiff.write_tiff(payload, width=100, tiled=True, kind=tiff.LZW, predictor=True))
    assert (page["width"], page["pixels"]) == (100, payload)
    good = tiff.write_tiff(b"x" * 640)
    for bad in (b"", b"II*\x00", good[:-30], b"MM" + good[2:]):
        with pytest.raises(ValueError):
            list(tiff.read_tiff(bad))


def test_tiff_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op1_tiff(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = (r["text"] or "").encode()
        payload = text + b"\x00" * ((-len(text)) % 64 if text else 64)
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (
            len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
        )
        media = tiff.write_tiff(payload, **tiff.layout(payload))
        assert (x["media_bytes"], x["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_tiff_odd_rows(spark):
    long = "é" * 200_000
    df = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (2, "", "b"), (3, long, "d")],
        "doc_id long, text string, media string",
    )
    pages = tiff.read_pages(tiff.store_texts(df))
    assert pages.where("doc_id = 3").count() == 2
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) for r in tiff.page_digests(pages, "doc_id", "n_bytes").collect())
    assert got == [("1", 0, 64), ("2", 0, 64), ("2", 0, 64), ("3", 400_000, 400_000), ("None", 1, 64)]
    assert tiff.page_digests(tiff.read_pages(tiff.store_texts(df.limit(0))), "doc_id").count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"junk"))], "doc_id long, media binary")
    assert tiff.read_pages(bad, strict=False).first()["error"] == "not a TIFF file"


def test_warc_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op6_warc(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["html"] or "").encode()
        assert (got[r["page_id"]]["payload_bytes"], got[r["page_id"]]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_warc_revisits_and_odd_rows(spark):
    big, small = "é" * 60, "s" * 99
    rows = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (9, "u", big), (4, "u", small), (6, "u", small), (7, "u", None), (8, "u", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    table = warc.archive_table(df)
    got = {r["page_id"]: r for r in warc.read_archives(table).collect()}
    assert {k: r["refers_to"] for k, r in got.items()} == {5: 3, 3: None, 9: 3, 4: None, 6: None, 7: None, 8: None}
    assert bytes(got[3]["payload"]).decode() == big and got[5]["payload"] is None and got[5]["payload_bytes"] == 120
    assert got[5]["url"] == "http://a/%20b%0D%0AX:%20y"
    assert warc.read_archives(warc.archive_table(df.limit(0))).count() == 0
    raw = bytes(table.first()["content"])
    for bad in (raw[:-3], raw[:20], raw.replace(warc.FRAME_MAGIC, b"\x00" * 4)):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))


def test_warc_record_validation():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (
        good[:-1], good.replace(b"payload\r\n", b"paylond\r\n"), good.replace(b"WARC-Date", b"Date"),
        good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(
    st.tuples(st.sampled_from(["user", "assistant", "system", "[INST]\\"]), st.text(st.sampled_from("<s>/[INST] \\\né"), max_size=30)),
    max_size=6,
))
def test_chat_reads_back(turns):
    got = chat.format_turns(1, turns)
    assert not got["rewrites_history"]
    assert list(zip(got["roles"], got["texts"], strict=True)) == turns
    assert got["loss_text"] == "".join(t for r, t in turns if r == "assistant")


def test_chat_detects_rewriting():
    last_only = lambda turns: "".join(f"<{r}>" + (t if i == len(turns) - 1 else t[:1]) for i, (r, t) in enumerate(turns))
    assert not chat.locate([("user", "x"), ("assistant", "y")], last_only)["rewritten"]
    assert chat.locate([("user", "long text"), ("assistant", "y")], last_only)["rewritten"]


def test_long_conversations_equal_whole_prefixes():
    turns = [("assistant" if i % 2 else "user", f"text {i} </s>") for i in range(150)]
    assert chat.locate(turns) == chat._prefixes(turns, chat.render)
    counts = lambda turns: "".join(f"<{i}{r}>{t}" for i, (r, t) in enumerate(turns))
    totals = lambda turns: f"{len(turns) // 100}" + counts(turns)
    for template in (counts, totals):
        assert chat.locate(turns, template) == chat._prefixes(turns, template)
    assert not chat.locate(turns, counts)["rewritten"] and chat.locate(turns, totals)["rewritten"]


def test_rewriting_at_any_prefix_is_seen():
    # Turns older than 30 go whenever the last one is a user's; prefixes of even length never show it.
    drops = lambda turns: "".join(f"<{r}>{t}" for r, t in (turns[-30:] if turns and turns[-1][0] == "user" else turns))
    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(64)]
    assert not chat.locate(turns[:30], drops)["rewritten"]
    assert chat.locate(turns, drops)["rewritten"]
    assert chat.format_turns(1, turns, drops)["rewrites_history"]


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, SF).collect()}
    assert got.keys() == convs.keys()
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k]["formatted_chars"] == len(chat.render(turns))


def test_chat_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, "assistant", None, 0), (1, 0, None, "q", 0), (None, 0, "user", "x", 0)],
        "conv_id long, turn long, role string, text string, formatted int",
    )
    got = {r["conv_id"]: (r["roles"], r["texts"]) for r in chat.format_chats(df).collect()}
    assert got == {1: (["", "assistant"], ["q", ""]), None: (["user"], ["x"])}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert {r["held_out"] for r in got} == {zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got if r["held_out"]} | {False}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    df = spark.createDataFrame(
        [(i, t, lang, 1) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("12 !?", "en"), ("the of and", "en"), ("der die das", "de"), ("the of and", None)])],
        "doc_id long, text string, lang string, Score int",
    )
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["und"] * 3 and got[3] == got[5] != "und"
    assert langid.identify(df.limit(0), df).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, df.limit(0)).collect()} == {"und"}


def test_network_gradients():
    net = langid.Network(["a", "b"])
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.grads(x, y)
    loss = lambda: -np.log(net.head(net.pool(x)[2])[1][np.arange(6), y]).mean()
    for k, at in (("out", (3, 1)), ("c", (0,)), ("b", (7,)), ("w", (1, 20)), ("emb", (int(x[0, 0]), 2))):
        eps, v = 1e-6, net.p[k][at]
        net.p[k][at] = v + eps
        up = loss()
        net.p[k][at] = v - eps
        assert abs((up - loss()) / (2 * eps) - g[k][at]) < 1e-4
        net.p[k][at] = v


def test_network_against_loops():
    r = np.random.default_rng(2)
    net = langid.Network(["a", "b", "c"])
    net.p["b"] = r.normal(0, 0.3, net.p["b"].shape).astype(np.float32)
    net.p["c"] = r.normal(0, 0.3, 3).astype(np.float32)
    texts = ["é" * 100 + "x" * 40, "ab", "", None, "y" * langid.WINDOW]
    x, of, size = langid.cut(pa.array(texts, pa.string()))
    raw = [(t or "").encode() for t in texts]
    pieces = [(i, b[p : p + langid.WINDOW]) for i, b in enumerate(raw) for p in range(0, len(b), langid.WINDOW)]
    assert [(i, bytes(w[:n])) for i, w, n in zip(of, x, size, strict=True)] == pieces and not any(w[n:].any() for w, n in zip(x, size, strict=True))
    got = net.predict(x)
    taps = max(langid.WIDTHS)
    for row, window in zip(got, x, strict=True):
        top = []
        for f in range(langid.FILTERS * len(langid.WIDTHS)):
            width = langid.WIDTHS[f // langid.FILTERS]
            answers = []
            for place in range(langid.WINDOW):
                total = 0.0
                for t in range(width):
                    byte = window[place + t] if place + t < langid.WINDOW else 0
                    total += sum(float(net.p["emb"][byte, d]) * float(net.p["w"][t * langid.DIM + d, f]) for d in range(langid.DIM))
                answers.append(total)
            assert not net.p["w"][width * langid.DIM : taps * langid.DIM, f].any()
            top.append(max(0.0, max(answers) + float(net.p["b"][f])))
        z = [sum(h * float(net.p["out"][f, k]) for f, h in enumerate(top)) + float(net.p["c"][k]) for k in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        assert np.allclose(row, np.array(e) / sum(e), atol=1e-4)


def test_pages_out_of_order_are_refused():
    files = tiff.write_tiff(bytes(640 * 3), page_rows=10)
    pages = [p | {"media_bytes": 1, "media_sha256": "", "error": None, "doc_id": 1} for p in tiff.read_tiff(files)]
    schema = pa.schema([("doc_id", pa.int64()), *tiff.PAGE.items()])
    run = tiff._digest(["doc_id"])
    assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_pylist(pages, schema)]))) == 1
    with pytest.raises(ValueError):
        list(run(iter([pa.RecordBatch.from_pylist([pages[1], pages[0], pages[2]], schema)])))
