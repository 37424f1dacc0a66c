"""The queries of the operators with their production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.llm import runtime

#: Where the public tokenizer files lie; a parameter of the session.
TOKENIZER_CONF = "spark.arcfold.tokenizer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runtime.tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession) -> str:
    path = spark.conf.get(TOKENIZER_CONF, None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return str(path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", n_items, items, "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, p, item FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.tiff import page_digests, read_pages, store_texts

    pages = read_pages(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return page_digests(pages, "doc_id", "n_bytes")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.jaccard_join import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + least(5, len(w)) - 1], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, p, hash(array_to_string(w[p : p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM v JOIN f USING (k) WHERE doc_id > first),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
y AS (SELECT x.doc_id, x.p, x.word, g.p IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY y.p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id, len(d.w)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = F.size("removed_spans").cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


#: Bytes in windows of 400 (removed) and 256 (reported) that start elsewhere too, merged to spans; what lies between
#: the spans of 400 is kept.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, hash(b[p + 1 : p + 256]) AS short, CASE WHEN p + 400 <= octet_length(b) THEN hash(b[p + 1 : p + 400]) END AS long
      FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 255)) AS p FROM d)),
m AS (SELECT doc_id, p, count(*) OVER (PARTITION BY short) > 1 AS short, long IS NOT NULL AND count(*) OVER (PARTITION BY long) > 1 AS long FROM w),
x AS (SELECT doc_id, p, 400 AS n FROM m WHERE long UNION ALL SELECT doc_id, p, 256 FROM m WHERE short),
g AS (SELECT doc_id, n, p, sum(new) OVER (PARTITION BY doc_id, n ORDER BY p) AS no
      FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, n ORDER BY p) + n THEN 0 ELSE 1 END AS new FROM x)),
s AS (SELECT doc_id, n, no, min(p) AS a, max(p) + n AS z FROM g GROUP BY doc_id, n, no),
t AS (SELECT doc_id, sum(z - a) FILTER (WHERE n = 400) AS n_removed, count(*) FILTER (WHERE n = 400) AS n_spans, sum(z - a) FILTER (WHERE n = 256) AS n_repeated FROM s GROUP BY doc_id),
cuts AS (SELECT doc_id, a, z FROM s WHERE n = 400 UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d),
k AS (SELECT cuts.doc_id, string_agg(hex(b[coalesce(before, 0) + 1 : a]), '' ORDER BY a, z) AS kept
      FROM (SELECT *, lag(z) OVER (PARTITION BY doc_id ORDER BY a, z) AS before FROM cuts) cuts JOIN d ON d.doc_id = cuts.doc_id GROUP BY cuts.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN t ON t.doc_id = d.doc_id JOIN k ON k.doc_id = d.doc_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.warc import archive_table, read_archives

    records = read_archives(archive_table(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS g FROM p),
m AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY g) AS again, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM m
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.langid import held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.chat import format_chats

    text = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string",
    ))
    out = format_chats(rows)
    turns = F.concat_ws("", F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Length of a text with its backslashes doubled and its control strings broken by one.
_ESCAPED = r"(length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '<s>|</s>|\[INST\]|\[/INST\]')))"
OP8_SQL = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, CASE WHEN role = 'assistant' THEN {text} + 4 ELSE {role} + {text} + 16 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
""".replace("{text}", _ESCAPED.format("text")).replace("{role}", _ESCAPED.format("role"))


def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcfold.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS no FROM documents),
k AS (SELECT doc_id, no, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, no, line, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (
        *(op1_tiff, op2_decontaminate, op3_pack, op4_jaccard_join, op5_substring_dedup),
        *(op6_warc, op7_language, op8_chat, op9_suffix_dedup, op10_dedup_lines),
    )
}
ORACLES = {
    "op2_decontaminate": OP2_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_chat": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_dedup_lines": OP10_SQL,
}
