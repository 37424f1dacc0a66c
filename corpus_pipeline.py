"""The corpus pipeline: documents -> language ID -> line dedup -> n-gram Jaccard join -> decontamination -> packing.

run() writes what each stage returns as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.llm import runtime
from arcfold.llm.queries import tokenizer_path

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this probability the language of a document counts as not recognised. Of four languages chance has 0.25. Of
#: 2,499 held-out documents (sf0.1) 2,497 are told right and none scores below 0.45; 0.5 would reject a right one.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the classifier does not recognise, go."""
    from arcfold.llm.langid import identify

    out = identify(docs, runtime.tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; a document that loses lines and is left without a word (of other characters than
    [\\x20\\x09-\\x0D]) goes too. n_chars follows the text; it is 0 where that is null."""
    from arcfold.llm.line_dedup import dedup_lines

    out = dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    wordless = F.translate("text", " \t\n\x0b\x0c\r", "") == ""
    return out.where(~((F.col("n_dropped") > 0) & wordless)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    from arcfold.llm.jaccard_join import keep_one

    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    from arcfold.llm.decontaminate import decontaminate

    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    from arcfold.llm.packing import pack

    return pack(docs, tokenizer_path(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the packing have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    docs = runtime.tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.swept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
