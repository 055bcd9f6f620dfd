"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``, with n_chars brought up to date where the text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowflow.llm import languages, lines, neardup, packing, secrets
from windowflow.llm.common import new_folder, remove, scratch
from windowflow.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be seen, a null text or one without a letter, and names the language of the others where lang is null.

    Without a language to learn from, or with one of that name, ``und`` says less: letters themselves decide.
    """
    model = languages.learn(docs)
    seen = languages.identify(docs, model).filter((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return seen.withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; a document that is left with white space alone goes.

    A document that loses no line keeps its place, whatever it holds.
    """
    rows = lines.dedup_lines(docs)
    empty = (F.length(F.btrim(F.col("kept_text"), F.lit(" \t\n\x0b\x0c\r"))) == 0) & (F.col("n_dropped") > 0)
    return rows.filter(~empty).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of every group of near-duplicates."""
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document goes."""
    clean = secrets.redact_secrets(docs.select(*COLUMNS), tokenizer_file("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; one row per piece."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).drop("ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: Sketches, a trained model and a tokenizer take part: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written as Parquet beside the checkpoints and read again.

    What a stage wrote for itself, and its predecessor's result, go once its own result is written; the last stage is lazy
    and reads the result before it, which stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
