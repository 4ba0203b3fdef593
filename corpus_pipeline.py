"""The training-data pipeline: five stages over the table of documents, each of which works on all that the one before kept.

All stages take further columns of any name, which stay until the last one, and empty tables, which stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import runtime
from quire.llm import decontaminate, jaccard_join, language_id, line_dedup, pieces


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is accepted as one of the languages that the column lang names, which are learned from all labelled rows.

    Texts that are null, empty or without letters go. Repeated rows and rows without doc_id are judged like others, very long
    texts whole. Ties go to the language whose name comes first. In a table that labels no language all rows go.
    """
    profiles, bound = language_id.learn(docs)
    return language_id.accepted_documents(docs, profiles, max_distance=bound)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that many documents share; n_chars is that of the new text.

    Texts that are made of such lines alone become empty; the next stage holds them for copies of each other.
    """
    cut = line_dedup.cut_common_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(_columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that are like no other, and of the least doc_id of each group of alike ones.

    Texts without a word, empty ones too, are one group. Rows without doc_id and null texts stay, as do all rows of a
    doc_id that stays.
    """
    gone = jaccard_join.group_heads(docs).where("doc_id <> head").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(_columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that hold no benchmark item; rows without doc_id and null texts stay, as do all if there is no item."""
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and exact of every row; a null text has null ids."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: Groups of alike documents are connected components of a join that finds pairs with a stated recall: no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each but the last is written to the shared folder and read again. What a stage wrote on its way, and its input, is deleted after it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with runtime.scratch(spark) as keep:
            docs = runtime.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(runtime.last_written())
        if last is not None:
            runtime.delete(spark, last)
        last = runtime.last_written()
    return STAGES[-1][1](spark, docs, sf_dir)
