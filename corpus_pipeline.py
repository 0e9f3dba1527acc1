"""The corpus pipeline: quality, near-duplicates, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller
writes as Parquet and reads again as the next stage's docs. All but the last return the
columns of ``documents`` and only drop rows, whatever other columns there are and
however they are named. Empty tables give empty results; texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.decontam import drop_contaminated
from talkmill.llm.near_dup import near_dup
from talkmill.llm.pu_quality import drop_bad
from talkmill.llm.registry import tokenizer_file
from talkmill.llm.shared import free_name, materialise, prepare, read_table
from talkmill.llm.spm_fst import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    A null text is judged as the empty one; equal texts fare alike, whatever their ids. A row with a null
    doc_id is judged but not learned from. A score equal to the cut is kept. Without positives all rows stay.
    """
    prepare(spark)
    return drop_bad(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the first of the smallest doc_id, of each near-duplicate group.

    Rows are told apart by a key of their own, so repeated rows and rows with a null
    doc_id are linked by their text like others; a null doc_id comes last. Null, empty and blank texts
    link with nothing, so all of them stay. Of rows with the same least doc_id in a group any one stays.
    """
    prepare(spark)
    key = free_name(docs, "_row")
    rows = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    groups = near_dup(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias(key), "component_id")
    groups = materialise(groups.join(rows.select(key, "doc_id"), key), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("m")).select(f"m.{key}")
    return rows.join(groups.join(first, key, "left_anti").select(key), key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which ten consecutive words of a benchmark item occur.

    Items of fewer words count whole; items with a null id count, without words they don't. Null, empty and
    blank texts hold no words and stay; repeated rows fare alike.
    """
    prepare(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them again.

    One row for each row of ``docs``, repeated ones too: doc_id (null stays null), n_tokens, ids, lossless.
    Null and empty texts have no ids.
    """
    prepare(spark)
    return encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", tokenize)]

#: The classifier and the encoder are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
