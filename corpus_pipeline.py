"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns token ids. run() writes each result to the shared folder and rereads it for the next stage. All stages
take nulls in any column, repeated rows, texts of any length, other columns (which they leave out) and no rows at all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece_bpe
from lexstrata.llm.common import Scratch, documents, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the learned decision list rejects go; a null or empty text fails the base test."""
    judged = quality_rules.judge(documents(docs), read(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for the first occurrence; documents left without any line go too. A null source
    is a site of its own; null and empty texts have no lines and stay."""
    out = line_dedup.dedup_lines(documents(docs)).where("n_removed = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars.cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one of the smallest doc_id with all its rows. Documents
    without words or without doc_id link nothing and stay."""
    docs = documents(docs)
    dropped = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per epoch of a document, the last of a source cut at its exact budget.
    Documents without words give no row; a null source is a source, sorted last."""
    return mixing.mixed_documents(documents(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; a null or empty text has no ids."""
    return sentencepiece_bpe.encode_documents(documents(docs), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mix), ("sentencepiece", encode)]

#: The learned rules, the components and the encoding are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name.replace(" ", "_"))
    return docs
