"""A corpus pipeline of five operators: classify, drop near-duplicates, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import bpe, classifier, mixing, secrets, simhash
from tidewrack.llm.common import remove, shared_subdir, table
from tidewrack.session import importable


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality. Null and empty texts are scored like any other, equal texts alike; an empty table stays empty."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the row with the least doc_id, nulls last, and one of repeated rows. Texts without words are one group."""
    importable(spark)
    return simhash.keep_one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all rows stay, repeated ones too, null texts stay null, and texts without secrets stay as they are."""
    importable(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target weight: documents are left out, taken, or repeated up to three times.

    Which ones is told by a hash of the id (of the text, for null ids), ties by the text. Texts without words are left out.
    """
    importable(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian, 32 bits each); none for null and empty texts."""
    importable(spark)
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("quality classifier", classify), ("simhash", deduplicate), ("secrets", redact), ("mixing", mix), ("bpe", encode)]

#: Hash fingerprints, a trained model and a byte-pair vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are written to the shared folder and read again; what the stage after has read is deleted.

    The result is the last stage's: a row for each row of the mix, none for an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_subdir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
