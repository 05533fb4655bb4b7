"""A corpus pipeline of five stages over ``documents``, each one of the operators in larkspur.llm.

Each stage takes what its predecessor kept, written as Parquet and read again. Toxic documents
go; of each group of near copies the one with the smallest doc_id stays; benchmark passages are
cut out, and documents that are mostly such go; secrets are replaced by a mark; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, decontam, jaccard, secrets, toxicity


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, counts the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5. It learns from the labels of rows that aren't held out."""
    return toxicity.reject_toxic(docs, common.load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id. Rows without a doc_id stay."""
    return jaccard.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages of 8 words and more, or whole shorter items; documents with over half their words in such go."""
    return _measured(decontam.removed_spans(docs, common.load(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which each secret is replaced by a mark."""
    return _measured(secrets.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the token ids as unsigned 32-bit little-endian numbers."""
    return bpe.encode_documents(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: The first stage learns a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = common.made(spark)
        path = common.scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        common.release(spark, common.made(spark) - before - {path})
        docs = spark.read.parquet(path)
    return docs
