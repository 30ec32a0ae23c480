"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens. Part of the subpackage annulus.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm import bpe, mixing, neardup, pii, quality
from annulus.llm.common import deleted, shared_folder, table

#: The vocabulary, by its name among the installed public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as long as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns. Null, empty and short texts go; null ids and repeated rows are judged like any other; an empty table stays empty."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (null ids last; ties by a hash of the text), whole, with all its columns. All texts without a word are one group. Repeated rows become one; an empty table stays empty."""
    return neardup.one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts; n_chars follows, other columns stay. Null and empty texts stay; repeated rows and null ids are like any other; an empty table stays empty."""
    return _counted(pii.replace(docs, pii.session_key(spark)).select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, whole or in part, with all its columns. Texts without a word have nothing to take and go; a null source is one of its own; repeated rows are taken one by one; an empty table stays empty."""
    return _counted(mixing.taken_rows(mixing.mix(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row of the mix; null and empty texts have no tokens, repeated rows and null ids each give a row, an empty table gives an empty one."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", good_quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("tokens", tokens)]

#: SQL can't express the pipeline; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again. What a stage has read is deleted once the next has written, so that two copies at most stand there; the last one's rows stay."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            deleted(spark, f"{folder}/{k - 1}")
    return docs
