"""A corpus from raw documents: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; all but the last
return the columns of documents. An empty table stays empty in every stage, texts of any length count in full, and further columns of docs, whatever
their names, go through unread up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import mixing, quality, secretscan, setjoin, triebpe
from deltaweave.llm.queries import BYTE_BPE, quality_rules
from deltaweave.llm.shared import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; among them null and empty texts. Rows are judged one by one, so repeated ones go or stay alike."""
    return quality.keep_good(docs, quality_rules())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five-word shingles join, the one with the smallest id stays; of rows with that id and
    equal texts, one. Rows without an id, and those without a word, stay."""
    return setjoin.keep_one(docs, setjoin.Terms(n=5, num=80, den=100))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. Null texts stay null, with null characters; repeated rows are changed alike."""
    return secretscan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of their sources' weights, repeated or left out as the schedule takes them. A null source is one source; texts
    without a word go; rows that share an id are taken alike; ties in the schedule go by the hash of the seed, and then by id and size."""
    return mixing.repeated(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to; a null text counts as empty, repeated rows are rows
    of their own, and only doc_id stays of the other columns."""
    return triebpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mix_sources), ("BPE encoding", tokens)]

#: SQL has no tokenizer, so the rows of run() are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
