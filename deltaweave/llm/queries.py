"""The thin queries of the operators: each applies one to its whole table and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, branchmerge, mixing, multiindex, quality, secretscan, setjoin, spelling, tokenfiles, toxicity, triebpe, urlfilter, warc

BYTE_BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_documents(_table(spark, sf_dir, "documents"), setjoin.Terms(n=3, num=90, den=100))


#: The rules of the query: (action, host, path).
URL_RULES = tuple(urlfilter.HostRule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), least_bytes=0))


def op4_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.sha2("value", 256).alias("value_sha256"), F.char_length("value").cast("long").alias("n_chars"), "score", "is_secret")


def quality_rules() -> quality.Rules:
    return quality.Rules(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_documents(_table(spark, sf_dir, "documents"), quality_rules())


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(mixing.mix(_table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokenfiles.read_token_files(tokenfiles.write_token_files(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, end_id=0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triebpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def coded_branch(branch: str) -> Column:
    """What a branch does to a row of (doc_id, lang, source, lines), by a code of each part of it: crc32(branch:doc_id:part) modulo 7."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    code = lambda part: F.crc32(F.concat(F.lit(f"{branch}:"), doc, F.lit(":"), part).cast("binary")) % 7
    mark = lambda c: F.when(c % 2 == 1, "!").otherwise("?")
    none, row = F.lit(None).cast("string"), code(F.lit("row"))

    def column(name):
        c = code(F.lit(name))
        return F.when(c == 0, "").when(c.isin(1, 2), F.concat(name, mark(c))).otherwise(F.col(name)).alias(name)

    def place(s):
        c = s["code"]
        kind = F.when(c == 0, branchmerge.DELETE).when(c.isin(1, 2), branchmerge.REPLACE).otherwise(branchmerge.RETAIN)
        return F.struct(kind.alias("kind"), F.when(c.isin(1, 2), F.concat(s["line"], mark(c))).alias("value"), F.when(c.isin(3, 4), mark(c)).alias("insert"))

    coded = F.transform("lines", lambda x, i: F.struct(x.alias("line"), code(i.cast("string")).alias("code")))
    before = F.struct(F.lit(branchmerge.RETAIN).alias("kind"), none.alias("value"), none.alias("insert"))
    added = F.struct((-1 - F.col("doc_id")).alias("doc_id"), "lang", "source", mark(row).alias("text"))
    return F.struct((row == 0).alias("deletes"), F.struct(column("lang"), column("source")).alias("columns"), F.concat(F.array(before), F.transform(coded, place)).alias("lines"), F.filter(F.array(added), lambda _: row.isin(3, 4)).alias("adds"))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    branched = docs.withColumn("lines", F.split("text", "\n")).withColumns({"left": coded_branch("L"), "right": coded_branch("R")}).drop("lines")
    return branchmerge.merge(branched).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *branchmerge.COUNTS)


def op13_multiindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(_table(spark, sf_dir, "documents"), setjoin.Terms(n=3, num=85, den=100))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
