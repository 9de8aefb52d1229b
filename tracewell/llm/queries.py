"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.convnet import quality
from tracewell.llm.decontaminate import leaks
from tracewell.llm.hostrules import host_rules
from tracewell.llm.licenses import license_scan
from tracewell.llm.mixing import mix, word_count
from tracewell.llm.neardup import near_duplicates
from tracewell.llm.sql import SQL
from tracewell.llm.storage import Scratch
from tracewell.llm.substrings import dedup_substrings
from tracewell.llm.tokens import read_documents, write_shards
from tracewell.llm.toxicity import toxicity
from tracewell.llm.urls import url_filter

URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of a public tokenizer is; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, two-word shingles, similarity of 0.8 or more."""
    return near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), shingle=2, percent=80).drop("class_id")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents, with verdicts on their sources."""
    out = host_rules(_documents(spark, sf_dir, "doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that repeat earlier ones."""
    cut = dedup_substrings(_documents(spark, sf_dir, "doc_id", "text"), length=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards and read back."""
    path = Scratch(spark).root
    write_shards(_documents(spark, sf_dir, "doc_id", "text"), path, tokenizer_path())
    return read_documents(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item in each document that holds it."""
    return leaks(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 at 150 % of their words, two epochs at most."""
    sized = _documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mix(Scratch(spark).table(sized), size="words")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return license_scan(_documents(spark, sf_dir, "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minhash, op2_rules, op3_substring, op4_toxicity, op5_tokens, op6_quality, op7_decontamination, op8_urls, op9_mixing, op10_licenses)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
