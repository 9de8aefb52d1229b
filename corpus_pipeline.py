"""A training corpus from raw documents: STAGES in order, each of one operator of tracewell.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.convnet import quality_model
from tracewell.llm.decontaminate import with_leaks
from tracewell.llm.mixing import mix
from tracewell.llm.neardup import near_duplicates
from tracewell.llm.queries import tokenizer_path
from tracewell.llm.storage import Scratch
from tracewell.llm.tokens import read_documents, write_shards
from tracewell.llm.toxicity import with_scores

#: A document is rejected if its quality score is less.
LEAST_QUALITY = 0.3


def unused(name: str, docs: DataFrame) -> str:
    """``name``, or more underscores before it if docs has such a column."""
    while name.lower() in map(str.lower, docs.columns):
        name = "_" + name
    return name


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is trained on the labelled ones among them.

    Null and empty texts are scored as such, repeated rows each by itself. Without labels all
    have the same score, 0.5, and stay. Columns of any name are kept; an empty table stays empty.
    """
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("_score", docs)
    return with_scores(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).select(*columns(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and a similarity of 0.8 or more.

    Documents without an id can't be compared and stay, as do null and empty texts, which have
    no shingles. Rows that repeat an id are one document, of which the row with the least hash
    of its text stays. Columns of any name are kept; an empty table stays empty.
    """
    known = docs.filter("doc_id is not null")
    copies = near_duplicates(known, shingle=5, percent=80).filter("not kept").select("doc_id").distinct()
    kept = known.join(copies, "doc_id", "left_anti").select(*columns(docs))
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*columns(docs)), F.xxhash64("text")).alias("one")).select(*(F.col("one")[c].alias(c) for c in docs.columns))
    return one.unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows are searched each by itself. Without items
    all stay. Columns of any name are kept; an empty table stays empty.
    """
    leaks = unused("_leaks", docs)
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks)
    return found.filter(F.size(leaks) == 0).select(*columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, sources weighing 5, 2, 1 in turn.

    Null and empty texts have no words, and come as often as their source is repeated. A null
    source is one, and repeated rows are documents of their own. Columns of any name are kept;
    an empty table stays empty.
    """
    copy = unused("_copy", docs)
    mixed = mix(docs.select(F.struct(*columns(docs)).alias("own"), "doc_id", "source", "text"))
    times = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.select("own", F.explode(times).alias(copy)).select("own.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token shards, and from them where each document's ids are.

    Null and empty texts are their end id alone; repeated rows are documents of their own, in
    order of a hash of the text, and documents without an id come last. Other columns than
    doc_id and text are left out; an empty table gives an empty result.
    """
    path = Scratch(spark).root
    write_shards(docs, path, tokenizer_path())
    return read_documents(spark, path)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Trained models, sketches and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each result written as Parquet and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
