"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents
go, one document of each near-duplicate class stays (the smallest id), repeated passages are cut out
of later documents, sources are drawn towards their weights, and what is left is encoded. Stages are
written as Parquet in the folder that the cluster shares and read again by the next.

Every stage takes an empty table, null texts and extra columns; all but the last return the columns
of the documents given.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.llm import bpe, jaccard, mixing, quality, suffixes
from tablegraph.llm.frame import quoted
from tablegraph.session import shared_folder


def columns_of(docs: DataFrame):
    return [quoted(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, labels).where("kept").select(*columns_of(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked documents."""
    others = jaccard.classes(docs).where("id <> component_id").select(F.col("id").alias("doc_id"))
    return docs.join(others, "doc_id", "left_anti").select(*columns_of(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of an earlier one; a document that is left without words goes.

    ``n_chars`` follows the text where that changes.
    """
    cut = suffixes.drop_passages(docs).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(
            F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, by output shard and shuffled inside it."""
    named = ("doc_id", "text")
    # The other columns travel in a struct, so that none meets a column of the mix.
    rest = F.struct(*[quoted(c) for c in docs.columns if c not in named]).alias("_rest")
    mix = mixing.mixed(docs.select(*named, "source", rest), carry=[*named, "_rest"])
    return mixing.written(mix).select(
        *[quoted(c) if c in named else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs.select("doc_id", "source", "text"), path).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

#: The cutoffs of the first stage, the draws of the fourth and the tokens of the last can't be said in
#: SQL. The tests hold the operators against brute-force versions, the stages only by expected ids and
#: columns, and the fourth by its order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
