"""The corpus pipeline: documents in, id shards out, in five stages, each written and read again as the next one's documents.

Part of the training-data subpackage; only the last stage returns other columns than those of documents. Other columns of the input are
not carried, whatever their names. Every stage gives an empty result for an empty table; rows with a null in lang, source or n_chars pass
like others. What odd ids and texts give, each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontam, id_shards, mixing, near_dup, quality
from lamella.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio; the model is fitted on this stage's own input.

    Null, empty and blank texts fail, as texts of under 50 words do; very long ones are judged whole; repeated rows all stay or all go; rows without an id are judged like others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.rate(docs, labels, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, those without an id last. A document is told by a 64-bit hash of id and text, and is kept once.

    Texts without words are in no group: each id's stays, once. Unlike texts of one id are documents of their own; of rows that tie, which are equal in id and text, one stays.
    """
    d = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))
    groups = near_dup.near_duplicates(d, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = d.select("row_key", "doc_id").distinct()
    first = F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("row_key")
    keep = groups.join(ids, "row_key").groupBy("component_id").agg(first).select("row_key")
    return d.join(keep, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; repeated rows all stay or all go; whole texts are searched."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share asks for. A null source is one of its own; rows with equal ids, null included, draw alike; texts are not looked at."""
    return mixing.mix(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id shards of all documents, and from them the place, size and checksum of each. Null and empty texts are the end id alone; null ids come first; repeated rows each have their place."""
    return id_shards.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: Tokenisation and hashed models are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each stored as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
