"""From raw documents to token ids in five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm import bpe, decontaminate, quality, simhash, substrings
from treediff.llm.common import read, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null, empty and blank texts have fewer than 50 words and go; repeated rows
    are judged alike; null ids and other nulls change nothing; columns beyond
    those of documents go; an empty table gives no rows.
    """
    return quality.keep(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest doc_id.

    Rows that share that id and its text stay once; a row that shares the id and
    is of another component is judged by its own; rows without an id all stay.
    Null and blank texts are one component; an empty table gives no rows.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that the corpus has elsewhere too.

    A text that loses nothing stays as it is (nulls and empty ones too); one that
    loses words has the kept ones, joined by spaces, and their number of
    characters. Documents of which nothing is left go: rows that are repeated
    and have 35 words or more do. An empty table gives no rows.
    """
    out = substrings.remove_repeats(docs.select(*COLUMNS), replace=True)
    removed = F.col(out.columns[-1])
    n_chars = F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where((removed == 0) | (F.col("text") != "")).withColumn("n_chars", n_chars).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    Null and empty texts contain none and stay; rows without an id are judged by
    their texts alone; repeated rows stay or go together; an empty table gives no
    rows, and an empty benchmark takes none away.
    """
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded text.

    A null text counts as empty and has no ids; repeated rows give repeated rows;
    an empty table gives no rows.
    """
    coded = bpe.encode(docs, bpe.default_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_ids),
]

#: SQL can't express SimHash components and BPE: tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows in the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
