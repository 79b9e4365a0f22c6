"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and
returns them again for the rows it keeps (the last adds token ids); between stages
the rows are written as Parquet and read again.  Rows whose ``doc_id`` is NULL or
repeated go through all stages like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystrata.llm import bpe, common, mixing, neardup, quality, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Sources and languages are tempered (share to the power 0.9); length classes keep their shares.
TARGETS: dict[str, mixing.Target] = {"source": 0.9, "lang": 0.9, "topic": 1.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list.

    NULL and empty texts have no words and fail the base rule; repeated rows are judged
    each; a document at a threshold follows the rule's comparison; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.fit(docs, labels, "doc_id", "text", "quality")
    return quality.judge(docs.select(*COLUMNS), "text", rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id.

    Rows that share that id and group are exact repeats or near ones; the one of
    the smallest text hash is kept.  Rows that share an id but no group are groups of their own.
    """
    return neardup.one_each(docs.select(*COLUMNS), "doc_id", "text")


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that also start elsewhere; documents that lose everything go.

    NULL, empty and blank texts have nothing to lose and stay; exact repeats lose all
    of 200 bytes and more; an empty table stays empty.
    """
    out = repeats.strip(docs.select(*COLUMNS), "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered sources and languages.

    NULL sources and languages are values of their own; NULL and empty texts have no
    tokens and share their cell's draw; repeated ids share a draw; an empty table stays empty.
    """
    rows = docs.select(*COLUMNS).withColumn("_tokens", mixing.word_count("text"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.length_topic(F.col("_tokens"))}
    return mixing.mix(rows, "doc_id", F.col("_tokens"), dims, TARGETS).where("kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text.

    NULL and empty texts have no tokens and decode to nothing; repeated rows are encoded
    each; an empty table stays empty.
    """
    at = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.decode(bpe.encode(docs.select(*COLUMNS), "text", "token_ids", *at), "token_ids", "decoded", *at)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_array),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: No SQL: the decision list is learned and the stages iterate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage_table(docs, f"stage{k}")
    return docs
