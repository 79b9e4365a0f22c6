"""The contract queries of the corpus operators: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, flac, licenses, lm, mixing, neardup, quality, repeats, token_count, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by byte_bpe_50k.json, and whether they pass 512."""
    import public_tokenizers as tokenizers

    counts = token_count.token_counts(_documents(spark, sf_dir), "doc_id", "text", tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text by context mixing, beside the unigram base."""
    return lm.scores(spark, _documents(spark, sf_dir), "doc_id", "text")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text, and the learned decision list's verdict."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rules = quality.fit(docs, _labels(spark, sf_dir), "doc_id", "text", "quality")
    out = quality.judge(docs, "text", rules)
    stats = [F.col(f"_ps_stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *stats, "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of the chain's categories for every whole text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.fit(docs, _labels(spark, sf_dir), "doc_id", "text", "toxic")
    return toxicity.score(docs, "text", chain).drop("text").withColumnsRenamed({"is_toxic": "toxic", "is_severe": "severe"})


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that lie in repeated 200-byte strings, and what is left."""
    return repeats.report(_documents(spark, sf_dir), "doc_id", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded bytes."""
    import public_tokenizers as tokenizers

    at = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, "text", "ids", *at).drop("text"), "ids", "decoded", *at)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every whole text."""
    return neardup.near_duplicates(_documents(spark, sf_dir), "doc_id", "text")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every whole text as a FLAC stream, read it back, and describe both."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    back = flac.load(flac.store(docs, "text").drop("text"), "media")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every whole text and of its lines, looked up among known licenses."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs, "text").select("doc_id", "text_digest", "license_id", "n_license_lines", "line_licenses")


#: Equal sources, fixed languages, more long texts.
MIX_TARGETS: dict[str, mixing.Target] = {
    "source": {"other": 1.0},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2, "other": 0.05},
    "topic": {"short": 0.2, "medium": 0.5, "long": 0.3},
}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rake tokens to source, language and length marginals; a keep decision for every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", "lang", mixing.word_count("text").alias("n"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.length_topic(F.col("n"))}
    out = mixing.mix(docs, "doc_id", F.col("n"), dims, MIX_TARGETS)
    return out.select("doc_id", "cell_source", "cell_lang", "cell_topic", "tokens", F.round("keep_prob", 6).alias("keep_prob"), "kept")


QUERIES = {"op1_token_count": op1_token_count, "op2_lm_score": op2_lm_score, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_suffix_array": op5_suffix_array, "op6_bpe": op6_bpe, "op7_licenses": op7_licenses, "op8_near_duplicates": op8_near_duplicates, "op9_flac": op9_flac, "op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {"op7_licenses": licenses.sql(), "op10_mixing": mixing.sql(MIX_TARGETS)}
