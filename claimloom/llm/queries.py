"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, licences, lines, pieces, private, quality, shards, simhash, substrings, topk
from claimloom.llm.common import table
from claimloom.llm.sql import SQL

SHARDS = 40


def model_path() -> str:
    """The public SentencePiece model; the path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    rounded = [F.round(c, 6).alias(c) for c in ("expected_grade", "p_at_least_1", "p_at_least_2")]
    return scored.select("doc_id", *rounded, (F.col("p_at_least_2") >= quality.LEAST).alias("kept"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.private_spans(table(spark, sf_dir, "documents"))
    names = [k for k, _, _ in private.PATTERNS]
    kinds = F.array(*[F.lit(k) for k in names], F.lit("term"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < len(names))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(names)]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["n"])), ",")
    return found.select("doc_id", "n_sentences", text.alias("licences"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), model_path())


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of each shard of op9_shards, which SQL can tell without the draw."""
    slots = op9_shards(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    return slots.select("shard", "n", "n_slots", "first", "last")


QUERIES = {f.__name__: f for f in (op1_ordinal, op2_simhash, op3_pii, op4_difference_cover, op5_licences, op6_fm_index, op7_suffix_array, op8_sentencepiece, op9_shards, op10_top_k, shard_counts)}
__all__ = ["QUERIES", "SQL", "model_path"]
