"""Documents to token ids: five stages, each written and read again as the next one's documents.

Stages keep all columns, whatever their names; an empty table gives an empty one.  A null text passes the first two stages
as it is, counts as empty for near copies (of all empty texts one stays), has no words for the benchmark and null ids at
the end.  Rows with a null id stay until the end.  Of rows that repeat an id the third stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, lines, pieces, quality, simhash
from claimloom.llm.common import table, written
from claimloom.llm.queries import model_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those without ratings are judged like all others."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go."""
    return lines.deduplicated(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the spans that they share with benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its id and, where it has them, its language and source."""
    return pieces.encode(docs, model_path(), keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", encode_stage),
]

#: SQL expresses neither the fitted classifier nor the encoder; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
