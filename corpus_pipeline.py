"""A corpus pipeline: toxicity, quality rules, near-duplicates, benchmark decontamination, SentencePiece.

Every stage works on all that its predecessor kept and writes its result; the last one returns token ids. Null and
empty texts are kept by the toxicity stage (a text without words scores low) and go with the quality rules, which want
50 words. Rows that repeat a doc_id are judged each by its own text, and of equal rows one stays. Columns besides those
of documents are passed through by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import Scratch, released
from loomgraph.llm.decontaminate import drop_contaminated
from loomgraph.llm.neardup import drop_near_duplicates
from loomgraph.llm.pieces import encode_documents
from loomgraph.llm.quality import keep_good
from loomgraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic. The model learns from the documents at hand that are labelled and not held out."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far from their language's and source's centre."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the least doc_id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """[doc_id, token_ids, n_tokens, round_trip] of what is left."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Models and automata can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage has read, and what it wrote on the way, is deleted when its result is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return docs
