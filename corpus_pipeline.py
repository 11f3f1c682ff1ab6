"""The corpus pipeline: every stage reads what the one before it wrote.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of ``docs``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodframe.llm import bpe_automaton, decontaminate, line_dedup, quality_rules, simhash_ball
from moodframe.llm.common import written
from moodframe.llm.queries import tokenizer_path
from moodframe.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (operator 4): rejected documents go, and lines above the
    limit leave the other texts."""
    return quality_rules.cleaned_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 9): later three-line windows leave the texts."""
    return line_dedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 6): one document of each group stays."""
    return simhash_ball.one_per_group(docs, shingle=4, max_bits=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 1): affected documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding (operator 5) of every whole text, decoded again."""
    return bpe_automaton.token_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]
#: SQL can't express the fingerprints and the tokenizer; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
