"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, long repeats are cut, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import stages
from factloom.llm.common import cut, table

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("suffix_array_dedup", stages.cut_repeats),
    ("source_mixing", stages.mix_sources),
    ("sentencepiece", stages.tokenize),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
