"""A corpus from documents to packed sequences: each stage is one operator of pgq.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pgq.llm import common, mixing, packing, simhash, suffix_dedup, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", simhash.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mix", mixing.stage),
    ("pack", packing.stage),
]
#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force on small tables instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each one returns is written and read again, and what it no longer needs removed.

    Defined results: those of each stage's operator for nulls, empty and very long texts, ties and repeated rows; extra
    columns pass through all stages but the last; an empty table gives no rows."""
    docs, mark = common.table(spark, sf_dir, "documents"), common.made()
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.remove_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
