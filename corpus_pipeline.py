"""A corpus pipeline over documents: each stage reads what its predecessor wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() chains them with a written table in the shared folder between two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common
from sparkloom.llm.decontaminate import drop_leaks
from sparkloom.llm.language import keep_identified
from sparkloom.llm.mixing import mix_rows
from sparkloom.llm.near_duplicates import keep_one_of_class
from sparkloom.llm.pii import mask_pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or a likely language go."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates."""
    return keep_one_of_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each once, with the number of its repetitions as `repeats`."""
    return mix_rows(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The stages use trained models and hashes that SQL lacks; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote and read goes once its result is written.

    Only the last stage's tables stay, as the result still reads them.
    """
    docs, first = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        last = common.written()
        docs = common.staged(done, f"pipeline-{name}")
        common.cleared(spark, first, last)
        first = last
    return STAGES[-1][1](spark, docs, sf_dir)
