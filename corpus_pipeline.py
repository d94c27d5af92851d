"""Corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``docs`` unchanged. Defined for every stage:
rows with nulls in any column stay unless the stage's own decision drops them;
a null text counts as empty; an empty table gives an empty result; other
columns pass through whatever their names. Rows that repeat as a whole are
copies: the exact-dedup stage leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vireo.llm import exact, mixing, packing, quality, simhash
from vireo.llm.common import keep_rows, keyed, pick, table
from vireo.llm.registry import TARGETS, TOKENIZER, domains
from vireo.session import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score 0.5 or more)."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels"), "quality"), 0.5)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are identical after lower-casing A-Z, the row with the largest doc_id."""
    found = exact.exact_duplicates(keyed(docs), keys=("doc_id", "key"))
    return keep_rows(docs, found.where("kept"), once=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints at 4 bits or fewer, the one with the smallest doc_id."""
    found = simhash.near_duplicates(keyed(docs), shingle=4, max_bits=4, keys=("doc_id", "key"))
    return keep_rows(docs, simhash.representatives(found), once=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out to the target weights, by chance in proportion to their rates."""
    labelled = domains(table(spark, sf_dir, "labels")).join(pick(docs, "doc_id").distinct(), "doc_id", "left_semi")
    mixed = mixing.mix(keyed(docs), labelled, TARGETS, keys=("doc_id", "key"))
    return keep_rows(docs, mixing.thinned(mixed), once=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids, with their ids."""
    return packing.pack(docs, TOKENIZER, 2048)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# models, fingerprints and tokenizers are beyond SQL; tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
