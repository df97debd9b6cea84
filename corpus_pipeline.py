"""A corpus pipeline: language filter, line deduplication, near-duplicate removal, substring deduplication, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame;
run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import stages

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_jaccard_join", stages.keep_one_of_each_group),
    ("suffix_array_dedup", stages.drop_repeated_passages),
    ("packing", stages.pack),
]

#: Language models, alignments and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
