"""The corpus pipeline: language, near duplicates, benchmark leaks, source weights, shards.

Documents have doc_id, text, lang, source and n_chars; all but the last stage return their columns. A null or blank text has
no language and goes in the first stage. Documents without an id or a source stay. Rows that are equal are copies, of which
one stays. Texts of any length are read whole by every stage, and empty tables pass through all of them. Extra columns travel along, but
for those that a stage adds itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.llm import decontaminate, langid, mixing, sharding, simhash
from reviewlens.llm.common import held_out, release, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    learnt = langid.learn(langid.training_rows(docs.select("doc_id", "text", "lang"), held_out(F.col("doc_id"))))
    return langid.keep_readable(docs, *learnt)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, with its own values or others, go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by temperature: every document at least once, those of small sources up to twice."""
    rows, _ = mixing.mix(docs, max_repeat=2.0)
    return rows.select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, with a place in the shard for every row."""
    return sharding.split_by_bytes(docs, shards=8)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_weights", source_weights),
    ("shards", shards),
]

#: A trained network and iterated searches have no SQL form; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
