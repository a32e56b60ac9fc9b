"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet
to the shared folder and gives what it reads back to the next stage. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm import mixing, packing, pii, quality, simhash
from lociforge.llm.store import columns_of, free_name, materialise, ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    ship(spark)
    name = free_name(docs, "_ledger")
    held = quality.ledger(docs, name=name)
    return held.filter(quality.passes(F.col(name)["bits"], quality.PRODUCTION)).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; fingerprints within 3 bits link, and 5-word shingles with a Jaccard similarity from 0.8."""
    ship(spark)
    return simhash.one_of_each(docs, resembling=True).select(*columns_of(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, disguised ones too, become their kinds in angle brackets; n_chars follows."""
    ship(spark)
    masked = docs.withColumn("text", pii.mask(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*columns_of(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150 % of all words, sources weighing 3, 1, 2 in turn and none taken more than twice."""
    ship(spark)
    return mixing.mixed_documents(docs, share=1.5, repeats=2)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a table directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Deduplication and tokens are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
