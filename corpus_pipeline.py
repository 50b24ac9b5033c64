"""From raw documents to packed token sequences; part of the subpackage llm.

Every stage takes what its predecessor kept, written as Parquet and read again.

1. toxicity: documents that score 0.7 or more go.
2. exact: of equal texts the row with the largest id stays.
3. near: of the near-duplicates of a group the document with the smallest id stays. Stages on word
   shingles take five words and a similarity of 0.8: documents link if their sets of distinct
   shingles have it. Candidates differ in 72 or fewer of 256 bits (sets of similarity 0.8 in 39 on
   average, with a standard deviation of 6) and have counts of shingles with a ratio of 0.8 or more.
4. mixing: every document is repeated, or left out, as its source's target weight says.
5. packing: the pieces of 4096-token sequences, with their ids.

SQL can express neither the learned nor the hashed stages, so ORACLE_SQL is None; the tests compare
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolemeter.llm import exact, mixing, packing, simhash, toxicity
from rolemeter.llm.shared import shipped, table
from rolemeter.operators.layout import stored

NEAR = {"words": 5, "parts": 4, "radius": 72, "ratio": 0.8, "distinct": True, "exact": True}


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@shipped
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, **NEAR)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
