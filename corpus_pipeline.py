"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
sources are mixed to their target weights, and every document that is left gets its shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandspark.llm import decontaminate, mixing, sharding, simhash, toxicity
from demandspark.llm.store import remainder, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; nothing is learned from held-out labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.accepted(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op5's near-duplicates: fingerprints linked at 2 or fewer
    differing bits by its bit-sliced search, the smallest doc_id of each component kept."""
    return simhash.one_of_each(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that is raked to the target weights of source, language and topic."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.with_shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Toxicity and fingerprints are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
