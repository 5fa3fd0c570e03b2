"""A corpus pipeline over ``documents``: its stages call the operators of ``txguard.llm``.

Quality classifier, near-duplicates, repeated passages, mix of sources, packing.
All stages but the last return the columns of ``documents``; each works on all that
the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txguard.llm import mixing, packing, quality, simhash, substrings
from txguard.llm.queries import byte_bpe, table
from txguard.llm.text import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, taught by ``labels``, accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that the SimHash operator links."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that stand in an earlier one."""
    return substrings.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return packing.packed(docs, byte_bpe()).drop("ids")


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing_sources", mix),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
