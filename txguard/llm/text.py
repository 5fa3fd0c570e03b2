"""Words and row identities, shared by the operators of this package."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.skew import fits_broadcast, left_join_skewed
from txguard.session import reliable, scratch_path

SEPARATORS = r"\x20\x09-\x0D"
WORD = f"[^{SEPARATORS}]+"
ROW = "__row"
HEAVY_ROWS = 100_000
DECISION_ROWS = 2_000_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]+"), lambda w: w != "")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a number that tells rows of the same ``doc_id`` apart.

    It comes from a row's place in its file, so it is the same each time the
    table is read, however its files are split. Rows that come from no file are
    numbered and kept in the shared folder.
    """
    try:
        numbered = docs.withColumn(ROW, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        numbered.schema  # noqa: B018
        return numbered
    except AnalysisException:
        return reliable(docs.withColumn(ROW, F.monotonically_increasing_id()))


def with_decisions(docs: DataFrame, decisions: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``docs`` to ``decisions``, which is unique in ``keys``.

    Decisions are broadcast if their size was found to be small; else the join is
    a shuffle in which the rows of frequent keys stay where they are.
    """
    if fits_broadcast(decisions, DECISION_ROWS):
        return docs.join(F.broadcast(decisions), keys, how)
    if how == "left":
        return left_join_skewed(docs, decisions, keys, HEAVY_ROWS)
    return docs.join(decisions, keys, how)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage, compressed and by column."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
