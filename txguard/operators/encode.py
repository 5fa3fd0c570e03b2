"""Ordinal codes of a text column as a table, for any number of categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.operators.skew import fits_broadcast, left_join_skewed, with_position
from txguard.session import reliable

UNKNOWN_CODE = -1.0
BROADCAST_CODES = 500_000
MAX_CATEGORY_ROWS = 1_000_000


@dataclass(frozen=True)
class OrdinalCodes:
    """Categories and their codes 0.0, 1.0, … in alphabetical order."""

    column: str
    table: DataFrame
    small: bool  # checked to fit a broadcast

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Add the code of ``column``; -1.0 for an unknown or missing category.

        A table of checked size is broadcast. A larger one is joined by
        shuffle, with the frequent categories kept in place.
        """
        name = name or f"{self.column}_code"
        codes = self.table.select(F.col(self.column), F.col("code").alias("_code"))
        if self.small:
            joined = df.join(F.broadcast(codes), [self.column], "left")
        elif df.isStreaming:
            joined = df.join(codes, [self.column], "left")
        else:
            joined = left_join_skewed(df, codes, [self.column], MAX_CATEGORY_ROWS)
        kept = [c for c in df.columns if c != name]
        return joined.select(*kept, F.coalesce("_code", F.lit(UNKNOWN_CODE)).alias(name))


def fit_codes(df: DataFrame, column: str) -> OrdinalCodes:
    """Number the distinct values of ``column`` alphabetically."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    table = with_position(values, [column]).select(column, F.col("position").cast("double").alias("code"))
    table = reliable(table)
    return OrdinalCodes(column, table, fits_broadcast(table, BROADCAST_CODES))
