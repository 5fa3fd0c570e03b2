"""A table of a stream's micro-batches that readers see once each, whole or not at all.

The rows of a micro-batch are written below its number, then a commit row for that
number. A job that fails between the two, or before the stream's own checkpoint,
writes the same number again, in place of the first. Readers take the numbers that
have a commit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from txguard.sources.files import read_or_empty

BATCH = "batch"


@dataclass(frozen=True)
class Committed:
    """Rows of one query below ``root``; a column ``batch`` tells the micro-batch."""

    spark: SparkSession
    root: str

    def write(self, df: DataFrame, number: int) -> None:
        """Store micro-batch ``number``, which can be given again; the commit comes last."""
        df.write.mode("overwrite").parquet(f"{self.root}/rows/{BATCH}={number}")
        done = self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.root}/commits/{BATCH}={number}")

    def commits(self) -> DataFrame:
        """(``at``, ``batch``) of the micro-batches that are whole."""
        return read_or_empty(self.spark, f"{self.root}/commits", f"at timestamp, {BATCH} long")

    def read(self, schema: str) -> DataFrame:
        """The rows of all whole micro-batches."""
        rows = read_or_empty(self.spark, f"{self.root}/rows", f"{schema}, {BATCH} long")
        return rows.join(self.commits(), BATCH, "left_semi")

    def newest(self, schema: str, keys: Sequence[str]) -> DataFrame:
        """Of each group the row of its last micro-batch, for streams that write groups again when they change."""
        values = [c for c in read_or_empty(self.spark, f"{self.root}/rows", schema).columns if c not in keys]
        last = F.max_by(F.struct(*values), BATCH).alias("_last")
        return self.read(schema).groupBy(*keys).agg(last).select(*keys, "_last.*")


def changed_groups(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer of an aggregated stream that hands only the groups that a micro-batch changed to ``write``."""
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
