"""Dropping repeated transactions from a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.scalar import computed_once


def drop_repeats(
    stream: DataFrame,
    key: Sequence[str] = ("transaction_id",),
    time: str = "timestamp",
    watermark: str = "24 hours",
    combine_first: bool = False,
) -> DataFrame:
    """The first row per key within the watermark.

    Rows without a complete key, or without a time, cannot be told to be repeats:
    they all pass, beside the suppression.

    With ``combine_first`` repeats inside one Arrow batch are dropped before
    the shuffle, so a key that makes up much of a micro-batch sends only one
    row per batch of its input tasks to the task that holds the key. Otherwise
    the rows are spread first, and that shuffle serves both kinds of rows: the
    stream is read, and its messages parsed, once.
    """
    names = list(key)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*names, time]])
    if combine_first:

        def first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.drop_duplicates(names)

        rows, others = stream.where(complete).mapInPandas(first_of_batch, stream.schema), ~complete
    else:
        # Rows only pass here, so fewer parts than the state has will do; not all cores may be there yet.
        spark = stream.sparkSession
        stream = stream.repartition(
            max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        )
        # Plain filters would be moved below the shuffle, which then could not serve both kinds of rows.
        rows, others = stream.where(computed_once(complete)), computed_once(~complete)
    once = rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(names)
    # Its watermark follows all rows: the earliest watermark of a query counts.
    return once.unionByName(stream.withWatermark(time, watermark).where(others))
