"""Building blocks that keep any single key from becoming a single task.

A key may hold a large share of all rows. The functions here find such keys,
join them without moving the large side, and compute ordered prefix sums and
positions over range partitions, whose borders fall inside a key when it is
large, instead of over one task per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txguard.session import reliable

# More heavy keys than this are kept as a table instead of being broadcast.
BROADCAST_KEYS = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024
CHUNK = "_chunk"


def fits_broadcast(table: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """Whether ``table`` has at most ``max_rows`` rows and ``max_bytes`` bytes of values; rows are counted where they are."""
    width = reduce(Column.__add__, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns])
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(width.cast("long")).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= (max_bytes or BROADCAST_BYTES)


@dataclass(frozen=True)
class HeavySplit:
    """Rows of ordinary keys, rows of heavy keys, and the heavy keys (None if there are none)."""

    light: DataFrame
    heavy: DataFrame | None = None
    keys: DataFrame | None = None
    few: bool = True


def split_heavy(df: DataFrame, keys: Sequence[str], max_rows: int, also: Column | None = None) -> HeavySplit:
    """Separate the rows of keys with more than ``max_rows`` rows, or with a row for which ``also`` holds.

    Null keys count as ordinary.

    Counting combines on the map side, so a heavy key costs one row per input
    task. At most (all rows / max_rows) keys are heavy. Up to ``BROADCAST_KEYS``
    of them are broadcast; more are kept as a table and joined by shuffle, where
    adaptive execution splits oversized partitions.
    """
    named = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    counted = (
        df.where(named)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(F.lit(False) if also is None else also).alias("_also"))
        .where((F.col("_rows") > max_rows) | F.col("_also"))
        .select(*keys)
    )
    found = counted.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return HeavySplit(df)
    size = sum(len(str(value).encode()) for row in found for value in row)
    few = len(found) <= BROADCAST_KEYS and size <= BROADCAST_BYTES
    if few:
        table = F.broadcast(df.sparkSession.createDataFrame(found, counted.schema))
    else:
        table = reliable(counted)
    return HeavySplit(
        light=df.join(table, list(keys), "left_anti"),
        heavy=df.join(table, list(keys), "left_semi"),
        keys=table,
        few=few,
    )


def left_join_skewed(left: DataFrame, right: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Left join to a table that is unique in ``keys``, when ``left`` may be skewed in them.

    The partners of heavy keys are at most as many as the heavy keys. Unless they
    are very wide, they are broadcast and the heavy rows stay where they are. The
    rest is a plain join, left to the optimizer.
    """
    parts = split_heavy(left, keys, max_rows)
    if parts.heavy is None or not parts.few:
        return left.join(right, list(keys), "left")
    partners = right.join(parts.keys, list(keys), "left_semi")
    if fits_broadcast(partners, BROADCAST_KEYS):
        partners = F.broadcast(partners)
    return parts.light.join(right, list(keys), "left").unionByName(parts.heavy.join(partners, list(keys), "left"))


def ordered_chunks(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Range partition ``df`` by ``order`` and name each row's partition in ``_chunk``.

    Chunk numbers rise with the order. The borders come from sampling, so the
    result is written to the shared folder: every later reader, also after a
    lost executor, sees the same borders.
    """
    by = list(order)
    ranged = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    return reliable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running_sums(
    chunked: DataFrame, order: Sequence[str | Column], values: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Replace each value column by its running sum over the rows strictly before, per group.

    ``chunked`` comes from ``ordered_chunks`` by (group, order) and holds no two
    rows of a group that are equal in the order. One short pass sums each chunk,
    a second adds the sums of earlier chunks to the running sums inside each.
    Sums keep the type of their column.
    """
    place = [*group, CHUNK]
    earlier = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kind = {v: chunked.schema[v].dataType for v in values}

    def summed(v: str, frame: WindowSpec) -> Column:
        return F.coalesce(F.sum(v).over(frame), F.lit(0)).cast(kind[v])

    offsets = (
        chunked.groupBy(*place)
        .agg(*[F.sum(v).cast(kind[v]).alias(v) for v in values])
        .select(*place, *[summed(v, earlier).alias(f"_before_{v}") for v in values])
    )
    total = {v: (summed(v, inside) + F.col(f"_before_{v}")).cast(kind[v]) for v in values}
    return chunked.join(offsets, place).withColumns(total).select(*chunked.columns)


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, … in a total order, without bringing them together."""
    counted = ordered_chunks(df, order).withColumn(name, F.lit(1).cast("long"))
    return running_sums(counted, order, [name]).drop(CHUNK)
