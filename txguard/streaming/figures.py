"""What became of the messages of each micro-batch: rejected, late, repeated or passed on.

Counts of rows are observed where they pass, without a pass of their own. Rows that
came after the watermark, and repeats, are counted by the operator that drops them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from txguard.sources.codec import split_decodable
from txguard.streaming.dedup import drop_repeats

SCHEMA = "query string, batch long, arrived long, rejected long, late long, repeated long, passed long"


def counted_rows(messages: DataFrame, watermark: str = "24 hours", combine_first: bool = False) -> DataFrame:
    """The usable rows of a stream of messages, each transaction once, with counts on the way."""
    seen = messages.observe("messages", F.count(F.lit(1)).alias("arrived"))
    usable, _ = split_decodable(seen)
    usable = usable.observe("usable", F.count(F.lit(1)).alias("rows"))
    once = drop_repeats(usable, watermark=watermark, combine_first=combine_first)
    return once.observe("once", F.count(F.lit(1)).alias("rows"))


def figures_of(progress: Mapping[str, Any]) -> tuple:
    """A row of SCHEMA from the progress of one micro-batch of ``counted_rows``."""
    counts = progress["observedMetrics"]

    def count(name: str, of: str) -> int:
        found = counts.get(name)
        return 0 if found is None else (found.asDict() if hasattr(found, "asDict") else dict(found)).get(of) or 0

    late = repeated = 0
    for operator in progress["stateOperators"]:
        late += operator["numRowsDroppedByWatermark"]
        repeated += operator["customMetrics"].get("numDroppedDuplicateRows", 0)
    arrived, usable = count("messages", "arrived"), count("usable", "rows")
    name = str(progress["name"] or progress["id"])
    return name, progress["batchId"], arrived, arrived - usable, late, repeated, count("once", "rows")


def figures(spark: SparkSession, queries: Sequence[StreamingQuery]) -> DataFrame:
    """The figures of the last micro-batches of queries, as many as Spark keeps."""
    return spark.createDataFrame([figures_of(p) for q in queries for p in q.recentProgress], SCHEMA)


class FigureLog(StreamingQueryListener):
    """Hands the figures of every finished micro-batch to ``write(row)``; for ``spark.streams.addListener``."""

    def __init__(self, write: Callable[[tuple], None]) -> None:
        self.write = write

    def onQueryStarted(self, event: Any) -> None:
        """Nothing to count yet."""

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        names = ("name", "id", "batchId", "observedMetrics")
        plain = {n: getattr(progress, n) for n in names}
        plain["stateOperators"] = [
            {"numRowsDroppedByWatermark": o.numRowsDroppedByWatermark, "customMetrics": dict(o.customMetrics)}
            for o in progress.stateOperators
        ]
        self.write(figures_of(plain))

    def onQueryIdle(self, event: Any) -> None:
        """Nothing came."""

    def onQueryTerminated(self, event: Any) -> None:
        """All figures have been handed on."""
