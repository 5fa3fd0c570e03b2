"""The scoring stream: messages in, alerts out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from txguard.functions.scalar import add_calendar
from txguard.operators.activity import MAX_USER_ROWS
from txguard.operators.patterns import add_merchant_risk
from txguard.plans.features import add_features
from txguard.plans.scoring import alerts
from txguard.schemas import RISKY_MERCHANTS
from txguard.sources.codec import encode, split_decodable
from txguard.streaming.dedup import drop_repeats
from txguard.streaming.history import IDLE_DAYS, with_history

# Adds ``prediction`` to rows with features.
Scorer = Callable[[DataFrame], DataFrame]


def alert_rows(
    messages: DataFrame, scorer: Scorer, risky: Sequence[str] | DataFrame = RISKY_MERCHANTS, watermark: str = "24 hours"
) -> DataFrame:
    """Decode, add features without history, score, and keep the alerts. Works on streams and tables.

    Messages without any usable field are not scored; ``rejected_messages`` gives them.
    """
    rows, _ = split_decodable(messages)
    if rows.isStreaming:
        rows = rows.withWatermark("timestamp", watermark)
    return alerts(scorer(add_features(rows, risky, mode="placeholder")))


def rejected_messages(messages: DataFrame) -> DataFrame:
    """The messages that are not scored, for a quarantine sink."""
    _, rejected = split_decodable(messages)
    return rejected


def alert_messages(
    messages: DataFrame, scorer: Scorer, risky: Sequence[str] | DataFrame = RISKY_MERCHANTS, watermark: str = "24 hours"
) -> DataFrame:
    """The alerts as (key, value) rows for a topic."""
    return encode(alert_rows(messages, scorer, risky, watermark))


def alerts_with_history(
    messages: DataFrame,
    scorer: Scorer,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    risky: Sequence[str] | DataFrame = RISKY_MERCHANTS,
    watermark: str = "24 hours",
    max_user_rows: int | None = MAX_USER_ROWS,
    idle_days: float = IDLE_DAYS,
    slices: int = 1,
) -> DataStreamWriter:
    """Score with the users' real activity, the features that a model is trained on.

    Repeated messages are dropped before they can count in anyone's history.
    ``write(alerts, number)`` gets the alert rows of each micro-batch; after a
    failure it may get those of the same number again.
    """
    decoded, _ = split_decodable(messages)
    once = drop_repeats(decoded, watermark=watermark)
    rows = add_merchant_risk(add_calendar(once), risky)

    def sink(features: DataFrame, number: int) -> None:
        write(alerts(scorer(features)), number)

    return with_history(rows, sink, checkpoint, max_user_rows, idle_days, slices)
