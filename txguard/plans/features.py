"""The feature rows of training and scoring, built from one definition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from txguard.functions.scalar import add_calendar, add_serving_placeholders
from txguard.operators.activity import MAX_USER_ROWS, add_activity
from txguard.operators.patterns import add_merchant_risk
from txguard.operators.quality import require_columns
from txguard.schemas import LABEL, RISKY_MERCHANTS, SCORING_COLUMNS, TRAINING_FEATURES


def add_features(
    df: DataFrame,
    risky: Sequence[str] | DataFrame = RISKY_MERCHANTS,
    mode: str = "computed",
    max_user_rows: int | None = MAX_USER_ROWS,
) -> DataFrame:
    """All features of a transaction table.

    ``computed`` takes the per-user features from each user's earlier rows.
    ``placeholder`` puts constants in their place and also works on a stream.
    """
    base = add_merchant_risk(add_calendar(df), risky)
    if mode == "placeholder":
        return add_serving_placeholders(base)
    if mode != "computed":
        raise ValueError(f"unknown feature mode {mode!r}")
    return add_activity(base, max_user_rows)


def training_rows(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The training features and the label, and ``extra`` columns such as the id."""
    require_columns(features, [LABEL])
    return features.select(*extra, *TRAINING_FEATURES, LABEL)


def scoring_rows(features: DataFrame, columns: Sequence[str] = SCORING_COLUMNS) -> DataFrame:
    """The columns a scorer receives: the given list, or the one saved with its model."""
    return features.select(*columns)
