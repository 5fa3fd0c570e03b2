"""Per-row features: calendar flags, merchant risk and ratios."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.schemas import RISKY_MERCHANTS


def computed_once(value: Column) -> Column:
    """``value`` itself, for columns that are costly to compute.

    A filter on a column is moved below the projection that makes it and then
    computes it a second time, with all that it is made from. It stays above a
    projection that is not deterministic, which the always true test makes it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def transaction_hour(time: Column) -> Column:
    return F.hour(time)


def is_night(time: Column) -> Column:
    """1 from 22:00 until 05:00, else 0; 0 without a time."""
    hour = F.hour(time)
    return F.when((hour >= 22) | (hour < 5), 1).otherwise(0)


def is_weekend(time: Column) -> Column:
    """1 on Saturday and Sunday, else 0; 0 without a time."""
    return F.when(F.dayofweek(time).isin(1, 7), 1).otherwise(0)


def transaction_day(time: Column) -> Column:
    return F.dayofmonth(time)


def merchant_risk(merchant: Column, risky: Iterable[str] = RISKY_MERCHANTS) -> Column:
    """1 for a merchant of the list, else 0; 0 without a merchant."""
    return F.coalesce(merchant.isin(list(risky)), F.lit(False)).cast("int")


def ratio_or_one(amount: Column, average: Column) -> Column:
    """amount / average; 1.0 where that has no value, also for a zero average."""
    return F.coalesce(F.try_divide(amount, average), F.lit(1.0))


def ratio_to_own_average(amount: Column, average: Column) -> Column:
    """amount / average by floating-point rules; 1.0 where that is not a number.

    Other than ``ratio_or_one`` a non-zero amount over a zero average is
    infinite, which happens only where negative amounts cancel out.
    """
    unlimited = F.when(amount == 0, F.lit(1.0)).otherwise(F.signum(amount) * F.lit(float("inf")))
    return F.coalesce(F.when(average == 0, unlimited).otherwise(F.try_divide(amount, average)), F.lit(1.0))


_DAY_AND_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?"
_ZONE = r"([Zz]|[+-]\d{2}:\d{2})"


def is_date_time(text: Column, zone_required: bool = True) -> Column:
    """Whether a text has the form of an RFC 3339 date-time; a bare year, day or time has not."""
    return text.rlike(_DAY_AND_TIME + _ZONE + ("$" if zone_required else "?$"))


def iso_timestamp(text: Column) -> Column:
    """A date and time as text to a timestamp; bad text raises. A zone in the text is honoured, UTC otherwise."""
    bad = F.concat(F.lit("not a date and time: "), text)
    return F.to_timestamp(F.when(is_date_time(text, False), text).otherwise(bad))


def iso_timestamp_or_null(text: Column) -> Column:
    """The same, with null for bad text."""
    return F.when(is_date_time(text, False), F.try_to_timestamp(text))


def whole_number(value: Column, kind: str = "bigint") -> Column:
    """A JSON number (a variant) as an integer: 1000 and 1000.0 alike; null for fractions and other kinds."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    exact = F.when(number, F.try_variant_get(value, "$", "decimal(38,9)"))
    return F.when(exact == F.floor(exact), exact.try_cast(kind))


def add_calendar(df: DataFrame, time: str = "timestamp") -> DataFrame:
    t = F.col(time)
    return df.withColumns(
        {
            "transaction_hour": transaction_hour(t),
            "is_night": is_night(t),
            "is_weekend": is_weekend(t),
            "transaction_day": transaction_day(t),
        }
    )


def add_serving_placeholders(
    df: DataFrame, activity: int = 1000, average: float = 1000.0, since_last: float = 0.0
) -> DataFrame:
    """Constants in place of the per-user features, for a scorer without history."""
    return df.withColumns(
        {
            "time_since_last_txn": F.lit(float(since_last)),
            "user_activity_24h": F.lit(activity).cast("long"),
            "rolling_avg_7d": F.lit(float(average)),
            "amount_to_avg_ratio": ratio_or_one(F.col("amount"), F.lit(float(average))),
        }
    )
