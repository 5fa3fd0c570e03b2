"""Rule-based risk patterns and their summary."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.skew import fits_broadcast, left_join_skewed
from txguard.schemas import ANOMALY_LOCATIONS, RISKY_MERCHANTS

# The patterns, the first that holds names the row.
PATTERNS = ["account_takeover", "card_testing", "merchant_collusion", "geo_anomaly"]

# A membership table up to this size is broadcast.
BROADCAST_MEMBERS = 1_000_000
MAX_KEY_ROWS = 1_000_000


@dataclass(frozen=True)
class PatternRules:
    """The limits of the patterns unless configured otherwise."""

    takeover_amount: float = 500.0
    testing_amount: float = 2.0
    testing_user_step: int = 1000
    collusion_amount: float = 300.0
    geo_user_step: int = 500
    risky_merchants: Sequence[str] | DataFrame = tuple(RISKY_MERCHANTS)
    anomaly_locations: Sequence[str] = tuple(ANOMALY_LOCATIONS)


def flag_members(df: DataFrame, members: DataFrame | Iterable[object], column: str, flag: str) -> DataFrame:
    """Add a boolean: is ``column`` among ``members`` (a list, or a table with that column)?

    A table of checked size is broadcast. A larger one is joined by shuffle
    with the frequent keys of ``df`` kept in place; on a stream, where keys
    cannot be counted ahead, the optimizer's join is used.
    """
    if not isinstance(members, DataFrame):
        return df.withColumn(flag, F.coalesce(F.col(column).isin(list(members)), F.lit(False)))
    table = members.select(column).where(F.col(column).isNotNull()).distinct().withColumn(flag, F.lit(True))
    if fits_broadcast(table, BROADCAST_MEMBERS):
        joined = df.join(F.broadcast(table), [column], "left")
    elif df.isStreaming:
        joined = df.join(table, [column], "left")
    else:
        joined = left_join_skewed(df, table, [column], MAX_KEY_ROWS)
    return joined.select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def add_merchant_risk(df: DataFrame, risky: DataFrame | Iterable[str] = RISKY_MERCHANTS) -> DataFrame:
    """Add ``merchant_risk``: 1 for a merchant of the list or table (column ``merchant``), else 0."""
    return flag_members(df, risky, "merchant", "merchant_risk").withColumn("merchant_risk", F.col("merchant_risk").cast("int"))


def account_takeover(compromised: Column, amount: Column, rules: PatternRules) -> Column:
    return compromised & (amount > rules.takeover_amount)


def card_testing(user: Column, amount: Column, rules: PatternRules) -> Column:
    return (amount < rules.testing_amount) & (user % rules.testing_user_step == 0)


def merchant_collusion(risky: Column, amount: Column, rules: PatternRules) -> Column:
    return risky & (amount > rules.collusion_amount)


def geo_anomaly(user: Column, location: Column, rules: PatternRules) -> Column:
    return (user % rules.geo_user_step == 0) & location.isin(list(rules.anomaly_locations))


def tag_patterns(
    df: DataFrame, compromised: DataFrame | Iterable[int] = (), rules: PatternRules | None = None
) -> DataFrame:
    """Add a boolean per pattern, ``pattern`` (the first that holds, or null) and ``is_flagged``.

    The risky merchants of ``rules``, like the compromised users, are a list or a table.
    """
    rules = rules or PatternRules()
    known = flag_members(df, compromised, "user_id", "_compromised")
    known = flag_members(known, rules.risky_merchants, "merchant", "_risky")
    user, amount = F.col("user_id"), F.col("amount")
    holds = {
        "account_takeover": account_takeover(F.col("_compromised"), amount, rules),
        "card_testing": card_testing(user, amount, rules),
        "merchant_collusion": merchant_collusion(F.col("_risky"), amount, rules),
        "geo_anomaly": geo_anomaly(user, F.col("location"), rules),
    }
    tagged = known.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in holds.items()})
    first = F.coalesce(*[F.when(F.col(name), F.lit(name)) for name in PATTERNS])
    return tagged.drop("_compromised", "_risky").withColumn("pattern", first).withColumn("is_flagged", first.isNotNull())


def users_summed(tagged: DataFrame) -> DataFrame:
    """Rows and amount per (pattern, user); rows without a pattern count as ``none``. For tables and streams."""
    named = F.coalesce("pattern", F.lit("none"))
    return tagged.groupBy(named.alias("pattern"), "user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")
    )


def pattern_summary(tagged: DataFrame) -> DataFrame:
    """Rows, amount and users per pattern.

    Users are reduced to one row per (pattern, user) first, which combines on
    the map side, so neither a large pattern nor a large user meets one task.
    """
    return sum_users(users_summed(tagged))


def sum_users(per_user: DataFrame) -> DataFrame:
    """The sums of ``users_summed`` per pattern."""
    return per_user.groupBy("pattern").agg(
        F.sum("rows").alias("rows"),
        F.sum("amount").alias("amount"),
        F.count("user_id").alias("users"),
    )
