from __future__ import annotations

import math
import random
import re
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from conftest import MIDDLE, by_id
from pyspark.sql import functions as F

from txguard.functions import scalar
from txguard.operators.activity import ACTIVITY_COLUMNS, add_activity
from txguard.plans.features import add_features, scoring_rows, training_rows
from txguard.schemas import SCORING_COLUMNS, TRAINING_FEATURES
from txguard.sources import tables
from txguard.sources.tables import events_as_transactions, orders_as_transactions


def test_night_and_day_borders(transactions):
    rows = transactions(
        ("a", 1, 1.0, None, "2024-01-05T21:59:59"),  # a Friday
        ("b", 1, 1.0, None, "2024-01-05T22:00:00"),
        ("c", 1, 1.0, None, "2024-01-06T04:59:59"),
        ("d", 1, 1.0, None, "2024-01-07T05:00:00"),
        ("e", 1, 1.0, None, "2024-01-08T00:00:00"),
        ("f", 1, 1.0, None, None),
    )
    found = by_id(scalar.add_calendar(rows), "transaction_hour", "is_night", "is_weekend", "transaction_day")
    assert found == {
        "a": (21, 0, 0, 5),
        "b": (22, 1, 0, 5),
        "c": (4, 1, 1, 6),
        "d": (5, 0, 1, 7),
        "e": (0, 1, 0, 8),
        "f": (None, 0, 0, None),
    }


def test_merchant_risk_of_risky_other_and_missing_merchants(transactions):
    rows = transactions(
        ("a", 1, 1.0, "QuickCash", None), ("b", 1, 1.0, "Corner Shop", None), ("c", 1, 1.0, None, None)
    )
    assert by_id(rows.withColumn("r", scalar.merchant_risk(F.col("merchant"))), "r") == {"a": 1, "b": 0, "c": 0}
    assert by_id(rows.withColumn("r", scalar.merchant_risk(F.col("merchant"), ["Corner Shop"])), "r")["b"] == 1


def test_ratios(spark):
    rows = spark.createDataFrame(
        [("a", 4.0, 2.0), ("b", None, 2.0), ("c", 0.0, 0.0), ("d", -3.0, 0.0), ("e", 3.0, None)],
        "transaction_id string, amount double, average double",
    )
    amount, average = F.col("amount"), F.col("average")
    assert by_id(rows.withColumn("r", scalar.ratio_or_one(amount, average)), "r") == {
        "a": 2.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0
    }
    assert by_id(rows.withColumn("r", scalar.ratio_to_own_average(amount, average)), "r") == {
        "a": 2.0, "b": 1.0, "c": 1.0, "d": -math.inf, "e": 1.0
    }


def test_iso_timestamps(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01T00:00:00+02:00"), ("b", "2024-01-01T00:00:00.123456")], "transaction_id string, text string"
    )
    found = by_id(rows.withColumn("t", F.unix_micros(scalar.iso_timestamp(F.col("text")))), "t")
    assert found == {"a": 1704060000000000, "b": 1704067200123456}
    bad = spark.createDataFrame([("soon",)], "text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        bad.select(scalar.iso_timestamp(F.col("text"))).collect()
    assert bad.select(scalar.iso_timestamp_or_null(F.col("text"))).first()[0] is None


GOLDEN = [
    ("a", 1, 10.0, None, "2024-01-01T00:00:00"),
    ("b", 1, 20.0, None, "2024-01-02T00:00:00"),  # exactly 24 h after a
    ("c", 1, None, None, "2024-01-02T12:00:00"),  # no amount
    ("d", 1, 30.0, None, "2024-01-02T12:00:00"),  # same time as c
    ("e", 1, 40.0, None, "2024-01-09T00:00:00"),  # exactly 7 d after b
    ("f", 2, 0.0, None, "2024-01-01T00:00:00"),  # zero average
    ("g", None, 5.0, None, "2024-01-01T00:00:00"),
    ("h", 1, 6.0, None, None),
]
EXPECTED = {
    "a": (0, 10.0, 1.0, 0.0, None),
    "b": (1, 15.0, 20 / 15, 86400.0, 10.0),
    "c": (1, 15.0, 1.0, 43200.0, 15.0),
    "d": (1, 20.0, 1.5, 0.0, 15.0),
    "e": (0, 25.0, 1.6, 561600.0, 25.0),
    "f": (0, 0.0, 1.0, 0.0, None),
    "g": (0, 5.0, 1.0, 0.0, None),
    "h": (0, 6.0, 1.0, 0.0, None),
}


@pytest.mark.parametrize("limit", [None, 1000, 1])
def test_activity_by_hand(transactions, limit):
    """The limits take the plain way, the plain way after a search, and the way of heavy users."""
    found = by_id(add_activity(transactions(*GOLDEN), limit), *ACTIVITY_COLUMNS)
    assert found.keys() == EXPECTED.keys()
    for key, values in EXPECTED.items():
        assert found[key] == pytest.approx(values), key


ODD_AMOUNTS = [1e13, 1.0, 2.0, 3.0, 1e-13, 2e-13, None, 0.1, math.nan, 5.0, math.inf, 1e16, -math.inf, -3.5, 0.0]


def _same(a, b):
    """Equal values, where null, NaN and the infinities are all different."""
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return type(a) is type(b) and a == b


def test_odd_amounts_have_one_definition_for_all_user_sizes(transactions):
    """Every odd amount alone, then many together, at equal and different times, more than a week apart too."""
    rows = []
    for n, amount in enumerate(ODD_AMOUNTS):
        times = ["2024-01-01T00:00:00", "2024-01-01T00:00:00", "2024-01-02T01:00:00", "2024-01-20T00:00:00"]
        rows += [(f"{n}-{k}", n, amount if k < 2 else 7.25, None, t) for k, t in enumerate(times)]
        rows.append((f"all-{n:02d}", 99, amount, None, f"2024-02-{1 + n // 4:02d}T{n % 4 * 6:02d}:00:00"))
        rows.append((f"late-{n:02d}", 99, 1.5, None, f"2024-02-{9 + n:02d}T00:00:00"))
    found = [by_id(add_activity(transactions(*rows), limit), *ACTIVITY_COLUMNS) for limit in (None, 20_000, 1)]
    assert len(found[0]) == len(rows)
    for key, values in found[0].items():
        for other in found[1:]:
            assert all(map(_same, values, other[key])), (key, values, other[key])
    assert found[0]["all-03"][1] == 2500000000001.5
    assert found[0]["5-3"][1] == pytest.approx((4e-13 + 14.5) / 4)
    assert math.isnan(found[0]["8-2"][4]) and found[0]["10-2"][4] == math.inf and found[0]["12-2"][4] == -math.inf


def _fraction_mean(amounts):
    """The mean of doubles by exact fractions, and by floating-point rules where one is no number."""
    values = [a for a in amounts if a is not None]
    if not values:
        return None
    odd = {str(v) for v in values if math.isnan(v) or math.isinf(v)}
    if odd:
        return math.nan if "nan" in odd or len(odd) > 1 else float(next(iter(odd)))
    return float(sum(map(Fraction, values)) / len(values))


@pytest.mark.parametrize("limit", [None, 3])
def test_means_are_exact_for_every_double(transactions, limit):
    """Amounts of all sizes in one frame, and their differences, against fractions; money in the fast way."""
    rng = random.Random(11)
    sizes = {
        1: [1e300, -1e300, 1e15, 1.0, 2.0, 1e-14, 1e-300, 5e-324, 0.1, -0.0, None, 1.7976931348623157e308, 1.7e308],
        2: [1e15, 1.0, 2.0, 1e-14, 1e16, -1e15, 3e22],
        3: [0.1, 0.2, 0.3, 19.99, 1e5, 0.01, 123456.78, -0.1, -19.99, 7e13, 2.0**-30],
        4: [math.nan, math.inf, -math.inf, 1e300, 5.0, None],
    }
    rows, times = [], {}
    for user, amounts in sizes.items():
        for n in range(60):
            hours = 5 * n if n < 30 else 5 * n + 24 * 20
            time = datetime(2024, 1, 1) + timedelta(hours=hours)
            key = f"{user}-{n:02d}"
            times[key] = (user, time, rng.choice(amounts))
            rows.append((key, user, times[key][2], None, time.isoformat()))
    found = by_id(add_activity(transactions(*rows), limit), "rolling_avg_7rows", "rolling_avg_7d")
    for key, (user, time, _) in times.items():
        mine = sorted((k, t, a) for k, (u, t, a) in times.items() if u == user)
        at = [k for k, _, _ in mine].index(key)
        expected = (
            _fraction_mean([a for _, _, a in mine[max(0, at - 6) : at + 1]]),
            _fraction_mean([a for _, t, a in mine if time - timedelta(days=7) <= t < time]),
        )
        for a, b in zip(found[key], expected, strict=True):
            # The sum is rounded once, and so is the quotient.
            assert _same(a, b) or (b is not None and math.isclose(a, b, rel_tol=2.3e-16)), (key, a, b)


def test_time_frames_only_grow(spark):
    plan = add_activity(events_as_transactions(spark, MIDDLE), None)._jdf.queryExecution().optimizedPlan().toString()
    frames = set(re.findall(r"RangeFrame, ([^,]+),", plan))
    assert frames == {"unboundedpreceding$()"}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_orders_of_a_large_customer_stay_apart(spark, monkeypatch, broadcast):
    """With broadcasts off, the shuffled join gets only the rows of the other customers."""
    monkeypatch.setattr(tables, "MAX_KEY_ROWS", 18)
    plain = by_id(orders_as_transactions(spark, MIDDLE), "user_id", "location")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = orders_as_transactions(spark, MIDDLE)
        assert by_id(rows, "user_id", "location") == plain
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and plan.index("LeftAnti") > plan.index("LeftOuter")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("table", [events_as_transactions, orders_as_transactions])
def test_heavy_users_get_the_same_values(spark, table):
    """One user owning a third of the rows and, in orders, many rows at one time."""
    rows = table(spark, MIDDLE)
    rows = rows.withColumn("user_id", F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0, 7).otherwise(F.col("user_id")))
    plain = by_id(add_activity(rows, None), *ACTIVITY_COLUMNS)
    split = by_id(add_activity(rows, 75), *ACTIVITY_COLUMNS)
    assert plain.keys() == split.keys()
    for key, values in plain.items():
        for a, b in zip(values, split[key], strict=True):
            assert a == b or math.isclose(a, b, rel_tol=1e-9), key


def test_activity_needs_one_exchange_and_one_sort(spark):
    plan = add_activity(events_as_transactions(spark, MIDDLE), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_activity_reads_only_its_columns(spark):
    rows = add_activity(events_as_transactions(spark, MIDDLE), None).select("transaction_id", "user_activity_24h")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan.split("ReadSchema")[1]
    assert plan.count("Window [") == 1


def test_feature_modes(transactions):
    rows = transactions(*GOLDEN[:2]).withColumn("is_fraud", F.lit(1))
    computed = by_id(add_features(rows), "user_activity_24h", "rolling_avg_7d")
    assert computed["b"] == (1, 10.0)
    constant = by_id(add_features(rows, mode="placeholder"), "user_activity_24h", "rolling_avg_7d", "amount_to_avg_ratio")
    assert constant["b"] == (1000, 1000.0, 0.02)
    with pytest.raises(ValueError):
        add_features(rows, mode="other")


def test_projections(transactions):
    rows = add_features(transactions(*GOLDEN[:2]))
    with pytest.raises(ValueError, match="is_fraud"):
        training_rows(rows)
    assert training_rows(rows.withColumn("is_fraud", F.lit(0))).columns == [*TRAINING_FEATURES, "is_fraud"]
    assert scoring_rows(rows).columns == SCORING_COLUMNS
