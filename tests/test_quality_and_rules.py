from __future__ import annotations

import json

import pytest
from conftest import by_id
from pyspark.sql import functions as F

from txguard.operators import quality
from txguard.operators.patterns import PatternRules, add_merchant_risk, flag_members, pattern_summary, tag_patterns
from txguard.operators.quality import Limits
from txguard.plans.records import produce_records
from txguard.schemas import LABELLED_TRANSACTION, TRANSACTION
from txguard.sources.codec import decode, encode

GOOD = {
    "transaction_id": "t",
    "user_id": 1000,
    "amount": 0.01,
    "currency": "USD",
    "merchant": "Shop",
    "timestamp": "2024-01-01T00:00:00.123456+00:00",
    "location": "US",
    "is_fraud": 0,
}


def without(*names):
    return {k: v for k, v in GOOD.items() if k not in names}


CASES = {
    "good": (GOOD, []),
    "no optional fields": (without("merchant", "location"), []),
    "whole number as 1000.0": ({**GOOD, "user_id": 1000.0}, []),
    "label as 1.0": ({**GOOD, "is_fraud": 1.0}, []),
    "upper borders": ({**GOOD, "user_id": 9999, "amount": 100000}, []),
    "user too low": ({**GOOD, "user_id": 999}, ["user_id:range"]),
    "user too high": ({**GOOD, "user_id": 10000}, ["user_id:range"]),
    "amount too low": ({**GOOD, "amount": 0.009}, ["amount:range"]),
    "amount too high": ({**GOOD, "amount": 100000.01}, ["amount:range"]),
    "amount as text": ({**GOOD, "amount": "12"}, ["amount:type"]),
    "amount true": ({**GOOD, "amount": True}, ["amount:type"]),
    "id as number": ({**GOOD, "transaction_id": 5}, ["transaction_id:type"]),
    "currency in small letters": ({**GOOD, "currency": "usd"}, ["currency:pattern"]),
    "long currency": ({**GOOD, "currency": "USDX"}, ["currency:pattern"]),
    "bad location": ({**GOOD, "location": "USA"}, ["location:pattern"]),
    "null merchant": ({**GOOD, "merchant": None}, ["merchant:type"]),
    "null currency": ({**GOOD, "currency": None}, ["currency:type"]),
    "bad time": ({**GOOD, "timestamp": "soon"}, ["timestamp:format"]),
    **{
        f"time {text}": ({**GOOD, "timestamp": text}, ["timestamp:format"])
        for text in ("2024", "2024-01", "2024-01-01", "12:30:00", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z")
    },
    "time in zulu": ({**GOOD, "timestamp": "2024-01-01T00:00:00Z"}, []),
    "user 1000.5": ({**GOOD, "user_id": 1000.5}, ["user_id:integer"]),
    "label 2": ({**GOOD, "is_fraud": 2}, ["is_fraud:range"]),
    "label 0.5": ({**GOOD, "is_fraud": 0.5}, ["is_fraud:integer"]),
    "nothing": ({}, [f"{f}:required" for f in Limits().required]),
    "no label": (without("is_fraud"), ["is_fraud:required"]),
    "two flaws": ({**without("currency"), "amount": -1}, ["amount:range", "currency:required"]),
    "array": ([1], ["record:type"]),
}


def messages(spark):
    rows = [(name, json.dumps(record)) for name, (record, _) in CASES.items()]
    rows += [("not json", "{oops"), ("no text", None)]
    return spark.createDataFrame(rows, "key string, value string")


def test_message_violations(spark):
    found = by_id(quality.validate_messages(messages(spark)), "violations", key="key")
    for name, (_, expected) in CASES.items():
        assert sorted(found[name]) == sorted(expected), name
    assert found["not json"] == ["record:json"]
    assert found["no text"] == ["record:json"]


def test_message_values(spark):
    rows = quality.validate_messages(messages(spark))
    assert rows.select(*LABELLED_TRANSACTION.names).schema.simpleString() == LABELLED_TRANSACTION.simpleString()
    row = rows.where("key = 'whole number as 1000.0'").select("user_id", F.unix_micros("timestamp")).first()
    assert tuple(row) == (1000, 1704067200123456)


def test_split_is_complete_and_disjoint(spark):
    checked = quality.validate_messages(messages(spark))
    valid, quarantined = quality.split_valid(checked)
    keys = [r["key"] for r in valid.collect()], [r["key"] for r in quarantined.collect()]
    assert sorted(keys[0] + keys[1]) == sorted([*CASES, "not json", "no text"])
    assert set(keys[0]) == {n for n, (_, v) in CASES.items() if not v}
    assert "violations" not in valid.columns


def test_report_counts_rows_per_rule(spark):
    report = by_id(quality.violation_report(quality.validate_messages(messages(spark))), "rows", key="rule")
    assert report["user_id:range"] == 2 and report["record:json"] == 2 and report["amount:range"] == 3


def test_typed_rows(spark, transactions):
    rows = transactions(("a", 1000, 5.0, "x", "2024-01-01T00:00:00"), ("b", 5, None, "x", None))
    found = by_id(quality.validate(rows.withColumn("is_fraud", F.lit(0))), "violations")
    assert found["a"] == []
    assert sorted(found["b"]) == ["amount:required", "timestamp:required", "user_id:range"]
    assert by_id(quality.validate(rows), "violations")["a"] == ["is_fraud:required"]


def test_checks(spark):
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_fraud int")
    assert quality.fraud_rate(rows).first()[0] == 25.0
    assert tuple(quality.label_support(rows).first()) == (4, 1)
    with pytest.warns(UserWarning, match="only 1"):
        assert quality.check_support(rows) == 1
    with pytest.raises(ValueError, match="no positive"):
        quality.check_support(rows.where("is_fraud = 0"))
    with pytest.raises(ValueError, match="no rows"):
        quality.require_nonempty(rows.where("is_fraud = 9"))
    with pytest.raises(ValueError, match="label"):
        quality.require_columns(rows, ["label"])


def test_decode_keeps_rows_and_nulls_what_does_not_fit(spark):
    raw = spark.createDataFrame(
        [(json.dumps(GOOD),), (json.dumps({**GOOD, "user_id": 1000.0, "timestamp": "soon"}),), ("oops",)], "value string"
    )
    for rows in (raw, raw.withColumn("value", F.col("value").cast("binary"))):
        first, second, third = decode(rows).collect()
        assert decode(rows).schema == TRANSACTION
        assert (first["user_id"], first["amount"], first["location"]) == (1000, 0.01, "US")
        assert second["timestamp"] is None and second["user_id"] == 1000 and second["transaction_id"] == "t"
        assert all(v is None for v in third)


def test_decode_and_validator_agree_on_ids_and_times(spark):
    values = [1000, 1000.0, 1e3, 1000.5, "1000", True, None, 9007199254740993, [1]]
    times = [GOOD["timestamp"], "2024", "2024-01-01", "12:30:00", "soon", "2024-01-01T00:00:00Z", 5, None, "x"]
    texts = [json.dumps({**GOOD, "user_id": v, "timestamp": t}) for v, t in zip(values, times, strict=True)]
    raw = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "key string, value string")
    checked = quality.validate_messages(raw).orderBy("key").select("user_id", "timestamp").collect()
    assert decode(raw.orderBy("key")).select("user_id", "timestamp").collect() == checked
    assert [r["user_id"] for r in checked] == [1000, 1000, 1000, None, None, None, None, 9007199254740993, None]


def test_encode_is_lossless(spark, transactions):
    rows = transactions(("a", 1, 0.1, "x", "2024-01-01T10:00:00.123456"))
    message = encode(rows).first()
    assert message["key"] == "a"
    assert json.loads(message["value"])["timestamp"] == "2024-01-01T10:00:00.123456+00:00"
    assert decode(encode(rows)).collect() == rows.collect()


PATTERN_ROWS = [
    # id, user, amount, merchant, location, expected first pattern
    ("a", 1234, 500.01, "QuickCash", "US", "account_takeover"),
    ("b", 1234, 500.0, "QuickCash", "US", "merchant_collusion"),
    ("c", 2000, 1.99, "Shop", "CN", "card_testing"),
    ("d", 2000, 2.0, "Shop", "CN", "geo_anomaly"),
    ("e", 1500, 1.0, "Shop", "RU", "geo_anomaly"),
    ("f", 1500, 300.0, "FastMoneyX", "US", None),
    ("g", 1500, 300.01, "FastMoneyX", "NG", "merchant_collusion"),
    ("h", 1501, 900.0, None, None, None),
    ("i", None, None, None, None, None),
]


def pattern_table(spark):
    rows = [row[:5] for row in PATTERN_ROWS]
    return spark.createDataFrame(rows, "transaction_id string, user_id long, amount double, merchant string, location string")


@pytest.mark.parametrize("as_table", [False, True])
def test_patterns_and_precedence(spark, as_table):
    users = spark.createDataFrame([(1234,), (1234,), (None,)], "user_id long") if as_table else [1234]
    found = by_id(tag_patterns(pattern_table(spark), users), "pattern", "is_flagged")
    assert found == {row[0]: (row[5], row[5] is not None) for row in PATTERN_ROWS}


def test_every_rule_parameter_counts(spark):
    rows = pattern_table(spark)
    base = by_id(tag_patterns(rows, [1234]), "pattern")
    changed = [
        PatternRules(takeover_amount=499),
        PatternRules(testing_amount=3),
        PatternRules(testing_user_step=500),
        PatternRules(collusion_amount=299),
        PatternRules(geo_user_step=7),
        PatternRules(risky_merchants=["Shop"]),
        PatternRules(anomaly_locations=["US"]),
    ]
    for rules in changed:
        assert by_id(tag_patterns(rows, [1234], rules), "pattern") != base, rules


def test_large_membership_table(spark, monkeypatch):
    from txguard.operators import patterns

    monkeypatch.setattr(patterns, "BROADCAST_MEMBERS", 1)
    monkeypatch.setattr(patterns, "MAX_KEY_ROWS", 2)
    rows = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (None,)], "user_id long")
    members = spark.createDataFrame([(1,), (2,)], "user_id long")
    found = flag_members(rows, members, "user_id", "m").groupBy("user_id", "m").count().collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, True, 3), (2, True, 1), (3, False, 1), (None, False, 1)], key=str)


def test_pattern_summary(spark):
    summary = by_id(pattern_summary(tag_patterns(pattern_table(spark), [1234])), "rows", "amount", "users", key="pattern")
    assert summary["geo_anomaly"] == (2, 3.0, 2)
    assert summary["none"] == (3, 1200.0, 2)


def test_records(spark, transactions):
    rows = transactions(("a", 1234, 600.0, "Shop", "2024-01-01T00:00:00"), ("b", 1, 600.0, "Shop", "2024-01-01T00:00:00"))
    made, quarantined = produce_records(rows.withColumn("is_fraud", F.lit(0)), [1234])
    assert json.loads(made.first()["value"])["pattern"] == "account_takeover"
    assert made.count() == 1 and quarantined.first()["transaction_id"] == "b"


def test_risky_merchants_as_a_table(spark, transactions):
    rows = transactions(("a", 1, 400.0, "Bad", "2024-01-01T00:00:00"), ("b", 1, 400.0, "Good", "2024-01-01T00:00:00"), ("c", 1, 400.0, None, None))
    table = spark.createDataFrame([("Bad",), ("Bad",), (None,), ("Other",)], "merchant string")
    assert by_id(add_merchant_risk(rows, table), "merchant_risk") == {"a": 1, "b": 0, "c": 0}
    assert by_id(add_merchant_risk(rows, ["Bad"]), "merchant_risk") == {"a": 1, "b": 0, "c": 0}
    tagged = by_id(tag_patterns(rows, [], PatternRules(risky_merchants=table)), "pattern")
    assert tagged == {"a": "merchant_collusion", "b": None, "c": None}
