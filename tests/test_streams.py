from __future__ import annotations

import json
import random
import shutil
import time
from datetime import datetime, timedelta

import pytest
from conftest import at, by_id
from pyspark.sql import functions as F

from txguard import workload
from txguard.operators.activity import ACTIVITY_COLUMNS, DAY, add_activity
from txguard.schemas import ALERT_COLUMNS, TRANSACTION
from txguard.sources import files
from txguard.sources.codec import decode, encode
from txguard.streaming import history
from txguard.streaming.committed import Committed, changed_groups
from txguard.streaming.dedup import drop_repeats
from txguard.streaming.figures import FigureLog, counted_rows, figures
from txguard.streaming.history import with_history
from txguard.streaming.scorer import alert_messages, alert_rows, alerts_with_history, rejected_messages


def table(spark, rows):
    full = [(i, u, a, "USD", m, at(t) if t else None, "US") for i, u, a, m, t in rows]
    return spark.createDataFrame(full, TRANSACTION)


def deliver(spark, place, batches, start):
    """One run of the stream per delivery, from the same checkpoint."""
    for rows in batches:
        encode(table(spark, rows)).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(files.MESSAGE).parquet(f"{place}/in")
        start(stream).trigger(availableNow=True).start().awaitTermination()


def history_features(spark, tmp_path, batches, **options):
    place = str(tmp_path)

    def sink(df, number):
        df.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    def start(stream):
        return with_history(decode(stream), sink, f"{place}/check", **options)

    deliver(spark, place, batches, start)
    return spark.read.parquet(f"{place}/out")


IN_ORDER = [
    [("a", 1, 10.0, "x", "2024-01-01T00:00:00"), ("b", 2, 5.0, "x", "2024-01-01T01:00:00")],
    [("c", 1, 20.0, "x", "2024-01-01T12:00:00"), ("d", 3, 7.0, "x", "2024-01-01T13:00:00"), ("n", None, 7.0, "x", None)],
    [("e", 1, 30.0, "x", "2024-01-02T00:00:00"), ("f", 2, 6.0, "x", "2024-01-20T00:00:00")],
    [("g", 1, 40.0, "x", "2024-01-09T00:00:00"), ("h", 1, 50.0, "x", "2024-03-01T00:00:00")],
]


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values), key


@pytest.mark.parametrize(("limit", "slices"), [(None, 1), (2, 3)])
def test_history_equals_the_batch_for_rows_in_order(spark, tmp_path, limit, slices):
    found = by_id(history_features(spark, tmp_path, IN_ORDER, max_user_rows=limit, slices=slices), *ACTIVITY_COLUMNS)
    everything = table(spark, [row for rows in IN_ORDER for row in rows])
    assert_same(found, by_id(add_activity(everything, None), *ACTIVITY_COLUMNS))


def test_late_rows_see_all_that_was_before_them(spark, tmp_path, monkeypatch):
    """Seven old rows, a newer one two months on, then a late row between: its six predecessors are old."""
    old = [(f"o{i}", 1, 10.0 * i, "x", f"2024-01-{i + 1:02d}T00:00:00") for i in range(7)]
    new = [(f"n{i}", 1, 1000.0, "x", f"2024-03-{i + 1:02d}T00:00:00") for i in range(7)]
    late = [("late", 1, 7.0, "x", "2024-02-01T00:00:00"), ("other", 2, 1.0, "x", "2024-03-09T00:00:00")]
    found = by_id(history_features(spark, tmp_path, [old, new, late]), *ACTIVITY_COLUMNS)
    before = by_id(add_activity(table(spark, old + late), None), *ACTIVITY_COLUMNS)
    assert found["late"] == pytest.approx(before["late"])
    assert found["late"][1] == pytest.approx((10 + 20 + 30 + 40 + 50 + 60 + 7) / 7)


def test_random_deliveries_see_all_that_arrived_before(spark, tmp_path):
    """Rows in any order, gaps of months, equal times, null ids, odd amounts: each has the batch's features at its arrival."""
    rng = random.Random(7)
    amounts = [1.0, 2.5, None, float("nan"), float("inf"), -3.0, 0.1]
    batches, number = [], 0
    for _ in range(4):
        rows = []
        for _ in range(25):
            number += 1
            day = rng.choice([1, 2, 3, 9, 10, 40, 41, 100])
            time = datetime(2024, 1, 1) + timedelta(days=day, hours=rng.randrange(24), microseconds=rng.randrange(3))
            rows.append((f"{number:03d}", rng.choice([1, 2, 1 << 60]), rng.choice(amounts), "x", time.isoformat()))
        batches.append(rows)
    found = by_id(history_features(spark, tmp_path, batches, slices=2), *ACTIVITY_COLUMNS)
    for n, rows in enumerate(batches):
        arrived = table(spark, [row for earlier in batches[: n + 1] for row in earlier])
        expected = by_id(add_activity(arrived, None), *ACTIVITY_COLUMNS)
        for key, *_ in rows:
            assert str(found[key]) == str(expected[key]) or found[key] == pytest.approx(expected[key], nan_ok=True), key


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    """With its commit gone, as after a crash, the last micro-batch is done again from the same state."""
    first = by_id(history_features(spark, tmp_path, IN_ORDER), *ACTIVITY_COLUMNS)
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    done = sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    shutil.rmtree(tmp_path / "out" / done[-1])
    assert by_id(history_features(spark, tmp_path, [[]]), *ACTIVITY_COLUMNS).items() >= first.items()


def test_idle_users_start_anew(spark, tmp_path):
    """While another user is served, the state of the idle one goes; a user with rows in each micro-batch keeps it."""
    batches = [
        [("a", 1, 10.0, "x", "2024-01-01T00:00:00"), ("b", 2, 10.0, "x", "2024-01-01T00:00:00")],
        [("c", 2, 20.0, "x", "2024-01-01T01:00:00")],
        [("d", 1, 30.0, "x", "2024-01-01T02:00:00"), ("e", 2, 60.0, "x", "2024-01-01T02:00:00")],
    ]
    found = by_id(history_features(spark, tmp_path, batches, idle_days=1e-9), *ACTIVITY_COLUMNS)
    assert found["d"] == (0, 30.0, 1.0, 0.0, None)
    assert found["e"] == pytest.approx((2, 30.0, 2.0, 3600.0, 15.0))


def test_each_message_goes_to_its_own_day_and_calls_the_days_before(spark):
    rows = spark.createDataFrame(
        [("day", 1, 10, 0, 10 * DAY + i, f"r{i}", "1.0", "{}") for i in range(20)] + [("none", 0, 0, 5, 0, None, None, "{}")], history._MESSAGE
    )
    sent = rows.coalesce(1).mapInPandas(history._wake(2), history._MESSAGE).groupBy("part", "day", "slice").count().collect()
    found = {(r["part"], r["day"], r["slice"]): r["count"] for r in sent}
    days = {("day", day, part): 1 + 20 * (day == 10 and part == 0) for day in range(3, 11) for part in (0, 1)}
    assert found == {**days, ("last", 0, 0): 6, ("none", 0, 5): 1}


@pytest.mark.parametrize("combine", [True, False])
def test_rows_without_an_id_or_a_time_all_pass(spark, tmp_path, combine):
    day = "2024-03-01T00:00:00"
    batches = [
        [(None, 1, 1.0, "x", day), (None, 2, 1.0, "x", day), ("a", 1, 1.0, "x", day), ("t", 1, 1.0, "x", None)],
        [("a", 1, 1.0, "x", day), (None, 1, 1.0, "x", day), ("t", 1, 1.0, "x", None), ("b", 1, 1.0, "x", day)],
    ]
    place = str(tmp_path)

    def start(stream):
        once = drop_repeats(decode(stream), combine_first=combine)
        return files.alert_writer(once, f"{place}/out", f"{place}/check")

    deliver(spark, place, batches, start)
    found = [r["transaction_id"] for r in spark.read.parquet(f"{place}/out").collect()]
    assert sorted(map(str, found)) == ["None", "None", "None", "a", "b", "t", "t"]


@pytest.mark.parametrize("combine", [True, False])
def test_repeats_are_dropped_and_late_rows_too(spark, tmp_path, combine):
    batches = [
        [("a", 1, 1.0, "x", "2024-03-01T00:00:00"), ("a", 1, 1.0, "x", "2024-03-01T00:00:00")],
        [("b", 1, 1.0, "x", "2024-03-05T00:00:00"), ("a", 1, 1.0, "x", "2024-03-01T00:00:00")],
        [("c", 1, 1.0, "x", "2024-03-05T01:00:00"), ("b", 1, 1.0, "x", "2024-03-05T00:00:00")],
        [("old", 1, 1.0, "x", "2024-02-01T00:00:00"), ("d", 1, 1.0, "x", "2024-03-05T02:00:00")],
    ]
    place = str(tmp_path)

    def start(stream):
        once = drop_repeats(decode(stream), combine_first=combine)
        return files.alert_writer(once, f"{place}/out", f"{place}/check")

    deliver(spark, place, batches, start)
    found = sorted(r["transaction_id"] for r in spark.read.parquet(f"{place}/out").collect())
    assert found == ["a", "b", "c", "d"]


def test_a_stream_is_read_once_for_all_its_rows(spark, tmp_path):
    """Rows with and without an id part after one pass over the messages."""
    day, place, runs = "2024-03-01T00:00:00", str(tmp_path), []
    batches = [
        [("a", 1, 1.0, "x", day), ("a", 1, 1.0, "x", day), (None, 2, 1.0, "x", day), ("t", 1, 1.0, "x", None)],
        [("b", 1, 1.0, "x", day), ("a", 1, 1.0, "x", day), (None, 2, 1.0, "x", day)],
    ]
    for rows in batches:
        encode(table(spark, rows)).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(files.MESSAGE).parquet(f"{place}/in")
        writer = files.alert_writer(drop_repeats(decode(stream)), f"{place}/out", f"{place}/check")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert runs == [4, 3]
    found = [r["transaction_id"] for r in spark.read.parquet(f"{place}/out").collect()]
    assert sorted(map(str, found)) == ["None", "None", "a", "b", "t"]


def by_amount(features):
    return features.withColumn("prediction", (F.col("amount") >= 20).cast("int"))


def test_alert_stream_and_restart(spark, tmp_path):
    place = str(tmp_path)

    def start(stream):
        return files.alert_writer(alert_rows(stream, by_amount), f"{place}/out", f"{place}/check")

    deliver(spark, place, IN_ORDER, start)
    found = spark.read.parquet(f"{place}/out")
    assert found.columns == ALERT_COLUMNS and len(ALERT_COLUMNS) == 17
    ids = ["c", "e", "g", "h"]
    assert sorted(r["transaction_id"] for r in found.collect()) == ids
    # Started again without anything new: nothing is added.
    stream = spark.readStream.schema(files.MESSAGE).parquet(f"{place}/in")
    start(stream).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{place}/out").count() == len(ids)


def test_stream_and_table_give_the_same_alerts(spark, tmp_path):
    rows = encode(table(spark, sum(IN_ORDER, [])))
    found = alert_messages(rows, by_amount).collect()
    assert sorted(r["key"] for r in found) == ["c", "e", "g", "h"]
    value = json.loads(next(r["value"] for r in found if r["key"] == "c"))
    assert list(value) == [c for c in ALERT_COLUMNS]
    assert value["user_activity_24h"] == 1000 and value["timestamp"] == "2024-01-01T12:00:00.000000+00:00"


def test_malformed_messages_are_set_aside(spark):
    texts = ["oops", "[1]", "{}", None, '{"amount": 50}', '{"user_id": "x"}']
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], files.MESSAGE)
    assert [r["amount"] for r in alert_rows(raw, lambda f: f.withColumn("prediction", F.lit(1))).collect()] == [50.0]
    rejected = rejected_messages(raw)
    assert rejected.columns == ["key", "value"]
    assert sorted(r["key"] for r in rejected.collect()) == ["0", "1", "2", "3", "5"]


def test_stateless_scoring_does_not_shuffle(spark):
    rows = encode(workload._events(spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in alert_rows(rows, by_amount)._jdf.queryExecution().executedPlan().toString()


def test_alerts_scored_with_history(spark, tmp_path):
    place = str(tmp_path)

    def scorer(features):
        return features.withColumn("prediction", (F.col("user_activity_24h") >= 1).cast("int"))

    def start(stream):
        def write(found, number):
            found.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

        return alerts_with_history(stream, scorer, write, f"{place}/check")

    deliver(spark, place, IN_ORDER[:3], start)
    assert sorted(r["transaction_id"] for r in spark.read.parquet(f"{place}/out").collect()) == ["c", "e"]


def test_committed_batches_count_once_and_whole(spark, tmp_path):
    """A batch written again replaces itself; one without a commit is not seen; groups show their last value."""
    kept = Committed(spark, str(tmp_path))
    assert kept.read("k string, v long").collect() == []
    for number, rows in ((0, [("a", 1), ("b", 2)]), (1, [("a", 5)]), (1, [("a", 6)]), (10, [("b", 7), ("c", None)])):
        kept.write(spark.createDataFrame(rows, "k string, v long"), number)
    spark.createDataFrame([("a", 99)], "k string, v long").write.parquet(f"{tmp_path}/rows/batch=11")
    assert sorted((r["batch"], r["k"], r["v"]) for r in kept.read("k string, v long").collect()) == [
        (0, "a", 1), (0, "b", 2), (1, "a", 6), (10, "b", 7), (10, "c", None),
    ]
    assert {r["k"]: r["v"] for r in kept.newest("k string, v long", ["k"]).collect()} == {"a": 6, "b": 7, "c": None}
    assert kept.commits().count() == 3


def test_figures_of_each_batch_reach_a_listener(spark, tmp_path):
    """A repeat, a late row and a malformed message, in the listener and in the query's own progress."""
    seen: list[tuple] = []
    log = FigureLog(seen.append)
    spark.streams.addListener(log)
    batches = [
        [("a", 1, 1.0, "x", "2024-03-05T00:00:00"), ("a", 1, 1.0, "x", "2024-03-05T00:00:00"), ("b", 1, 1.0, "x", "2024-03-05T00:00:00")],
        [("old", 1, 1.0, "x", "2024-02-01T00:00:00"), ("b", 1, 1.0, "x", "2024-03-05T00:00:00"), ("c", 1, 1.0, "x", "2024-03-05T00:00:00")],
    ]
    found = []
    try:
        for rows in batches:
            messages = encode(table(spark, rows)).union(spark.createDataFrame([("bad", "oops")], files.MESSAGE))
            messages.write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(files.MESSAGE).parquet(f"{tmp_path}/in")
            writer = files.alert_writer(counted_rows(stream), f"{tmp_path}/out", f"{tmp_path}/check")
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
            found.append([sum(c) for c in zip(*(tuple(r)[2:] for r in figures(spark, [query]).collect()), strict=True)])
        for _ in range(50):
            if sum(r[2] for r in seen) == 8:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert found == [[4, 1, 0, 1, 2], [4, 1, 1, 1, 1]]
    assert [sum(c) for c in zip(*(r[2:] for r in seen), strict=True)] == [8, 2, 1, 2, 3]


def test_only_changed_groups_are_written(spark, tmp_path):
    kept = Committed(spark, f"{tmp_path}/sums")

    def start(stream):
        return changed_groups(decode(stream).groupBy("user_id").agg(F.sum("amount").alias("v")), kept.write, f"{tmp_path}/check")

    deliver(spark, str(tmp_path), IN_ORDER, start)
    rows = [(r["batch"], r["user_id"], r["v"]) for r in kept.read("user_id long, v double").collect()]
    assert {r[:2]: r[2] for r in rows if r[1] == 3} == {(1, 3): 7.0}
    assert {r["user_id"]: r["v"] for r in kept.newest("user_id long, v double", ["user_id"]).collect()} == {1: 150.0, 2: 11.0, 3: 7.0, None: 7.0}


def test_state_is_kept_by_buckets_of_users(spark, tmp_path):
    """The calls of the state function do not grow with the users; each user has its own history."""
    users, days = 3_000, ["2024-01-01", "2024-01-02"]
    batches = [[(f"{d}-{u}", u, float(u), "x", f"{day}T00:00:00") for u in range(users)] for d, day in enumerate(days)]
    queries = []

    def start(stream):
        writer = with_history(decode(stream), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/check")
        started = writer.trigger(availableNow=True).start
        writer.trigger = lambda **_: writer
        writer.start = lambda: queries.append(started()) or queries[-1]
        return writer

    deliver(spark, str(tmp_path), batches, start)
    for n, query in enumerate(queries, 1):
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= n * history.DAY_BUCKETS + history.USER_BUCKETS
    found = by_id(spark.read.parquet(f"{tmp_path}/out"), *ACTIVITY_COLUMNS)
    assert len(found) == users * len(days)
    assert all(found[f"1-{u}"] == (1, float(u), 1.0, 86400.0, float(u)) for u in range(users))


def test_rows_before_1970_are_no_calls(spark, tmp_path):
    batches = [[("a", 1, 10.0, "x", "1969-12-30T00:00:00")], [("b", 1, 20.0, "x", "1969-12-30T12:00:00")]]
    found = by_id(history_features(spark, tmp_path, batches), *ACTIVITY_COLUMNS)
    assert found == {"a": (0, 10.0, 1.0, 0.0, None), "b": (1, 15.0, 20.0 / 15.0, 43200.0, 10.0)}
