from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from conftest import MIDDLE, by_id
from pyspark.sql import functions as F

from txguard.operators import encode, oversample as over, skew, split
from txguard.operators.oversample import nearest_neighbours, oversample
from txguard.operators.split import fold_quotas, split_quotas, stratified_folds, stratified_split
from txguard.sources.tables import events_as_transactions


@pytest.fixture(scope="module")
def labelled(spark):
    rows = events_as_transactions(spark, MIDDLE)
    return rows.withColumn("is_fraud", (F.col("amount") > 200).cast("int")).cache()


def test_split_quotas():
    assert split_quotas({0: 9990, 1: 10}, 0.2) == {0: 1998, 1: 2}
    # 2 classes whose shares both round up would give one row too many.
    assert sum(split_quotas({0: 9752, 1: 248}, 0.2).values()) == 2000
    assert split_quotas({0: 3, 1: 3}, 0.5) == {0: 1, 1: 2}
    assert sum(split_quotas({0: 10**12, 1: 4 * 10**9 + 1}, 0.2).values()) == -(-(10**12 + 4 * 10**9 + 1) // 5)


def test_fold_quotas_are_dealt_in_turn():
    assert fold_quotas({0: 7, 1: 4}, 3) == {0: [3, 2, 2], 1: [1, 2, 1]}
    assert fold_quotas({0: 2, 1: 1}, 3) == {0: [1, 1, 0], 1: [0, 0, 1]}


def test_split_keeps_class_shares(labelled):
    parts = stratified_split(labelled)
    counts = {(r["split"], r["is_fraud"]): r["n"] for r in parts.groupBy("split", "is_fraud").agg(F.count("*").alias("n")).collect()}
    classes = Counter(r["is_fraud"] for r in labelled.select("is_fraud").collect())
    quotas = split_quotas(classes, 0.2)
    assert sum(counts.values()) == 10000
    assert all(counts["test", c] == quotas[c] and counts["train", c] == n - quotas[c] for c, n in classes.items())


def test_split_does_not_shuffle_the_rows(labelled):
    plan = stratified_split(labelled)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_seed_changes_the_split(labelled):
    first, again, other = (by_id(stratified_split(labelled, seed=s), "split") for s in (1, 1, 2))
    assert first == again != other


def test_narrowing_down_gives_the_same_borders(labelled, monkeypatch):
    plain = by_id(stratified_split(labelled), "split"), by_id(stratified_folds(labelled), "fold")
    monkeypatch.setattr(split, "BUCKET_ROWS", 3)
    monkeypatch.setattr(split, "_DIGITS", 1)
    assert (by_id(stratified_split(labelled), "split"), by_id(stratified_folds(labelled), "fold")) == plain


def test_copies_of_one_id_stay_together(spark, monkeypatch):
    """A third of the rows share an id: the border search ends, and no row is lost."""
    monkeypatch.setattr(split, "BUCKET_ROWS", 3)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("transaction_id"),
        (F.col("id") % 2).cast("int").alias("is_fraud"),
    )
    parts = stratified_split(rows).groupBy("transaction_id", "is_fraud").agg(F.collect_set("split").alias("s"), F.count("*").alias("n"))
    found = parts.collect()
    assert sum(r["n"] for r in found) == 300
    assert all(len(r["s"]) == 1 for r in found)


def test_folds(labelled):
    folds = stratified_folds(labelled, 3)
    counts = {(r["fold"], r["is_fraud"]): r["n"] for r in folds.groupBy("fold", "is_fraud").agg(F.count("*").alias("n")).collect()}
    classes = dict(sorted(Counter(r["is_fraud"] for r in labelled.select("is_fraud").collect()).items()))
    assert counts == {(f, c): n for c, per in fold_quotas(classes, 3).items() for f, n in enumerate(per)}


def test_bad_labels(spark):
    with pytest.raises(ValueError, match="nulls"):
        stratified_split(spark.createDataFrame([("a", 1), ("b", None)], "transaction_id string, is_fraud int"))
    many = spark.range(200).select(F.col("id").cast("string").alias("transaction_id"), F.col("id").cast("int").alias("is_fraud"))
    with pytest.raises(ValueError, match="classes"):
        stratified_split(many)


@pytest.mark.parametrize("broadcast", [True, False])
def test_codes(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(encode, "BROADCAST_CODES", 0)
        monkeypatch.setattr(encode, "MAX_CATEGORY_ROWS", 2)
    known = spark.createDataFrame([("b",), ("a",), ("Z",), ("b",), (None,)], "merchant string")
    codes = encode.fit_codes(known, "merchant")
    asked = spark.createDataFrame([("b",)] * 5 + [("a",), ("Z",), ("new",), (None,)], "merchant string")
    found = Counter((r["merchant"], r["merchant_code"]) for r in codes.transform(asked).collect())
    assert found == {("b", 2.0): 5, ("a", 1.0): 1, ("Z", 0.0): 1, ("new", -1.0): 1, (None, -1.0): 1}


def test_positions_cover_all_rows_in_order(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("x"))
    found = sorted((r["x"], r["position"]) for r in skew.with_position(rows, ["x"]).collect())
    assert [p for _, p in found] == list(range(5000))


def test_skewed_join_equals_the_plain_one(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = skew.left_join_skewed(left, right, ["k"], 50)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    parts = skew.split_heavy(left, ["k"], 50)
    assert parts.heavy.count() == 400 and parts.light.count() == 600


def test_many_heavy_keys_are_kept_as_a_table(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    left = spark.range(1000).select((F.col("id") % 10).alias("k"))
    parts = skew.split_heavy(left, ["k"], 50)
    assert not parts.few and parts.heavy.count() == 1000 and parts.light.isEmpty()


def points(spark, shape, size=600):
    rng = np.random.default_rng(5)
    if shape == "cloud":
        values = np.column_stack([rng.lognormal(4, 1, size), rng.integers(0, 2, size), rng.integers(1, 32, size)])
    elif shape == "copies":  # a third of all points are one point
        values = np.column_stack([rng.normal(size=size), rng.normal(size=size), np.zeros(size)])
        values[: size // 3] = [0.5, 0.5, 0.0]
    elif shape == "grid":  # many equally far ones
        values = np.array([(i % 20, i // 20, 0) for i in range(400)], float)
    elif shape == "outlier":
        values = rng.normal(size=(size, 3))
        values[7, 0] = 1e9
    elif shape == "sixfold":  # the nearest are the other five copies
        values = np.repeat(rng.normal(size=(size // 6, 3)), 6, axis=0)
    else:  # two clusters and a few points far away
        values = np.vstack([rng.normal(0, 1, (size // 2, 3)), rng.normal(1000, 1, (size - size // 2, 3))])
        values[:3] = [[5000, 0, 0], [500, 500, 500], [-9000, 0, 1]]
    rows = [(f"p{i:04d}", *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "transaction_id string, a double, b double, c double"), values


@pytest.mark.parametrize("shape", ["cloud", "copies", "grid", "outlier", "sixfold", "clusters"])
@pytest.mark.parametrize("large", [False, True])
def test_neighbours_are_the_nearest(spark, monkeypatch, shape, large):
    """Against brute force; ``large`` takes the way for minorities beyond a broadcast matrix."""
    if large:
        for name, value in {"BLOCK_ROWS": 100, "BOX_ROWS": 40, "VISIT_ROWS": 50, "GROUP_BOXES": 4, "WINDOW_ROWS": 6}.items():
            monkeypatch.setattr(over, name, value)
    rows, values = points(spark, shape)
    found = nearest_neighbours(rows, ["a", "b", "c"], "transaction_id", 5, exact_rows=0 if large else 10_000).collect()
    gaps = ((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(gaps, np.inf)
    per_id: dict[str, list] = {}
    for r in found:
        per_id.setdefault(r["id"], []).append(r)
    assert len(per_id) == len(values)
    for name, near in per_id.items():
        own = int(name[1:])
        assert sorted(r["nth"] for r in near) == [0, 1, 2, 3, 4]
        assert len({r["neighbour"] for r in near}) == 5 and name not in {r["neighbour"] for r in near}
        nearest = np.lexsort((np.arange(len(values)), gaps[own]))[:5]
        assert [r["neighbour"] for r in sorted(near, key=lambda r: r["nth"])] == [f"p{i:04d}" for i in nearest]
        taken = sorted(gaps[own, int(r["neighbour"][1:])] for r in near)
        assert taken == pytest.approx(np.sort(gaps[own])[:5]), name
        assert all(r["w"] == pytest.approx(list(values[int(r["neighbour"][1:])])) for r in near)


@pytest.mark.parametrize("large", [False, True])
def test_oversampling(spark, large):
    rows, _ = points(spark, "cloud", 300)
    rows = rows.withColumn("is_fraud", (F.substring("transaction_id", 2, 4).cast("int") < 40).cast("int"))
    balanced = oversample(rows, ["a", "b", "c"], k=5, exact_rows=0 if large else 10_000).cache()
    counts = Counter((r["is_fraud"], r["is_synthetic"]) for r in balanced.collect())
    assert counts == {(0, False): 260, (1, False): 40, (1, True): 220}
    originals = balanced.where("not is_synthetic").drop("is_synthetic")
    assert sorted(map(tuple, originals.collect())) == sorted(map(tuple, rows.collect()))
    assert balanced.select("transaction_id").distinct().count() == 520
    ranges = rows.where("is_fraud = 1").agg(*[F.min(c).alias(f"min_{c}") for c in "abc"], *[F.max(c).alias(f"max_{c}") for c in "abc"]).first()
    for r in balanced.where("is_synthetic").collect():
        assert all(ranges[f"min_{c}"] - 1e-9 <= r[c] <= ranges[f"max_{c}"] + 1e-9 for c in "abc")


def test_oversampling_needs_enough_of_two_classes(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("transaction_id"), F.col("id").alias("a"), (F.col("id") < 5).cast("int").alias("is_fraud"))
    with pytest.raises(ValueError, match="neighbours"):
        oversample(rows, ["a"], k=5).collect()
    with pytest.raises(ValueError, match="two classes"):
        oversample(rows.where("is_fraud = 0"), ["a"])
    even = rows.where("id < 10") if "id" in rows.columns else rows.where("a < 10")
    assert oversample(even, ["a"]).count() == 10


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    table = spark.createDataFrame([("abc",), ("de",), (None,)], "k string")
    assert skew.fits_broadcast(table, 3) and not skew.fits_broadcast(table, 2)
    assert skew.fits_broadcast(table, 3, 5) and not skew.fits_broadcast(table, 3, 4)


def test_boxes_are_small_by_the_distance_itself(spark, monkeypatch):
    """One wide column and narrow ones: a row visits the boxes beside its own, not all that share narrow values."""
    for name, value in {"BOX_ROWS": 100, "VISIT_ROWS": 500, "GROUP_BOXES": 8, "WINDOW_ROWS": 6}.items():
        monkeypatch.setattr(over, name, value)
    visits, counts = over._visits, []

    def counted(*args):
        found = visits(*args).persist()
        counts.append(found.count())
        return found

    monkeypatch.setattr(over, "_visits", counted)
    rng, names = np.random.default_rng(3), list("abcde")
    values = np.column_stack([rng.random(4_000) * 1000, rng.random((4_000, 4)) * 1e-3])
    rows = spark.createDataFrame([(f"p{i:04d}", *map(float, v)) for i, v in enumerate(values)], f"transaction_id string, {', '.join(n + ' double' for n in names)}")
    assert nearest_neighbours(rows, names, "transaction_id", 5, exact_rows=0).count() == 20_000
    assert counts[0] <= 2 * len(values)
