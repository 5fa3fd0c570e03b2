from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import MIDDLE, SMALL, by_id
from pyspark import cloudpickle
from pyspark.sql import functions as F

from txguard import workload
from txguard.config import Config, ModelConfig
from txguard.plans import training
from txguard.plans.registry import Registry, best_model, candidate_versions
from txguard.plans.scoring import positive_share, score_foreign, score_native
from txguard.schemas import LABEL, SCORING_COLUMNS, TRAINING_FEATURES

QUICK = ModelConfig(n_estimators=3, max_depth=3, search_iterations=2, folds=2)


@pytest.fixture(scope="module")
def rows(spark):
    features = workload._features(spark, MIDDLE)
    return training.training_rows(features, ["transaction_id"]).persist()


@pytest.fixture(scope="module")
def model(rows):
    return training.fit(rows, QUICK)


def test_scores_are_probabilities_that_find_positives(rows, model):
    scored = model.transform(rows)
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= low < high <= 1.0
    means = {r[LABEL]: r["m"] for r in scored.groupBy(LABEL).agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
    assert scored.count() == rows.count() and scored.columns == [*rows.columns, "score"]


def test_saved_model_scores_the_same(spark, rows, model, tmp_path):
    model.save(f"{tmp_path}/m")
    loaded = training.FraudModel.load(spark, f"{tmp_path}/m")
    assert list(loaded.features) == TRAINING_FEATURES and loaded.threshold == model.threshold
    some = rows.where("amount > 150")
    assert by_id(loaded.transform(some), "score") == by_id(model.transform(some), "score")


def test_threshold_of_the_model_or_given(rows, model):
    own = training.FraudModel(model.codes, model.trees, model.features, threshold=0.0)
    assert score_native(rows, own, None).where("prediction = 0").isEmpty()
    assert score_native(rows, own, 1.1).where("prediction = 1").isEmpty()


def test_fits_read_kept_rows(rows):
    """No task of a fit carries the steps that made its rows, nor sends their metrics back."""
    _, prepared = training.prepare(rows, QUICK)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and not any(step in plan for step in ("Union", "Join", "Exchange"))
    lineage = prepared._jdf.queryExecution().toRdd().toDebugString()
    assert "ReliableCheckpointRDD" in lineage and "UnionRDD" not in lineage


def test_unknown_merchants_can_be_scored(rows, model):
    odd = rows.withColumn("merchant", F.lit("never seen")).limit(5)
    assert odd.count() == model.transform(odd).where("score is not null").count()


def test_balancing_sees_training_rows_only(rows):
    _, prepared = training.prepare(rows, QUICK)
    counts = {r[LABEL]: r["count"] for r in prepared.groupBy(LABEL).count().collect()}
    assert counts[0] == counts[1] == rows.where("is_fraud = 0").count()


def test_candidates_are_distinct_and_seeded():
    first, again = training.sample_candidates(ModelConfig()), training.sample_candidates(ModelConfig())
    assert first == again and len(first) == 20 == len({tuple(c.items()) for c in first})
    assert training.sample_candidates(ModelConfig(seed=1)) != first
    assert len(training.sample_candidates(ModelConfig(search_iterations=1000))) == 243


def test_cross_validation_prefers_the_better_candidate(rows):
    found = training.cross_validate(rows, [{"maxDepth": 1, "minInfoGain": 100.0}, {"maxDepth": 4}], QUICK)
    assert found[1]["f2"] > found[0]["f2"]
    assert all(0.0 <= r["f2"] <= 1.0 for r in found)


def test_training_from_transactions_to_registry(spark, tmp_path):
    registry = Registry(spark, f"{tmp_path}/registry")
    config = Config(model=QUICK, high_risk_merchants=("error",))
    source = workload._labelled(spark, MIDDLE)
    fitted, metrics = training.train_and_register(
        source, config, registry, f"{tmp_path}/m", {"maxDepth": [3], "stepSize": [0.1]}
    )
    assert set(metrics) == {"auc_pr", "precision", "recall", "f1", "threshold"}
    assert metrics["auc_pr"] > 0.3 and metrics["threshold"] == fitted.threshold
    run = registry.runs().first()
    assert run["metrics"]["train_samples"] == 8000 and run["metrics"]["test_samples"] == 2000
    assert run["params"] == {"maxDepth": "3", "stepSize": "0.1"}
    best = registry.best(config.model.name)
    assert best["version"] == 1 and best["uri"] == f"{tmp_path}/m"
    loaded = training.FraudModel.load(spark, best["uri"])
    assert loaded.threshold == fitted.threshold


def test_training_needs_positives(spark, tmp_path):
    source = workload._labelled(spark, SMALL).withColumn(LABEL, F.lit(0))
    with pytest.raises(ValueError, match="no positive"):
        training.train_and_register(source, Config(model=QUICK), Registry(spark, f"{tmp_path}/r"), f"{tmp_path}/m")


def registry_tables(spark):
    versions = spark.createDataFrame(
        [
            ("m", 1, "Production", "r1", ""),
            ("m", 2, "Production", "r2", ""),
            ("m", 3, "None", "r3", ""),
            ("m", 4, "Staging", "r4", ""),
            ("n", 1, "Archived", "r5", ""),
        ],
        "name string, version int, stage string, run_id string, uri string",
    )
    runs = spark.createDataFrame(
        [("r1", {"auc_pr": 0.9}), ("r2", {"auc_pr": 0.5}), ("r3", {"auc_pr": 0.5}), ("r4", {"auc_pr": 1.0}), ("r5", {"f1": 1.0})],
        "run_id string, metrics map<string,double>",
    )
    return versions, runs


def test_candidates_and_best(spark):
    versions, runs = registry_tables(spark)
    latest = candidate_versions(versions)
    assert sorted(r["version"] for r in latest.collect()) == [2, 3]
    # Equal metrics: the lowest version.
    assert best_model(latest, runs).first()["version"] == 2
    assert best_model(candidate_versions(versions, policy="all"), runs).first()["version"] == 1
    assert best_model(candidate_versions(versions, policy="all", stages=["Staging"]), runs).first()["version"] == 4
    assert best_model(latest, runs, "f1").isEmpty()
    with pytest.raises(ValueError):
        candidate_versions(versions, policy="newest")


def test_registry_errors_and_versions(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no versions"):
        registry.best("m")
    run = registry.log_run({"a": 1}, {"f1": 0.5})
    assert registry.register("m", run, "x") == 1
    with pytest.raises(ValueError, match="auc_pr"):
        registry.best("m")
    assert registry.register("m", registry.log_run({}, {"auc_pr": 0.1}), "y") == 2
    assert registry.best("m")["uri"] == "y"


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Half:
    def __init__(self, two_columns):
        self.two_columns = two_columns

    def predict(self, frame: pd.DataFrame):
        assert list(frame.columns) == SCORING_COLUMNS
        share = np.where(frame["amount"] > 50, 0.6, 0.59)
        return np.column_stack([1 - share, share]) if self.two_columns else share


@pytest.mark.parametrize("two_columns", [True, False])
def test_foreign_models(spark, two_columns):
    features = workload.add_features(workload._events(spark, SMALL), mode="placeholder")
    scored = score_foreign(features, Half(two_columns))
    assert scored.where((F.col("amount") > 50) != (F.col("prediction") == 1)).isEmpty()
    assert score_foreign(features, Half(two_columns), 0.5).where("prediction = 0").isEmpty()


def test_prediction_shapes():
    assert positive_share([0.1]).tolist() == [0.1]
    assert positive_share([[0.9, 0.1]]).tolist() == [0.1]
    with pytest.raises(ValueError):
        positive_share([[[0.1]]])


def test_writers_at_the_same_time_get_versions_of_their_own(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    run = registry.log_run({}, {"auc_pr": 0.5})
    with ThreadPoolExecutor(20) as pool:
        given = list(pool.map(lambda n: registry.register("m/é", run, f"u{n}"), range(20)))
    assert sorted(given) == list(range(1, 21))
    found = {r["version"]: r["uri"] for r in registry.versions().collect()}
    assert found == {version: f"u{n}" for n, version in enumerate(given)}
    assert registry.register("other", run, "x") == 1 and registry.register("m/é", run, "y") == 21
