from __future__ import annotations

import json

import pytest
from conftest import MIDDLE

from txguard import workload
from txguard.config import Config, ModelConfig, ScoringConfig
from txguard.plans import serving, training
from txguard.plans.registry import Registry
from txguard.sources import files, kafka
from txguard.sources.codec import encode

QUICK = ModelConfig(n_estimators=3, max_depth=3)


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    """Version 1 (Production, best f1) and 2 (None, best auc_pr) of one model, and an older Production version 0."""
    place = tmp_path_factory.mktemp("registry")
    rows = training.training_rows(workload._features(spark, MIDDLE), ["transaction_id"]).persist()
    fitted = training.fit(rows, QUICK)
    made = Registry(spark, str(place / "tables"))
    for number, (stage, threshold, metrics) in enumerate(
        [
            ("Production", 0.55, {"auc_pr": 0.99, "f1": 0.1}),
            ("Production", 0.0, {"auc_pr": 0.3, "f1": 0.9}),
            ("None", 1.1, {"auc_pr": 0.5, "f1": 0.2}),
        ]
    ):
        uri = str(place / f"m{number}")
        training.FraudModel(fitted.codes, fitted.trees, fitted.features, threshold).save(uri)
        made.register(Config().model.name, made.log_run({}, metrics), uri, stage)
    return made


def settings(**scoring):
    return Config(scoring=ScoringConfig(**scoring), high_risk_merchants=("error",))


@pytest.fixture(scope="module")
def messages(spark):
    return encode(workload._events(spark, "/root/testdata/sf0.001"))


def test_model_choice_follows_metric_and_policy(spark, registry):
    def threshold(**scoring):
        return serving.best_model(spark, settings(**scoring), registry).threshold

    assert threshold() == 1.1
    assert threshold(metric="f1") == 0.0
    assert threshold(candidate_policy="all") == 0.55


def test_threshold_is_given_or_from_training(registry, messages):
    def alerts(**scoring):
        return serving.keyed_alerts(messages, settings(**scoring), registry).count()

    assert alerts(threshold=0.0) == 1000 == alerts(metric="f1", threshold="registry")
    assert alerts(threshold="registry") == 0
    assert 0 < alerts(threshold=0.60) < 1000


def test_native_model_on_a_stream(spark, registry, messages, tmp_path):
    messages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.MESSAGE).parquet(f"{tmp_path}/in")
    found = serving.keyed_alerts(stream, settings(), registry)
    writer = files.alert_writer(found, f"{tmp_path}/out", f"{tmp_path}/check")
    writer.trigger(availableNow=True).start().awaitTermination()
    written = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("key", "value").collect()))
    assert written == sorted(map(tuple, serving.keyed_alerts(messages, settings(), registry).collect()))
    assert json.loads(written[0][1])["prediction"] == 1


def test_watermark_setting(spark, registry, messages, tmp_path):
    messages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.MESSAGE).parquet(f"{tmp_path}/in")
    plan = serving.keyed_alerts(stream, settings(watermark="3 hours"), registry)._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "3 hours" in plan


def test_topics_need_a_connector(spark, registry):
    """The connector is not installed here; everything up to it is built."""
    with pytest.raises(Exception, match="kafka"):
        serving.serve(spark, settings(checkpoint_location="c"), registry)
    with pytest.raises(Exception, match="kafka"):
        training.training_job(spark, settings(), registry, "u", "q")
    assert kafka.alert_options(Config().kafka, settings(checkpoint_location="x").scoring.checkpoint_location)["checkpointLocation"] == "x"


def test_the_job_needs_its_folders_and_a_known_mode(spark, messages):
    def job(**scoring):
        return serving.scoring_job(messages, lambda f: f, settings(**scoring), serving.Sinks(print, print))

    with pytest.raises(ValueError, match="checkpoint_location"):
        job()
    with pytest.raises(ValueError, match="mode"):
        job(checkpoint_location="c", mode="other")
