from __future__ import annotations

import dataclasses
import re
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from txguard.config import BrokerConfig, Config, ModelConfig, ScoringConfig
from txguard.plans import training
from txguard.session import reliable, scratch_path, shared_folder
from txguard.sources import files, kafka
from txguard.sources.tables import events_as_transactions, orders_as_transactions

PACKAGE = Path(__file__).resolve().parents[1] / "txguard"
BROKER = BrokerConfig(
    topic="in", output_topic="out", bootstrap_servers="h:1", security_protocol="SASL_SSL", username="u", password="p"
)


def test_config_from_nested_settings(tmp_path):
    config = Config.from_dict({"kafka": {"topic": "t"}, "model": {"seed": 7}, "high_risk_merchants": ["A"]})
    assert (config.kafka.topic, config.model.seed, config.high_risk_merchants) == ("t", 7, ("A",))
    assert config.scoring == ScoringConfig() and config.model.test_size == 0.2
    with pytest.raises(ValueError, match="tipic"):
        Config.from_dict({"kafka": {"tipic": "t"}})
    with pytest.raises(ValueError, match="other"):
        Config.from_dict({"other": {}})


def test_config_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("model:\n  n_estimators: 5\nkafka:\n  topic: t\n")
    assert Config.from_yaml(str(tmp_path / "c.yaml")).model.n_estimators == 5


def test_every_broker_setting_reaches_the_options():
    def options(broker):
        records = kafka.record_options(broker), kafka.rejected_options(broker)
        return kafka.stream_options(broker), kafka.alert_options(broker, "c"), *records

    for field in dataclasses.fields(BrokerConfig):
        assert options(dataclasses.replace(BROKER, **{field.name: "changed"})) != options(BROKER), field.name


def test_broker_options():
    stream = kafka.stream_options(BROKER)
    assert stream["subscribe"] == "in" and stream["startingOffsets"] == "earliest" and "endingOffsets" not in stream
    assert 'username="u" password="p";' in stream["kafka.sasl.jaas.config"]
    assert kafka.batch_options(BROKER)["endingOffsets"] == "latest"
    alert = kafka.alert_options(BROKER, "place")
    assert alert["topic"] == "out" and alert["checkpointLocation"] == "place"
    record = kafka.record_options(BROKER)
    assert record["topic"] == "in" and record["kafka.compression.type"] == "gzip"
    assert kafka.connection_options(BrokerConfig(bootstrap_servers=""))["kafka.bootstrap.servers"] == "localhost:9092"


def test_model_settings_reach_the_trees():
    base = training.default_params(ModelConfig())
    for name in ("learning_rate", "max_depth", "subsample", "colsample_bytree", "gamma"):
        value = getattr(ModelConfig(), name)
        assert training.default_params(dataclasses.replace(ModelConfig(), **{name: value + 1})) != base, name
    assert base["maxDepth"] == 5 and base["stepSize"] == 0.05
    trees = training._classifier(ModelConfig(n_estimators=9, seed=3))
    assert trees.getMaxIter() == 9 and trees.getSeed() == 3


@pytest.mark.parametrize("format", ["parquet", "json", "orc"])
def test_files_in_several_formats(spark, tmp_path, format):
    rows = events_as_transactions(spark, SMALL).withColumn("is_fraud", F.lit(0))
    # JSON would otherwise keep only milliseconds.
    rows.write.format(format).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").save(str(tmp_path / "t"))
    back = files.read_batch(spark, str(tmp_path / "t"), format=format)
    assert back.exceptAll(rows).isEmpty() and back.count() == rows.count()
    stream = files.read_stream(spark, str(tmp_path / "t"), back.schema, format)
    assert stream.isStreaming and stream.schema == back.schema


def test_missing_table_is_empty(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a int").isEmpty()


def test_tables_as_transactions(spark):
    events, orders = events_as_transactions(spark, SMALL), orders_as_transactions(spark, SMALL)
    assert events.schema.simpleString() == orders.schema.simpleString()
    assert orders.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert orders.where("location is null").isEmpty()


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder and scratch_path(spark, "x").startswith(folder.rstrip("/"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    kept = reliable(spark.range(5))
    assert kept.count() == 5
    assert spark.conf.get("spark.checkpoint.dir", folder) == folder


ALLOWED_COLLECTS = {
    # Bounded by a limit or by the number of classes, borders or boxes.
    "operators/skew.py": 1,
    "operators/split.py": 3,
    "operators/oversample.py": 2,
}


def test_nothing_unbounded_comes_to_the_driver():
    for path in PACKAGE.rglob("*.py"):
        name = path.relative_to(PACKAGE).as_posix()
        text = path.read_text()
        found = len(re.findall(r"\.(collect|toPandas|toLocalIterator)\(\)", text))
        # The optional subpackage has such a test of its own.
        if name.startswith(("plans/training", "workload", "llm/")):
            continue
        assert found <= ALLOWED_COLLECTS.get(name, 0), name
        for word in ("localCheckpoint", "crossJoin", ".rdd", "F.udf(", "repartition(1)"):
            assert word not in text, (name, word)
