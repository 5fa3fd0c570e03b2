"""The scoring job: the best registered model on a stream or table of messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from txguard.config import Config
from txguard.plans.registry import Registry
from txguard.plans.scoring import score_native
from txguard.plans.training import FraudModel
from txguard.sources import kafka
from txguard.sources.codec import encode
from txguard.streaming.scorer import Scorer, alert_messages, alerts_with_history, rejected_messages


def best_model(spark: SparkSession, config: Config, registry: Registry) -> FraudModel:
    chosen = registry.best(config.model.name, config.scoring.metric, config.scoring.candidate_policy)
    return FraudModel.load(spark, chosen["uri"])


def scorer(model: FraudModel, config: Config) -> Scorer:
    """Scores at the configured threshold; ``registry`` stands for the one found in training."""
    limit = config.scoring.threshold
    return partial(score_native, model=model, threshold=None if limit == "registry" else float(limit))


def keyed_alerts(messages: DataFrame, config: Config, registry: Registry) -> DataFrame:
    """(key, value) alerts of a stream or table of messages, by the best registered model."""
    model = best_model(messages.sparkSession, config, registry)
    return alert_messages(messages, scorer(model, config), config.high_risk_merchants, config.scoring.watermark)


@dataclass(frozen=True)
class Sinks:
    """Where a scoring job puts (key, value) rows of a micro-batch: its alerts, and the messages it does not score."""

    alerts: Callable[[DataFrame, int], None]
    rejected: Callable[[DataFrame, int], None]


def scoring_job(messages: DataFrame, score: Scorer, config: Config, sinks: Sinks) -> list[DataStreamWriter]:
    """The two streams of a scoring job, not started: alerts, and messages set aside.

    In the mode ``computed`` a model gets the users' activity as it was trained on,
    with repeated messages dropped first; ``placeholder`` puts constants there.
    Checkpoints, which hold the users' history too, go below the configured folder.
    """
    settings = config.scoring
    if not settings.checkpoint_location:
        raise ValueError("set checkpoint_location to a folder that all machines share")
    checkpoint = f"{settings.checkpoint_location}/alerts"
    risky = config.high_risk_merchants
    if settings.mode == "computed":
        found = alerts_with_history(
            messages, score, lambda df, n: sinks.alerts(encode(df), n), checkpoint, risky, settings.watermark,
            idle_days=settings.idle_days, slices=settings.user_day_slices,
        )
    elif settings.mode == "placeholder":
        keyed = alert_messages(messages, score, risky, settings.watermark)
        found = keyed.writeStream.foreachBatch(sinks.alerts).option("checkpointLocation", checkpoint)
    else:
        raise ValueError(f"unknown scoring mode {settings.mode!r}")
    aside = rejected_messages(messages).writeStream.foreachBatch(sinks.rejected)
    return [found, aside.option("checkpointLocation", f"{settings.checkpoint_location}/rejected")]


def serve(spark: SparkSession, config: Config, registry: Registry) -> list[StreamingQuery]:
    """Follow the transaction topic; write alerts to the alert topic and malformed messages to their own."""
    score = scorer(best_model(spark, config, registry), config)
    sinks = Sinks(
        lambda df, _: kafka.write_records(df, kafka.record_options(config.kafka) | {"topic": config.kafka.output_topic}),
        lambda df, _: kafka.write_records(df, kafka.rejected_options(config.kafka)),
    )
    return [w.start() for w in scoring_job(kafka.read_stream(spark, config.kafka), score, config, sinks)]
