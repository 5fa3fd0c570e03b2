"""Topics as sources and sinks: options apart from the calls that need a broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from txguard.config import BrokerConfig

# Fixed value: the login line of the PLAIN mechanism.
_LOGIN = 'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{password}";'

# Batching of written records.
_PRODUCER = {"kafka.compression.type": "gzip", "kafka.linger.ms": "5", "kafka.batch.size": "15000"}


def connection_options(broker: BrokerConfig) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": broker.bootstrap_servers or "localhost:9092",
        "kafka.security.protocol": broker.security_protocol,
        "kafka.sasl.mechanism": broker.sasl_mechanism,
        "kafka.sasl.jaas.config": _LOGIN.format(user=broker.username, password=broker.password),
    }


def stream_options(broker: BrokerConfig) -> dict[str, str]:
    """Follow one topic from its first record."""
    return {**connection_options(broker), "subscribe": broker.topic, "startingOffsets": "earliest"}


def batch_options(broker: BrokerConfig) -> dict[str, str]:
    """Read one topic from its first to its present last record."""
    return {**stream_options(broker), "endingOffsets": "latest"}


def alert_options(broker: BrokerConfig, checkpoint: str) -> dict[str, str]:
    return {**connection_options(broker), "topic": broker.output_topic, "checkpointLocation": checkpoint}


def record_options(broker: BrokerConfig) -> dict[str, str]:
    return {**connection_options(broker), **_PRODUCER, "topic": broker.topic}


def rejected_options(broker: BrokerConfig) -> dict[str, str]:
    return {**record_options(broker), "topic": broker.rejected_topic}


def read_stream(spark: SparkSession, broker: BrokerConfig) -> DataFrame:
    return spark.readStream.format("kafka").options(**stream_options(broker)).load()


def read_batch(spark: SparkSession, broker: BrokerConfig) -> DataFrame:
    return spark.read.format("kafka").options(**batch_options(broker)).load()


def alert_writer(keyed: DataFrame, broker: BrokerConfig, checkpoint: str) -> DataStreamWriter:
    """A writer of (key, value) rows to the alert topic; at least once, so readers drop repeated keys."""
    return keyed.writeStream.format("kafka").options(**alert_options(broker, checkpoint)).outputMode("append")


def write_records(keyed: DataFrame, options: dict[str, str]) -> None:
    """Write (key, value) rows of a batch to the topic of ``options``."""
    keyed.write.format("kafka").options(**options).save()
