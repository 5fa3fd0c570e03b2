"""Settings of the jobs, from a mapping or a YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from txguard.schemas import RISKY_MERCHANTS


@dataclass(frozen=True)
class BrokerConfig:
    topic: str = ""
    output_topic: str = "predicted"
    rejected_topic: str = "rejected"
    bootstrap_servers: str = "localhost:9092"
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str = "PLAIN"
    username: str = ""
    password: str = ""


@dataclass(frozen=True)
class ModelConfig:
    name: str = "fraud_detection_model"
    test_size: float = 0.2
    seed: int = 42
    n_estimators: int = 300
    learning_rate: float = 0.05
    max_depth: int = 5
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    gamma: float = 0.0
    search_iterations: int = 20
    folds: int = 3
    neighbours: int = 5


@dataclass(frozen=True)
class ScoringConfig:
    metric: str = "auc_pr"
    candidate_policy: str = "latest_per_stage"
    threshold: float | str = 0.60
    watermark: str = "24 hours"
    mode: str = "computed"
    # A folder that all machines share; needed by the streaming jobs, whose state lies there too.
    checkpoint_location: str = ""
    # Days without rows after which a user's state is removed, and the parts of a user's day.
    idle_days: float = 60.0
    user_day_slices: int = 1


@dataclass(frozen=True)
class SparkConfig:
    app_name: str = "txguard"
    packages: str = ""
    shuffle_partitions: int | None = None


@dataclass(frozen=True)
class Config:
    kafka: BrokerConfig = field(default_factory=BrokerConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    spark: SparkConfig = field(default_factory=SparkConfig)
    high_risk_merchants: tuple[str, ...] = tuple(RISKY_MERCHANTS)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Config:
        """Build from nested mappings; an unknown key is an error, a missing one its default."""
        parts = {"kafka": BrokerConfig, "model": ModelConfig, "scoring": ScoringConfig, "spark": SparkConfig}
        known = {f.name for f in fields(cls)}
        _reject_unknown("config", raw, known)
        built: dict[str, Any] = {}
        for name, part in parts.items():
            values = dict(raw.get(name) or {})
            _reject_unknown(name, values, {f.name for f in fields(part)})
            built[name] = part(**values)
        if raw.get("high_risk_merchants") is not None:
            built["high_risk_merchants"] = tuple(raw["high_risk_merchants"])
        return cls(**built)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading a YAML config needs the yaml package; use Config.from_dict") from missing
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})


def _reject_unknown(where: str, given: Mapping[str, Any], known: set[str]) -> None:
    unknown = sorted(set(given) - known)
    if unknown:
        raise ValueError(f"unknown {where} keys: {unknown}")
