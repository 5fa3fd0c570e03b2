"""Runs and model versions as tables, and the choice of the best model."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.sources.files import read_or_empty

RUNS = "run_id string, params map<string,string>, metrics map<string,double>"
VERSIONS = "name string, version int, stage string, run_id string, uri string"

# The stages a model may be served from.
SERVED_STAGES = ("Production", "None")
_CLAIMING = threading.Lock()


def candidate_versions(
    versions: DataFrame,
    name: str | None = None,
    policy: str = "latest_per_stage",
    stages: Sequence[str] = SERVED_STAGES,
) -> DataFrame:
    """Versions that may be served: the latest of each served stage per model, or ``all`` of them."""
    served = versions.where(F.col("stage").isin(list(stages)))
    if name is not None:
        served = served.where(F.col("name") == name)
    if policy == "all":
        return served
    if policy != "latest_per_stage":
        raise ValueError(f"unknown candidate policy {policy!r}")
    # max_by combines on the map side, so a model with very many versions meets no single task.
    row = F.struct(*versions.columns)
    latest = served.groupBy("name", "stage").agg(F.max_by(row, F.col("version")).alias("_row"))
    return latest.select("_row.*")


def best_model(candidates: DataFrame, runs: DataFrame, metric: str = "auc_pr") -> DataFrame:
    """Per model name the version whose run has the highest metric, the lowest version among equals.

    A run without the metric counts as minus infinity, and a model all of whose
    candidates lack it has no best version.
    """
    value = F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(float("-inf")))
    scored = candidates.join(runs.select("run_id", value.alias("metric")), "run_id", "left").where(
        F.col("metric") > float("-inf")
    )
    row = F.struct("version", "stage", "run_id", "uri", "metric")
    best = scored.groupBy("name").agg(F.max_by(row, F.struct("metric", -F.col("version"))).alias("_best"))
    return best.select("name", "_best.*")


@dataclass(frozen=True)
class Registry:
    """Two parquet tables below ``root``, for any number of writers and readers.

    A writer claims a version by making a file that must not exist yet, and takes the
    next number if another one was faster. A claim whose writer fails leaves a gap.
    """

    spark: SparkSession
    root: str

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def versions(self) -> DataFrame:
        return self._read("model_versions", VERSIONS)

    def log_run(self, params: Mapping[str, object], metrics: Mapping[str, float]) -> str:
        run_id = uuid.uuid4().hex
        row = (run_id, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})
        self._append("runs", row, RUNS)
        return run_id

    def register(self, name: str, run_id: str, uri: str, stage: str = "None") -> int:
        last = self.versions().where(F.col("name") == name).agg(F.max("version").alias("v")).first()["v"]
        version = (last or 0) + 1
        while not self._claim(name, version):
            version += 1
        self._append("model_versions", (name, version, stage, run_id, uri), VERSIONS)
        return version

    def _claim(self, name: str, version: int) -> bool:
        """Whether this writer is the first to take ``version``."""
        folder = hashlib.sha256(name.encode()).hexdigest()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{folder}/{version}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # The store decides between processes; a local disk's check and creation are two steps, so threads wait.
        with _CLAIMING:
            try:
                files.create(place, False).close()
            except Py4JJavaError as error:
                if "AlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                return False
        return True

    def best(self, name: str, metric: str = "auc_pr", policy: str = "latest_per_stage") -> dict:
        candidates = candidate_versions(self.versions(), name, policy)
        if candidates.isEmpty():
            raise ValueError(f"no versions found for model {name}")
        found = best_model(candidates, self.runs(), metric).first()
        if found is None:
            raise ValueError(f"no version of model {name} has the metric {metric}")
        return found.asDict()

    def _read(self, table: str, schema: str) -> DataFrame:
        found = read_or_empty(self.spark, f"{self.root}/{table}", schema)
        return found.drop("entry")

    def _append(self, table: str, row: tuple, schema: str) -> None:
        one = self.spark.createDataFrame([row], schema).coalesce(1)
        # Writers that share a folder would remove each other's unfinished files.
        one.write.parquet(f"{self.root}/{table}/entry={uuid.uuid4().hex}")
