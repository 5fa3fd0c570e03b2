"""Training: split, balance, search, threshold, evaluation and registration."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.config import Config, ModelConfig
from txguard.functions.scalar import computed_once
from txguard.operators.encode import BROADCAST_CODES, OrdinalCodes, fit_codes
from txguard.operators.evaluate import best_threshold, classification_metrics, metric_record, to_label
from txguard.operators.oversample import oversample
from txguard.operators.quality import Limits, check_support, require_nonempty, split_valid, validate_messages
from txguard.operators.skew import fits_broadcast
from txguard.operators.split import split_stats, stratified_folds, stratified_split
from txguard.plans.features import add_features, training_rows
from txguard.plans.registry import Registry
from txguard.plans.scoring import DEFAULT_THRESHOLD, positive_probability
from txguard.schemas import LABEL, LABELLED_TRANSACTION, TRAINING_FEATURES
from txguard.session import reliable
from txguard.sources import kafka

ID = "transaction_id"
CODE = "merchant_code"

# The search space. Keys are parameters of the boosted trees.
# colsample_bytree becomes a share of features per node, gamma a minimal gain
# per split; L1 and L2 weights have no counterpart.
SEARCH_SPACE: dict[str, list] = {
    "maxDepth": [3, 5, 7],
    "stepSize": [0.01, 0.05, 0.1],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    "minInfoGain": [0.0, 0.1, 0.3],
}


@dataclass(frozen=True)
class FraudModel:
    """Merchant codes, boosted trees, and what a scorer needs to know about them."""

    codes: OrdinalCodes
    trees: GBTClassificationModel
    features: Sequence[str] = tuple(TRAINING_FEATURES)
    threshold: float = DEFAULT_THRESHOLD

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of the positive class, to rows with the model's features."""
        vectors = _assemble(self.codes.transform(df, CODE), self.features)
        scored = self.trees.transform(vectors).withColumn("score", computed_once(positive_probability()))
        return scored.select(*df.columns, "score")

    def save(self, uri: str) -> None:
        spark = self.codes.table.sparkSession
        about = {
            "features": list(self.features),
            "threshold": self.threshold,
            "column": self.codes.column,
        }
        self.codes.table.write.mode("overwrite").parquet(f"{uri}/codes")
        self.trees.write().overwrite().save(f"{uri}/trees")
        note = spark.createDataFrame([(json.dumps(about),)], "value string")
        note.coalesce(1).write.mode("overwrite").text(f"{uri}/about")

    @classmethod
    def load(cls, spark: SparkSession, uri: str) -> FraudModel:
        about = json.loads(spark.read.text(f"{uri}/about").first()["value"])
        table = spark.read.parquet(f"{uri}/codes")
        codes = OrdinalCodes(about["column"], table, fits_broadcast(table, BROADCAST_CODES))
        trees = GBTClassificationModel.load(f"{uri}/trees")
        return cls(codes, trees, about["features"], about["threshold"])


def vector_columns(features: Sequence[str] = TRAINING_FEATURES) -> list[str]:
    """The columns of the feature vector: the merchant's code first, if it is a feature, then the others as they are."""
    return [*([CODE] if "merchant" in features else []), *[f for f in features if f != "merchant"]]


def _assemble(encoded: DataFrame, features: Sequence[str] = TRAINING_FEATURES) -> DataFrame:
    columns = vector_columns(features)
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(encoded)


def default_params(config: ModelConfig) -> dict:
    return {
        "maxDepth": config.max_depth,
        "stepSize": config.learning_rate,
        "subsamplingRate": config.subsample,
        "featureSubsetStrategy": str(config.colsample_bytree),
        "minInfoGain": config.gamma,
    }


def _classifier(config: ModelConfig) -> GBTClassifier:
    return GBTClassifier(
        labelCol=LABEL, featuresCol="features", maxIter=config.n_estimators, seed=config.seed, checkpointInterval=10
    )


def _param_map(classifier: GBTClassifier, params: Mapping[str, object]) -> dict:
    return {classifier.getParam(name): value for name, value in params.items()}


def prepare(
    train: DataFrame, config: ModelConfig, features: Sequence[str] = TRAINING_FEATURES
) -> tuple[OrdinalCodes, DataFrame]:
    """Codes learnt from ``train`` and its rows encoded, balanced and assembled.

    Balancing comes after encoding, so synthetic rows also lie between the
    merchant codes of their pair. The rows are kept in the shared folder.
    """
    codes = fit_codes(train, "merchant")
    columns = vector_columns(features)
    balanced = oversample(codes.transform(train, CODE), columns, LABEL, ID, config.neighbours, config.seed)
    # Otherwise each task of every pass of a fit would report the metrics of all the steps that made its rows, cached or not.
    return codes, reliable(_assemble(balanced, features).select("features", LABEL))


def fit(
    train: DataFrame,
    config: ModelConfig | None = None,
    params: Mapping[str, object] | None = None,
    features: Sequence[str] = TRAINING_FEATURES,
) -> FraudModel:
    """Balance ``train`` and fit boosted trees to it."""
    config = config or ModelConfig()
    codes, rows = prepare(train, config, features)
    # Fitting reads the rows several times.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    classifier = _classifier(config)
    trees = classifier.fit(rows, _param_map(classifier, params or default_params(config)))
    rows.unpersist()
    return FraudModel(codes, trees, tuple(features))


def sample_candidates(config: ModelConfig, space: Mapping[str, Sequence] | None = None) -> list[dict]:
    """Distinct random points of the search space, all of it if it is smaller than the number asked for."""
    space = space or SEARCH_SPACE
    grid = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]
    return random.Random(config.seed).sample(grid, min(config.search_iterations, len(grid)))


def cross_validate(
    train: DataFrame,
    candidates: Sequence[Mapping[str, object]],
    config: ModelConfig,
    parallelism: int = 2,
    features: Sequence[str] = TRAINING_FEATURES,
) -> list[dict]:
    """Mean F2 of each candidate over stratified folds.

    Encoding and balancing see only a fold's training rows and do not depend on
    the candidate, so they are done once per fold and shared by its fits.
    """
    folded = reliable(stratified_folds(train, config.folds, LABEL, ID, config.seed))
    scores: list[list[float]] = [[] for _ in candidates]
    classifier = _classifier(config)
    for fold in range(config.folds):
        codes, rows = prepare(folded.where(F.col("fold") != fold).drop("fold"), config, features)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        held_out = folded.where(F.col("fold") == fold).drop("fold")

        def f2(params: Mapping[str, object], rows=rows, codes=codes, held_out=held_out) -> float:
            model = FraudModel(codes, classifier.fit(rows, _param_map(classifier, params)), tuple(features))
            labelled = model.transform(held_out).withColumn("prediction", to_label(F.col("score"), 0.5))
            return classification_metrics(labelled, LABEL, "prediction", beta=2.0).first()["f_beta"]

        with ThreadPoolExecutor(parallelism) as pool:
            for kept, value in zip(scores, pool.map(f2, candidates), strict=True):
                kept.append(value)
        rows.unpersist()
    return [{**params, "f2": sum(kept) / len(kept)} for params, kept in zip(candidates, scores, strict=True)]


def random_search(
    train: DataFrame,
    config: ModelConfig,
    space: Mapping[str, Sequence] | None = None,
    parallelism: int = 2,
    features: Sequence[str] = TRAINING_FEATURES,
) -> tuple[FraudModel, dict, list[dict]]:
    """Try random candidates by cross-validation and refit the best on all training rows."""
    results = cross_validate(train, sample_candidates(config, space), config, parallelism, features)
    best = max(results, key=lambda r: r["f2"])
    params = {name: value for name, value in best.items() if name != "f2"}
    return fit(train, config, params, features), params, results


def train_and_register(
    transactions: DataFrame,
    config: Config,
    registry: Registry,
    uri: str,
    space: Mapping[str, Sequence] | None = None,
    stage: str = "None",
    columns: Sequence[str] = TRAINING_FEATURES,
) -> tuple[FraudModel, dict[str, float]]:
    """From labelled transactions to a registered model and its hold-out metrics."""
    settings = config.model
    features = add_features(require_nonempty(transactions), config.high_risk_merchants)
    # Read by the search for the split's borders, then by every fold, fit and evaluation below.
    labelled = reliable(training_rows(features, [ID]))
    rows = reliable(stratified_split(labelled, LABEL, ID, settings.test_size, settings.seed))
    check_support(rows)
    train, test = (rows.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    stats = {r["split"]: r for r in split_stats(rows).collect()}

    model, params, _ = random_search(train, settings, space, features=columns)
    own = model.transform(train).select(F.col(LABEL).alias("label"), "score")
    threshold = best_threshold(own).first()["threshold"]
    model = FraudModel(model.codes, model.trees, model.features, threshold)

    held_out = model.transform(test).select(F.col(LABEL).alias("label"), "score")
    metrics = metric_record(held_out, threshold).first().asDict()
    model.save(uri)
    run = registry.log_run(
        params,
        {
            **metrics,
            "train_samples": stats["train"]["samples"],
            "positive_samples": stats["train"]["positive_samples"],
            "class_ratio": stats["train"]["class_ratio"],
            "test_samples": stats["test"]["samples"],
        },
    )
    registry.register(settings.name, run, uri, stage)
    return model, metrics


def train_from_messages(
    messages: DataFrame,
    config: Config,
    registry: Registry,
    uri: str,
    quarantine: str,
    limits: Limits | None = None,
    space: Mapping[str, Sequence] | None = None,
) -> tuple[FraudModel, dict[str, float]]:
    """From labelled messages to a registered model: decode, check, set aside, train.

    Messages that break a rule go to ``quarantine`` with the rules they break; a
    message that comes more than once is trained on once.
    """
    checked = reliable(validate_messages(messages.select("key", "value"), limits))
    valid, broken = split_valid(checked)
    broken.select("key", "value", "violations").write.mode("overwrite").parquet(quarantine)
    rows = valid.select(*LABELLED_TRANSACTION.names)
    first = F.min_by(F.struct(*rows.columns), F.struct("timestamp", F.xxhash64(*rows.columns)))
    once = rows.groupBy(F.col(ID).alias("_id")).agg(first.alias("_row")).select("_row.*")
    return train_and_register(once, config, registry, uri, space)


def training_job(spark: SparkSession, config: Config, registry: Registry, uri: str, quarantine: str) -> FraudModel:
    """Train on all that the transaction topic holds."""
    return train_from_messages(kafka.read_batch(spark, config.kafka), config, registry, uri, quarantine)[0]
