"""Queries over the analytic tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txguard.config import Config, ModelConfig, ScoringConfig
from txguard.functions.scalar import add_calendar, iso_timestamp, merchant_risk
from txguard.operators import evaluate, quality
from txguard.operators.activity import add_activity
from txguard.operators.encode import fit_codes
from txguard.operators.oversample import nearest_neighbours, oversample
from txguard.operators.patterns import PATTERNS, PatternRules, pattern_summary, sum_users, tag_patterns, users_summed
from txguard.operators.quality import Limits, split_valid, validate, validate_messages, violation_report
from txguard.operators.split import split_stats, stratified_folds, stratified_split
from txguard.plans.features import add_features, scoring_rows, training_rows
from txguard.plans.records import produce_records
from txguard.plans.registry import Registry, best_model, candidate_versions
from txguard.plans.scoring import alerts, score_foreign, score_native
from txguard.plans.serving import Sinks, scorer, scoring_job
from txguard.plans.training import ID, FraudModel, cross_validate, fit, train_and_register, train_from_messages
from txguard.schemas import LABEL, LABELLED_TRANSACTION
from txguard.session import reliable, scratch_path
from txguard.sources import files
from txguard.sources.codec import decode, encode
from txguard.sources.tables import events_as_transactions, orders_as_transactions
from txguard.streaming.committed import Committed, changed_groups
from txguard.streaming.dedup import drop_repeats
from txguard.streaming.figures import counted_rows, figures
from txguard.streaming.history import with_history
from txguard.streaming.scorer import alert_rows

# The tables' amounts, users and names differ from payment data, so the rules get other thresholds.
EVENT_RISKY = ["error"]
EVENT_RULES = PatternRules(
    takeover_amount=100.0,
    testing_amount=2.0,
    testing_user_step=10,
    collusion_amount=150.0,
    geo_user_step=50,
    risky_merchants=EVENT_RISKY,
)
ORDER_RULES = PatternRules(
    takeover_amount=300000.0,
    testing_amount=20000.0,
    testing_user_step=10,
    collusion_amount=450000.0,
    geo_user_step=5,
    risky_merchants=["1-URGENT", "5-LOW"],
    anomaly_locations=["NATION_3", "NATION_7", "NATION_11"],
)
EVENT_LIMITS = Limits(user_min=10, user_max=140, amount_min=0.5, amount_max=200)
MESSAGE_LIMITS = Limits(user_min=0, user_max=1e9, amount_min=0.5, amount_max=200)
SEED = 42

Query = Callable[[SparkSession, str], DataFrame]


def _utc(spark: SparkSession) -> SparkSession:
    """The settings of ``spark_session`` that matter here, for a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_transactions(_utc(spark), folder)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return orders_as_transactions(_utc(spark), folder)


def _indebted(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a negative balance stand for compromised users."""
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    return customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").cast("long").alias("user_id"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Events labelled by the rules."""
    events = _events(spark, folder)
    tagged = tag_patterns(events, _indebted(spark, folder), EVENT_RULES)
    return tagged.select(*events.columns, F.col("is_flagged").cast("int").alias(LABEL))


def _smooth_score() -> Column:
    return F.col("amount") / (F.col("amount") + 100.0)


def _scored(spark: SparkSession, folder: str, steps: int | None = 100) -> DataFrame:
    """Label and score of the events, the score cut to ``steps`` levels so that ties occur."""
    score = _smooth_score()
    if steps:
        score = F.floor(score * steps).cast("double") / float(steps)
    return _labelled(spark, folder).select("transaction_id", F.col(LABEL).alias("label"), score.alias("score"))


def _r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _micros(name: str = "timestamp") -> Column:
    return F.unix_micros(name).alias("event_us")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return add_features(_labelled(spark, folder), EVENT_RISKY)


class ShareModel:
    """A foreign model: the positive share grows with the amount and with merchant risk."""

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        amount = frame["amount"].to_numpy()
        positive = amount / (amount + 100.0) + 0.1 * frame["merchant_risk"].to_numpy()
        return np.column_stack([1.0 - positive, positive])


def _foreign_scorer(features: DataFrame) -> DataFrame:
    return score_foreign(features, ShareModel(), 0.60)


# --- Messages and validation ------------------------------------------------


def decode_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode(encode(_events(spark, folder)))
    return rows.select("transaction_id", "user_id", "amount", "currency", "merchant", _micros(), "location")


def _flawed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as JSON text, with eight kinds of flaws worked in, one of them five kinds of bad times."""
    events = _utc(spark).read.parquet(f"{folder}/events.parquet")
    kind = F.col("event_id") % 11
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    user = F.col("user_id").cast("string")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    fixed = [F.lit(text) for text in ("soon", "2024", "2024-01-01", "12:30:00")]
    bad_times = F.array(*fixed, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    bad_time = F.element_at(bad_times, (F.floor(F.col("event_id") / 11) % 5 + 1).cast("int"))

    fields = F.concat(
        F.lit('{"transaction_id":'),
        quoted(F.col("event_id").cast("string")),
        F.lit(',"user_id":'),
        F.when(kind == 2, quoted(user)).when(kind == 6, F.concat(user, F.lit(".0"))).otherwise(user),
        F.lit(',"amount":'),
        F.when(kind == 3, quoted(amount)).otherwise(amount),
        F.when(kind == 1, "").when(kind == 4, ',"currency":"usd"').otherwise(',"currency":"USD"'),
        F.lit(',"merchant":'),
        F.when(kind == 7, "null").otherwise(quoted(F.col("event_type"))),
        F.lit(',"timestamp":'),
        quoted(F.when(kind == 5, bad_time).otherwise(time)),
        F.lit(',"is_fraud":'),
        (F.col("event_id") % 3).cast("string"),
        F.lit("}"),
    )
    value = F.when(kind == 0, "not json").when(kind == 8, "[1]").otherwise(fields)
    return events.select(F.col("event_id").cast("string").alias("key"), value.alias("value"))


def message_violations(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate_messages(_flawed_messages(spark, folder), MESSAGE_LIMITS)
    return checked.select("key", "user_id", "amount", F.array_join(F.sort_array("violations"), ",").alias("violations"))


def message_violation_report(spark: SparkSession, folder: str) -> DataFrame:
    return violation_report(validate_messages(_flawed_messages(spark, folder), MESSAGE_LIMITS))


def validated_rows(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate(_labelled(spark, folder), EVENT_LIMITS)
    return checked.select("transaction_id", F.array_join(F.sort_array("violations"), ",").alias("violations"))


def valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = split_valid(validate(_labelled(spark, folder), EVENT_LIMITS))
    return valid.select("transaction_id", "user_id", "amount")


def quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, quarantined = split_valid(validate(_labelled(spark, folder), EVENT_LIMITS))
    return quarantined.select("transaction_id", F.size("violations").cast("int").alias("broken"))


def violations_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    return violation_report(validate(_labelled(spark, folder), EVENT_LIMITS))


def fraud_rate(spark: SparkSession, folder: str) -> DataFrame:
    return quality.fraud_rate(_labelled(spark, folder)).select(_r6("fraud_rate"))


def label_support(spark: SparkSession, folder: str) -> DataFrame:
    return quality.label_support(_labelled(spark, folder))


# --- Row features -------------------------------------------------------------


def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["transaction_id", "transaction_hour", "is_night", "is_weekend", "transaction_day"]
    return add_calendar(_events(spark, folder)).select(*columns)


def risky_merchants(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    named = F.when(F.col("merchant") != "signup", F.col("merchant"))
    return events.select("transaction_id", merchant_risk(named, EVENT_RISKY).alias("merchant_risk"))


def serving_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    rows = add_features(_events(spark, folder), EVENT_RISKY, mode="placeholder")
    names = ["transaction_id", "time_since_last_txn", "user_activity_24h", "rolling_avg_7d"]
    return rows.select(*names, _r6("amount_to_avg_ratio"))


def iso_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    rows = _events(spark, folder).select("transaction_id", text.alias("text"))
    return rows.select("transaction_id", F.unix_micros(iso_timestamp(F.col("text"))).alias("event_us"))


# --- Per-user features --------------------------------------------------------


def user_activity_24h(spark: SparkSession, folder: str) -> DataFrame:
    return add_activity(_events(spark, folder)).select("transaction_id", "user_activity_24h")


def amount_ratio_7rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = add_activity(_events(spark, folder))
    return rows.select("transaction_id", _r6("rolling_avg_7rows"), _r6("amount_to_avg_ratio"))


def time_since_last(spark: SparkSession, folder: str) -> DataFrame:
    return add_activity(_events(spark, folder)).select("transaction_id", _r6("time_since_last_txn"))


def rolling_avg_7d(spark: SparkSession, folder: str) -> DataFrame:
    return add_activity(_events(spark, folder)).select("transaction_id", _r6("rolling_avg_7d"))


def _all_activity(rows: DataFrame) -> DataFrame:
    means = ["rolling_avg_7rows", "amount_to_avg_ratio", "time_since_last_txn", "rolling_avg_7d"]
    return rows.select("transaction_id", "user_activity_24h", *[_r6(m) for m in means])


def order_activity(spark: SparkSession, folder: str) -> DataFrame:
    return _all_activity(add_activity(_orders(spark, folder)))


def heavy_user_activity(spark: SparkSession, folder: str) -> DataFrame:
    """The way of users too large for one task, taken by every user with more than 60 rows."""
    return _all_activity(add_activity(_events(spark, folder), max_user_rows=60))


def training_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_rows(_features(spark, folder), [ID])
    return rows.withColumn("amount_to_avg_ratio", F.round("amount_to_avg_ratio", 6))


def scoring_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = add_features(_events(spark, folder), EVENT_RISKY)
    scored = scoring_rows(rows, ["transaction_id", *scoring_rows(rows).columns])
    rounded = {name: F.round(name, 6) for name in ("amount_to_avg_ratio", "time_since_last_txn")}
    return scored.withColumns(rounded)


# --- Rules --------------------------------------------------------------------


def tagged_patterns(spark: SparkSession, folder: str) -> DataFrame:
    tagged = tag_patterns(_orders(spark, folder), _indebted(spark, folder), ORDER_RULES)
    return tagged.select("transaction_id", *PATTERNS, "pattern", "is_flagged")


def tagged_events(spark: SparkSession, folder: str) -> DataFrame:
    tagged = tag_patterns(_events(spark, folder), _indebted(spark, folder), EVENT_RULES)
    return tagged.select("transaction_id", "pattern", "is_flagged")


def patterns_summed(spark: SparkSession, folder: str) -> DataFrame:
    tagged = tag_patterns(_orders(spark, folder), _indebted(spark, folder), ORDER_RULES)
    return pattern_summary(tagged).withColumn("amount", F.round("amount", 2))


def flagged_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: all features of every event, and of those the ones a rule flags."""
    rows = add_features(_events(spark, folder), EVENT_RISKY)
    flagged = tag_patterns(rows, _indebted(spark, folder), EVENT_RULES).where("is_flagged")
    whole = ["transaction_id", "user_id", "merchant", "pattern", "transaction_hour", "is_night", "is_weekend"]
    means = ["amount", "amount_to_avg_ratio", "time_since_last_txn", "rolling_avg_7d"]
    return flagged.select(*whole, "transaction_day", "user_activity_24h", "merchant_risk", *[_r6(m) for m in means])


def produced_records(spark: SparkSession, folder: str) -> DataFrame:
    """Valid events as labelled messages, read back."""
    messages, _ = produce_records(_labelled(spark, folder), _indebted(spark, folder), EVENT_LIMITS, EVENT_RULES)
    rows = decode(messages, T.StructType([*LABELLED_TRANSACTION.fields, T.StructField("pattern", T.StringType())]))
    return rows.select("transaction_id", "user_id", "amount", _micros(), LABEL, "pattern")


# --- Splits, codes, balancing -------------------------------------------------


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(_labelled(spark, folder), seed=SEED).select("transaction_id", LABEL, "split")


def split_figures(spark: SparkSession, folder: str) -> DataFrame:
    stats = split_stats(stratified_split(_labelled(spark, folder), seed=SEED))
    return stats.withColumn("class_ratio", F.round("class_ratio", 6))


def fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_folds(_labelled(spark, folder), 3, seed=SEED).select("transaction_id", LABEL, "fold")


def ordinal_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes learnt from two thirds of the names, by hash; the others are unknown."""
    events = _events(spark, folder).withColumn("merchant", F.concat_ws("-", "merchant", F.col("user_id").cast("string")))
    codes = fit_codes(events.where(F.substring(F.md5("merchant"), 1, 1).between("0", "a")), "merchant")
    return codes.transform(events).select("transaction_id", "merchant", "merchant_code")


BALANCED_FEATURES = ["amount", "is_night", "transaction_day", "merchant_risk"]


def _to_balance(spark: SparkSession, folder: str) -> DataFrame:
    rows = add_calendar(_labelled(spark, folder))
    return rows.withColumn("merchant_risk", merchant_risk(F.col("merchant"), EVENT_RISKY))


def minority_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    minority = _to_balance(spark, folder).where(F.col(LABEL) == 1)
    return nearest_neighbours(minority, BALANCED_FEATURES, ID).select("id", "nth", "neighbour")


def minority_neighbours_boxed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the way of large minorities."""
    minority = _to_balance(spark, folder).where(F.col(LABEL) == 1)
    return nearest_neighbours(minority, BALANCED_FEATURES, ID, exact_rows=0).select("id", "nth", "neighbour")


def oversampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = oversample(_to_balance(spark, folder), BALANCED_FEATURES, seed=SEED)
    return rows.select("transaction_id", *[_r6(f) for f in BALANCED_FEATURES], LABEL, "is_synthetic")


def oversampled_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = oversample(_to_balance(spark, folder), BALANCED_FEATURES, seed=SEED)
    return rows.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_synthetic").alias("synthetic_rows")
    )


# --- Evaluation ---------------------------------------------------------------


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.pr_curve(_scored(spark, folder)).select("threshold", _r6("precision"), _r6("recall"))


def pr_curve_fine(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.pr_curve(_scored(spark, folder, None))
    return rows.select(_r6("threshold"), _r6("precision"), _r6("recall"))


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.average_precision(_scored(spark, folder, None)).select(_r6("average_precision"))


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    best = evaluate.best_threshold(_scored(spark, folder))
    return best.select("threshold", _r6("precision"), _r6("recall"), _r6("f1"))


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).withColumn("prediction", evaluate.to_label(F.col("score"), 0.60))


def threshold_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _predicted(spark, folder).select("transaction_id", "prediction")


def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rates = evaluate.classification_metrics(_predicted(spark, folder), beta=2.0)
    return rates.select(*[_r6(c) for c in ("precision", "recall", "f1", "f_beta")])


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(_predicted(spark, folder))


def metric_record(spark: SparkSession, folder: str) -> DataFrame:
    record = evaluate.metric_record(_scored(spark, folder), 0.60)
    return record.select(*[_r6(c) for c in ("auc_pr", "precision", "recall", "f1", "threshold")])


# --- Registry -----------------------------------------------------------------


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every (event type, user) as a version of the model named by the event type."""
    pairs = _events(spark, folder).groupBy("merchant", "user_id").agg(F.max("amount").alias("top"))
    stage = F.element_at(F.array(*map(F.lit, ("None", "Staging", "Production", "Archived"))), F.col("n"))
    return pairs.withColumn("n", (F.col("user_id") % 4 + 1).cast("int")).select(
        F.col("merchant").alias("name"),
        F.col("user_id").cast("int").alias("version"),
        stage.alias("stage"),
        F.concat_ws("-", "merchant", F.col("user_id").cast("string")).alias("run_id"),
        F.lit("").alias("uri"),
        "top",
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_versions(_versions(spark, folder)).select("name", "version", "stage", "run_id")


def best_models(spark: SparkSession, folder: str) -> DataFrame:
    """Every third version lacks the metric."""
    versions = _versions(spark, folder)
    metric = F.when(F.col("version") % 3 == 0, F.lit("f1")).otherwise(F.lit("auc_pr"))
    runs = versions.select("run_id", F.create_map(metric, F.floor(F.col("top") / 50.0).cast("double")).alias("metrics"))
    chosen = best_model(candidate_versions(versions.drop("top"), policy="all"), runs)
    return chosen.select("name", "version", "stage", "run_id", "metric")


def logged_run(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the scored events, logged, registered and read back as the best model."""
    registry = Registry(_utc(spark), scratch_path(spark, "registry"))
    record = evaluate.metric_record(_scored(spark, folder), 0.60).first().asDict()
    registry.register("fraud_detection_model", registry.log_run({"threshold": 0.60}, record), "")
    chosen = best_model(candidate_versions(registry.versions()), registry.runs())
    return chosen.select("name", "version", "stage", F.round("metric", 6).alias("metric"))


# --- Models -------------------------------------------------------------------


def foreign_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _foreign_scorer(add_features(_events(spark, folder), EVENT_RISKY))
    return rows.select("transaction_id", "prediction")


SMALL_MODEL = ModelConfig(n_estimators=5, max_depth=3, search_iterations=2, folds=2)
SMALL_SPACE = {"maxDepth": [3], "stepSize": [0.05, 0.1]}


# A model that SQL can follow: one tree with one split, on the 0/1 column merchant_risk.
STUMP = ModelConfig(n_estimators=1, max_depth=1, subsample=1.0, colsample_bytree=1.0, folds=2)
STUMP_FEATURES = ["merchant_risk"]


def scored_gbt(spark: SparkSession, folder: str) -> DataFrame:
    """A tree trained on the balanced training part, saved, loaded, and applied to the test part."""
    rows = reliable(stratified_split(training_rows(_features(spark, folder), [ID]), seed=SEED))
    place = scratch_path(spark, "stump")
    fit(rows.where(F.col("split") == "train").drop("split"), STUMP, features=STUMP_FEATURES).save(place)
    model = FraudModel.load(spark, place)
    scored = score_native(rows.where(F.col("split") == "test").drop("split"), model, 0.60)
    return scored.select(ID, LABEL, F.round("score", 6).alias("score"), "prediction")


def cv_results(spark: SparkSession, folder: str) -> DataFrame:
    """Mean F2 of two candidates over the folds."""
    rows = training_rows(_features(spark, folder), [ID])
    tried = [{"maxDepth": 1, "stepSize": 0.05, "subsamplingRate": 1.0}, {"maxDepth": 1, "stepSize": 0.1, "subsamplingRate": 1.0}]
    results = cross_validate(rows, tried, STUMP, features=STUMP_FEATURES)
    schema = "maxDepth int, stepSize double, f2 double"
    return spark.createDataFrame([(r["maxDepth"], r["stepSize"], round(r["f2"], 6)) for r in results], schema)


def trained_model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The whole training: features, split, search, threshold, evaluation, saved and registered model."""
    place = scratch_path(_utc(spark), "training")
    registry = Registry(spark, f"{place}/registry")
    config = Config(model=STUMP, high_risk_merchants=tuple(EVENT_RISKY))
    space = {"maxDepth": [1], "stepSize": [0.05, 0.1], "subsamplingRate": [1.0]}
    train_and_register(_labelled(spark, folder), config, registry, f"{place}/model", space, columns=STUMP_FEATURES)
    metrics = registry.runs().select(F.explode("metrics").alias("metric", "value"))
    return metrics.select("metric", _r6("value"))


# --- Alerts and streams -------------------------------------------------------


def alerts_from_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The alert rows of a table of messages, written as messages and read back."""
    found = alert_rows(encode(_events(spark, folder)), _foreign_scorer, EVENT_RISKY)
    return _alert_columns(decode(encode(found), found.schema))


def alerts_with_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts scored with the computed per-user features."""
    rows = _foreign_scorer(add_features(_events(spark, folder), EVENT_RISKY))
    found = alerts(rows)
    means = ["amount_to_avg_ratio", "time_since_last_txn", "rolling_avg_7d"]
    return found.select("transaction_id", "amount", "user_activity_24h", "merchant_risk", *[_r6(m) for m in means])


def _alert_columns(rows: DataFrame) -> DataFrame:
    names = ["transaction_id", "user_id", "amount", "currency", "merchant", "transaction_hour", "is_night"]
    more = ["is_weekend", "transaction_day", "user_activity_24h", "merchant_risk", "prediction"]
    return rows.select(*names, *more, _micros(), _r6("amount_to_avg_ratio"))


def _turn(events: DataFrame, parts: int) -> Column:
    """The row's delivery, of ``parts`` by time, rows without a time first."""
    first, last = events.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    width = (last - first) // parts + 1
    return F.coalesce(F.floor((F.unix_micros("timestamp") - first) / width), F.lit(0))


def _arrivals(events: DataFrame, parts: int, repeats: bool = False) -> list[DataFrame]:
    """Rows as messages in ``parts`` deliveries by time; with ``repeats`` each also brings the one before."""
    turn = _turn(events, parts)

    def delivery(n: int) -> DataFrame:
        return encode(events.where(turn.isin([n, n - 1] if repeats else [n])))

    return [delivery(n) for n in range(parts)]


def _deliver(spark: SparkSession, arrivals: list[DataFrame], start: Callable[[DataFrame, str], object], again: bool = False) -> str:
    """Put each delivery in place, then run the stream over what is new, from the same checkpoint.

    ``start`` gives a writer, several, or a function that starts the query. With
    ``again`` a run that fails is started once more.
    """
    place = scratch_path(spark, "stream")
    for delivery in arrivals:
        delivery.write.mode("append").parquet(f"{place}/in")
        messages = files.read_stream(spark, f"{place}/in", files_per_batch=1000)
        started = start(messages, place)
        for writer in started if isinstance(started, list) else [started]:
            run = writer if callable(writer) else writer.trigger(availableNow=True).start
            try:
                run().awaitTermination()
            except StreamingQueryException:
                if not again:
                    raise
                run().awaitTermination()
    return place


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    """Per-user features of a stream of three deliveries, each a restart from the checkpoint."""

    def start(messages: DataFrame, place: str):
        def write(features: DataFrame, number: int) -> None:
            features.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

        return with_history(decode(messages), write, f"{place}/checkpoint")

    place = _deliver(spark, _arrivals(_events(spark, folder), 3), start)
    return _all_activity(spark.read.parquet(f"{place}/out"))


def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    def start(messages: DataFrame, place: str):
        found = alert_rows(messages, _foreign_scorer, EVENT_RISKY)
        return files.alert_writer(found, f"{place}/out", f"{place}/checkpoint")

    place = _deliver(spark, _arrivals(_events(spark, folder), 2), start)
    return _alert_columns(spark.read.parquet(f"{place}/out"))


def stream_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every message but the last delivery's arrives twice; each transaction with an id comes out once.

    Every 13th has none.
    """
    events = _events(spark, folder)
    nameless = F.col("transaction_id").cast("long") % 13 == 0
    events = events.withColumn("transaction_id", F.when(~nameless, F.col("transaction_id")))

    def start(messages: DataFrame, place: str):
        once = drop_repeats(decode(messages), combine_first=True)
        return files.alert_writer(once, f"{place}/out", f"{place}/checkpoint")

    place = _deliver(spark, _arrivals(events, 3, repeats=True), start)
    return spark.read.parquet(f"{place}/out").select("transaction_id", "user_id", "amount", _micros())


def running_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Pattern sums of three deliveries of orders, kept up to date by the groups that each delivery changes."""
    indebted, store = _indebted(spark, folder), []

    def start(messages: DataFrame, place: str):
        groups = users_summed(tag_patterns(decode(messages), indebted, ORDER_RULES))
        store.append(Committed(spark, f"{place}/sums"))
        return changed_groups(groups, store[-1].write, f"{place}/checkpoint")

    _deliver(spark, _arrivals(_orders(spark, folder), 3), start)
    newest = store[-1].newest("pattern string, user_id long, rows long, amount double", ["pattern", "user_id"])
    return sum_users(newest).withColumn("amount", F.round("amount", 2))


def alerts_once(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of a job that is stopped after it wrote a delivery, before Spark noted that, and started again."""
    store, failed = [], []

    def start(messages: DataFrame, place: str):
        store.append(Committed(spark, f"{place}/alerts"))

        def write(found: DataFrame, number: int) -> None:
            store[-1].write(found, number)
            if not failed:
                failed.append(number)
                raise RuntimeError("stopped after the rows were written")

        found = alert_rows(messages, _foreign_scorer, EVENT_RISKY)
        return found.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint")

    _deliver(spark, _arrivals(_events(spark, folder), 2), start, again=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alert_rows(encode(_events(spark, folder)), _foreign_scorer, EVENT_RISKY).schema)
    return _alert_columns(store[-1].read(schema))


def delivery_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Messages rejected, late, repeated and passed in each of three deliveries; every 50th of the first comes with the third."""
    events, queries = _events(spark, folder), []
    malformed = spark.createDataFrame([("bad", "no json"), ("none", None)], files.MESSAGE)
    turn = _turn(events, 3)
    slow = (turn == 0) & (F.col("transaction_id").cast("long") % 50 == 0)
    kinds = [(turn == 0) & ~slow, turn.isin([0, 1]) & ~slow, turn.isin([1, 2]) | slow]
    arrivals = [encode(events.where(kind)) for kind in kinds]

    def start(messages: DataFrame, place: str):
        rows = counted_rows(messages)

        def run() -> StreamingQuery:
            query = files.alert_writer(rows, f"{place}/out", f"{place}/checkpoint").trigger(availableNow=True).start()
            queries.append(query)
            return query

        return run

    _deliver(spark, [part.union(malformed) for part in arrivals], start)
    parts = [figures(spark, [query]).withColumn("delivery", F.lit(n).cast("long")) for n, query in enumerate(queries)]
    counts = ["arrived", "rejected", "late", "repeated", "passed"]
    return reduce(DataFrame.unionByName, parts).groupBy("delivery").agg(*[F.sum(c).alias(c) for c in counts])


def _served(spark: SparkSession, folder: str) -> tuple[DataFrame, FraudModel, str]:
    """Events with odd ids, streamed in three deliveries that bring messages twice, to a model of the others."""
    events, odd = _labelled(spark, folder), F.col("transaction_id").cast("long") % 2 == 1
    # Fitting reads the rows several times.
    model = fit(reliable(training_rows(add_features(events.where(~odd), EVENT_RISKY), [ID])), SMALL_MODEL)
    streamed = events.where(odd).drop(LABEL)
    malformed = spark.createDataFrame([("bad", "no json"), ("none", None)], files.MESSAGE)
    arrivals = [part.unionByName(malformed) for part in _arrivals(streamed, 3, repeats=True)]

    def start(messages: DataFrame, place: str) -> list:
        scoring = ScoringConfig(threshold=0.5, checkpoint_location=f"{place}/checks")
        config = Config(scoring=scoring, high_risk_merchants=tuple(EVENT_RISKY))

        def into(name: str) -> Callable[[DataFrame, int], None]:
            return lambda df, number: df.write.mode("overwrite").parquet(f"{place}/{name}/batch={number}")

        return scoring_job(messages, scorer(model, config), config, Sinks(into("alerts"), into("rejected")))

    return streamed, model, _deliver(spark, arrivals, start)


def served_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the streamed events, and whether the job's alerts equal the batch's features and predictions."""
    streamed, model, place = _served(spark, folder)
    batch = score_native(add_features(streamed, EVENT_RISKY), model, 0.5)
    alerted = decode(spark.read.schema(files.MESSAGE).parquet(*_batches(spark, f"{place}/alerts")), alerts(batch).schema)
    names = [c for c in alerted.columns if c != ID]
    seen = alerted.groupBy(ID).agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(f"seen_{c}") for c in names])
    same = reduce(Column.__and__, [F.col(f"seen_{c}").eqNullSafe(F.col(c)) for c in names])
    agrees = F.when(F.col("prediction") == 1, (F.col("times") == 1) & same).otherwise(F.col("times").isNull())
    rows = batch.join(seen, ID, "left").withColumn("agrees", F.coalesce(agrees, F.lit(False)))
    means = ["rolling_avg_7rows", "amount_to_avg_ratio", "time_since_last_txn", "rolling_avg_7d"]
    return rows.select(ID, "user_activity_24h", *[_r6(m) for m in means], "agrees")


def _batches(spark: SparkSession, root: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return [f.getPath().toString() for f in found]


def rejected_by_job(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that the scoring job sets aside."""
    _, _, place = _served(spark, folder)
    rejected = spark.read.schema(files.MESSAGE).parquet(*_batches(spark, f"{place}/rejected"))
    return rejected.groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


def training_from_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of a training run on files of messages, flaws among them, and of what it set aside."""
    place = scratch_path(_utc(spark), "training")
    _flawed_messages(spark, folder).write.parquet(f"{place}/in")
    messages = files.read_batch(spark, f"{place}/in", files.MESSAGE)
    registry = Registry(spark, f"{place}/registry")
    config = Config(model=SMALL_MODEL, high_risk_merchants=tuple(EVENT_RISKY))
    train_from_messages(messages, config, registry, f"{place}/model", f"{place}/aside", MESSAGE_LIMITS, SMALL_SPACE)
    aside = spark.read.parquet(f"{place}/aside").agg(F.count(F.lit(1)).alias("set_aside"))
    names = ("train_samples", "positive_samples", "test_samples")
    run = registry.runs().select(*[F.col("metrics")[n].cast("long").alias(n) for n in names])
    return run.withColumn("set_aside", F.lit(aside.first()[0]))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        decode_json,
        message_violations,
        message_violation_report,
        validated_rows,
        valid_rows,
        quarantined_rows,
        violations_per_rule,
        fraud_rate,
        label_support,
        calendar_features,
        risky_merchants,
        serving_placeholders,
        iso_timestamps,
        user_activity_24h,
        amount_ratio_7rows,
        time_since_last,
        rolling_avg_7d,
        order_activity,
        heavy_user_activity,
        training_features,
        scoring_features,
        tagged_patterns,
        tagged_events,
        patterns_summed,
        flagged_transactions,
        produced_records,
        split_rows,
        split_figures,
        fold_rows,
        ordinal_codes,
        minority_neighbours,
        minority_neighbours_boxed,
        oversampled_rows,
        oversampled_counts,
        pr_curve,
        pr_curve_fine,
        average_precision,
        best_threshold,
        threshold_labels,
        classification_metrics,
        confusion_matrix,
        metric_record,
        candidates,
        best_models,
        logged_run,
        foreign_scores,
        scored_gbt,
        cv_results,
        trained_model_metrics,
        alerts_from_messages,
        alerts_with_activity,
        stream_features,
        stream_alerts,
        stream_without_repeats,
        running_patterns,
        alerts_once,
        delivery_figures,
        served_alerts,
        rejected_by_job,
        training_from_messages,
    )
}
