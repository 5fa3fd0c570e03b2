"""Record layouts and the fixed values the rules depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of a transaction record.
TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("location", T.StringType()),
    ]
)

LABEL = "is_fraud"

LABELLED_TRANSACTION = T.StructType([*TRANSACTION.fields, T.StructField(LABEL, T.IntegerType())])

# Merchants and locations treated as risky unless configured otherwise.
RISKY_MERCHANTS = ["QuickCash", "GlobalDigital", "FastMoneyX"]
ANOMALY_LOCATIONS = ["CN", "RU", "NG"]

# The columns a model is trained on, and the columns a scorer receives.
TRAINING_FEATURES = [
    "amount",
    "is_night",
    "is_weekend",
    "transaction_day",
    "user_activity_24h",
    "amount_to_avg_ratio",
    "merchant_risk",
    "merchant",
]
SCORING_COLUMNS = [
    "user_id",
    "amount",
    "currency",
    "transaction_hour",
    "is_weekend",
    "time_since_last_txn",
    "merchant_risk",
    "amount_to_avg_ratio",
    "is_night",
    "transaction_day",
    "user_activity_24h",
    "merchant",
]
# Feature columns of an alert, next to the transaction columns and the prediction.
ALERT_FEATURES = [
    "transaction_hour",
    "is_night",
    "is_weekend",
    "transaction_day",
    "time_since_last_txn",
    "user_activity_24h",
    "rolling_avg_7d",
    "amount_to_avg_ratio",
    "merchant_risk",
]
ALERT_COLUMNS = [*TRANSACTION.names, *ALERT_FEATURES, "prediction"]
