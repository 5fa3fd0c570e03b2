"""Validation with a quarantine branch, and quality figures."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.scalar import computed_once, is_date_time, whole_number
from txguard.schemas import LABEL, LABELLED_TRANSACTION


@dataclass(frozen=True)
class Limits:
    """The ranges, patterns and required fields of a transaction record."""

    user_min: float = 1000
    user_max: float = 9999
    amount_min: float = 0.01
    amount_max: float = 100000
    currency: str = "^[A-Z]{3}$"
    location: str = "^[A-Z]{2}$"
    required: Sequence[str] = ("transaction_id", "user_id", "amount", "currency", "timestamp", "is_fraud")


def _outside(value: Column, low: float, high: float) -> Column:
    return ~value.between(low, high)


def _value_rules(limits: Limits) -> dict[str, Column]:
    """Violations that can be seen on typed columns."""
    return {
        "user_id:range": _outside(F.col("user_id"), limits.user_min, limits.user_max),
        "amount:range": _outside(F.col("amount"), limits.amount_min, limits.amount_max),
        "currency:pattern": ~F.col("currency").rlike(limits.currency),
        "location:pattern": ~F.col("location").rlike(limits.location),
        "is_fraud:range": _outside(F.col(LABEL), 0, 1),
    }


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the broken rules as one text: unlike filtering an array, this stays in generated code."""
    return computed_once(F.concat_ws(",", *[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def _listed(broken: Column) -> Column:
    return F.when(broken == "", F.array().cast("array<string>")).otherwise(F.split(broken, ","))


def validate(df: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Add ``violations``, the rules a typed row breaks; a required column that is absent is null."""
    limits = limits or Limits()
    missing = {
        f"{name}:required": F.col(name).isNull() if name in df.columns else F.lit(True) for name in limits.required
    }
    values = {name: rule for name, rule in _value_rules(limits).items() if name.split(":")[0] in df.columns}
    marked = df.withColumn("_broken", _broken({**missing, **values}))
    return marked.select(*df.columns, _listed(F.col("_broken")).alias("violations"))


def validate_messages(raw: DataFrame, limits: Limits | None = None, value: str = "value") -> DataFrame:
    """Decode JSON text and check it as written: types before conversion, then values.

    Adds the transaction columns, the label and ``violations`` to ``raw``.
    Fields of the wrong type are null; a whole number such as 1000.0 is a
    valid user id, and a time is a full RFC 3339 date-time. A null field has the wrong type, an absent one is only a
    violation where it is required.
    """
    limits = limits or Limits()
    text, number = ("STRING",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    fields = {
        "transaction_id": text,
        "user_id": number,
        "amount": number,
        "currency": text,
        "merchant": text,
        "timestamp": text,
        "location": text,
        LABEL: number,
    }
    each = ",".join(f"{f} variant" for f in fields)
    parsed = (
        raw.withColumn("_v", F.try_parse_json(value))
        .withColumns({"_record": F.schema_of_variant("_v"), "_f": F.try_variant_get("_v", "$", f"struct<{each}>")})
        .withColumns({f"_k_{f}": F.schema_of_variant(F.col("_f")[f]) for f in fields})
    )

    def right_kind(name: str) -> Column:
        return reduce(Column.__or__, [F.col(f"_k_{name}").startswith(kind) for kind in fields[name]])

    def typed(name: str, as_type: str) -> Column:
        return F.when(right_kind(name), F.try_variant_get(F.col("_f")[name], "$", as_type))

    decoded = parsed.withColumns(
        {
            "transaction_id": typed("transaction_id", "string"),
            "_user": typed("user_id", "double"),
            "user_id": whole_number(F.col("_f")["user_id"]),
            "amount": typed("amount", "double"),
            "currency": typed("currency", "string"),
            "merchant": typed("merchant", "string"),
            "_time": typed("timestamp", "string"),
            "location": typed("location", "string"),
            LABEL: typed(LABEL, "double"),
        }
    ).withColumn("timestamp", F.when(is_date_time(F.col("_time")), F.try_to_timestamp("_time")))
    is_object = F.col("_record").startswith("OBJECT")
    broken = {
        "record:json": F.col("_v").isNull(),
        "record:type": ~is_object,
        **{f"{f}:required": is_object & F.col(f"_k_{f}").isNull() for f in limits.required},
        **{f"{f}:type": ~right_kind(f) for f in fields},
        **_value_rules(limits),
        "user_id:range": _outside(F.col("_user"), limits.user_min, limits.user_max),
        "user_id:integer": F.col("_user").isNotNull() & F.col("user_id").isNull(),
        "is_fraud:integer": F.col(LABEL) != F.floor(LABEL),
        "timestamp:format": F.col("_time").isNotNull() & F.col("timestamp").isNull(),
    }
    columns = [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in LABELLED_TRANSACTION]
    marked = decoded.select(*raw.columns, *columns, _broken(broken).alias("_broken"))
    return marked.select(*raw.columns, *LABELLED_TRANSACTION.names, _listed(F.col("_broken")).alias("violations"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with violations; the first loses the ``violations`` column."""
    clean = F.size("violations") == 0
    return validated.where(clean).drop("violations"), validated.where(~clean)


def violation_report(validated: DataFrame) -> DataFrame:
    """Rows per broken rule."""
    # The outer form: the plain one makes the optimizer check the array, and so compute it, a second time.
    rules = validated.select(F.explode_outer("violations").alias("rule")).where(F.col("rule").isNotNull())
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def require_nonempty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows to work on")
    return df


def require_columns(df: DataFrame, columns: Sequence[str] = (LABEL,)) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def fraud_rate(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: the positive share in per cent."""
    return df.agg((F.avg(label) * 100).alias("fraud_rate"))


def label_support(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: rows and positives."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"))


def check_support(df: DataFrame, label: str = LABEL, low: int = 10) -> int:
    """The number of positives; none is an error, fewer than ``low`` a warning."""
    positives = label_support(df, label).first()["positives"]
    if positives == 0:
        raise ValueError("no positive samples")
    if positives < low:
        warnings.warn(f"only {positives} positive samples", stacklevel=2)
    return positives
