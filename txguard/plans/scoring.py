"""Scoring of batches and streams, by a trained model or a foreign Python model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.evaluate import to_label
from txguard.schemas import ALERT_COLUMNS, SCORING_COLUMNS

DEFAULT_THRESHOLD = 0.60


def positive_probability(probability: str = "probability") -> Column:
    """The second entry of a probability vector."""
    return vector_to_array(F.col(probability))[1]


def positive_share(predictions: object) -> np.ndarray:
    """Probabilities of the positive class from a model's 1-D or two-column output."""
    values = np.asarray(predictions)
    if values.ndim == 1:
        return values
    if values.ndim == 2 and values.shape[1] >= 2:
        return values[:, 1]
    raise ValueError(f"unexpected prediction shape {values.shape}")


def score_foreign(
    df: DataFrame, model: object, threshold: float = DEFAULT_THRESHOLD, columns: Sequence[str] = SCORING_COLUMNS
) -> DataFrame:
    """Add ``prediction`` by any Python object with ``predict(frame)``, in Arrow batches.

    The model is broadcast once; a batch is a pandas frame with ``columns``.
    """
    # Serialised with its code, so workers need not be able to import it.
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    names = list(columns)

    @F.pandas_udf("int")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        loaded = cloudpickle.loads(shared.value)
        for batch in batches:
            batch.columns = names
            yield pd.Series((positive_share(loaded.predict(batch)) >= threshold).astype("int32"))

    # Marked so that a filter on the prediction does not run the model a second time.
    return df.withColumn("prediction", predict.asNondeterministic()(F.struct(*names)))


def score_native(df: DataFrame, model, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``score`` and ``prediction`` by a trained model; None takes the model's own threshold."""
    limit = model.threshold if threshold is None else threshold
    return model.transform(df).withColumn("prediction", to_label(F.col("score"), limit))


def alerts(scored: DataFrame) -> DataFrame:
    """Rows predicted positive, with the alert columns."""
    return scored.where(F.col("prediction") == 1).select(*ALERT_COLUMNS)
