"""Evaluation of scored rows (label 0/1 and score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.operators.skew import CHUNK, ordered_chunks, running_sums


def to_label(score: Column, threshold: float | Column) -> Column:
    """1 from the threshold on, else 0."""
    return (score >= threshold).cast("int")


def _share(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(otherwise))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """Weighted harmonic mean; 0 where precision and recall are both 0."""
    weight = beta * beta
    return _share((1 + weight) * precision * recall, weight * precision + recall)


def threshold_table(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score: rows and positives with it, and those at or above it.

    Rows are counted per score first, with partial sums on the map side, so
    ties cost nothing. The running sums go over range partitions of the score.
    """
    per_score = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives")
    )
    chunks = ordered_chunks(
        per_score.withColumns({"above": F.col("rows"), "positives_above": F.col("positives")}), [F.desc("threshold")]
    )
    total = chunks.agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("n")).first()["n"]
    sums = running_sums(chunks, [F.desc("threshold")], ["above", "positives_above"]).drop(CHUNK)
    return sums.withColumns(
        {
            "above": F.col("above") + F.col("rows"),
            "positives_above": F.col("positives_above") + F.col("positives"),
            "positives_total": F.lit(total).cast("long"),
        }
    )


def _with_rates(table: DataFrame) -> DataFrame:
    precision = _share(F.col("positives_above"), F.col("above"))
    # Without any positive, recall counts as 1 at every threshold.
    recall = _share(F.col("positives_above"), F.col("positives_total"), otherwise=1.0)
    return table.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", f_beta(F.col("precision"), F.col("recall"))
    )


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall per distinct score, and the end point (1, 0) without a threshold."""
    columns = ["threshold", "precision", "recall"]
    points = _with_rates(threshold_table(scored, label, score)).select(*columns)
    end = scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def best_threshold(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the threshold with the highest F1, the lowest one among equals."""
    table = _with_rates(threshold_table(scored, label, score))
    return table.orderBy(F.desc("f1"), F.asc("threshold")).limit(1).select("threshold", "precision", "recall", "f1")


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the sum of precision times recall gained, by falling score."""
    table = _with_rates(threshold_table(scored, label, score))
    gained = _share(F.col("positives"), F.col("positives_total"))
    return table.agg(F.coalesce(F.sum(gained * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: true and false negatives and positives."""

    def rows(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    return df.agg(
        rows(0, 0).alias("true_negatives"),
        rows(0, 1).alias("false_positives"),
        rows(1, 0).alias("false_negatives"),
        rows(1, 1).alias("true_positives"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Four rows: label, prediction, rows; also where a combination does not occur."""
    cells = {
        (0, 0): "true_negatives",
        (0, 1): "false_positives",
        (1, 0): "false_negatives",
        (1, 1): "true_positives",
    }
    listed = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(name).alias("rows"))
            for (a, p), name in cells.items()
        ]
    )
    return confusion_counts(df, label, prediction).select(F.inline(listed))


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 1.0
) -> DataFrame:
    """One row: precision, recall, F1 and F-beta; 0 where a rate has no denominator."""
    hit, false, miss = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    rates = confusion_counts(df, label, prediction).select(
        _share(hit, hit + false).alias("precision"), _share(hit, hit + miss).alias("recall")
    )
    return rates.withColumns(
        {
            "f1": f_beta(F.col("precision"), F.col("recall")),
            "f_beta": f_beta(F.col("precision"), F.col("recall"), beta),
        }
    )


def metric_record(
    scored: DataFrame, threshold: float, label: str = "label", score: str = "score", average_name: str = "auc_pr"
) -> DataFrame:
    """One row: average precision, and precision, recall and F1 at a threshold."""
    table = _with_rates(threshold_table(scored, label, score)).withColumn(
        "_taken", F.col("threshold") >= F.lit(float(threshold))
    )
    gained = _share(F.col("positives"), F.col("positives_total"))
    taken = table.agg(
        F.coalesce(F.sum(gained * F.col("precision")), F.lit(0.0)).alias(average_name),
        _share(F.sum(F.when(F.col("_taken"), F.col("positives"))), F.sum(F.when(F.col("_taken"), F.col("rows")))).alias(
            "precision"
        ),
        _share(F.sum(F.when(F.col("_taken"), F.col("positives"))), F.sum("positives")).alias("recall"),
    )
    return taken.withColumns(
        {"f1": f_beta(F.col("precision"), F.col("recall")), "threshold": F.lit(float(threshold))}
    )
