from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txguard.operators import evaluate

SEVEN = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4), (0, 0.4)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def curve(spark, rows):
    found = evaluate.pr_curve(scored(spark, rows)).collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0]))


def by_hand(rows):
    """Precision, recall and F1 per threshold, and the average precision."""
    positives = sum(label for label, _ in rows)
    table, average, last = {}, 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        above = [label for label, s in rows if s >= t]
        p = sum(above) / len(above)
        r = sum(above) / positives if positives else 1.0
        average += (r - last) * p
        last = r
        table[t] = (p, r, 2 * p * r / (p + r) if p + r else 0.0)
    return table, average


def test_seven_rows(spark):
    assert evaluate.average_precision(scored(spark, SEVEN)).first()[0] == pytest.approx(0.755556, abs=1e-6)
    found = curve(spark, SEVEN)
    assert found[0] == (None, 1.0, 0.0)
    assert found[1] == (0.4, pytest.approx(3 / 7), 1.0)
    assert [r[0] for r in found[1:]] == [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])), min_size=1, max_size=30))
def test_against_hand_computation(spark, rows):
    table, average = by_hand(rows)
    found = {r[0]: r[1:] for r in curve(spark, rows)}
    assert found.pop(None) == (1.0, 0.0)
    assert found == {t: (pytest.approx(p), pytest.approx(r)) for t, (p, r, _) in table.items()}
    recalls = [found[t][1] for t in sorted(found)]
    assert recalls == sorted(recalls, reverse=True)
    assert evaluate.average_precision(scored(spark, rows)).first()[0] == pytest.approx(average if any(x for x, _ in rows) else 0.0)
    best = evaluate.best_threshold(scored(spark, rows)).first()
    top = max(f for _, _, f in table.values())
    assert best["f1"] == pytest.approx(top)
    assert best["threshold"] == min(t for t, (_, _, f) in table.items() if f == pytest.approx(top))


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only(spark, label):
    rows = [(label, 0.2), (label, 0.8)]
    found = curve(spark, rows)
    assert [r[1:] for r in found[1:]] == ([(0.0, 1.0), (0.0, 1.0)] if label == 0 else [(1.0, 1.0), (1.0, 0.5)])
    assert evaluate.average_precision(scored(spark, rows)).first()[0] == float(label)
    record = evaluate.metric_record(scored(spark, rows), 0.5).first().asDict()
    assert record["precision"] == float(label) and record["recall"] == label * 0.5


def test_many_distinct_scores_over_chunks(spark):
    """More distinct scores than fit one chunk give the same sums as one window over all."""
    rows = spark.range(20000).select(
        (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).cast("int").alias("label"), (F.xxhash64("id") % 15000 / 15000.0).alias("score")
    )
    table = evaluate.threshold_table(rows)
    from pyspark.sql import Window

    down = Window.orderBy(F.desc("threshold"))
    wrong = table.withColumns({"a": F.sum("rows").over(down), "p": F.sum("positives").over(down)}).where(
        (F.col("a") != F.col("above")) | (F.col("p") != F.col("positives_above"))
    )
    assert wrong.isEmpty() and table.count() > 5000


def test_metrics_at_a_threshold(spark):
    rows = scored(spark, SEVEN).withColumn("prediction", evaluate.to_label(F.col("score"), 0.6))
    cells = {tuple(r)[:2]: r["rows"] for r in evaluate.confusion_matrix(rows).collect()}
    assert cells == {(0, 0): 2, (0, 1): 2, (1, 0): 1, (1, 1): 2}
    rates = evaluate.classification_metrics(rows, beta=2.0).first()
    assert rates["precision"] == 0.5 and rates["recall"] == pytest.approx(2 / 3)
    assert rates["f1"] == pytest.approx(4 / 7)
    assert rates["f_beta"] == pytest.approx(5 * 0.5 * (2 / 3) / (4 * 0.5 + 2 / 3))
    record = evaluate.metric_record(scored(spark, SEVEN), 0.6).first()
    assert (record["precision"], record["recall"], record["f1"]) == pytest.approx(
        (rates["precision"], rates["recall"], rates["f1"])
    )
    assert record["auc_pr"] == pytest.approx(0.755556, abs=1e-6)


def test_nothing_predicted(spark):
    rows = scored(spark, SEVEN).withColumn("prediction", evaluate.to_label(F.col("score"), 2.0))
    assert tuple(evaluate.classification_metrics(rows).first()) == (0.0, 0.0, 0.0, 0.0)
    assert len(evaluate.confusion_matrix(rows).collect()) == 4
