"""The queries of ``workload`` in SQL, for comparison on the same tables."""

from __future__ import annotations

_EVENTS = """events_tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, user_id, value AS amount, 'USD' AS currency,
         event_type AS merchant, ts, epoch_us(ts) AS event_us, CAST(NULL AS VARCHAR) AS location
  FROM events)"""

_ORDERS = """orders_tx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, o_custkey AS user_id, o_totalprice AS amount,
         o_orderpriority AS merchant, o_orderdate AS ts, n_name AS location
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

_INDEBTED = "indebted AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0)"

_TAGGED_EVENTS = f"""{_EVENTS}, {_INDEBTED}, tagged AS (
  SELECT *, CASE
    WHEN user_id IN (SELECT user_id FROM indebted) AND amount > 100 THEN 'account_takeover'
    WHEN amount < 2 AND user_id % 10 = 0 THEN 'card_testing'
    WHEN merchant = 'error' AND amount > 150 THEN 'merchant_collusion' END AS pattern
  FROM events_tx)"""

_LABELLED = f"""{_TAGGED_EVENTS}, labelled AS (
  SELECT *, CAST(pattern IS NOT NULL AS INTEGER) AS is_fraud FROM tagged)"""

_TAGGED_ORDERS = f"""{_ORDERS}, {_INDEBTED}, rules AS (
  SELECT *,
    user_id IN (SELECT user_id FROM indebted) AND amount > 300000 AS account_takeover,
    amount < 20000 AND user_id % 10 = 0 AS card_testing,
    merchant IN ('1-URGENT', '5-LOW') AND amount > 450000 AS merchant_collusion,
    coalesce(user_id % 5 = 0 AND location IN ('NATION_3', 'NATION_7', 'NATION_11'), false) AS geo_anomaly
  FROM orders_tx), tagged AS (
  SELECT *, CASE WHEN account_takeover THEN 'account_takeover' WHEN card_testing THEN 'card_testing'
    WHEN merchant_collusion THEN 'merchant_collusion' WHEN geo_anomaly THEN 'geo_anomaly' END AS pattern
  FROM rules)"""


def _activity(source: str) -> str:
    return f"""frames AS (
  SELECT *,
    count(amount) OVER (PARTITION BY user_id ORDER BY ts
      RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS user_activity_24h,
    avg(amount) OVER (PARTITION BY user_id ORDER BY ts, transaction_id
      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg_rows,
    epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, transaction_id) AS gap,
    avg(amount) OVER (PARTITION BY user_id ORDER BY ts
      RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS avg_7d
  FROM {source}), activity AS (
  SELECT *, round(avg_rows, 6) AS rolling_avg_7rows,
    round(coalesce(amount / nullif(avg_rows, 0), 1.0), 6) AS amount_to_avg_ratio,
    round(coalesce(gap / 1000000.0, 0.0), 6) AS time_since_last_txn, round(avg_7d, 6) AS rolling_avg_7d
  FROM frames)"""


_CALENDAR = """CAST(hour(ts) AS INTEGER) AS transaction_hour,
  CAST(hour(ts) >= 22 OR hour(ts) < 5 AS INTEGER) AS is_night,
  CAST(dayofweek(ts) IN (0, 6) AS INTEGER) AS is_weekend,
  CAST(day(ts) AS INTEGER) AS transaction_day"""

_RISK = "CAST(merchant = 'error' AS INTEGER) AS merchant_risk"

_VIOLATIONS = f"""{_LABELLED}, checked AS (
  SELECT *, list_filter([
    CASE WHEN user_id NOT BETWEEN 10 AND 140 THEN 'user_id:range' END,
    CASE WHEN amount NOT BETWEEN 0.5 AND 200 THEN 'amount:range' END], lambda x: x IS NOT NULL) AS broken
  FROM labelled)"""

_MESSAGES = r"""raw AS (
  SELECT CAST(event_id AS VARCHAR) AS key, CASE event_id % 11 WHEN 0 THEN 'not json' WHEN 8 THEN '[1]' ELSE concat(
      '{"transaction_id":"', event_id, '","user_id":',
      CASE event_id % 11 WHEN 2 THEN concat('"', user_id, '"') WHEN 6 THEN concat(user_id, '.0')
        ELSE CAST(user_id AS VARCHAR) END,
      ',"amount":', CASE event_id % 11 WHEN 3 THEN concat('"', CAST(value AS DECIMAL(12,2)), '"')
        ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END,
      CASE event_id % 11 WHEN 1 THEN '' WHEN 4 THEN ',"currency":"usd"' ELSE ',"currency":"USD"' END,
      ',"merchant":', CASE event_id % 11 WHEN 7 THEN 'null' ELSE concat('"', event_type, '"') END,
      ',"timestamp":"', CASE event_id % 11 WHEN 5 THEN
        ['soon', '2024', '2024-01-01', '12:30:00', strftime(ts, '%Y-%m-%dT%H:%M:%S')][event_id // 11 % 5 + 1]
        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END,
      '","is_fraud":', event_id % 3, '}') END AS value
  FROM events), typed AS (
  SELECT *, CASE WHEN json_valid(value) THEN json_type(value) END AS record,
    CASE WHEN json_valid(value) THEN json_type(value, '$.user_id') END AS user_kind,
    CASE WHEN json_valid(value) THEN json_type(value, '$.amount') END AS amount_kind,
    CASE WHEN json_valid(value) THEN json_type(value, '$.currency') END AS currency_kind,
    CASE WHEN json_valid(value) THEN json_type(value, '$.merchant') END AS merchant_kind
  FROM raw), decoded AS (
  SELECT *,
    CASE WHEN user_kind <> 'VARCHAR' THEN CAST(json_extract_string(value, '$.user_id') AS DOUBLE) END AS user_value,
    CASE WHEN amount_kind <> 'VARCHAR' THEN CAST(json_extract_string(value, '$.amount') AS DOUBLE) END AS amount,
    CASE WHEN record = 'OBJECT' THEN json_extract_string(value, '$.currency') END AS currency,
    CASE WHEN record = 'OBJECT' THEN json_extract_string(value, '$.timestamp') END AS time_text,
    CASE WHEN record = 'OBJECT' THEN CAST(json_extract_string(value, '$.is_fraud') AS INTEGER) END AS is_fraud
  FROM typed), checked AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN record IS NULL THEN 'record:json' END,
    CASE WHEN record <> 'OBJECT' THEN 'record:type' END,
    CASE WHEN user_kind = 'VARCHAR' THEN 'user_id:type' END,
    CASE WHEN amount_kind = 'VARCHAR' THEN 'amount:type' END,
    CASE WHEN merchant_kind = 'NULL' THEN 'merchant:type' END,
    CASE WHEN record = 'OBJECT' AND currency_kind IS NULL THEN 'currency:required' END,
    CASE WHEN NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'currency:pattern' END,
    CASE WHEN amount NOT BETWEEN 0.5 AND 200 THEN 'amount:range' END,
    CASE WHEN time_text IS NOT NULL AND NOT (try_cast(time_text AS TIMESTAMPTZ) IS NOT NULL AND regexp_full_match(time_text,
      '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})')) THEN 'timestamp:format' END,
    CASE WHEN is_fraud NOT BETWEEN 0 AND 1 THEN 'is_fraud:range' END], lambda x: x IS NOT NULL)) AS broken
  FROM decoded)"""

_SPLIT = f"""{_LABELLED}, classes AS (SELECT is_fraud, count(*) AS n FROM labelled GROUP BY is_fraud),
shares AS (
  SELECT is_fraud, n, sum(n) OVER () AS total, sum(n) OVER () - ceil(0.2 * sum(n) OVER ()) AS train FROM classes),
whole AS (SELECT *, floor(n * train / total) AS base, (n * train) % total AS remainder FROM shares),
ranked AS (SELECT *, row_number() OVER (ORDER BY remainder DESC, is_fraud) AS place,
  train - sum(base) OVER () AS spare FROM whole),
quotas AS (SELECT is_fraud, n - base - CAST(place <= spare AS INTEGER) AS test FROM ranked),
ordered AS (SELECT *, row_number() OVER (PARTITION BY is_fraud
  ORDER BY md5(concat(transaction_id, '|42')), transaction_id) AS rn FROM labelled),
split AS (SELECT o.*, CASE WHEN rn <= test THEN 'test' ELSE 'train' END AS split
  FROM ordered o JOIN quotas USING (is_fraud))"""

_FOLDS = f"""{_LABELLED}, classes AS (SELECT is_fraud, count(*) AS n FROM labelled GROUP BY is_fraud),
starts AS (SELECT is_fraud, n, sum(n) OVER (ORDER BY is_fraud) - n AS start FROM classes),
dealt AS (SELECT is_fraud, CAST((start + unnest(range(n))) % 3 AS INTEGER) AS fold FROM starts),
sizes AS (SELECT is_fraud, fold, count(*) AS size FROM dealt GROUP BY ALL),
ends AS (SELECT *, sum(size) OVER (PARTITION BY is_fraud ORDER BY fold) AS upto FROM sizes),
ordered AS (SELECT *, row_number() OVER (PARTITION BY is_fraud
  ORDER BY md5(concat(transaction_id, '|42')), transaction_id) AS rn FROM labelled)"""

_BALANCE = f"""{_LABELLED}, points AS (
  SELECT transaction_id, amount, {_CALENDAR}, {_RISK}, is_fraud FROM labelled),
minority AS (SELECT transaction_id AS id, amount AS a, CAST(is_night AS DOUBLE) AS b,
  CAST(transaction_day AS DOUBLE) AS c, CAST(merchant_risk AS DOUBLE) AS d FROM points WHERE is_fraud = 1),
gaps AS (SELECT x.id, y.id AS neighbour, x.a, x.b, x.c, x.d, y.a AS na, y.b AS nb, y.c AS nc, y.d AS nd,
  (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) + (x.d - y.d) * (x.d - y.d) AS gap
  FROM minority x JOIN minority y ON x.id <> y.id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, neighbour) - 1 AS nth FROM gaps
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, neighbour) <= 5),
sizes AS (SELECT count_if(is_fraud = 1) AS small, count_if(is_fraud = 0) - count_if(is_fraud = 1) AS needed FROM points),
ranked AS (SELECT id, row_number() OVER (ORDER BY md5(concat(id, '|42')), id) - 1 AS place FROM minority),
pairs AS (SELECT place * 5 + nth AS pair, near.* FROM near JOIN ranked USING (id)),
numbers AS (SELECT unnest(range(CAST(needed AS BIGINT))) AS n, CAST(small AS BIGINT) AS small FROM sizes),
draws AS (SELECT n, CAST('0x' || substr(md5(concat('42|', n)), 1, 15) AS BIGINT) % (small * 5) AS pair,
  CAST('0x' || substr(md5(concat('42|', n)), 17, 12) AS BIGINT) / 281474976710656.0 AS step FROM numbers),
balanced AS (
  SELECT transaction_id, round(amount, 6) AS amount, CAST(is_night AS DOUBLE) AS is_night,
    CAST(transaction_day AS DOUBLE) AS transaction_day, CAST(merchant_risk AS DOUBLE) AS merchant_risk,
    is_fraud, false AS is_synthetic FROM points
  UNION ALL
  SELECT concat('synthetic-42-', n), round(a + step * (na - a), 6), round(b + step * (nb - b), 6),
    round(c + step * (nc - c), 6), round(d + step * (nd - d), 6), 1, true
  FROM draws JOIN pairs USING (pair))"""

def _stump(rows: str, group: str = "0") -> str:
    """``stump`` (g, merchant_risk, score) from the rows (g, transaction_id, merchant_risk, is_fraud) of each group.

    Synthetic rows repeat the 0 or 1 of the row they are drawn from, whose nearest neighbours are equal to it. A leaf is
    the mean of its labels as -1 and 1, and the score the logistic of twice that.
    """
    return f"""fitted AS (SELECT {group} AS g, transaction_id, merchant_risk, is_fraud FROM {rows}),
amounts AS (SELECT g, count_if(is_fraud = 1) AS small, count_if(is_fraud = 0) - count_if(is_fraud = 1) AS needed
  FROM fitted GROUP BY g),
placed AS (SELECT g, merchant_risk, row_number() OVER (PARTITION BY g ORDER BY md5(concat(transaction_id, '|42')),
  transaction_id) - 1 AS place FROM fitted WHERE is_fraud = 1),
made AS (SELECT g, small, unnest(range(CAST(needed AS BIGINT))) AS n FROM amounts),
drawn AS (SELECT g, CAST('0x' || substr(md5(concat('42|', n)), 1, 15) AS BIGINT) % (CAST(small AS BIGINT) * 5) // 5 AS place
  FROM made),
labels AS (SELECT g, merchant_risk, 2 * is_fraud - 1 AS y FROM fitted
  UNION ALL SELECT g, merchant_risk, 1 FROM drawn JOIN placed USING (g, place)),
stump AS (SELECT g, merchant_risk, 1 / (1 + exp(-2 * avg(y))) AS score FROM labels GROUP BY g, merchant_risk)"""


_SMOOTH = "amount / (amount + 100.0)"
_STEPPED = f"floor({_SMOOTH} * 100) / 100.0"


def _scores(score: str) -> str:
    return f"""{_LABELLED}, scored AS (
  SELECT transaction_id, is_fraud AS label, {score} AS score FROM labelled),
per_score AS (SELECT score, count(*) AS n, sum(label) AS positives FROM scored GROUP BY score),
sums AS (SELECT score, positives, sum(n) OVER (ORDER BY score DESC) AS above,
  sum(positives) OVER (ORDER BY score DESC) AS hits, sum(positives) OVER () AS total FROM per_score),
curve AS (SELECT score AS threshold, positives / total AS gained, hits / above AS precision, hits / total AS recall
  FROM sums),
with_f1 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM curve),
cells AS (SELECT count_if(label = 1 AND score >= 0.6) AS tp, count_if(label = 0 AND score >= 0.6) AS fp,
  count_if(label = 1 AND score < 0.6) AS fn, count_if(label = 0 AND score < 0.6) AS tn FROM scored),
rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM cells)"""


_CURVE = """SELECT {threshold} AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0"""

_VERSIONS = f"""{_EVENTS}, pairs AS (
  SELECT merchant AS name, CAST(user_id AS INTEGER) AS version, concat(merchant, '-', user_id) AS run_id,
    ['None', 'Staging', 'Production', 'Archived'][user_id % 4 + 1] AS stage, max(amount) AS top
  FROM events_tx GROUP BY merchant, user_id),
served AS (SELECT * FROM pairs WHERE stage IN ('Production', 'None'))"""

_FOREIGN = f"CAST({_SMOOTH} + 0.1 * CAST(merchant = 'error' AS INTEGER) >= 0.6 AS INTEGER)"

_ALERT = f"""SELECT transaction_id, user_id, amount, currency, merchant, {_CALENDAR},
  CAST(1000 AS BIGINT) AS user_activity_24h, {_RISK}, {_FOREIGN} AS prediction, event_us,
  round(amount / 1000.0, 6) AS amount_to_avg_ratio
FROM events_tx WHERE {_FOREIGN} = 1"""

_ALL_ACTIVITY = """SELECT transaction_id, user_activity_24h, rolling_avg_7rows, amount_to_avg_ratio,
  time_since_last_txn, rolling_avg_7d FROM activity"""

ORACLES: dict[str, str] = {
    "decode_json": f"""WITH {_EVENTS}
        SELECT transaction_id, user_id, amount, currency, merchant, event_us, location FROM events_tx""",
    "message_violations": f"""WITH {_MESSAGES}
        SELECT key, CAST(user_value AS BIGINT) AS user_id, amount, array_to_string(broken, ',') AS violations
        FROM checked""",
    "message_violation_report": f"""WITH {_MESSAGES}
        SELECT rule, count(*) AS rows FROM (SELECT unnest(broken) AS rule FROM checked) GROUP BY rule""",
    "validated_rows": f"""WITH {_VIOLATIONS}
        SELECT transaction_id, array_to_string(list_sort(broken), ',') AS violations FROM checked""",
    "valid_rows": f"""WITH {_VIOLATIONS}
        SELECT transaction_id, user_id, amount FROM checked WHERE len(broken) = 0""",
    "quarantined_rows": f"""WITH {_VIOLATIONS}
        SELECT transaction_id, CAST(len(broken) AS INTEGER) AS broken FROM checked WHERE len(broken) > 0""",
    "violations_per_rule": f"""WITH {_VIOLATIONS}
        SELECT rule, count(*) AS rows FROM (SELECT unnest(broken) AS rule FROM checked) GROUP BY rule""",
    "fraud_rate": f"WITH {_LABELLED} SELECT round(avg(is_fraud) * 100, 6) AS fraud_rate FROM labelled",
    "label_support": f"""WITH {_LABELLED}
        SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS positives FROM labelled""",
    "calendar_features": f"WITH {_EVENTS} SELECT transaction_id, {_CALENDAR} FROM events_tx",
    "risky_merchants": f"WITH {_EVENTS} SELECT transaction_id, {_RISK} FROM events_tx",
    "serving_placeholders": f"""WITH {_EVENTS}
        SELECT transaction_id, CAST(0 AS DOUBLE) AS time_since_last_txn, CAST(1000 AS BIGINT) AS user_activity_24h,
          CAST(1000 AS DOUBLE) AS rolling_avg_7d, round(amount / 1000.0, 6) AS amount_to_avg_ratio
        FROM events_tx""",
    "iso_timestamps": f"""WITH {_EVENTS}
        SELECT transaction_id, epoch_us(ts - INTERVAL 2 HOURS) AS event_us FROM events_tx""",
    "user_activity_24h": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, user_activity_24h FROM activity""",
    "amount_ratio_7rows": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, rolling_avg_7rows, amount_to_avg_ratio FROM activity""",
    "time_since_last": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, time_since_last_txn FROM activity""",
    "rolling_avg_7d": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, rolling_avg_7d FROM activity""",
    "order_activity": f"WITH {_ORDERS}, {_activity('orders_tx')} {_ALL_ACTIVITY}",
    "heavy_user_activity": f"WITH {_EVENTS}, {_activity('events_tx')} {_ALL_ACTIVITY}",
    "training_features": f"""WITH {_LABELLED}, {_activity('labelled')}
        SELECT transaction_id, amount, {_CALENDAR}, user_activity_24h, amount_to_avg_ratio, {_RISK}, merchant, is_fraud
        FROM activity""".replace("CAST(hour(ts) AS INTEGER) AS transaction_hour,", "", 1),
    "scoring_features": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, user_id, amount, currency, {_CALENDAR}, time_since_last_txn, {_RISK},
          amount_to_avg_ratio, user_activity_24h, merchant
        FROM activity""",
    "tagged_patterns": f"""WITH {_TAGGED_ORDERS}
        SELECT transaction_id, account_takeover, card_testing, merchant_collusion, geo_anomaly, pattern,
          pattern IS NOT NULL AS is_flagged
        FROM tagged""",
    "tagged_events": f"""WITH {_TAGGED_EVENTS}
        SELECT transaction_id, pattern, pattern IS NOT NULL AS is_flagged FROM tagged""",
    "patterns_summed": f"""WITH {_TAGGED_ORDERS}
        SELECT coalesce(pattern, 'none') AS pattern, count(*) AS rows, round(sum(amount), 2) AS amount,
          count(DISTINCT user_id) AS users
        FROM tagged GROUP BY 1""",
    "flagged_transactions": f"""WITH {_TAGGED_EVENTS}, {_activity('tagged')}
        SELECT transaction_id, user_id, merchant, pattern, {_CALENDAR}, user_activity_24h, {_RISK}, amount,
          amount_to_avg_ratio, time_since_last_txn, rolling_avg_7d
        FROM activity WHERE pattern IS NOT NULL""",
    "produced_records": f"""WITH {_VIOLATIONS}
        SELECT transaction_id, user_id, amount, event_us, is_fraud, pattern FROM checked WHERE len(broken) = 0""",
    "split_rows": f"WITH {_SPLIT} SELECT transaction_id, is_fraud, split FROM split",
    "split_figures": f"""WITH {_SPLIT}
        SELECT split, count(*) AS samples, CAST(sum(is_fraud) AS BIGINT) AS positive_samples,
          round(avg(is_fraud), 6) AS class_ratio
        FROM split GROUP BY split""",
    "fold_rows": f"""WITH {_FOLDS}
        SELECT o.transaction_id, o.is_fraud, e.fold
        FROM ordered o JOIN ends e ON o.is_fraud = e.is_fraud AND o.rn > e.upto - e.size AND o.rn <= e.upto""",
    "ordinal_codes": f"""WITH {_EVENTS}, named AS (
          SELECT transaction_id, ts, concat(merchant, '-', user_id) AS merchant FROM events_tx),
        codes AS (SELECT merchant, CAST(dense_rank() OVER (ORDER BY merchant) - 1 AS DOUBLE) AS code
          FROM (SELECT DISTINCT merchant FROM named WHERE substr(md5(merchant), 1, 1) BETWEEN '0' AND 'a'))
        SELECT transaction_id, merchant, coalesce(code, -1.0) AS merchant_code
        FROM named LEFT JOIN codes USING (merchant)""",
    "minority_neighbours": f"WITH {_BALANCE} SELECT id, CAST(nth AS INTEGER) AS nth, neighbour FROM near",
    "minority_neighbours_boxed": f"WITH {_BALANCE} SELECT id, CAST(nth AS INTEGER) AS nth, neighbour FROM near",
    "oversampled_rows": f"""WITH {_BALANCE}
        SELECT transaction_id, amount, is_night, transaction_day, merchant_risk, is_fraud, is_synthetic FROM balanced""",
    "oversampled_counts": f"""WITH {_BALANCE}
        SELECT is_fraud, count(*) AS rows, count_if(is_synthetic) AS synthetic_rows FROM balanced GROUP BY is_fraud""",
    "pr_curve": f"WITH {_scores(_STEPPED)} {_CURVE.format(threshold='threshold')}",
    "pr_curve_fine": f"WITH {_scores(_SMOOTH)} {_CURVE.format(threshold='round(threshold, 6)')}",
    "average_precision": f"""WITH {_scores(_SMOOTH)}
        SELECT round(sum(gained * precision), 6) AS average_precision FROM curve""",
    "best_threshold": f"""WITH {_scores(_STEPPED)}
        SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
        FROM with_f1 ORDER BY with_f1.f1 DESC, threshold LIMIT 1""",
    "threshold_labels": f"""WITH {_scores(_STEPPED)}
        SELECT transaction_id, CAST(score >= 0.6 AS INTEGER) AS prediction FROM scored""",
    "classification_metrics": f"""WITH {_scores(_STEPPED)}
        SELECT round(p, 6) AS precision, round(r, 6) AS recall,
          round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
          round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS f_beta
        FROM rates""",
    "confusion_matrix": f"""WITH {_scores(_STEPPED)}
        SELECT 0 AS label, 0 AS prediction, tn AS rows FROM rates UNION ALL SELECT 0, 1, fp FROM rates
        UNION ALL SELECT 1, 0, fn FROM rates UNION ALL SELECT 1, 1, tp FROM rates""",
    "metric_record": f"""WITH {_scores(_STEPPED)}
        SELECT (SELECT round(sum(gained * precision), 6) FROM curve) AS auc_pr, round(p, 6) AS precision,
          round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
          CAST(0.6 AS DOUBLE) AS threshold
        FROM rates""",
    "candidates": f"""WITH {_VERSIONS}
        SELECT name, version, stage, run_id FROM served
        QUALIFY row_number() OVER (PARTITION BY name, stage ORDER BY version DESC) = 1""",
    "best_models": f"""WITH {_VERSIONS}
        SELECT name, version, stage, run_id, floor(top / 50.0) AS metric FROM served WHERE version % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY floor(top / 50.0) DESC, version) = 1""",
    "logged_run": f"""WITH {_scores(_STEPPED)}
        SELECT 'fraud_detection_model' AS name, 1 AS version, 'None' AS stage,
          round(sum(gained * precision), 6) AS metric
        FROM curve""",
    "foreign_scores": f"WITH {_EVENTS} SELECT transaction_id, {_FOREIGN} AS prediction FROM events_tx",
    "alerts_from_messages": f"WITH {_EVENTS} {_ALERT}",
    "alerts_with_activity": f"""WITH {_EVENTS}, {_activity('events_tx')}
        SELECT transaction_id, amount, user_activity_24h, {_RISK}, amount_to_avg_ratio, time_since_last_txn,
          rolling_avg_7d
        FROM activity WHERE {_FOREIGN} = 1""",
    "stream_features": f"WITH {_EVENTS}, {_activity('events_tx')} {_ALL_ACTIVITY}",
    "stream_alerts": f"WITH {_EVENTS} {_ALERT}",
    "stream_without_repeats": f"""WITH {_EVENTS}, bounds AS (SELECT min(event_us) AS low, max(event_us) AS high FROM events_tx),
turns AS (SELECT *, CAST(transaction_id AS BIGINT) % 13 = 0 AS nameless,
  coalesce((event_us - low) // ((high - low) // 3 + 1), 0) AS turn FROM events_tx, bounds)
SELECT transaction_id, user_id, amount, event_us FROM (
  SELECT CASE WHEN NOT nameless THEN transaction_id END AS transaction_id, user_id, amount, event_us,
    unnest(range(CASE WHEN nameless AND turn < 2 THEN 2 ELSE 1 END)) AS time FROM turns)""",
    "running_patterns": f"""WITH {_TAGGED_ORDERS}
        SELECT coalesce(pattern, 'none') AS pattern, count(*) AS rows, round(sum(amount), 2) AS amount,
          count(DISTINCT user_id) AS users
        FROM tagged GROUP BY 1""",
    "alerts_once": f"WITH {_EVENTS} {_ALERT}",
    "delivery_figures": f"""WITH {_EVENTS}, bounds AS (SELECT min(event_us) AS low, max(event_us) AS high FROM events_tx),
turns AS (SELECT transaction_id, event_us, coalesce((event_us - low) // ((high - low) // 3 + 1), 0) AS turn FROM events_tx, bounds),
known AS (SELECT *, turn = 0 AND CAST(transaction_id AS BIGINT) % 50 = 0 AS slow FROM turns),
delivered AS (
  SELECT *, turn AS delivery FROM known WHERE NOT slow
  UNION ALL SELECT *, turn + 1 FROM known WHERE NOT slow AND turn < 2
  UNION ALL SELECT *, 2 FROM known WHERE slow),
marks AS (SELECT delivery + 1 AS delivery, max(event_us) - 86400000000 AS mark FROM delivered GROUP BY 1),
judged AS (SELECT d.*, coalesce(event_us // 1000 <= mark // 1000, false) AS late,
    row_number() OVER (PARTITION BY transaction_id, coalesce(event_us // 1000 <= mark // 1000, false) ORDER BY delivery) > 1 AS repeated
  FROM delivered d LEFT JOIN marks USING (delivery))
SELECT CAST(delivery AS BIGINT) AS delivery, count(*) + 2 AS arrived, CAST(2 AS BIGINT) AS rejected, count_if(late) AS late, count_if(NOT late AND repeated) AS repeated,
  count_if(NOT late AND NOT repeated) AS passed FROM judged GROUP BY delivery""",
    "served_alerts": f"""WITH {_EVENTS}, chosen AS (SELECT * FROM events_tx WHERE CAST(transaction_id AS BIGINT) % 2 = 1),
{_activity('chosen')} SELECT transaction_id, user_activity_24h, rolling_avg_7rows, amount_to_avg_ratio, time_since_last_txn,
  rolling_avg_7d, true AS agrees FROM activity""",
    "rejected_by_job": "SELECT * FROM (VALUES ('bad', 3), ('none', 3)) AS v(key, messages) WHERE (SELECT count(*) FROM events) > 0",
    "training_from_messages": f"""WITH {_MESSAGES}, classes AS (
  SELECT is_fraud, count(*) AS n FROM checked WHERE len(broken) = 0 GROUP BY is_fraud),
shares AS (
  SELECT is_fraud, n, sum(n) OVER () AS total, sum(n) OVER () - ceil(0.2 * sum(n) OVER ()) AS train FROM classes),
whole AS (SELECT *, floor(n * train / total) AS base, (n * train) % total AS remainder FROM shares),
ranked AS (SELECT *, row_number() OVER (ORDER BY remainder DESC, is_fraud) AS place,
  train - sum(base) OVER () AS spare FROM whole),
taken AS (SELECT is_fraud, n, base + CAST(place <= spare AS INTEGER) AS train FROM ranked)
SELECT CAST(sum(train) AS BIGINT) AS train_samples, CAST(sum(train) FILTER (is_fraud = 1) AS BIGINT) AS positive_samples,
  CAST(sum(n - train) AS BIGINT) AS test_samples, (SELECT count(*) FROM checked WHERE len(broken) > 0) AS set_aside
FROM taken""",
    "scored_gbt": f"""WITH {_SPLIT}, featured AS (SELECT *, {_RISK} FROM split),
{_stump("(SELECT * FROM featured WHERE split = 'train')")}
SELECT transaction_id, is_fraud, round(score, 6) AS score, CAST(score >= 0.6 AS INTEGER) AS prediction
FROM featured JOIN stump USING (merchant_risk) WHERE split = 'test'""",
    "cv_results": f"""WITH {_FOLDS.replace("% 3", "% 2")}, featured AS (
  SELECT o.*, {_RISK}, (SELECT min(fold) FROM ends e WHERE e.is_fraud = o.is_fraud AND o.rn <= e.upto) AS fold FROM ordered o),
others AS (SELECT f.*, held FROM featured f JOIN range(2) AS h(held) ON fold <> held),
{_stump("others", "held")},
judged AS (SELECT fold, is_fraud, CAST(score >= 0.5 AS INTEGER) AS prediction
  FROM featured f JOIN stump s ON s.g = f.fold AND s.merchant_risk = f.merchant_risk),
rates AS (SELECT fold, count_if(is_fraud = 1 AND prediction = 1) AS tp, count_if(prediction = 1) AS p, count_if(is_fraud = 1) AS t
  FROM judged GROUP BY fold),
scored AS (SELECT coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(t, 0), 0) AS re FROM rates),
mean AS (SELECT round(avg(coalesce(5 * pr * re / nullif(4 * pr + re, 0), 0)), 6) AS f2 FROM scored)
SELECT 1 AS "maxDepth", CAST(step AS DOUBLE) AS "stepSize", f2 FROM mean, (VALUES (0.05), (0.1)) AS v(step)""",
    "trained_model_metrics": f"""WITH {_SPLIT}, featured AS (SELECT *, {_RISK} FROM split),
{_stump("(SELECT * FROM featured WHERE split = 'train')")},
judged AS (SELECT split, is_fraud AS label, score FROM featured JOIN stump USING (merchant_risk)),
levels AS (SELECT split, score, count(*) AS n, sum(label) AS pos FROM judged GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER down AS above, sum(pos) OVER down AS pos_above, sum(pos) OVER (PARTITION BY split) AS total
  FROM levels WINDOW down AS (PARTITION BY split ORDER BY score DESC)),
rated AS (SELECT *, pos_above / above AS p, pos_above / total AS r FROM summed),
best AS (SELECT score AS t FROM rated WHERE split = 'train' ORDER BY coalesce(2 * p * r / nullif(p + r, 0), 0) DESC, score LIMIT 1),
held AS (SELECT sum(pos / total * p) AS auc_pr, coalesce(sum(pos) FILTER (score >= t) / sum(n) FILTER (score >= t), 0) AS p,
  coalesce(sum(pos) FILTER (score >= t) / sum(pos), 0) AS r, any_value(t) AS t FROM rated, best WHERE split = 'test'),
figures AS (SELECT split, count(*) AS n, sum(label) AS pos FROM judged GROUP BY split)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT unnest(['auc_pr', 'precision', 'recall', 'f1', 'threshold']) AS metric,
    unnest([auc_pr, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0), t]) AS value FROM held
  UNION ALL SELECT unnest(['train_samples', 'positive_samples', 'class_ratio']), unnest([n, pos, pos / n]) FROM figures WHERE split = 'train'
  UNION ALL SELECT 'test_samples', n FROM figures WHERE split = 'test')""",
}
