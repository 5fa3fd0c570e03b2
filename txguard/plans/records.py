"""Record production: check, set bad records aside, tag patterns, and key the rest as messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from txguard.operators.patterns import PatternRules, tag_patterns
from txguard.operators.quality import Limits, split_valid, validate
from txguard.sources.codec import encode


def produce_records(
    transactions: DataFrame,
    compromised: DataFrame | Iterable[int] = (),
    limits: Limits | None = None,
    rules: PatternRules | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(messages of valid records labelled with their pattern, quarantined records)."""
    valid, quarantined = split_valid(validate(transactions, limits))
    tagged = tag_patterns(valid, compromised, rules)
    return encode(tagged.select(*valid.columns, "pattern")), quarantined
