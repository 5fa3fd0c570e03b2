"""Stratified split and folds by hash order, without moving the rows.

Within each class the rows are put in the order of md5(id | seed). A part is a
run of that order with an exact number of rows, so it is fixed by the hash at
its border. The borders are found by narrowing down hash prefixes over counts;
the rows themselves are then labelled by a plain comparison, with no shuffle.

Ids are expected to be unique. Copies of one id always land in the same part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.schemas import LABEL

MAX_CLASSES = 100
# Hash buckets up to this many rows are searched by a sort; larger ones are narrowed down first.
BUCKET_ROWS = 200_000
_DIGITS = 4  # hexadecimal digits per narrowing step: 65,536 buckets
_HASH_DIGITS = 32

Border = tuple[str, str] | None


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class, in the order of the classes."""
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    if any(row[label] is None for row in found):
        raise ValueError(f"{label} has nulls")
    return dict(sorted((row[label], row["n"]) for row in found))


def split_quotas(counts: Mapping[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class: ceil(test_size * rows) in all, shared by largest remainder.

    The training share is what is rounded; equal remainders go to the lower class.
    """
    total = sum(counts.values())
    train = total - ceil(test_size * total)
    share = {c: divmod(n * train, total) for c, n in counts.items()}
    left = train - sum(whole for whole, _ in share.values())
    favoured = sorted(share, key=lambda c: (-share[c][1], c))[:left]
    return {c: n - share[c][0] - (c in favoured) for c, n in counts.items()}


def fold_quotas(counts: Mapping[int, int], folds: int) -> dict[int, list[int]]:
    """Rows per class and fold, as if the rows, sorted by class, were dealt out in turn."""
    quotas, start = {}, 0
    for label, n in counts.items():
        quotas[label] = [len(range((fold - start) % folds, n, folds)) for fold in range(folds)]
        start += n
    return quotas


def find_borders(
    df: DataFrame,
    label: str,
    id_col: str,
    seed: int,
    counts: Mapping[int, int],
    ranks: Mapping[int, Sequence[int]],
) -> dict[int, list[Border]]:
    """(hash, id) of the row at each rank (from 1) of each class; None for rank 0."""
    keyed = df.select(
        F.col(label).alias("label"), F.col(id_col).cast("string").alias("id"), hash_order(id_col, seed).alias("h")
    )
    spark = df.sparkSession
    # Searched positions: number, class, rank within the bucket, the bucket's prefix.
    wanted = [(c, i, r) for c, rs in ranks.items() for i, r in enumerate(rs) if r > 0]
    open_ = [(n, c, r, "") for n, (c, _, r) in enumerate(wanted)]
    largest, depth = max(counts.values(), default=0), 0
    schema = "n int, label long, r long, p string"

    def candidates() -> DataFrame:
        places = spark.createDataFrame(open_, schema).withColumnRenamed("label", "of")
        return keyed.join(
            F.broadcast(places),
            (F.col("label") == F.col("of")) & (F.substring("h", 1, depth) == F.col("p") if depth else F.lit(True)),
        )

    while open_ and largest > BUCKET_ROWS and depth < _HASH_DIGITS:
        depth_next = depth + _DIGITS
        up_to = Window.partitionBy("n").orderBy("p")
        picked = (
            candidates()
            .groupBy("n", "r", F.substring("h", 1, depth_next).alias("p"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("upto", F.sum("rows").over(up_to))
            .where(F.col("upto") >= F.col("r"))
            .groupBy("n", "r")
            .agg(F.min(F.struct("p", "rows", "upto")).alias("b"))
            .collect()
        )
        label_of = {n: c for n, c, _, _ in open_}
        open_ = [(x.n, label_of[x.n], x.r - (x.b.upto - x.b.rows), x.b.p) for x in picked]
        largest, depth = max(x.b.rows for x in picked), depth_next

    found: dict[int, Border] = {}
    if open_:
        up_to = Window.partitionBy("n").orderBy("h", "id")
        rows = (
            candidates()
            .groupBy("n", "r", "h", "id")
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("upto", F.sum("rows").over(up_to))
            .where(F.col("upto") >= F.col("r"))
            .groupBy("n")
            .agg(F.min(F.struct("h", "id")).alias("b"))
            .collect()
        )
        found = {x.n: (x.b.h, x.b.id) for x in rows}
    number = {(c, i): n for n, (c, i, _) in enumerate(wanted)}
    return {
        c: [found[number[c, i]] if (c, i) in number else None for i in range(len(rs))] for c, rs in ranks.items()
    }


def _part_number(label: str, id_col: str, seed: int, borders: Mapping[int, Sequence[Border]]) -> Column:
    """How many borders of its class a row lies beyond."""
    h, own = hash_order(id_col, seed), F.col(id_col).cast("string")

    def beyond(border: Border) -> Column:
        if border is None:
            return F.lit(1)
        at_hash, at_id = border
        return ((h > at_hash) | ((h == at_hash) & (own > at_id))).cast("int")

    number = F.lit(None).cast("int")
    for c, of_class in borders.items():
        passed = F.lit(0)
        for border in of_class:
            passed = passed + beyond(border)
        number = F.when(F.col(label) == c, passed).otherwise(number)
    return number


def stratified_split(
    df: DataFrame, label: str = LABEL, id_col: str = "transaction_id", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``, 'test' or 'train', with the class shares kept in both."""
    counts = class_counts(df, label)
    quotas = split_quotas(counts, test_size)
    borders = find_borders(df, label, id_col, seed, counts, {c: [n] for c, n in quotas.items()})
    part = _part_number(label, id_col, seed, borders)
    return df.withColumn("split", F.when(part == 0, "test").otherwise("train"))


def stratified_folds(
    df: DataFrame, k: int = 3, label: str = LABEL, id_col: str = "transaction_id", seed: int = 42
) -> DataFrame:
    """Add ``fold``, 0 … k-1, with the class shares kept in each."""
    counts = class_counts(df, label)
    quotas = fold_quotas(counts, k)
    ranks = {c: list(accumulate(per_fold))[:-1] for c, per_fold in quotas.items()}
    borders = find_borders(df, label, id_col, seed, counts, ranks)
    return df.withColumn("fold", _part_number(label, id_col, seed, borders))


def split_stats(split: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, positives and positive share per part."""
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(label).cast("long").alias("positive_samples"),
        F.avg(label).alias("class_ratio"),
    )
