"""Mixing sources to target weights by systematic sampling.

A document's expected number of copies is its source's target over its source's
size. Within a source, in the order of size, the expected copies are summed up,
one random offset is added, and a document is emitted once per integer that its
part of the sum crosses. In the order of size the words taken from a source miss
its target by less than its largest document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.llm.text import HEAVY_ROWS, ROW, identified, with_decisions, word_count
from txguard.operators.skew import CHUNK, fits_broadcast, left_join_skewed, ordered_chunks, running_sums, with_position
from txguard.session import reliable

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
CAP = 2
KEY = "__source"
MAX_SOURCES = 1_000_000


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP
) -> DataFrame:
    """Add ``weight``, ``target``, ``per`` and ``of`` to (``__source``, ``source``, ``source_size``).

    Sources by code point, null last, get the weights in turn. Together they are
    to give ``share`` (a fraction) of all sizes; what a source cannot give, since
    targets stop at ``cap`` times its size, is shared out again by weight. The
    sources that stop are those with the least size per weight, so one ordered
    pass finds them. A row's expected copies are the exact fraction ``per / of``.
    """
    named = with_position(sizes, [F.col("source").isNull(), F.col("source"), F.col(KEY)], "__rank")
    turn = F.array(*[F.lit(w) for w in weights])
    common = math.lcm(*weights)
    weighed = named.withColumn("weight", F.element_at(turn, (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("__order", _exact(F.col("source_size")) * (F.lit(common) / F.col("weight")).cast("long"))
    order = ["__order", "__rank"]
    summed = weighed.withColumns({"__sizes": F.col("source_size"), "__weights": F.col("weight")})
    summed = running_sums(ordered_chunks(summed, order), order, ["__sizes", "__weights"]).drop(CHUNK)
    total = summed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    all_size, all_weight = total["s"] or 0, total["w"] or 0
    num, den = share
    wanted = num * all_size
    stops = _exact(F.col("source_size")) * (cap * den) * _exact(F.lit(all_weight) - F.col("__weights")) <= _exact(
        F.col("weight")
    ) * (_exact(F.lit(wanted)) - _exact(F.col("__sizes")) * (cap * den))
    marked = reliable(summed.withColumn("__stops", stops))
    held = marked.where("__stops").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    rest, weight = wanted - cap * den * (held["s"] or 0), all_weight - (held["w"] or 0)
    per = F.when(F.col("__stops"), _exact(F.lit(cap))).otherwise(_exact(F.col("weight")) * _exact(F.lit(rest)))
    of = F.when(F.col("__stops"), _exact(F.lit(1))).otherwise(_exact(F.col("source_size")) * _exact(F.lit(den * weight)))
    target = F.when(F.col("__stops"), (F.col("source_size") * cap).cast("double")).otherwise(
        (_exact(F.col("weight")) * _exact(F.lit(rest))).cast("double") / F.lit(float(max(1, den * weight)))
    )
    per = F.when(F.col("source_size") == 0, _exact(F.lit(0))).otherwise(per)
    return marked.select(KEY, "source", "source_size", "weight", target.alias("target"), per.alias("per"), of.alias("of"))


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document with its size, its source's size and target, ``copies`` and ``taken`` words.

    A null text has size 0; a null source is a source. Sources without words give
    nothing. Repeated rows are documents of their own. The offset of a source
    comes from its name and ``seed``, so reruns agree.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    slim = identified(docs).select(ROW, "doc_id", "source", key.alias(KEY), word_count(F.col("text")).alias("size"))
    order = [KEY, F.col("size"), F.col("doc_id"), F.col(ROW)]
    placed = ordered_chunks(slim.withColumn("__place", F.lit(1).cast("long")), order)
    sizes = placed.groupBy(KEY).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes).drop("source")
    placed = running_sums(placed, order[1:], ["__place"], [KEY]).drop(CHUNK)
    if fits_broadcast(targets, MAX_SOURCES):
        rows = placed.join(F.broadcast(targets), KEY)
    else:
        rows = left_join_skewed(placed, targets, [KEY], HEAVY_ROWS)
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(KEY)), 256), 1, 8), 16, 10)
    rows = rows.withColumn("__chance", _exact(chance))
    rows = rows.withColumn("__offset", _exact(F.expr("(__chance * of) div cast(4294967296 as decimal(38,0))")))

    def crossed(place: Column) -> Column:
        return F.call_function("div", _exact(place) * F.col("per") + F.col("__offset"), F.col("of"))

    rows = rows.withColumn("copies", crossed(F.col("__place") + 1) - crossed(F.col("__place")))
    return rows.select(
        ROW, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    copies = reliable(mixture(docs).where("copies > 0").select(ROW, F.col("copies").alias("__copies")))
    rows = with_decisions(identified(docs), copies, [ROW])
    return rows.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
