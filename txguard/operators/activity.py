"""Per-user sliding features, one definition for training, scoring and micro-batches.

All features of a row look only at its user's earlier rows (and, for the 7-row
mean, the row itself), in the order of time and then transaction id:

- ``user_activity_24h``: rows with an amount in [t - 24 h, t)
- ``rolling_avg_7rows``: mean amount of the last 7 rows, this one included
- ``amount_to_avg_ratio``: amount over that mean, 1.0 where it has no value
- ``time_since_last_txn``: seconds since the previous row, 0.0 for the first
- ``rolling_avg_7d``: mean amount in [t - 7 d, t), null without rows

Rows without a user or a time belong to no history: they get 0, their own
amount, 0.0 and null.

Means have one definition, whatever the size of a user. Amounts are summed
exactly: a double is cut into whole numbers of 32 bits at fixed places (bins), each bin
is summed as a long, and differences of such sums are exact too. The frame's sum is
then rounded once and divided. Money needs four bins. Users with other amounts, below
2^-30 or from 2^46 on, have as many bins as those need. NaN and infinite amounts are
counted apart, and a frame that holds one has the mean that floating-point rules give.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from txguard.functions.scalar import ratio_to_own_average
from txguard.operators.skew import CHUNK, left_join_skewed, ordered_chunks, running_sums, split_heavy

DAY = 86_400_000_000  # microseconds
ROWS = 7
# Users beyond this are spread over many tasks.
MAX_USER_ROWS = 20_000
NO_LIMIT = (1 << 63) - 1
# A bin holds the bits of an amount from 2^(LOWEST + WIDTH * bin) on; there are 66 for all doubles.
LOWEST, WIDTH = -1074, 32
# The bins of ordinary amounts: bits from 2^-82 up to 2^46.
MONEY = range(31, 35)

ACTIVITY_COLUMNS = [
    "user_activity_24h",
    "rolling_avg_7rows",
    "amount_to_avg_ratio",
    "time_since_last_txn",
    "rolling_avg_7d",
]


def add_activity(df: DataFrame, max_user_rows: int | None = MAX_USER_ROWS) -> DataFrame:
    """Add the per-user features to a batch table.

    Users with more than ``max_user_rows`` rows (``None``: no such limit), or with
    amounts unlike money, are spread over range partitions of (user, time, id); the
    others share one hash exchange on the user.
    """
    timed = df.withColumn("_t", F.unix_micros("timestamp"))
    owned = timed.withColumn("_user", F.when(F.col("_t").isNotNull(), F.col("user_id")))
    parts = split_heavy(owned, ["_user"], max_user_rows or NO_LIMIT, also=~_is_money(F.col("amount")))
    ordinary = _finish(_ordinary_users(parts.light), df.columns)
    if parts.heavy is None:
        return ordinary
    return ordinary.unionByName(_finish(_heavy_users(parts.heavy, _bins_of(parts.heavy)), df.columns))


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    known = F.col("user_id").isNotNull() & F.col("_t").isNotNull()
    average = F.when(known, F.col("_avg_rows")).otherwise(F.col("amount"))
    return df.select(
        *columns,
        F.when(known, F.col("_count_24h")).otherwise(F.lit(0)).cast("long").alias("user_activity_24h"),
        average.alias("rolling_avg_7rows"),
        ratio_to_own_average(F.col("amount"), average).alias("amount_to_avg_ratio"),
        F.coalesce(F.when(known, (F.col("_t") - F.col("_previous")) / F.lit(1e6)), F.lit(0.0)).alias(
            "time_since_last_txn"
        ),
        F.when(known, F.col("_avg_7d")).alias("rolling_avg_7d"),
    )


def _is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _is_money(x: Column) -> Column:
    """Whether the bins of MONEY hold all bits of an amount; true for null."""
    low, high = (2.0 ** (LOWEST + WIDTH * b) for b in (MONEY.start, MONEY.stop))
    return F.coalesce(_is_finite(x) & (F.abs(x) < high) & (x % F.lit(low) == 0), F.lit(True))


def _bins_of(df: DataFrame) -> list[int]:
    """The bins that the finite amounts of ``df`` reach, and those between: at most all 66."""
    place = (F.log2(F.abs("amount")) - LOWEST) / WIDTH
    # The logarithm may round over a border, hence the margin; the lowest bit is 52 places below the highest.
    ends = df.where(_is_finite(F.col("amount")) & (F.col("amount") != 0)).agg(
        F.min(F.floor(place - 0.01 - 53 / WIDTH)).alias("low"), F.max(F.floor(place + 0.01)).alias("high")
    )
    found = ends.first()
    low, high = MONEY.start, MONEY.stop - 1
    if found["low"] is not None:
        low, high = max(0, min(low, found["low"])), max(high, found["high"])
    return list(range(low, high + 1))


def _parts(bins: Sequence[int] = MONEY) -> dict[str, Column]:
    """What a mean is made of, per row: 1 for a value, the bins of a finite one, and 1 for a NaN, for either infinity."""
    x = F.col("amount")
    usable = _is_finite(x) if bins != MONEY else _is_money(x) & x.isNotNull()

    def one(case: Column) -> Column:
        return F.when(case, 1).otherwise(0).cast("long")

    def digit(b: int) -> Column:
        """The bits of a bin, with the sign of the amount: remainders and scaling by powers of two are exact."""
        top = LOWEST + WIDTH * (b + 1)
        rest = x % F.lit(2.0**top) if top < 1024 else x
        return F.when(usable, (rest / F.lit(2.0 ** (top - WIDTH))).cast("long")).otherwise(F.lit(0).cast("long"))

    odd = {"_nan": one(F.isnan(x)), "_high": one(x == float("inf")), "_low": one(x == -float("inf"))}
    return {"_n": one(x.isNotNull()), **{f"_b{b}": digit(b) for b in bins}, **(odd if bins != MONEY else {})}


def _long(sums: Column) -> Column:
    return F.coalesce(sums, F.lit(0)).cast("long")


def _digits(bins: Column) -> Column:
    """Sums of bins, lowest first, as digits below 2^32, and what is carried beyond them, with its sign, at the end."""

    def step(state: Column, s: Column) -> Column:
        here = s + state["carry"]
        low = F.array_append(state["digits"], here.bitwiseAND(F.lit((1 << WIDTH) - 1)))
        return F.struct(F.shiftright(here, WIDTH).alias("carry"), low.alias("digits"))

    begin = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(bins, begin, step, lambda state: F.array_append(state["digits"], state["carry"]))


def _mean(parts: dict[str, Column]) -> Column:
    """The mean of a frame from the sums of its parts; null without values.

    The three leading digits and whether there is anything below them decide how
    the sum is rounded. It is divided before it is scaled, so that a sum beyond all
    doubles can have a mean.
    """
    n = parts["_n"]
    bins = sorted(int(p[2:]) for p in parts if p.startswith("_b"))
    sums = F.array(*[parts[f"_b{b}"] for b in bins])
    sign = F.when(F.element_at(_digits(sums), -1) < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
    high_first = F.reverse(_digits(F.transform(sums, lambda s: s * sign)))
    whole = "decimal(38,0)"

    def step(state: Column, d: Column) -> Column:
        skip, take = (state["taken"] == 0) & (d == 0), state["taken"] < 3
        lead = F.when(~skip & take, (state["lead"] * F.lit(1 << WIDTH).cast("decimal(10,0)") + d).cast(whole)).otherwise(state["lead"])
        return F.struct(
            lead.alias("lead"),
            (state["taken"] + F.when(~skip & take, 1).otherwise(0)).alias("taken"),
            (state["below"] + F.when(skip | take, 0).otherwise(1)).alias("below"),
            (state["more"] | (~skip & ~take & (d > 0))).alias("more"),
        )

    begin = F.struct(
        F.lit(0).cast(whole).alias("lead"), F.lit(0).alias("taken"), F.lit(0).alias("below"), F.lit(False).alias("more")
    )

    def scaled(state: Column) -> Column:
        # Twice the leading digits, and one if more follows: a cast rounds that as it would round the whole.
        value = (state["lead"] * 2 + F.when(state["more"], 1).otherwise(0)).cast(whole).cast("double")
        places = state["below"] * WIDTH + (LOWEST + WIDTH * bins[0] - 1)
        half = F.floor(places / 2)
        return value / n * sign * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), places - half)

    found = F.aggregate(high_first, begin, step, scaled)
    if "_nan" in parts:
        nan, high, low = (parts[p] for p in ("_nan", "_high", "_low"))
        odd = F.when((nan > 0) | ((high > 0) & (low > 0)), float("nan"))
        found = F.coalesce(odd.when(high > 0, float("inf")).when(low > 0, float("-inf")), found)
    return F.when(n > 0, found)


def _mean_over(frame: WindowSpec, parts: Iterable[str]) -> Column:
    return _mean({p: _long(F.sum(p).over(frame)) for p in parts})


def _ordinary_users(df: DataFrame) -> DataFrame:
    """One exchange and one sort: ordering by (time, id) also serves the frames over time."""
    known = F.col("user_id").isNotNull() & F.col("_t").isNotNull()
    parts = _parts()
    spread = df.withColumn("_alone", F.when(~known, F.monotonically_increasing_id())).withColumns(parts)
    user = Window.partitionBy("user_id", "_alone")
    by_row = user.orderBy("_t", "transaction_id")
    by_time = user.orderBy("_t")

    def before(part: str, reach: int) -> Column:
        """The sum in [t - reach, t), as a difference of running sums, whose frames only grow."""
        until, left = (by_time.rangeBetween(Window.unboundedPreceding, -1 - back) for back in (0, reach))
        return _long(F.sum(part).over(until)) - _long(F.sum(part).over(left))

    return spread.withColumns(
        {"_avg_rows": _mean_over(by_row.rowsBetween(1 - ROWS, 0), parts), "_previous": F.lag("_t").over(by_row)}
    ).withColumns({"_count_24h": before("_n", DAY), "_avg_7d": _mean({p: before(p, 7 * DAY) for p in parts})})


def _heavy_users(df: DataFrame, bins: Sequence[int]) -> DataFrame:
    """The same features for users too large for one task, or with amounts in other bins."""
    rows = ordered_chunks(df, ["user_id", "_t", "transaction_id"])
    return left_join_skewed(_row_frames(rows, bins), _time_frames(rows, bins), ["user_id", "_t"], MAX_USER_ROWS)


def _row_frames(rows: DataFrame, bins: Sequence[int]) -> DataFrame:
    """Frames over rows: each chunk of a user also receives the user's last rows before it."""
    back = ROWS - 1
    place = ["user_id", CHUNK]
    latest = Window.partitionBy(*place).orderBy(F.desc("_t"), F.desc("transaction_id"))
    tails = (
        rows.select(*place, "_t", "transaction_id", "amount")
        .withColumn("_nth", F.row_number().over(latest))
        .where(F.col("_nth") <= back)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(F.struct("_t", "transaction_id", "amount"))).alias("_tail"))
    )
    earlier = Window.partitionBy("user_id").orderBy(CHUNK).rowsBetween(-back, -1)
    halo = (
        tails.withColumn("_carried", F.flatten(F.collect_list("_tail").over(earlier)))
        .select(*place, F.explode(F.slice(F.reverse("_carried"), 1, back)).alias("_row"))
        .select(*place, "_row.*", F.lit(True).alias("_halo"))
    )
    by_row = Window.partitionBy(*place).orderBy("_t", "transaction_id")
    parts = _parts(bins)
    return (
        rows.withColumn("_halo", F.lit(False))
        .unionByName(halo, allowMissingColumns=True)
        .withColumns(parts)
        .withColumns({"_avg_rows": _mean_over(by_row.rowsBetween(-back, 0), parts), "_previous": F.lag("_t").over(by_row)})
        .where(~F.col("_halo"))
        .drop("_halo", CHUNK, *parts)
    )


def _time_frames(rows: DataFrame, bins: Sequence[int]) -> DataFrame:
    """Frames over time, as prefix sums per instant.

    A row counts from just after its time until it leaves the frame, so each
    instant adds its parts once and takes them off once per frame length; the sum
    over all earlier instants is then the frame's content, exactly.
    """
    parts = _parts(bins)
    instants = rows.withColumns(parts).groupBy("user_id", "_t")
    instants = instants.agg(*[_long(F.sum(p)).alias(p) for p in parts])
    week = [f"_7{p}" for p in parts]

    def signed(part: str, sign: int) -> Column:
        return F.col(part) * F.lit(sign).cast("long")

    def change(after: int, day: int, days: int) -> Column:
        """What an instant changes ``after`` microseconds: the 24-hour count and the parts of 7 days, times a sign."""
        return F.struct(
            (F.col("_t") + after).alias("_at"),
            signed("_n", day).alias("_n24"),
            *[signed(p, days).alias(w) for p, w in zip(parts, week, strict=True)],
            F.lit(after == 0).alias("_is_row"),
        )

    changes = instants.select(
        "user_id", F.explode(F.array(change(0, 1, 1), change(DAY, -1, 0), change(7 * DAY, 0, -1))).alias("_c")
    ).select("user_id", "_c.*")
    changes = changes.groupBy("user_id", "_at").agg(
        F.sum("_n24").alias("_n24"),
        *[_long(F.sum(w)).alias(w) for w in week],
        F.max("_is_row").alias("_is_row"),
    )
    held = running_sums(ordered_chunks(changes, ["user_id", "_at"]), ["_at"], ["_n24", *week], ["user_id"])
    return held.where("_is_row").select(
        "user_id",
        F.col("_at").alias("_t"),
        F.col("_n24").alias("_count_24h"),
        _mean({p: F.col(w) for p, w in zip(parts, week, strict=True)}).alias("_avg_7d"),
    )
