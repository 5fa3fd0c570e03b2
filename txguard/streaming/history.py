"""Per-user features of a stream, exact against everything that arrived before.

What users did earlier is kept as keyed state of the stream itself, so it lies in
the checkpoint, is versioned with it, and a micro-batch that is run again after a
failure sees the same past. There are two kinds of state:

- the rows of a day, of a bucket of users, in ``slices`` parts, so that a user with a
  large share of all rows is spread over as many tasks as the stream has days and slices
- of a smaller bucket of users the last six rows of each user's days, for the frames
  that count rows however old

A bucket is one call of the state function, which works on whole columns: the calls
do not grow with the users. A new row goes to its own day, and wakes its user in the
days that its frames reach back to. Those hand out the user's rows as context. The other
state adds the six rows before, where they are older. The micro-batch and its context
then go through the batch operator, which spreads large users over many tasks. Features
of a row are those of the batch operator over all rows that arrived so far, also for a
late one; rows already written are not revised when a late one arrives.

What no row has touched for ``idle_days`` is removed, user by user, with the next
micro-batch: after such a pause, a user starts anew. The timers go by the clock, as those
of event time would drop late rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txguard.operators.activity import DAY, MAX_USER_ROWS, ROWS, add_activity
from txguard.session import reliable

BACK = ROWS - 1
REACH_DAYS = 7
#: Days without rows after which a user's state is removed.
IDLE_DAYS = 60
#: Groups for rows without a user or a time, which have no state.
LOOSE = 64
#: Buckets of users, of a day's rows and of the last rows of their days. A checkpoint keeps the numbers it began with.
DAY_BUCKETS, USER_BUCKETS = 64, 1_024
#: Rows whose calls are put together before they are sent.
CALL_ROWS = 200_000
#: Micro-batches with fewer rows, context included, are not searched for large users.
SMALL_BATCH = 200_000

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_MESSAGE = "part string, user long, day long, slice long, t long, id string, amount string, payload string"
_GIVEN = "fresh boolean, user long, t long, id string, amount string, payload string"
#: Rows as an Arrow stream, with the time of the last row that touched their user.
_STATE = "rows binary"
_ROW = pa.schema([("user", pa.int64()), ("t", pa.int64()), ("id", pa.string()), ("amount", pa.string()), ("touched", pa.int64())])


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """By user and time, then id, null first: the order of the batch operator."""
    return rows.sort_values(["user", "t", "id"], na_position="first", ignore_index=True)


def _last_per_day(ordered: pd.DataFrame) -> pd.DataFrame:
    """The last six rows of each user's days, in order."""
    return ordered.groupby([ordered["user"], ordered["t"] // DAY], sort=False).tail(BACK).reset_index(drop=True)


def _reached(days: pd.DataFrame) -> pd.DataFrame:
    """(user, day) of all days that frames of rows on ``days`` reach."""
    back = pd.DataFrame({"back": range(REACH_DAYS + 1)})
    reached = days[["user", "day"]].drop_duplicates().merge(back, "cross")
    return reached.assign(day=reached["day"] - reached["back"])[["user", "day"]].drop_duplicates(ignore_index=True)


def _wake(slices: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows as messages to the state: each to its day, and once per user and day to what its frames reach."""
    columns = [c.split()[0] for c in _MESSAGE.split(", ")]
    parts = pd.DataFrame({"slice": range(slices)})

    def calls(rows: pd.DataFrame) -> pd.DataFrame:
        called = _reached(rows).merge(parts, "cross").assign(part="day", t=0)
        last = _last_per_day(_in_order(rows)).assign(part="last", day=0, slice=0)
        return pd.concat([called, last], ignore_index=True).assign(payload=None)[columns]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            yield batch[columns]
            held.append(batch.loc[batch["part"] == "day", ["user", "day", "t", "id", "amount"]])
            size += len(held[-1])
            if size >= CALL_ROWS:
                yield calls(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield calls(pd.concat(held, ignore_index=True))

    return work


def _packed(rows: pd.DataFrame) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, _ROW, preserve_index=False)
    with pa.ipc.new_stream(sink, _ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState) -> pd.DataFrame:
    if not state.exists:
        return _ROW.empty_table().to_pandas()
    return pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()


def _remember(idle_ms: int) -> Callable:
    """The state function: hands out new rows, and the old ones that they need."""
    columns = [c.split()[0] for c in _GIVEN.split(", ")]

    def work(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = key[0]
        now = 0 if part == "none" else state.getCurrentProcessingTimeMs()
        given = [] if state.hasTimedOut else list(batches)
        messages = pd.concat(given, ignore_index=True) if given else pd.DataFrame(columns=[c.split()[0] for c in _MESSAGE.split(", ")])
        # Calls have no payload; rows for the last six have none either.
        seen = messages if part == "last" else messages[messages["payload"].notna()]
        fresh = seen.assign(fresh=True)[columns]
        if part == "none":
            yield fresh
            return
        old = _unpacked(state)
        served = old["user"].isin(messages["user"].unique())
        old = old[served | (old["touched"] + idle_ms >= now)].reset_index(drop=True)
        served = old["user"].isin(messages["user"].unique())
        old.loc[served, "touched"] = now
        context = old[served] if part == "day" else _before(old, seen)
        context = context.assign(fresh=False, payload=None)[columns]
        if not messages.empty:
            yield context if part == "last" else pd.concat([context, fresh], ignore_index=True)
        new = seen[["user", "t", "id", "amount"]].assign(touched=now)
        kept = pd.concat([old, new], ignore_index=True) if len(new) else old
        if part == "last" and len(new):
            kept = _last_per_day(_in_order(kept))
        if kept.empty:
            if state.exists:
                state.remove()
            return
        state.update((_packed(kept),))
        state.setTimeoutDuration(max(1, int(kept["touched"].min()) + idle_ms - now))

    return work


def _before(old: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """Of ``old``, in order, the six rows before each day with new rows, but for those of days that are handed out whole."""
    touched = seen[["user"]].assign(day=seen["t"] // DAY).drop_duplicates(ignore_index=True)
    user, start = (np.concatenate([touched[a].to_numpy(np.int64) * b, old[c].to_numpy(np.int64)]) for a, b, c in (("user", 1, "user"), ("day", DAY, "t")))
    is_old = np.arange(len(user)) >= len(touched)
    order = np.lexsort((is_old, start, user))
    # Rows before the start of each touched day; earlier users' rows are told apart below.
    ahead = np.cumsum(is_old[order])[~is_old[order]]
    place = ahead[:, None] - 1 - np.arange(BACK)
    mine = touched["user"].to_numpy()[order[~is_old[order]]]
    known = place >= np.searchsorted(old["user"].to_numpy(np.int64), mine)[:, None]
    found = old.iloc[np.unique(place[known])]
    whole = pd.MultiIndex.from_frame(_reached(touched))
    return found[~pd.MultiIndex.from_arrays([found["user"], found["t"] // DAY]).isin(whole)]


def with_context(stream: DataFrame, idle_days: float = IDLE_DAYS, slices: int = 1) -> DataFrame:
    """New rows of a stream (``fresh``, as JSON in ``payload``) and the earlier rows that their features need."""
    t, user = F.unix_micros("timestamp"), F.col("user_id").cast("long")
    owned = t.isNotNull() & user.isNotNull()
    day = F.floor(t / F.lit(DAY)).cast("long")

    def known(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).cast("long")

    rows = stream.select(
        F.when(owned, "day").otherwise("none").alias("part"),
        F.when(owned, user).otherwise(F.lit(0)).cast("long").alias("user"),
        known(F.when(owned, day)).alias("day"),
        F.when(owned, F.pmod(F.xxhash64("transaction_id"), F.lit(slices))).otherwise(F.pmod(F.xxhash64("transaction_id", "amount", t), F.lit(LOOSE))).alias("slice"),
        known(F.when(owned, t)).alias("t"),
        F.col("transaction_id").alias("id"),
        F.col("amount").cast("string").alias("amount"),
        F.to_json(F.struct(*stream.columns), _JSON).alias("payload"),
    )
    buckets = F.when(F.col("part") == "day", DAY_BUCKETS).when(F.col("part") == "last", USER_BUCKETS).otherwise(1)
    messages = rows.mapInPandas(_wake(slices), _MESSAGE).withColumn("bucket", F.pmod(F.xxhash64("user"), buckets))
    idle = max(1, int(idle_days * 86_400_000))
    return messages.groupBy("part", "bucket", "day", "slice").applyInPandasWithState(
        _remember(idle), _GIVEN, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def batch_features(found: DataFrame, schema: str, max_user_rows: int | None = MAX_USER_ROWS) -> DataFrame:
    """The new rows among ``found``, a micro-batch of ``with_context``, with their per-user features."""
    kept = reliable(found)
    rows = kept.where("fresh").select(F.from_json("payload", schema, _JSON).alias("row")).select("row.*")
    context = kept.where("not fresh").select(
        F.col("user").alias("user_id"),
        F.timestamp_micros("t").alias("timestamp"),
        F.col("id").alias("transaction_id"),
        F.col("amount").cast("double").alias("amount"),
    )
    together = rows.withColumn("_new", F.lit(True)).unionByName(context.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    if max_user_rows == MAX_USER_ROWS and kept.count() < SMALL_BATCH:
        max_user_rows = None
    return add_activity(together, max_user_rows).where("_new").drop("_new")


class _Writer(DataStreamWriter):
    """Starts a query whose micro-batches all have rows: timers by the clock would ask for empty ones for ever."""

    def start(self, *args, **options) -> StreamingQuery:
        conf, name = self._spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name)
        conf.set(name, "false")
        try:
            # A query keeps the settings that it is started with.
            return super().start(*args, **options)
        finally:
            conf.set(name, before)


def with_history(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_user_rows: int | None = MAX_USER_ROWS,
    idle_days: float = IDLE_DAYS,
    slices: int = 1,
) -> DataStreamWriter:
    """A writer that hands every micro-batch with its per-user features to ``sink(df, number)``.

    ``sink`` may be called twice for the same number after a failure. Rows without a
    user or a time pass with the features that the batch operator gives them.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def handle(batch: DataFrame, number: int) -> None:
        sink(batch_features(batch, schema, max_user_rows), number)

    return _Writer(with_context(stream, idle_days, slices)).foreachBatch(handle).option("checkpointLocation", checkpoint)
