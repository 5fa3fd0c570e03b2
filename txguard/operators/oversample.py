"""Minority oversampling: synthetic rows between a minority row and a near neighbour.

A synthetic row draws a (minority row, neighbour) pair and a step in [0, 1) by
hashing its number, so any task can make any of them and a lost task makes the
same ones again. Distances are Euclidean on the given columns, as they are.

Neighbours are exact for any size, equally distant ones by id. A minority that fits
a broadcast matrix of checked size is compared as a whole. A larger one is cut into
boxes, the leaves of a k-d tree that halves the widest column of the raw values, so
boxes are small by the measure that counts. The tree comes from a sample; the borders
of boxes come from all rows. The rows of its own box, and those around it on shifted
Z-order curves (as in Zhang, Li and Jestes 2012), give an upper bound of a row's k-th
distance. A row is then compared with the other boxes that its bound reaches: first the
groups of boxes that it reaches are found, then the boxes of each. Groups and boxes that
many rows reach are handled by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.operators.skew import BROADCAST_BYTES, with_position
from txguard.operators.split import class_counts, hash_order
from txguard.schemas import LABEL
from txguard.session import reliable

EXACT_ROWS = 10_000  # largest minority matrix to broadcast
BLOCK_ROWS = 50_000  # rows of a curve handled by one task
WINDOW_ROWS = 16  # rows compared on each side of a curve
CURVES = 3
BOX_ROWS = 1_024  # rows per box
BOX_SAMPLE, SAMPLE_ROWS = 16, 500_000  # rows per box that the tree is made from, and all of them at most
GROUP_BOXES = 256  # boxes per group; the borders of all groups are broadcast, one per half a million rows
CUTS = 1_024  # quantiles that give a column's scale on the curves
VISIT_ROWS = 20_000  # rows one task compares with a box
DRAWN_ROWS = 5_000_000  # synthetic rows made by one task
_NEAR = "id string, neighbour string, gap double, w array<double>"
_BITS = 16
_FRACTION_BITS = 48


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column."""
    total = np.zeros(np.broadcast_shapes(points.shape[:-1], others.shape[:-1]))
    for c in range(points.shape[-1]):
        gap = points[..., c] - others[..., c]
        total += gap * gap
    return total


def _vectors(rows: np.ndarray) -> pd.Series:
    return pd.Series(list(rows), dtype=object)


def _exact_neighbours(minority: DataFrame, k: int) -> DataFrame:
    """Compare each row with the whole minority, broadcast as a matrix; ties go to the lower id."""
    rows = minority.orderBy("id").limit(EXACT_ROWS + 1).toPandas()
    if len(rows) > EXACT_ROWS:
        raise ValueError("the minority is too large to broadcast")
    shared = minority.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        place = pd.Series(np.arange(len(ids)), index=ids)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                own = place.loc[part["id"]].to_numpy()
                gaps = _distances(matrix[own][:, None, :], matrix[None, :, :])
                gaps[np.arange(len(own)), own] = np.inf
                best = np.argsort(gaps, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame(
                    {
                        "id": np.repeat(part["id"].to_numpy(), k),
                        "nth": np.tile(np.arange(k), len(own)),
                        "neighbour": ids[best.ravel()],
                        "w": _vectors(matrix[best.ravel()]),
                    }
                )

    return minority.mapInPandas(nearest, "id string, nth int, neighbour string, w array<double>")


def _curve_keys(minority: DataFrame, dimensions: int, seed: int) -> DataFrame:
    """The row's place on each of the shifted curves, as hexadecimal text.

    A column's scale is that of its quantiles, so neither a wide column nor an
    outlier spoils the order. Distances are taken on the raw values.
    """
    shares = [i / CUTS for i in range(CUTS + 1)]
    cuts = minority.agg(*[F.percentile_approx(F.col("v")[i], shares, 10 * CUTS).alias(f"c{i}") for i in range(dimensions)]).first()
    scales = []
    for i in range(dimensions):
        values, last = np.unique(np.array(cuts[f"c{i}"], dtype=float)[::-1], return_index=True)
        scales.append((values, 1 - last / CUTS))
    shifts = np.random.default_rng(seed).random((CURVES, dimensions))
    shifts[0] = 0.0

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            raw = np.stack(batch["v"].to_numpy())
            values = np.stack([np.interp(raw[:, i], *scale) for i, scale in enumerate(scales)], axis=1)
            for curve in range(CURVES):
                cells = ((values + shifts[curve]) / 2 * (2**_BITS - 1)).astype(np.uint32)
                bits = (cells[:, None, :] >> np.arange(_BITS - 1, -1, -1)[None, :, None]) & 1
                packed = np.packbits(bits.reshape(len(batch), -1).astype(np.uint8), axis=1)
                yield pd.DataFrame(
                    {"curve": curve, "z": [p.tobytes().hex() for p in packed], "id": batch["id"], "v": batch["v"]}
                )

    return minority.mapInPandas(keys, "curve int, z string, id string, v array<double>")


def _curve_candidates(placed: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, gap, w): the k nearest among the rows around each row on each curve.

    Each curve is cut into blocks of a fixed number of positions; rows near a
    border also go to the block next to it, so a block is all a task needs.
    """
    width = max(WINDOW_ROWS, k)
    block = F.floor(F.col("at") / BLOCK_ROWS)
    within = F.col("at") % BLOCK_ROWS
    home = F.array_compact(
        F.array(
            block,
            F.when((within < width) & (block > 0), block - 1),
            F.when(within >= BLOCK_ROWS - width, block + 1),
        )
    )
    spread = placed.withColumns({"home": block, "block": F.explode(home)})

    def around(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        matrix, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
        curve, size = rows["curve"].to_numpy(), len(rows)
        offsets = np.array([o for o in range(-width, width + 1) if o])
        gaps = np.full((size, len(offsets)), np.inf)
        for j, o in enumerate(offsets):
            own = np.arange(max(0, -o), min(size, size - o))
            own = own[curve[own] == curve[own + o]]
            gaps[own, j] = _distances(matrix[own], matrix[own + o])
        best = np.argpartition(gaps, k - 1, axis=1)[:, :k]
        gap = np.take_along_axis(gaps, best, 1).ravel()
        own = np.repeat(np.arange(size), k)
        other = own + offsets[best.ravel()]
        mine = (rows["home"] == rows["block"]).to_numpy()
        kept = mine[own] & np.isfinite(gap)
        own, other = own[kept], other[kept]
        return pd.DataFrame({"id": ids[own], "neighbour": ids[other], "gap": gap[kept], "w": _vectors(matrix[other])})

    return spread.groupBy("block").applyInPandas(around, _NEAR)


def _gaps_to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the nearest place of each box."""
    total = np.zeros((len(points), len(low)))
    for c in range(points.shape[1]):
        own = points[:, c, None]
        outside = np.maximum(np.maximum(low[None, :, c] - own, own - high[None, :, c]), 0.0)
        total += outside * outside
    return total


def _borders(rows: DataFrame, key: str, dimensions: int) -> DataFrame:
    """Per ``key`` the lowest and highest value of each column of ``v``, or of ``low`` and ``high``."""
    low, high = ("low", "high") if "low" in rows.columns else ("v", "v")
    return rows.groupBy(key).agg(
        F.array(*[F.min(F.col(low)[i]) for i in range(dimensions)]).alias("low"),
        F.array(*[F.max(F.col(high)[i]) for i in range(dimensions)]).alias("high"),
    )


def _reached(points: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, boxes) of the boxes that hold a place as near as a row's bound, some rows at a time."""
    for start in range(0, len(points), 512):
        part = slice(start, start + 512)
        row, box = np.nonzero(_gaps_to_boxes(points[part], low, high) <= reach[part, None])
        yield row + start, box


def _dealt(visits: DataFrame, places: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part``, so that no task gets more than about VISIT_ROWS visits of a place."""
    # One row per place.
    parts = F.broadcast(reliable(visits.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).cast("int").alias("parts"))))
    visitors = visits.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    hosts = places.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return visitors.drop("parts"), hosts.drop("parts")


def _tree(sample: np.ndarray, boxes: int) -> tuple[np.ndarray, ...]:
    """Per node of a k-d tree: column, border, the nodes up to it and above it, and the box of a leaf (else -1)."""
    nodes: list[list] = []
    leaves = 0
    todo = [(sample, boxes, -1, 0)]
    while todo:
        rows, share, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = here
        nodes.append([0, 0.0, here, here, -1])
        cut = _cut(rows) if share > 1 and len(rows) > 1 else None
        if cut is None:
            nodes[here][4], leaves = leaves, leaves + 1
            continue
        column, border = cut
        low = rows[:, column] <= border
        below = min(share - 1, max(1, round(share * low.mean())))
        nodes[here][:2] = cut
        # The lower side is numbered first: boxes of near numbers are near.
        todo += [(rows[~low], share - below, here, 1), (rows[low], below, here, 0)]
    columns = zip(*nodes, strict=True)
    return tuple(np.array(c, dtype=float if i == 1 else np.int64) for i, c in enumerate(columns))


def _cut(rows: np.ndarray) -> tuple[int, float] | None:
    """The widest column without its outermost values, and a border in its middle with rows on both sides."""
    inner = np.diff(np.quantile(rows, [0.05, 0.95], axis=0), axis=0)[0]
    wide = inner if inner.any() else np.ptp(rows, axis=0)
    if not wide.any():
        return None
    column = int(np.argmax(wide))
    values = np.sort(rows[:, column])
    border = values[(len(values) - 1) // 2]
    return column, float(border if border < values[-1] else values[values < border][-1])


def _in_boxes(minority: DataFrame, seed: int) -> DataFrame:
    """(box, id, v): every row with its box."""
    size = minority.count()
    boxes = -(-size // BOX_ROWS)
    every = max(1, size // min(BOX_SAMPLE * boxes, SAMPLE_ROWS))
    drawn = minority.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(every)) == 0).limit(2 * SAMPLE_ROWS)
    sample = drawn.agg(F.collect_list("v")).first()[0]
    if not sample:
        return minority.select(F.lit(0).cast("long").alias("box"), "id", "v")
    shared = minority.sparkSession.sparkContext.broadcast(_tree(np.array(sample, dtype=float), boxes))

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column, border, low, high, leaf = shared.value
        for batch in batches:
            if batch.empty:
                continue
            rows, node = np.stack(batch["v"].to_numpy()), np.zeros(len(batch), np.int64)
            while (inside := np.flatnonzero(leaf[node] < 0)).size:
                at = node[inside]
                node[inside] = np.where(rows[inside, column[at]] <= border[at], low[at], high[at])
            yield pd.DataFrame({"box": leaf[node], "id": batch["id"], "v": batch["v"]})

    return minority.select("id", "v").mapInPandas(boxed, "box long, id string, v array<double>")


def _best(gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, gap) of the k least finite gaps of each row, equal ones by column."""
    kept = min(k, gaps.shape[1])
    row, column = np.nonzero((gaps <= np.partition(gaps, kept - 1, axis=1)[:, kept - 1 : kept]) & np.isfinite(gaps))
    gap = gaps[row, column]
    order = np.lexsort((column, gap, row))
    row, column, gap = row[order], column[order], gap[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < kept], column[nth < kept], gap[nth < kept]


def _near_rows(points: pd.DataFrame, hosts: pd.DataFrame, k: int) -> pd.DataFrame:
    """_NEAR of ``points`` among ``hosts``; with a column ``reach``, only what is as near as that."""
    hosts = hosts.sort_values("id", ignore_index=True)
    ids, matrix = hosts["id"].to_numpy(), np.stack(hosts["v"].to_numpy())
    place, found = pd.Index(ids), []
    for start in range(0, len(points), 512):
        part = points.iloc[start : start + 512]
        own = part["id"].to_numpy()
        gaps = _distances(np.stack(part["v"].to_numpy())[:, None, :], matrix[None, :, :])
        itself = place.get_indexer(own)
        home = np.flatnonzero(itself >= 0)
        gaps[home, itself[home]] = np.inf
        if "reach" in part:
            gaps[gaps > part["reach"].to_numpy()[:, None]] = np.inf
        row, other, gap = _best(gaps, k)
        found.append(pd.DataFrame({"id": own[row], "neighbour": ids[other], "gap": gap, "w": _vectors(matrix[other])}))
    return pd.concat(found, ignore_index=True)


def _visits(home: DataFrame, bounds: DataFrame, dimensions: int) -> DataFrame:
    """(box, id, v, reach): the boxes, but for its own, that may hold something as near as a row's bound."""
    boxes = _borders(home, "box", dimensions).withColumn("group", F.floor(F.col("box") / GROUP_BOXES))
    boxes = reliable(boxes)
    groups = _borders(boxes, "group", dimensions).toPandas()
    shared = home.sparkSession.sparkContext.broadcast(
        (groups["group"].to_numpy(), np.stack(groups["low"].to_numpy()), np.stack(groups["high"].to_numpy()))
    )
    columns = ["id", "v", "reach", "own"]

    def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high = shared.value
        for batch in batches:
            if batch.empty:
                continue
            for row, group in _reached(np.stack(batch["v"].to_numpy()), batch["reach"].to_numpy(), low, high):
                picked = batch.iloc[row][columns].reset_index(drop=True)
                picked.insert(0, "group", names[group])
                yield picked

    def to_boxes(visitors: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or places.empty:
            return pd.DataFrame(columns=["box", "id", "v", "reach"])
        low, high, found = np.stack(places["low"].to_numpy()), np.stack(places["high"].to_numpy()), []
        names, own = places["box"].to_numpy(), visitors["own"].to_numpy()
        for row, box in _reached(np.stack(visitors["v"].to_numpy()), visitors["reach"].to_numpy(), low, high):
            other = own[row] != names[box]
            picked = visitors.iloc[row[other]][["id", "v", "reach"]].reset_index(drop=True)
            picked.insert(0, "box", names[box[other]])
            found.append(picked)
        return pd.concat(found, ignore_index=True)

    rows = home.join(bounds, "id").select("id", "v", "reach", F.col("box").alias("own"))
    sent = reliable(rows.mapInPandas(to_groups, "group long, id string, v array<double>, reach double, own long"))
    visitors, places = _dealt(sent, boxes, "group")
    by = ["group", "part"]
    return visitors.groupBy(*by).cogroup(places.groupBy(*by)).applyInPandas(to_boxes, "box long, id string, v array<double>, reach double")


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each id by (gap, neighbour), also where some were found more than once."""
    rank = Window.partitionBy("id").orderBy("gap", "neighbour")
    return (
        found.withColumn("nth", F.dense_rank().over(rank) - 1).where(F.col("nth") < k).dropDuplicates(["id", "nth"])
    )


def _boxed_neighbours(points: DataFrame, k: int, dimensions: int, seed: int) -> DataFrame:
    """The k nearest of every row, equally far ones by id.

    Equal points stand for one another in the search, each with its k + 1 lowest
    ids, so a point that very many rows share is searched for once.
    """
    by_id = Window.partitionBy("v").orderBy("id")
    lowest = points.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    distinct = lowest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = reliable(distinct.withColumn("id", F.col("ids")[0]))
    found = _neighbours_of_distinct(distinct.select("id", "v"), k, dimensions, seed)
    owners = distinct.select(F.col("id").alias("neighbour"), "ids")
    others = found.join(owners, "neighbour").groupBy("id").agg(F.collect_list(F.struct("gap", "ids", "w")).alias("others"))
    known = distinct.join(others, "id", "left").withColumn(
        "others",
        F.concat(
            F.array(F.struct(F.lit(0.0).alias("gap"), "ids", F.col("v").alias("w"))),
            F.coalesce("others", F.array().cast("array<struct<gap:double,ids:array<string>,w:array<double>>>")),
        ),
    )
    each = F.flatten(F.transform("others", lambda o: F.transform(o["ids"], lambda i: F.struct(o["gap"], i.alias("neighbour"), o["w"]))))
    rows = points.select("id", "v").join(known.select("v", each.alias("near")), "v")
    nearest = F.slice(F.array_sort(F.filter("near", lambda n: n["neighbour"] != F.col("id"))), 1, k)
    return rows.select("id", F.posexplode(nearest).alias("nth", "n")).select("id", "nth", "n.neighbour", "n.w")


def _neighbours_of_distinct(minority: DataFrame, k: int, dimensions: int, seed: int) -> DataFrame:
    keys = _curve_keys(minority, dimensions, seed)
    placed = reliable(with_position(keys, ["curve", "z", "id"], "at"))
    home = reliable(_in_boxes(minority, seed))
    inside = home.groupBy("box").applyInPandas(lambda rows: _near_rows(rows, rows, k), _NEAR)
    near = reliable(_nearest_of(_curve_candidates(placed, k).unionByName(inside), k))
    # k rows per id: the farthest bounds the true k-th distance.
    reach = F.when(F.count(F.lit(1)) < k, float("inf")).otherwise(F.max("gap")).alias("reach")
    bounds = minority.select("id").join(near.groupBy("id").agg(reach), "id", "left").fillna(float("inf"), ["reach"])
    visits = reliable(_visits(home, bounds, dimensions))
    visitors, hosts = _dealt(visits, home, "box")

    def search(visitors: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if hosts.empty or visitors.empty:
            return pd.DataFrame(columns=["id", "neighbour", "gap", "w"])
        return _near_rows(visitors, hosts, k)

    found = visitors.groupBy("box", "part").cogroup(hosts.groupBy("box", "part")).applyInPandas(search, _NEAR)
    return _nearest_of(found.unionByName(near.drop("nth")), k)


def nearest_neighbours(
    df: DataFrame, features: Sequence[str], id_col: str, k: int = 5, seed: int = 42, exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """(id, nth, neighbour, w): the k nearest other rows of each row, ``w`` being the neighbour's features.

    Up to ``exact_rows`` rows are compared as a whole. Ids are unique.
    """
    points = df.select(
        F.col(id_col).cast("string").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("v")
    )
    size = points.limit(max(exact_rows, k) + 1).count()
    if size <= k:
        raise ValueError(f"{size} rows have no {k} neighbours each")
    if size <= min(exact_rows, EXACT_ROWS):
        return _exact_neighbours(points, k)
    return _boxed_neighbours(points, k, len(features), seed)


def _number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def oversample(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    id_col: str = "transaction_id",
    k: int = 5,
    seed: int = 42,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """(id, features, label, is_synthetic): all rows, and synthetic ones until both classes are equal.

    Features are doubles in the result. For training rows only.
    """
    counts = class_counts(df, label)
    if len(counts) != 2:
        raise ValueError(f"oversampling needs two classes, found {len(counts)}")
    minor, major = sorted(counts, key=lambda c: (counts[c], c))
    size, needed = counts[minor], counts[major] - counts[minor]
    kept = df.select(
        F.col(id_col).cast("string").alias(id_col),
        *[F.col(f).cast("double").alias(f) for f in features],
        F.col(label).cast("int").alias(label),
        F.lit(False).alias("is_synthetic"),
    )
    if needed == 0:
        return kept
    minority = df.where(F.col(label) == minor)
    points = minority.select(
        F.col(id_col).cast("string").alias("id"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("v"),
        hash_order(id_col, seed).alias("h"),
    )
    near = nearest_neighbours(minority, features, id_col, k, seed, exact_rows)
    small = size <= min(exact_rows, EXACT_ROWS)
    if small:
        # Bounded by the size just checked.
        ranked = points.withColumn("rank", F.row_number().over(Window.orderBy("h", "id")) - 1)
    else:
        ranked = with_position(points, ["h", "id"], "rank")
    pairs = ranked.join(near, "id").select(
        (F.col("rank") * k + F.col("nth")).cast("long").alias("pair"), "v", "w"
    )
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("n").cast("string")))
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, needed // DRAWN_ROWS)
    drawn = spark.range(0, needed, 1, tasks).withColumnRenamed("id", "n").select(
        "n",
        F.pmod(_number(draw, 1, 15), F.lit(size * k)).alias("pair"),
        (_number(draw, 17, _FRACTION_BITS // 4) / F.lit(float(2**_FRACTION_BITS))).alias("step"),
    )
    fits = small and size * k * 2 * 8 * len(features) <= BROADCAST_BYTES
    made = drawn.join(F.broadcast(pairs) if fits else pairs, "pair").select(
        F.concat(F.lit(f"synthetic-{seed}-"), F.col("n").cast("string")).alias(id_col),
        *[
            (F.col("v")[i] + F.col("step") * (F.col("w")[i] - F.col("v")[i])).alias(f)
            for i, f in enumerate(features)
        ],
        F.lit(minor).cast("int").alias(label),
        F.lit(True).alias("is_synthetic"),
    )
    return kept.unionByName(made)
