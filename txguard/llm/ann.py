"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

For largest inner products, a vector x becomes the unit vector (x / M, rest), with
M the largest norm of its band of norms, and a query its unit vector (q / |q|, 0).
A table turns them by three rounds of random signs and a fast Hadamard transform,
and files a vector under its nearest signed axis. A query visits, in each table, the
axes it is nearest to. The longest vectors, up to HEAD of all, need not point the same
way to score high, so they are filed under several axes. Candidates are ranked by their
exact inner product. Only a query that found too few is compared with all vectors. The
exact mode also does so for queries whose last score does not exceed what a vector on
another axis can reach by its norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.text import ROW, identified
from txguard.session import reliable

TABLES = 4
#: Share of a table's signed axes that a query visits.
PROBES = 0.25
ROUNDS = 3
SEED = 7
#: Axes of a table are dealt to so many cells; rows of a cell beyond SLICE go to further slices.
CELLS = 16
SLICE = 8192
BLOCK = 256
#: Parts of all rows for the queries that are compared with them, if the rows fill that many blocks.
SPREAD = 32
#: Bands of norms for each factor of two.
BANDS = 4
#: Bands that together hold at most this share of the vectors, the longest ones, are filed under so many axes.
HEAD, FILED = 0.125, 8
#: Rounding of an inner product, as a share of the product of both norms.
TIE = 1e-9


KIND = f"asker long, query_id long, {ROW} long, vec_id long, score double"
FOUND = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in KIND.split(", ")])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def padded(dim: int) -> int:
    """The least power of two above ``dim``, so that there is room for the added component."""
    return 1 << int(dim).bit_length()


def turned(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors after the pseudo-rotation of ``table``, against all signed axes."""
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (ROUNDS, x.shape[1]))
    for row in signs:
        x = hadamard(x * row)
    return np.concatenate([x, -x], axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(x, "<f8")
    return pa.array([r.tobytes() for r in rows], pa.binary())


def searchable(vectors: DataFrame) -> DataFrame:
    """(``__row``, ``vec_id``, ``dim``, ``norm``, ``vec``) of the rows that take part.

    Left out are null ids, null, empty and zero vectors, and vectors with a null or
    non-finite component. ``vec`` holds the components as doubles.
    """
    x = F.col("embedding").cast("array<double>")
    rows = identified(vectors).select(ROW, F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    rows = rows.select(ROW, "vec_id", F.size("x").alias("dim"), F.sqrt(square).alias("norm"), "x").where("norm > 0")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            vec = pa.array([np.asarray(v.values, "<f8").tobytes() for v in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], vec], [ROW, "vec_id", "dim", "norm", "vec"])

    return reliable(rows.mapInArrow(work, f"{ROW} long, vec_id long, dim int, norm double, vec binary"))


def _units(batch: pa.RecordBatch, dim: int, query: bool) -> np.ndarray:
    vec, norm = _vectors(batch.column("vec"), dim), batch.column("norm").to_numpy()
    out = np.zeros((len(vec), padded(dim)))
    if query:
        out[:, :dim] = vec / norm[:, None]
    else:
        most = batch.column("most").to_numpy()
        out[:, :dim] = vec / most[:, None]
        out[:, dim] = np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def neighbours(
    vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: float = PROBES, exact: bool = False
) -> DataFrame:
    """The ``k`` nearest found of every row whose ``vec_id`` is divisible by ``every``, among all other rows.

    Columns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the inner product
    of the original vectors in double precision; ties go to the smaller ``vec_id``.
    Vectors of different lengths are not compared. Repeated rows are rows of their
    own: each is a candidate for the others and, with such an id, a query.

    The axes of a table are dealt to cells; a cell with more rows or queries than
    SLICE is cut into slices of both, so a frequent vector fills no task. The queries
    that ``_open`` keeps go on to all rows; with ``exact`` the result is that of a full search.
    """
    rows = searchable(vectors).withColumn("band", F.floor(F.log2("norm") * BANDS))
    longest = rows.groupBy("dim", "band").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("size"))
    # One row per length of vectors and band of norms.
    above = Window.partitionBy("dim").orderBy(F.desc("band"))
    longest = longest.withColumn("axes", F.when(F.sum("size").over(above) <= HEAD * F.sum("size").over(Window.partitionBy("dim")), FILED).otherwise(1))
    longest = reliable(longest)
    index = rows.join(F.broadcast(longest.drop("size")), ["dim", "band"])
    asked = rows.where(F.col("vec_id") % every == 0)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                units = _units(part, dim, False)
                many = part.column("axes").to_numpy()
                for t in range(tables):
                    near = turned(units, t)
                    for n in np.unique(many).tolist():
                        here = np.flatnonzero(many == n)
                        n = min(n, near.shape[1])
                        axes = near[here].argmax(1)[:, None] if n == 1 else np.argpartition(-near[here], n - 1, axis=1)[:, :n]
                        filed, axis = part.take(pa.array(np.repeat(here, n))), axes.ravel()
                        fields = [filed.column("dim"), pa.array(t * CELLS + axis % CELLS), pa.array(axis), filed.column(ROW), filed.column("vec_id"), filed.column("vec")]
                        yield pa.RecordBatch.from_arrays(fields, ["dim", "cell", "axis", ROW, "vec_id", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                units = _units(part, dim, True)
                n = max(1, round(2 * padded(dim) * probes))
                for t in range(tables):
                    near = np.argpartition(-turned(units, t), n - 1, axis=1)[:, :n]
                    for cell in range(CELLS):
                        of_cell = near % CELLS == cell
                        here = np.flatnonzero(of_cell.any(1))
                        axes = pa.array([near[i][of_cell[i]].astype("<i4").tobytes() for i in here], pa.binary())
                        chosen = part.take(pa.array(here))
                        label = pa.array(np.full(len(here), t * CELLS + cell))
                        fields = [chosen.column("dim"), label, axes, chosen.column(ROW), chosen.column("vec_id"), chosen.column("vec")]
                        yield pa.RecordBatch.from_arrays(fields, ["dim", "cell", "axes", ROW, "vec_id", "vec"])

    filed = index.mapInArrow(file, f"dim int, cell long, axis long, {ROW} long, vec_id long, vec binary")
    visits = asked.mapInArrow(visit, f"dim int, cell long, axes binary, {ROW} long, vec_id long, vec binary")
    # One row per length of vectors and cell.
    cuts = filed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("s"))
    asks = visits.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("q"))
    cuts = F.broadcast(reliable(cuts.join(asks, ["dim", "cell"])))

    def rank(there: pa.Table, here: pa.Table) -> pa.Table:
        if not len(there) or not len(here):
            return FOUND.empty_table()
        dim = there.column("dim")[0].as_py()
        vec, query = _vectors(there.column("vec"), dim), _vectors(here.column("vec"), dim)
        axis, row, vec_id = (there.column(c).to_numpy() for c in ("axis", ROW, "vec_id"))
        asker, query_id = here.column(ROW).to_numpy(), here.column("vec_id").to_numpy()
        lists = [np.frombuffer(a, "<i4") for a in here.column("axes").to_pylist()]
        who, which = np.repeat(np.arange(len(lists)), [len(a) for a in lists]), np.concatenate(lists)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in np.unique(axis):
            rows_a, all_a = np.flatnonzero(axis == a), who[which == a]
            for at in range(0, len(all_a), BLOCK):
                queries_a = all_a[at : at + BLOCK]
                i, j, exact = _nearest(query[queries_a], vec[rows_a], asker[queries_a], row[rows_a], k)
                found.append(_first(queries_a[i], rows_a[j], exact, vec_id, k))
        return _found(found, asker, query_id, row, vec_id, k)

    place = ["dim", "cell", "s_at", "q_at"]
    sides = (_dealt(filed, cuts, "s", "q").groupBy(place), _dealt(visits, cuts, "q", "s").groupBy(place))
    best = sides[0].cogroup(sides[1]).applyInArrow(rank, KIND)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", ROW)

    def first(found: DataFrame) -> DataFrame:
        found = found.repartition("asker").dropDuplicates(["asker", ROW])
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = reliable(first(best))
    more = _among_all(rows, reliable(_open(asked, best, longest, k, exact)), k)
    ranked = first(best.drop("rank").unionByName(more))
    return ranked.select("query_id", "rank", "vec_id", "score")


def _open(asked: DataFrame, best: DataFrame, longest: DataFrame, k: int, exact: bool) -> DataFrame:
    """The queries that go on to all rows, with ``reach``, the least norm of a row that can still be a neighbour.

    A query that has fewer than ``k`` rows, though there are more, can use any row.
    With ``exact`` the others go on too, while the longest vector could reach their last score.
    """
    per_dim = longest.groupBy("dim").agg(F.max("most").alias("most"), F.sum("size").alias("size"))
    have = best.groupBy("asker").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("last"))
    known = asked.join(F.broadcast(per_dim), "dim").join(have, F.col(ROW) == F.col("asker"), "left")
    had = F.coalesce("have", F.lit(0))
    known = known.where((had >= k) & F.lit(exact) | (had < F.least(F.lit(k), F.col("size") - 1)))
    known = known.withColumn("reach", F.when(had >= k, F.col("last") / F.col("norm") - TIE * F.col("most")).otherwise(0.0))
    known = known.where(F.col("reach") <= F.col("most")).select("dim", ROW, "vec_id", "vec", "reach")
    # New columns, so that the queries can meet the rows they come from.
    return known.toDF(*known.columns)


def _among_all(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each open query, among all rows that its ``reach`` admits, in blocks."""
    n = F.count(F.lit(1))
    parts = F.greatest(F.ceil(n / SLICE), F.least(F.lit(SPREAD), F.ceil(n / BLOCK)))
    cuts = rows.groupBy("dim").agg(parts.cast("long").alias("s"))
    asks = asked.groupBy("dim").agg(F.ceil(n / SLICE).cast("long").alias("q"))
    cuts = F.broadcast(reliable(cuts.join(asks, "dim")))

    def rank(there: pa.Table, here: pa.Table) -> pa.Table:
        if not len(there) or not len(here):
            return FOUND.empty_table()
        dim = there.column("dim")[0].as_py()
        there, here = there.sort_by([("norm", "descending")]), here.sort_by("reach")
        vec, query = _vectors(there.column("vec"), dim), _vectors(here.column("vec"), dim)
        norm, row, vec_id = (there.column(c).to_numpy() for c in ("norm", ROW, "vec_id"))
        asker, query_id, reach = (here.column(c).to_numpy() for c in (ROW, "vec_id", "reach"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(query), BLOCK):
            block = slice(at, at + BLOCK)
            to = int(np.searchsorted(-norm, -reach[at], "right"))
            if to:
                i, j, exact = _nearest(query[block], vec[:to], asker[block], row[:to], k)
                found.append(_first(i + at, j, exact, vec_id, k))
        return _found(found, asker, query_id, row, vec_id, k)

    place = ["dim", "s_at", "q_at"]
    there = _dealt(rows.select("dim", ROW, "vec_id", "norm", "vec"), cuts, "s", "q").groupBy(place)
    return there.cogroup(_dealt(asked, cuts, "q", "s").groupBy(place)).applyInArrow(rank, KIND)


def _dealt(side: DataFrame, cuts: DataFrame, own: str, other: str) -> DataFrame:
    """``side`` in its own slices, a copy for each slice of the other side."""
    keys = [c for c in cuts.columns if c not in ("s", "q")]
    placed = side.join(cuts, keys).withColumn(f"{own}_at", F.pmod(F.xxhash64(ROW), F.col(own)))
    every_slice = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
    return placed.withColumn(f"{other}_at", F.explode(every_slice)).drop("s", "q")


def _nearest(query: np.ndarray, vec: np.ndarray, asker: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of all that may be among the ``k`` best of a query, itself left out."""
    near = query @ vec.T
    slack = TIE * np.sqrt((query**2).sum(1))[:, None] * np.sqrt((vec**2).sum(1))[None, :]
    near[asker[:, None] == row[None, :]] = -np.inf
    kth = max(0, len(vec) - k)
    least = np.partition(near - slack, kth, axis=1)[:, kth] if kth else np.full(len(near), -np.finfo(float).max)
    i, j = np.nonzero((near + slack >= least[:, None]) & (near > -np.inf))
    return i, j, (query[i] * vec[j]).sum(1)


def _found(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], asker: np.ndarray, query_id: np.ndarray, row: np.ndarray, vec_id: np.ndarray, k: int) -> pa.Table:
    """The k best of each query over all blocks, as rows of FOUND."""
    q, v, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
    # A row that is filed under several axes counts once.
    once = np.unique(np.stack([q, row[v]]), axis=1, return_index=True)[1] if len(q) else q
    q, v, score = _first(q[once], v[once], score[once], vec_id, k)
    values = [asker[q], query_id[q], row[v], vec_id[v], score]
    return pa.table([pa.array(x, f.type) for x, f in zip(values, FOUND, strict=True)], FOUND)


def _first(q: np.ndarray, v: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then id."""
    order = np.lexsort((vec_id[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    kept = place < k
    return q[kept], v[kept], score[kept]
