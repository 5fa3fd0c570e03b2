"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. It is cut into segments, so that two fingerprints that
differ in at most THRESHOLD bits differ in at most floor(THRESHOLD / segments) = 1
bit on some segment. The anchors of a segment are the words of a covering code: a
Hamming code of 15 bits (covering radius 1) beside the segment's other bits.
Every fingerprint has its home at the anchor nearest to it, and is sent to every
anchor within covering radius plus that threshold that can be the home of such a
partner. At each anchor the homes are compared with all that came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.components import components
from txguard.llm.text import ROW, identified, with_decisions
from txguard.session import reliable

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: First bit and number of bits of each segment; the first 15 bits of each are the Hamming code's.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE = 15
#: Homes of an anchor that are compared in one place; more are cut into slices.
SLICE = 4096
PAIRS = 1 << 21


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the word shingles of ``text``, in order; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = len(words) - shingle + 1
    starts, stops = (ends - sizes)[:n].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over the word shingles of ``text``: a bit is 1 if it is set in over half their hashes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(``__row``, ``doc_id``, ``fp`` as signed long); a null text has no words, so its fingerprint is 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), fp], [ROW, "doc_id", "fp"])

    rows = identified(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"{ROW} long, doc_id long, fp long")


def _syndromes() -> np.ndarray:
    """The syndrome of each 15-bit word: the exclusive or of the numbers (from 1) of its set bits."""
    words = np.arange(1 << CODE)
    found = np.zeros(1 << CODE, np.int64)
    for bit in range(CODE):
        found ^= np.where(words >> bit & 1, bit + 1, 0)
    return found


def _pairs_of() -> np.ndarray:
    """For each syndrome from 1, the seven pairs of bits, as masks, whose flip leads to a code word."""
    rows = [[(1 << a - 1) | (1 << (a ^ s) - 1) for a in range(1, CODE + 1) if a < a ^ s] for s in range(1, CODE + 1)]
    return np.array([[0] * 7, *rows], np.int64)


def anchors(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchors, whether these are the rows' homes) for unsigned fingerprints, part by part."""
    syndrome, pairs = _syndromes(), _pairs_of()
    everyone = np.arange(len(fp))
    for number, (first, bits) in enumerate(SEGMENTS):
        segment = (fp >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        word, rest = segment & ((1 << CODE) - 1), segment >> CODE
        fault = syndrome[word]
        home = word ^ np.where(fault, 1 << np.maximum(fault - 1, 0), 0)
        label = np.int64(number) << 32
        yield everyone, label | rest << CODE | home, True
        yield everyone, label | rest << CODE | home, False
        for bit in range(bits - CODE):
            yield everyone, label | (rest ^ (1 << bit)) << CODE | home, False
        off = np.flatnonzero(fault)
        for pair in range(7):
            yield off, label | rest[off] << CODE | (word[off] ^ pairs[fault[off], pair]), False


def _forest(homes: np.ndarray, guests: np.ndarray, group_h: np.ndarray, group_g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (fingerprint, root) that join what is linked between homes and guests of equal groups.

    Both sides are sorted by group. The pairs are formed in blocks; of each block
    only a forest is kept, so a group of n linked rows gives about n edges.
    """
    low = np.searchsorted(group_h, group_g, "left")
    count = np.searchsorted(group_h, group_g, "right") - low
    at = 0
    ends = np.cumsum(count)
    while at < len(guests):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = count[at:to]
        guest = np.repeat(np.arange(at, to), n)
        home = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        differ = np.bitwise_count(guests[guest] ^ homes[home])
        linked = (differ <= THRESHOLD) & (differ > 0)
        if linked.any():
            a, b = guests[guest[linked]], homes[home[linked]]
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = place[: len(a)], place[len(a) :]
            root = np.arange(len(nodes))
            while True:
                least = root.copy()
                np.minimum.at(least, a, root[b])
                np.minimum.at(least, b, least[a])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield nodes[moved], nodes[root[moved]]
        at = to


def links(distinct: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect exactly what links of at most THRESHOLD bits connect.

    ``distinct`` has one row ``fp`` per fingerprint. An anchor that is the home of
    more than SLICE fingerprints is cut into cells, one for each slice of its homes
    and slice of its guests, so no task holds an unbounded group.
    """

    def spread(batches: Iterator[pa.RecordBatch], homes_only: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for rows, anchor, home in anchors(fp):
                if home or not homes_only:
                    fields = [pa.array(anchor), pa.array(fp[rows].view(np.int64)), pa.array(np.full(len(rows), home))]
                    yield pa.RecordBatch.from_arrays(fields, ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Groups get numbers in their order, so that searches need no pairs of keys.
            new = np.r_[True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["slice"][1:] != rows["slice"][:-1])]
            group, home = np.cumsum(new), rows["home"]
            fp = rows["fp"].view(np.uint64)
            for a, b in _forest(fp[home], fp[~home], group[home], group[~home]):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        kinds = [("anchor", np.int64), ("slice", np.int64), ("home", np.bool_), ("fp", np.int64)]
        for batch in batches:
            rows = np.empty(batch.num_rows, kinds)
            for name, _ in kinds:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            if not len(rows):
                continue
            last = (rows["anchor"] == rows["anchor"][-1]) & (rows["slice"] == rows["slice"][-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            same = held and held[-1]["anchor"][-1] == rows["anchor"][0] and held[-1]["slice"][-1] == rows["slice"][0]
            if held and (cut or not same):
                yield from settle(np.concatenate([*held, rows[:cut]]))
                held = []
            elif cut:
                yield from settle(rows[:cut])
            held.append(rows[cut:])
        if held:
            yield from settle(np.concatenate(held))

    kind = "anchor long, fp long, home boolean"
    fps = distinct.select("fp")
    homes = fps.mapInArrow(lambda batches: spread(batches, True), kind)
    heavy = homes.groupBy("anchor").count().where(F.col("count") > SLICE)
    heavy = reliable(heavy.select("anchor", F.ceil(F.col("count") / SLICE).cast("long").alias("slices")))
    sent = fps.mapInArrow(spread, kind)
    if heavy.isEmpty():
        dealt = sent.withColumn("slice", F.lit(0).cast("long"))
    else:
        dealt = with_decisions(sent, heavy, ["anchor"], "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        row, column = F.when(F.col("home"), F.col("own")).otherwise(F.col("other")), F.when(F.col("home"), F.col("other"))
        dealt = dealt.withColumn("slice", row * F.col("slices") + F.coalesce(column, F.col("own")))
    placed = dealt.select("anchor", "slice", "home", "fp").repartition("anchor", "slice").sortWithinPartitions("anchor", "slice")
    return placed.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(``__row``, ``doc_id``, ``fp``, ``component_id``, ``kept``) for every row of ``docs``.

    Documents with equal fingerprints are linked, and so are those whose
    fingerprints differ in THRESHOLD bits or fewer; ``component_id`` is the
    smallest ``doc_id`` that can be reached (null if no row there has one), and
    ``kept`` marks one row per component, of that id. Repeated rows are documents
    of their own with equal fingerprints.
    """
    found = reliable(fingerprints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW)
    distinct = reliable(found.groupBy("fp").agg(F.min(first).alias("first")))
    roots = reliable(components(links(distinct)))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = reliable(named)
    least = reliable(named.groupBy("root").agg(F.min("first").alias("least")))
    # A root may have many fingerprints.
    named = reliable(with_decisions(named, least, ["root"], "left").select("fp", "least"))
    rows = found.join(named, "fp")
    return rows.select(
        ROW, "doc_id", "fp", F.col("least.doc_id").alias("component_id"), (F.col("least")[ROW] == F.col(ROW)).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``."""
    kept = reliable(near_duplicates(docs).where("kept").select(ROW))
    return with_decisions(identified(docs), kept, [ROW]).select(*docs.columns)
