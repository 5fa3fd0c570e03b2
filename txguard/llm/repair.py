"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation is repaired by the cheapest edits that make the initials of its
roles read ``(s?(ua)+)?``: keep a turn (0), give it the role user or assistant (3),
delete it (4, the only choice for blank and repeated turns), or insert an empty
user or assistant turn anywhere (3). A truncated turn that stays costs 3 more.

The edits of a conversation are the paths of a lattice whose nodes are (turns
read, state of the pattern). Every node has an integer price, a lower bound of its
distance to the end. A path grows from the start by an arc that its price pays for
(extension); where none does, the price rises to the cheapest arc and the path
goes back by one node (contraction). When the path reaches the end, prices along
it are distances, and all arcs of cheapest paths are tight: the cost equals the
difference of prices. Of the tight arcs that lead to the end, the least letter is
taken at each node, so ties go to the least audit.

Long conversations are priced block by block from their end, the four entries of a
block being the ends of the one before, so work grows with their length only.

Only one small number per turn is brought together for a conversation. Texts are
joined to their edits afterwards, by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.text import ROW, identified, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns that are priced together.
BLOCK = 64
#: Audits that a task remembers, for conversations of at most so many turns.
REMEMBERED, SHORT = 50_000, 24
#: Rows of results that are handed on together.
LOT = 5_000
BLANK = " \t\n\x0b\x0c\r"
#: Faults of a turn: none, truncated, and those that only deletion mends.
FINE, CUT, DUPLICATE, EMPTY = range(4)
#: Initials of roles by their number; 0 is any other.
INITIALS = " sua"
#: The next state by state and initial: start, after the system turn, after a user's, after an assistant's.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
FINAL = (0, 3)

Arc = tuple[int, int, str]


def _arcs(state: int, code: int | None) -> tuple[Arc, ...]:
    """(distance to the target node, cost, letter) of the edits in ``state`` before a turn, or at the end (None)."""
    added = next((q for r, q in STEP[state].items() if r in ROLE))
    found = [(added - state, INSERT, "I")]
    if code is not None:
        initial, fault = INITIALS[code // 4], code % 4
        found.append((4, DELETE, "D"))
        if fault in (FINE, CUT):
            more = TRUNCATED if fault == CUT else 0
            found.append((4 + added - state, REROLE + more, "R"))
            if initial in STEP[state]:
                found.append((4 + STEP[state][initial] - state, KEEP + more, "K"))
    return tuple(sorted(found, key=lambda arc: arc[2]))


#: The edits by 4 * code of a turn + state; those at the end come last.
ARCS = [_arcs(state, code) for code in [*range(16), None] for state in range(4)]
#: What any edit of a turn costs at least, by its code.
LEAST = [(0, TRUNCATED, DELETE, DELETE)[code % 4] for code in range(16)]


def _priced(codes: bytes, end: list[int] | None) -> list[int]:
    """Prices of the nodes of a block, exact for its four entries.

    ``end`` has the distances from the block's last four nodes; None if the
    conversation ends there.
    """
    n = len(codes)
    arcs = [ARCS[4 * code + state] for code in codes for state in range(4)]
    goal = 4 * n + 4
    if end is None:
        arcs += [(*ARCS[64 + q], *((((goal - 4 * n - q), 0, "."),) if q in FINAL else ())) for q in range(4)]
    else:
        arcs += [((goal - 4 * n - q, end[q], "."),) for q in range(4)]
    floor = min(end) if end else 0
    price = [0] * (goal + 1)
    for q in range(4):
        price[4 * n + q] = end[q] if end else 0
    for i in range(n - 1, -1, -1):
        floor += LEAST[codes[i]]
        price[4 * i : 4 * i + 4] = [floor] * 4
    for origin in range(4):
        path = [origin]
        while path[-1] != goal:
            node = path[-1]
            cost, target = min([(length + price[node + step], node + step) for step, length, _ in arcs[node]])
            if price[node] < cost:
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)
    return price[: 4 * n + 4]


def _traced(codes: bytes, price: list[int]) -> str:
    """The least letters along tight arcs that lead to the end."""
    n = len(codes)
    tight: list[list[Arc]] = [[] for _ in price]
    good = [False] * len(price)
    for q in FINAL:
        good[4 * n + q] = price[4 * n + q] == 0
    for i in range(n, -1, -1):
        # Insertions stay at a place: two steps at most before a turn is read.
        for _ in range(3):
            for node in range(4 * i, 4 * i + 4):
                arcs = ARCS[(4 * codes[i] if i < n else 64) + node % 4]
                tight[node] = [(s, c, x) for s, c, x in arcs if good[node + s] and price[node] == c + price[node + s]]
                good[node] |= bool(tight[node])
    letters, node = [], 0
    # A final state can only be left by an insertion, which is not tight there.
    while tight[node]:
        step, _, letter = tight[node][0]
        letters.append(letter)
        node += step
    return "".join(letters)


def audit(codes: bytes) -> tuple[int, str]:
    """Cost and letters (Keep, Rerole, Delete, Insert) of the cheapest repair, the ASCII-least of them.

    ``codes`` has 4 * (number of the role's initial) + fault for each turn.
    """
    blocks: list[list[int]] = []
    for at in range(len(codes) - (len(codes) - 1) % BLOCK - 1 if codes else 0, -1, -BLOCK):
        block = _priced(codes[at : at + BLOCK], blocks[-1][:4] if blocks else None)
        # The last four nodes of a block are the entries of the next one.
        blocks.append(block[:-4] if blocks else block)
    price = [p for block in reversed(blocks) for p in block]
    return price[0], _traced(codes, price)


def _roles(codes: bytes, letters: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(letter, turn or None if inserted, new role or None) of each edit."""
    state = at = 0
    for letter in letters:
        turn = None if letter == "I" else at
        at += letter != "I"
        if letter == "D":
            yield letter, turn, None
            continue
        initial = INITIALS[codes[turn] // 4] if letter == "K" else next(r for r in STEP[state] if r in ROLE)
        state = STEP[state][initial]
        yield letter, turn, None if letter == "K" else ROLE[initial]


EDITS = f"conv_id long, place long, letter string, {ROW} long, copy int, role string"
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_KIND = f"{EDITS}, {', '.join(f'{c} long' for c in SUMMARY)}, audit string"


def faults(conversations: DataFrame) -> DataFrame:
    """``conversations`` with ``__row``, ``copy`` and each turn's ``code``.

    Null roles and texts count as one space. Rows of a conversation go by turn (null
    first), rows of equal turns by role, then by the SHA-256 of the text. A column
    ``copy`` tells rows of the same place in the table apart (all 0 if there is none).
    """
    copy = F.col("copy") if "copy" in conversations.columns else F.lit(0)
    given = conversations if ROW in conversations.columns else identified(conversations)
    rows = given.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        ROW,
        copy.cast("int").alias("copy"),
    )
    rows = rows.withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", ROW, "copy")
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    first = first.select(F.col("first")[ROW].alias(ROW), F.col("first.copy").alias("copy"), F.lit(True).alias("new"))
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(end == "", EMPTY).when(F.col("new").isNull(), DUPLICATE)
    fault = fault.when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.greatest(F.instr(F.lit(INITIALS[1:]), F.substring("role", 1, 1)), F.lit(0))
    initial = F.when(F.substring("role", 1, 1) == "", 0).otherwise(initial)
    return rows.join(first, [ROW, "copy"], "left").withColumn("code", (4 * initial + fault).cast("int"))


def edits(coded: DataFrame) -> DataFrame:
    """The edits of each conversation of ``faults``, in order, and one row (``place`` -1) of its figures and audit."""

    names = [c.split()[0] for c in _KIND.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in _KIND.split(", ")]
    blank = (None,) * (len(SUMMARY) + 1)

    def rows_of(conv: int | None, solved: tuple[int, str], codes: bytes, turns: pa.Array, rows: list, copies: list) -> Iterator[tuple]:
        cost, letters = solved
        known = turns.drop_null().to_numpy()
        gaps = int(known[-1] - known[0] - np.count_nonzero(np.diff(known))) if len(known) else 0
        faults = [code % 4 for code in codes]
        legal = {(1, 2), (2, 3), (3, 2)}
        illegal = sum((a // 4, b // 4) not in legal for a, b in pairwise(codes))
        counts = [faults.count(f) for f in (EMPTY, DUPLICATE, CUT)]
        yield (conv, -1, None, None, None, None, gaps, *counts, illegal, cost, letters)
        for place, (letter, at, role) in enumerate(_roles(codes, letters)):
            yield (conv, place, letter, *((None, None) if at is None else (rows[at], copies[at])), role, *blank)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[tuple] = []
        remembered = lru_cache(REMEMBERED)(audit)

        def settle() -> None:
            whole = pa.Table.from_batches(held) if len(held) > 1 else held[0]
            codes = bytes(whole.column("code").to_pylist())
            solved = (remembered if len(codes) <= SHORT else audit)(codes)
            turns = whole.column("turn")
            rows, copies = (whole.column(c).to_pylist() for c in (ROW, "copy"))
            ready.extend(rows_of(whole.column("conv_id")[0].as_py(), solved, codes, turns, rows, copies))
            held.clear()

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*ready, strict=True), types, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id")
            mark = np.stack([ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()])
            begins = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            if held and held[-1].column("conv_id")[0].as_py() != ids[0].as_py():
                settle()
            for begin, end in zip(begins, begins[1:], strict=False):
                if begin:
                    settle()
                held.append(batch.slice(begin, end - begin))
            if len(ready) >= LOT:
                yield handed_on()
        if held:
            settle()
        if ready:
            yield handed_on()

    order = [F.col("turn").asc_nulls_first(), "role", "digest", ROW, "copy"]
    placed = coded.select("conv_id", "turn", "role", "digest", ROW, "copy", "code").repartition("conv_id")
    placed = placed.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    return stored(placed.select("conv_id", "turn", ROW, "copy", "code").mapInArrow(work, _KIND), "edits")


def repaired(coded: DataFrame, found: DataFrame) -> DataFrame:
    """(``conv_id``, ``place``, ``role``, ``text``): the turns that stay and the inserted ones, by ``place``."""
    kept = found.where("place >= 0 and letter <> 'D'").select("conv_id", "place", ROW, "copy", F.col("role").alias("given"))
    texts = coded.select(ROW, "copy", "role", "text")
    old = kept.where(F.col(ROW).isNotNull()).join(texts, [ROW, "copy"])
    old = old.select("conv_id", "place", F.coalesce("given", "role").alias("role"), "text")
    return old.union(kept.where(F.col(ROW).isNull()).select("conv_id", "place", "given", F.lit("")))


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of each conversation's turns, joined by a newline, taken turn by turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            ready: list[tuple[int | None, str]] = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        ready.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line)
                else:
                    digest.update(b"\n")
                    digest.update(line)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv_id", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "sha"])

    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    placed = lines.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    return placed.select("conv_id", "line").mapInArrow(work, "conv_id long, sha string")


def repaired_conversations(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``every``: figures, cost, audit and digest of the repaired conversation.

    A conversation without turns has zeros, an empty audit and the digest of an
    empty text. Null ``conv_id`` is one conversation. Repeated rows are duplicates
    of the first; extra columns are ignored.
    """
    coded = stored(faults(conversations), "turns")
    found = edits(coded)
    figures = found.where("place = -1").select("conv_id", *SUMMARY, "audit")
    parts = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = parts.unionByName(figures, True).unionByName(digests(repaired(coded, found)), True)
    empty = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in SUMMARY],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.lit(empty)).alias("repaired_sha256"),
    )
