"""Substring dedup by suffix automata over shards of reference passages.

A word is removed if it lies in a window of WINDOW words whose words also start
earlier in the corpus. The reference is the corpus itself, so an automaton of each
part of it cannot go past every document: parts times documents grows with the
square. Instead a reference passage and the documents that may repeat it are
brought to the same shard by an anchor: the least k-gram hash of a window, which
equal windows share. A document's windows with the same anchor make a segment.

- An anchor that occurs once in the corpus has no repeated window.
- Equal segments (by anchor and two hashes, 159 bits) stand for one another: all but the
  first are repeated throughout.
- The first ones of different segments under an anchor are a shard's reference
  passages. In corpus order each is streamed through the suffix automaton of those
  before it; where the matching statistic reaches WINDOW, a window is repeated.
  Then it is added to the automaton.
- An anchor with more than SEGMENTS different segments (a phrase in very many
  surroundings) gives its windows instead, and equal windows meet by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from txguard.llm.text import ROW, identified, stored, with_decisions

WINDOW = 20
GRAM = 8
SEGMENTS = 2000
BASE = 0x9E3779B97F4A7C15
#: A second hash of runs has another modulus, since some texts collide under every base modulo a power of two.
PRIME, REST_BASE = (1 << 31) - 1, 0x2545F491
#: Longer words are hashed one by one; up to this length no two words that only differ in such an order collide.
LONG_WORD, SEED = 32, 42


class WordHashes:
    """Hashes of words, and of runs of words by powers of a base modulo 2^64 and, apart from that, modulo a prime."""

    def __init__(self) -> None:
        self.up = self.down = self.rest_up = self.rest_down = np.ones(1, np.uint64)
        self.separator = np.zeros(256, bool)
        self.separator[[9, 10, 11, 12, 13, 32]] = True

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << n.bit_length()
        self.up, self.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]) for base in (BASE, pow(BASE, -1, 1 << 64)))
        both = []
        for base in (REST_BASE, pow(REST_BASE, -1, PRIME)):
            powers = np.ones(1, np.uint64)
            while len(powers) < size:
                powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), PRIME)) % np.uint64(PRIME)])
            both.append(powers)
        self.rest_up, self.rest_down = both

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        """Spread every bit of the input over the output."""
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    def words(self, text: bytes) -> np.ndarray:
        """A hash of each word: by powers of the base, or XXH64 if it is long."""
        raw = np.frombuffer(text, np.uint8)
        self._powers(len(raw) + 1)
        inside = np.concatenate([[False], ~self.separator[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])
        found = self.mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            found[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), SEED)
        return found

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)])])

    def runs(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of ``size`` words from ``start`` on."""
        return self.mixed((sums[start + size] - sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))

    def rests(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Second hashes of the same runs, modulo PRIME, of the upper bits of the words' hashes."""
        self._powers(len(hashes) + 1)
        prime = np.uint64(PRIME)
        # Each term is below 2^31, so sums of 2^32 of them fit.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((hashes >> np.uint64(33)) * self.rest_up[: len(hashes)] % prime)])
        return (sums[start + size] - sums[start]) % prime * self.rest_down[start] % prime


def segments(hashes: np.ndarray, maker: WordHashes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, both segment hashes, first window and number of windows of a document's segments."""
    n = len(hashes)
    if n < window:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int32, np.int32, np.int32))
    sums = maker.sums(hashes)
    grams = maker.runs(sums, np.arange(n - gram + 1), gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    whole = maker.runs(sums, first, count + window - 1)
    rest = maker.rests(hashes, first, count + window - 1)
    return grams[least[first]].view(np.int64), whole.view(np.int64), rest.astype(np.int32), first.astype(np.int32), count.astype(np.int32)


class SuffixAutomaton:
    """A suffix automaton of passages over words, which are added one after the other."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, passage: list[bytes]) -> None:
        last = 0
        for word in passage:
            last = self._extend(last, word)

    def _clone(self, state: int, start: int, word: bytes, length: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = clone
        while start >= 0 and self.next[start].get(word) == state:
            self.next[start][word] = clone
            start = self.link[start]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(known, last, word, self.length[last] + 1)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            if self.length[target] != self.length[last] + 1:
                target = self._clone(target, last, word, self.length[last] + 1)
            self.link[state] = target
        return state

    def statistics(self, passage: list[bytes]) -> list[int]:
        """Length of the longest run of words that ends at each word and that some passage has."""
        state = size = 0
        found = []
        for word in passage:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            found.append(size)
        return found


def repeated_windows(passages: list[list[bytes]], window: int) -> Iterator[list[int]]:
    """For each passage, the windows (by their first word) that an earlier one has."""
    automaton = SuffixAutomaton()
    for passage in passages:
        matched = automaton.statistics(passage)
        yield [end - window + 1 for end, size in enumerate(matched) if size >= window]
        automaton.add(passage)


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per segment of a document, kept as lists per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = WordHashes()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for text in batch.column("text"):
                found = segments(maker.words(text.as_buffer() if text.is_valid else b""), maker, window, gram)
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            ends = np.cumsum([0, *map(len, columns[0])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(c))) for c in columns] if columns[0] else []
            if lists:
                names = [ROW, "doc_id", "anchor", "segment", "rest", "start", "windows"]
                yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), *lists], names)

    kind = f"{ROW} long, doc_id long, anchor array<long>, segment array<long>, rest array<int>, start array<int>, windows array<int>"
    lists = stored(docs.mapInArrow(work, kind), "segments")
    return lists.select(ROW, "doc_id", F.inline(F.arrays_zip("anchor", "segment", "rest", "start", "windows")))


def _passages(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of wanted segments (``__row``, ``start``, ``windows``, ...), joined by one space."""
    fields = [c for c in wanted.columns if c != ROW]
    by_doc = wanted.groupBy(ROW).agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    rows = with_decisions(docs.select(ROW, "text"), by_doc, [ROW])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lists, row in zip(batch.column("text"), batch.column("wanted"), batch.column(ROW), strict=True):
                words = text.as_buffer().to_pybytes().split()
                struct = lists.values
                start, windows = (struct.field(fields.index(c)).to_numpy() for c in ("start", "windows"))
                cut = [b" ".join(words[s : s + n + window - 1]) for s, n in zip(start.tolist(), windows.tolist(), strict=True)]
                same = pa.array(np.full(len(cut), row.as_py()))
                columns = [struct.field(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([same, *columns, pa.array(cut, pa.binary())], [ROW, *fields, "words"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != ROW)
    return rows.mapInArrow(work, f"{ROW} long, {kinds}, words binary")


def _by_automata(passages: DataFrame, window: int) -> DataFrame:
    """(``__row``, ``start``, ``windows``) repeated in earlier passages of the same anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, list[bytes]]] = []
        anchor = None

        def settle() -> pa.RecordBatch | None:
            found = []
            for (row, start, _), places in zip(group, repeated_windows([g[2] for g in group], window), strict=True):
                found += [(row, start + p) for p in places]
            if not found:
                return None
            rows, starts = (pa.array(x) for x in zip(*found, strict=True))
            fields = [rows, starts.cast(pa.int32()), pa.array(np.ones(len(found), np.int32))]
            return pa.RecordBatch.from_arrays(fields, [ROW, "start", "windows"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", ROW, "start", "words")]
            for here, row, start, words in zip(*columns, strict=True):
                if here != anchor and group:
                    if (found := settle()) is not None:
                        yield found
                    group = []
                anchor = here
                group.append((row, start, words.split(b" ")))
        if group and (found := settle()) is not None:
            yield found

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW), F.col("start")]
    placed = passages.repartition("anchor").sortWithinPartitions("anchor", *order)
    return placed.select("anchor", ROW, "start", "words").mapInArrow(work, f"{ROW} long, start int, windows int")


def _by_windows(passages: DataFrame, window: int) -> DataFrame:
    """The same as ``_by_automata``, from single windows that meet by their words."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW, "start")
    parts = F.split(F.col("words").cast("string"), " ")
    single = F.transform(
        F.sequence(F.lit(0), F.col("windows") - 1),
        lambda i: F.struct((F.col("start") + i).alias("start"), F.sha2(F.array_join(F.slice(parts, i + 1, window), " "), 256).alias("words")),
    )
    rows = stored(passages.select(ROW, "doc_id", F.inline(single)), "windows")
    first = rows.groupBy("words").agg(F.min(place).alias("first"))
    return rows.join(first, "words").where(place != F.col("first")).select(ROW, "start", F.lit(1).alias("windows"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(``__row``, ``start``, ``windows``): runs of windows of a document whose words start earlier in the corpus.

    ``docs`` has ``__row``, ``doc_id`` (null last) and ``text`` as binary (null for
    none). Documents of equal ``doc_id`` go by ``__row``.
    """
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW, "start")
    seen = _occurrences(docs.select(ROW, "doc_id", "text"), window, gram)
    # Kept apart, so that the join below starts from plain shuffles, whose large partitions can be split.
    again = stored(seen.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    shared = stored(seen.join(again, "anchor"), "shared")
    first = shared.groupBy("anchor", "segment", "rest", "windows").agg(F.min(place).alias("first"))
    first = stored(first, "first")
    copied = shared.join(first, ["anchor", "segment", "rest", "windows"]).where(place != F.col("first")).select(ROW, "start", "windows")
    many = first.groupBy("anchor").count().where("count > 1").select("anchor", F.col("count").alias("different"))
    wanted = first.join(many, "anchor").select(
        F.col("first")[ROW].alias(ROW), F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "anchor", "windows", "different"
    )
    passages = stored(_passages(docs, wanted, window), "passages")
    found = copied.union(_by_automata(passages.where(F.col("different") <= SEGMENTS), window))
    return found.union(_by_windows(passages.where(F.col("different") > SEGMENTS), window))


def _kept(text: pa.Scalar, begins: pa.Scalar, ends: pa.Scalar) -> tuple[int, list[bytes]]:
    """Number of words of a text and those outside of the given spans."""
    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
    if not begins.is_valid:
        return len(words), words
    left, at = [], 0
    for begin, end in zip(begins.values.to_pylist(), ends.values.to_pylist(), strict=True):
        left += words[at:begin]
        at = end
    return len(words), left + words[at:]


def _marked(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``docs``, which has ``__row``, with the ``__begins`` and ``__ends`` of its maximal repeated spans, in words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for starts, counts in zip(batch.column("starts"), batch.column("counts"), strict=True):
                start = starts.values.to_numpy()
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + counts.values.to_numpy() + window - 1)[order])
                apart = np.flatnonzero(start[1:] > end[:-1])
                begins.append(start[np.r_[0, apart + 1]])
                ends.append(end[np.r_[apart, len(end) - 1]])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(begins, kind), pa.array(ends, kind)], [ROW, "__begins", "__ends"])

    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    runs = repeats(rows, window, gram).groupBy(ROW).agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    spans = runs.mapInArrow(merge, f"{ROW} long, __begins array<int>, __ends array<int>")
    return with_decisions(docs, stored(spans, "spans"), [ROW], "left")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_removed``, ``kept`` as binary) of every row of ``docs``.

    ``kept`` joins the kept words by one space. A null text has no words. Repeated
    rows are documents of their own, so all but the first lose what they repeat.
    """
    rows = identified(docs.select("doc_id", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept(*row) for row in zip(*(batch.column(c) for c in ("text", "__begins", "__ends")), strict=True)]
            sizes = pa.array([n for n, _ in found], pa.int64())
            removed = pa.array([n - len(left) for n, left in found], pa.int64())
            kept = pa.array([b" ".join(left) for _, left in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, removed, kept], ["doc_id", "n_words", "n_removed", "kept"])

    marked = _marked(rows, window, gram)
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "__begins", "__ends")
    return marked.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the words that repeat earlier text, with the columns of ``docs``.

    A text that loses nothing stays as it is; else its kept words are joined by one
    space, and ``n_chars``, where there is one, is counted anew. A document that
    loses all its words stays, with an empty text.
    """

    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, begins, ends in zip(*(batch.column(c) for c in ("__text", "__begins", "__ends")), strict=True):
                n, left = _kept(text, begins, ends) if begins.is_valid else (0, [])
                texts.append(b" ".join(left).decode() if len(left) < n else None)
            rest = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*columns, "__cut"])

    marked = _marked(identified(docs), window, gram).withColumn("__text", F.col("text").cast("binary"))
    kind = StructType([*docs.schema.fields, StructField("__cut", StringType())])
    cut = marked.select(*columns, "__text", "__begins", "__ends").mapInArrow(work, kind)
    changes = {"text": F.coalesce("__cut", "text")}
    if "n_chars" in columns:
        counted = F.length("__cut").cast(docs.schema["n_chars"].dataType)
        changes["n_chars"] = F.when(F.col("__cut").isNotNull(), counted).otherwise(F.col("n_chars"))
    return cut.withColumns(changes).select(*columns)
