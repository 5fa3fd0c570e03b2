"""Phrase collocations from depth-truncated suffix subtrees, built part by part.

The text of a language is a string of words, and a phrase's occurrences are the
leaves below its node in the tree of all suffixes. The tree is cut vertically:
suffixes are put into groups by their prefix of two words, packed so that the
suffixes of a group stay within a memory budget; a prefix beyond the budget is split
into longer ones. Each group then gets its suffixes, cut off after DEPTH words, and
builds its subtrees alone: sorted suffixes lie in the order of the tree, and the
counts of equal leaves add up to their nodes. Totals of nodes above a split prefix
are added over the groups.

Frequencies come from passes before that one: words are counted exactly, pairs of
frequent words by buckets of their hash. A suffix ends before a pair whose bucket is
rarer than the wanted support, since no wanted phrase can hold such a pair; equal
suffixes of a task are counted together before they are sent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.llm.text import stored
from txguard.operators.skew import left_join_skewed

SUPPORT = 30
BEST = 2000
DEPTH = 4
FACTOR = 2_000_000
#: A part is dropped if a longer phrase has so many of a hundred of its occurrences.
COVERED = 80
#: Suffixes of a group, and the greatest number of groups, beyond which groups grow.
BUDGET, GROUPS = 500_000, 16_384
#: Bits of the hash of a word or pair that name its bucket; a bitmap of all buckets has 8 MB.
BITS = 26
#: Prefix buckets are packed into groups by this many bits.
COARSE = 14
#: Words and different words of a language that a task holds before it hands on what it found of all languages.
HELD, DIFFERENT = 2_000_000, 500_000
#: Languages that a task holds together.
MANY = 64
HEAVY_PARTS = 100_000
SALTS = 64

# Letters made small, and the marks between pieces, of which none is part of a word.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in small letters, with ``.`` where a piece ends."""
    return text.translate(_LETTERS).replace(b".", b" . ").split()


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.where(F.col("text").isNotNull()).select(lang, F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(``lang``, ``word``, ``f``) of words with ``support``, and of all words together (``word`` null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                counts.pop(b".", None)
                words = pa.array([None, *counts], pa.binary()).cast(pa.string())
                sizes = np.fromiter(counts.values(), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), words, pa.array(np.r_[sizes.sum(), sizes])], ["lang", "word", "f"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, found.values())) > DIFFERENT:
                yield from settle()
        yield from settle()

    parts = _texts(docs).mapInArrow(work, "lang string, word string, f long")
    summed = parts.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return stored(summed.where((F.col("f") >= support) | F.col("word").isNull()), "words")


def _bitmap(numbers: DataFrame) -> bytes:
    """A bit for each number (column ``bit``, below 2^BITS) of a table; 4 KB for each 32,768 numbers that occur."""
    place = F.col("bit") + 1
    rows = numbers.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    whole = bytearray(1 << BITS - 3)
    for row in rows.collect():
        whole[(row["at"] - 1) * 4096 : row["at"] * 4096] = row["bits"]
    return bytes(whole)


class _Coded:
    """The texts of one language as numbers of their frequent words; 0 for others and between pieces."""

    def __init__(self, lang: str, bitmap: bytes) -> None:
        seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
        self.words: list[bytes] = [b""]
        self.hashes = [0]
        self.parts: list[np.ndarray] = []
        self.size = 0

        class Codes(dict):
            def __missing__(codes, word: bytes) -> int:  # noqa: N805
                # The same as Spark's xxhash64 of language and word.
                number = xxhash.xxh64_intdigest(word, seed)
                bit = number >> 64 - BITS
                code = 0
                if word != b"." and bitmap[bit >> 3] >> (bit & 7) & 1:
                    code = len(self.words)
                    self.words.append(word)
                    self.hashes.append(number)
                codes[word] = code
                return code

        self.codes = Codes()

    def add(self, text: bytes) -> None:
        found = tokens(text)
        found.append(b".")
        self.parts.append(np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text, and the different pairs in it: place of each pair's first word, which pair it is, each pair's bucket."""
        text = np.concatenate([*self.parts, np.zeros(DEPTH, np.int64)])
        at = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
        many = len(self.words)
        pairs, which = np.unique(text[at] * many + text[at + 1], return_inverse=True)
        hashes = np.array(self.hashes, np.uint64)
        mixed = (hashes[pairs // many] * _MIX) ^ (hashes[pairs % many] >> np.uint64(7))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        return text, at, which, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _over_texts(docs: DataFrame, bitmap: bytes, work: Callable[[str, _Coded], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """Apply ``work`` to the texts of each language, in lots that a task can hold."""
    kept = docs.sparkSession.sparkContext.broadcast(bitmap)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Coded] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                coded = held.get(lang)
                if coded is None:
                    coded = held[lang] = _Coded(lang, kept.value)
                coded.add(text.as_py())
                if coded.size > HELD or len(coded.codes) > DIFFERENT or len(held) > MANY:
                    for name in list(held):
                        yield from work(name, held.pop(name))
        for lang, coded in held.items():
            yield from work(lang, coded)

    return _texts(docs).mapInArrow(go, kind)


def pair_buckets(docs: DataFrame, bitmap: bytes, support: int) -> DataFrame:
    """(``bucket``, ``f``) of hash buckets of pairs of frequent words that reach ``support``."""

    def work(lang: str, coded: _Coded) -> Iterator[pa.RecordBatch]:
        _, _, which, bucket = coded.pairs()
        if len(bucket):
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.bincount(which))], ["bucket", "f"])

    summed = _over_texts(docs, bitmap, work, "bucket long, f long").groupBy("bucket").agg(F.sum("f").alias("f"))
    return stored(summed.where(F.col("f") >= support), "pairs")


def groups(buckets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of each coarse bucket of prefixes, and the buckets that are split.

    At most 2^COARSE sums and GROUPS split buckets come to the driver.
    """
    total = buckets.agg(F.sum("f")).first()[0] or 0
    budget = max(BUDGET, total // GROUPS)
    split = [r["bucket"] for r in buckets.where(F.col("f") > budget).select("bucket").collect()]
    coarse = buckets.where(F.col("f") <= budget).groupBy(F.shiftright("bucket", BITS - COARSE).alias("at")).agg(F.sum("f").alias("f"))
    sums = np.zeros(1 << COARSE, np.int64)
    for row in coarse.collect():
        sums[row["at"]] = row["f"]
    # A group ends where its sum would pass the budget; there are enough groups for what is split.
    group = (np.cumsum(sums) - sums) // budget
    group[-1] = max(group[-1], total // budget)
    return group, np.array(sorted(split), np.int64)


WORDS = [f"w{d}" for d in range(1, DEPTH + 1)]
_SUFFIX = f"group long, lang string, {', '.join(f'{w} string' for w in WORDS)}, f long, split boolean"


def suffixes(docs: DataFrame, bitmap: bytes, pairs: bytes, group: np.ndarray, split: np.ndarray) -> DataFrame:
    """The suffixes of each group, cut after DEPTH words or before a rare pair, equal ones of a task counted together."""
    shared = docs.sparkSession.sparkContext.broadcast((pairs, group, split))

    def work(lang: str, coded: _Coded) -> Iterator[pa.RecordBatch]:
        bits, group, split = shared.value
        text, at, which, bucket = coded.pairs()
        bits = np.frombuffer(bits, np.uint8)
        often = (bits[bucket >> 3] >> (bucket & 7) & 1).astype(bool)
        # For each place, the number of its pair if that is frequent.
        pair = np.full(len(text), -1)
        pair[at] = np.where(often[which], which, -1)
        begin = np.flatnonzero(pair >= 0)
        if not len(begin):
            return
        many = len(coded.words)
        third = np.where(pair[begin + 1] >= 0, text[begin + 2], 0)
        fourth = np.where((third > 0) & (pair[begin + 2] >= 0), text[begin + 3], 0)
        head = np.unique(pair[begin], return_inverse=True)[1]
        _, first, count = np.unique((head * many + third) * many + fourth, return_index=True, return_counts=True)
        here = begin[first]
        place = bucket[pair[here]]
        apart = np.isin(place, split)
        own = group[place >> BITS - COARSE]
        if apart.any():
            hashes = np.array(coded.hashes, np.uint64)
            mixed = (hashes[third[first]] * _MIX) ^ (hashes[fourth[first]] >> np.uint64(9)) ^ place.astype(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            own = np.where(apart, (mixed >> np.uint64(33)).astype(np.int64) % (int(group[-1]) + 1), own)
        known = pa.array([None, *coded.words[1:]], pa.binary()).cast(pa.string())
        codes = [text[here], text[here + 1], third[first], fourth[first]]
        columns = [pa.array(own), pa.array([lang] * len(here)), *(known.take(pa.array(c)) for c in codes), pa.array(count), pa.array(apart)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SUFFIX.split(", ")])

    return _over_texts(docs, bitmap, work, _SUFFIX)


def subtrees(sent: DataFrame, support: int) -> DataFrame:
    """(``lang``, ``phrase``, ``f``): the nodes of two words and more with their leaf totals.

    Suffixes are sorted group by group; only the path to the last leaf is kept
    between batches. Nodes below ``support`` go at once, unless their prefix is split.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        carried = [0] * (DEPTH + 1)

        def nodes(depth: int, rows: pa.Table, at: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            there = rows.column(f"w{depth}").is_valid().to_numpy()[at]
            wanted = there & ((sums >= support) | rows.column("split").to_numpy()[at])
            if wanted.any():
                found = rows.take(pa.array(at[wanted]))
                phrase = pc.binary_join_element_wise(*(found.column(w) for w in WORDS[:depth]), " ")
                yield from pa.table({"lang": found.column("lang"), "phrase": phrase, "f": pa.array(sums[wanted])}).to_batches()

        def differs(rows: pa.Table, column: str) -> np.ndarray:
            values = pc.fill_null(rows.column(column), "")
            return pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if last is not None:
                rows = pa.concat_tables([last, rows])
            rows = rows.combine_chunks()
            count = rows.column("f").to_numpy().copy()
            if last is not None:
                count[0] = 0
            new = np.r_[True, differs(rows, "lang") | differs(rows, "w1")]
            for depth in range(2, DEPTH + 1):
                new[1:] |= differs(rows, f"w{depth}")
                at = np.flatnonzero(new)
                sums = np.add.reduceat(count, at)
                sums[0] += carried[depth]
                yield from nodes(depth, rows, at[:-1], sums[:-1])
                carried[depth] = int(sums[-1])
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            for depth in range(2, DEPTH + 1):
                yield from nodes(depth, last.combine_chunks(), np.zeros(1, np.int64), np.array([carried[depth]]))

    placed = sent.repartition("group").sortWithinPartitions("group", "lang", *WORDS)
    found = placed.mapInArrow(work, "lang string, phrase string, f long")
    summed = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return summed.where(F.col("f") >= support)


def phrase_counts(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``k``, ``f``) of all phrases of 1 to DEPTH words with ``support``, and (``lang``, ``n``)."""
    words = word_counts(docs, support)
    frequent = words.where(F.col("word").isNotNull())
    bitmap = _bitmap(frequent.select(F.shiftrightunsigned(F.xxhash64("lang", "word"), 64 - BITS).alias("bit")))
    buckets = pair_buckets(docs, bitmap, support)
    pairs = _bitmap(buckets.select(F.col("bucket").alias("bit")))
    longer = subtrees(suffixes(docs, bitmap, pairs, *groups(buckets)), support)
    k = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    counts = frequent.select("lang", F.col("word").alias("phrase"), "f").union(longer)
    total = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    return stored(counts.withColumn("k", k.cast("int")), "counts"), total


def _run(words: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (two words and more) with ``a`` and the ``l``, ``r`` and ``score`` of their lowest cut."""
    candidates = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": _run(words, F.lit(1), F.col("cut")), "right": _run(words, F.col("cut") + 1, F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = left_join_skewed(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], HEAVY_PARTS)
    exact = F.expr(f"(cast({FACTOR} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("lowest")
    found = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest)
    return found.select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")


def covered(counts: DataFrame) -> DataFrame:
    """(``lang``, ``phrase``) of the phrases that a longer one has nearly always around it."""
    words = F.split("phrase", " ")
    longer = counts.where("k >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    most = longer.groupBy("lang", _run(words, F.col("begin"), F.col("size")).alias("phrase")).agg(F.max("f").alias("most"))
    share = F.expr(f"cast(100 as decimal(3,0)) * cast(most as decimal(19,0)) >= cast({COVERED} as decimal(3,0)) * cast(f as decimal(19,0))")
    return most.join(counts, ["lang", "phrase"]).where(share).select("lang", "phrase")


def phrases(docs: DataFrame, support: int = SUPPORT, best: int = BEST) -> DataFrame:
    """The ``best`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A null language is ``und``; a null or empty text has no words. Repeated rows
    count each; extra columns are ignored. No phrase crosses a mark of punctuation,
    a line or a document.
    """
    counts, total = phrase_counts(docs, support)
    rows = scored(counts).join(covered(counts), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
