"""Winnowing fingerprints: rolling k-gram hashes, the minimum per window, rightmost ties.

Words are hashed, k-gram hashes are cyclic polynomials of them (made by doubling:
the hash of 2s words from two hashes of s words, one of them rotated by s bits),
and window minima are made by doubling too. A gram is carried as its hash above
its position counted down, so that the smaller number is the smaller hash and,
among equal ones, the one further right. Texts that share ``GRAM + WINDOW - 1``
words in a row share a fingerprint hash. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.functions.scalar import computed_once
from txguard.llm.text import ROW, identified, words

GRAM = 4
WINDOW = 8
PLACES = (1 << 31) - 1
CHUNKS_PER_PARTITION = 4


def _shifted(array: str, by: int, value: str) -> Column:
    """``value`` of each element a and the element b that stands ``by`` places further on."""
    left = f"greatest(size({array}) - {by}, 0)"
    return F.expr(f"zip_with(slice({array}, 1, {left}), slice({array}, {by + 1}, {left}), (a, b) -> {value})")


def with_fingerprint(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``name``: the chosen grams of ``text`` as array<long>, in the order of their places.

    ``gram`` and ``window`` are powers of two. A text with fewer words than a gram
    is one gram; one with fewer grams than a window is one window; a text without
    words (or null) has none.
    """
    if gram & (gram - 1) or window & (window - 1) or gram < 1 or window < 1:
        raise ValueError("gram and window must be powers of two")
    g = f"__{name}"
    df = df.withColumn(g, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    short = F.when(F.size(g) > 0, F.array(F.xxhash64(g))).otherwise(F.col(g))
    df = df.withColumn(f"{g}_short", F.when(F.size(g) < gram, short))
    for s in (1 << i for i in range(gram.bit_length() - 1)):
        df = df.withColumn(g, _shifted(g, s, f"shiftleft(a, {s}) ^ shiftrightunsigned(a, {64 - s}) ^ b"))
    df = df.withColumn(g, F.coalesce(f"{g}_short", g))
    df = df.withColumn(g, F.expr(f"transform({g}, (x, i) -> shiftleft(xxhash64(x) & 4294967295, 31) | ({PLACES} - i))"))
    df = df.withColumn(f"{g}_few", F.when((F.size(g) > 0) & (F.size(g) < window), F.array(F.array_min(g))))
    for s in (1 << i for i in range(window.bit_length() - 1)):
        df = df.withColumn(g, _shifted(g, s, "least(a, b)"))
    chosen = F.coalesce(F.col(f"{g}_few"), F.array_distinct(g))
    # A filter on the fingerprint must not be written out through all these steps.
    return df.withColumn(name, computed_once(chosen)).drop(g, f"{g}_short", f"{g}_few")


def hashes(grams: Column) -> Column:
    """The distinct 32-bit hashes of chosen grams, in order of first place."""
    return F.array_distinct(F.transform(grams, lambda x: F.shiftrightunsigned(x, 31)))


def places(grams: Column) -> Column:
    """Word positions of chosen grams, from 0."""
    return F.transform(grams, lambda x: F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES)))


def digest(grams: Column) -> Column:
    """The hashes of chosen grams as one string, 8 hex digits each; empty for none."""
    return F.array_join(F.transform(grams, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 31))), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Shared hashes over all hashes; 1 for two fingerprints without any."""
    shared, both = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the document that follows in (``doc_id``, null last, row); after the last, the first.

    ``docs`` carries ``__row``. Documents are put into chunks by ranges of
    ``doc_id`` (those without one by ranges of ``__row``); the first document of
    each chunk is also sent to the chunk before, so that each chunk sees what
    follows it. One shuffle, and a window no longer than a chunk, which spills.
    """
    spark = docs.sparkSession
    chunks = CHUNKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("__key", F.col("doc_id").cast("double"))
    borders = keyed.where("__key is not null").approxQuantile("__key", [i / chunks for i in range(1, chunks)], 0.2 / chunks)
    splits = [float("-inf"), *sorted(set(borders) or {0.0}), float("inf")]
    spread = F.floor((F.col(ROW) / F.lit(2.0**64) + 0.5) * chunks) + chunks
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol="__bucket", handleInvalid="keep")
    placed = cut.transform(keyed).withColumn("__chunk", F.coalesce(F.when(F.col("__key").isNotNull(), F.col("__bucket")), spread).cast("long"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))
    firsts = placed.groupBy("__chunk").agg(F.min(place).alias("__first"))
    around = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most 2 * chunks rows.
    firsts = firsts.withColumn(
        "__before", F.coalesce(F.lag("__chunk").over(Window.orderBy("__chunk")), F.last("__chunk").over(around))
    )
    firsts = firsts.select("__chunk", F.col("__first")[ROW].alias("__first_row"), "__before")
    placed = placed.join(F.broadcast(firsts), "__chunk")
    copies = F.when(F.col(ROW) == F.col("__first_row"), F.array("__chunk", "__before")).otherwise(F.array("__chunk"))
    sent = placed.select("*", F.posexplode(copies).alias("__guest", "__in"))
    following = Window.partitionBy("__in").orderBy("__guest", F.col("doc_id").isNull(), "doc_id", ROW)
    found = sent.withColumns({f"next_{c}": F.lead(c).over(following) for c in columns}).where("__guest = 0")
    return found.drop("__key", "__bucket", "__chunk", "__first_row", "__before", "__guest", "__in")


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter replaced.

    The last floor(n_chars / 4) code points give way to the first as many of the
    next document. A null text is empty. Returns the digests, the edited text, the
    likeness of a document's fingerprint to the edited text's and to the next
    document's, and ``places`` of the fingerprint's grams.
    """
    rows = identified(docs).select(ROW, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(rows.withColumn("n_chars", F.length("text").cast("long")), "text", "grams", gram, window)
    rows = with_next(rows, ["text", "grams"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter)
    )
    rows = rows.select("doc_id", "n_chars", "grams", "next_grams", edited.alias("edited_text"))
    rows = with_fingerprint(rows, "edited_text", "edited_grams", gram, window)
    rows = rows.withColumns({h: hashes(F.col(g)) for h, g in (("own", "grams"), ("new", "edited_grams"), ("next", "next_grams"))})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_text",
        digest(F.col("grams")).alias("fingerprint"),
        digest(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        places(F.col("grams")).alias("places"),
    )
