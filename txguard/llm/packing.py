"""Packing documents into sequences: concatenate and cut.

The first pass encodes every document where it is read and notes its place within
its chunk (a partition of the input). Prefix sums over the chunks' totals give
each chunk's place among all ids. The second pass cuts every document at the
borders of fixed windows and writes one boundary record per piece. No row is
shuffled, and only the last sequence can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.token_files import chunk_starts
from txguard.llm.tokens import encoder
from txguard.session import scratch_path

LENGTH = 2048
END = 1


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(``doc_id``, ``chunk``, ``before``, ``n_ids``, ``ids``) of every row, kept in the shared folder.

    ``ids`` holds the ids and ``end`` as unsigned numbers of ``width`` bytes,
    ``before`` counts the ids of the chunk's earlier rows. A null text is empty.
    """
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        close = np.array([end], encode.dtype).tobytes()
        before = 0
        for batch in batches:
            ids = [encode(text.as_py()).tobytes() + close for text in batch.column("text")]
            sizes = np.array([len(x) // encode.dtype.itemsize for x in ids], np.int64)
            places = np.cumsum(sizes) - sizes + before
            before += int(sizes.sum())
            width = pa.array(np.full(len(ids), encode.dtype.itemsize, np.int32))
            fields = [batch.column("doc_id"), batch.column("chunk"), pa.array(places), pa.array(sizes), width, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "chunk", "before", "n_ids", "width", "ids"])

    rows = docs.select(F.spark_partition_id().alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "ids")
    kind = "doc_id long, chunk int, before long, n_ids long, width int, ids binary"
    rows.mapInArrow(work, kind).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    Columns: ``doc_id``, ``start`` and ``length`` of the piece in its document's ids
    (with ``end`` as the last), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, the
    piece's ``offset`` there, and ``ids`` of the piece. Repeated rows are documents
    of their own.
    """
    ids = encoded(docs, tokenizer, end)
    starts = chunk_starts(ids.select("chunk", "n_ids"), "n_ids").withColumnRenamed("before", "chunk_before")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("n_ids").to_numpy()
            place = batch.column("place").to_numpy()
            pieces = (place + size - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(size)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[row] // length + nth
            begin = np.maximum(place[row], sequence * length)
            stop = np.minimum(place[row] + size[row], (sequence + 1) * length)
            start, taken = begin - place[row], stop - begin
            whole = [np.frombuffer(x.as_buffer(), f"<u{w.as_py()}").astype("<u4") for x, w in zip(batch.column("ids"), batch.column("width"), strict=True)]
            parts = [whole[r][a : a + n].tobytes() for r, a, n in zip(row.tolist(), start.tolist(), taken.tolist(), strict=True)]
            sums = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            fields = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(taken), sums, pa.array(size[row]),
                      pa.array(sequence), pa.array(begin - sequence * length), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, names)

    placed = ids.join(F.broadcast(starts), "chunk")
    placed = placed.select("doc_id", "n_ids", "width", "ids", (F.col("before") + F.col("chunk_before")).alias("place"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(work, kind)
