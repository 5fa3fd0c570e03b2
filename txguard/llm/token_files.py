"""Token files: ids of all documents in order, in Simple-8b blocks, and their reading.

A file set is a folder of Parquet files, so that Spark commits and reads it on any
store. A row is a block of whole documents: its chunk (a range of documents), its
number and first id there, its documents with their numbers of ids, and its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txguard.llm import simple8b
from txguard.llm.text import ROW, identified
from txguard.llm.tokens import encoder

END = 0
BLOCK_IDS = 1 << 17


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every text and write the ids, each document's followed by ``end``, by ascending ``doc_id``.

    A null text is empty; a null ``doc_id`` comes last; repeated rows are documents
    of their own. A block takes documents until it has BLOCK_IDS ids.
    """
    kind = pa.schema(
        [("chunk", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        block = first = held = 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        close = np.array([end], encode.dtype)

        def row(chunk: int) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            sizes = [len(p) + 1 for p in parts[::2]]
            values = {"chunk": chunk, "block": block, "first": first, "n_ids": len(ids), "doc_ids": names, "sizes": sizes}
            return pa.RecordBatch.from_pylist([values | {"ids": simple8b.encode(ids)}], kind)

        chunk = 0
        for batch in batches:
            for number, doc_id, text in zip(*(batch.column(c) for c in ("chunk", "doc_id", "text")), strict=True):
                chunk = number.as_py()
                ids = encode(text.as_py())
                parts += [ids, close]
                names.append(doc_id.as_py())
                held += len(ids) + 1
                if held >= BLOCK_IDS:
                    yield row(chunk)
                    block, first, held = block + 1, first + held, 0
                    names, parts = [], []
        if names:
            yield row(chunk)

    rows = identified(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().alias("chunk"), "doc_id", "text")
    types = "chunk int, block long, first long, n_ids long, doc_ids array<long>, sizes array<long>, ids binary"
    numbered.mapInArrow(work, types).write.option("compression", "none").parquet(path)


def chunk_starts(totals: DataFrame, size: str) -> DataFrame:
    """(``chunk``, ``before``): the sum of ``size`` over all earlier chunks. One row per chunk, of which there are as many as tasks."""
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.groupBy("chunk").agg(F.sum(size).alias("total"))
    return summed.select("chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``) of every document, from the files alone."""
    files = spark.read.parquet(path)
    starts = chunk_starts(files.select("chunk", "n_ids"), "n_ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                names, sizes, ids, first = (batch.column(c)[block] for c in ("doc_ids", "sizes", "ids", "first"))
                values = simple8b.decode(ids.as_buffer().to_pybytes()).astype("<u4")
                length = np.array(sizes.as_py(), np.int64)
                stop = np.cumsum(length)
                sums = [zlib.crc32(values[z - n : z]) for z, n in zip(stop.tolist(), length.tolist(), strict=True)]
                fields = [names.values, pa.array(stop - length + first.as_py()), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(fields, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(starts), "chunk").select("doc_ids", "sizes", "ids", (F.col("first") + F.col("before")).alias("first"))
    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
