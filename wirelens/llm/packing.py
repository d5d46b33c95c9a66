"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the binary digits of L (as many full
sequences as fit, then falling powers of two).  Every piece is a sequence of its own: none crosses
documents and none needs padding.  Sequences of one length form a bucket and are numbered without
gaps, bucket by bucket, from counts per (task, bucket); rows are never gathered for it.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wirelens.llm.common import landed
from wirelens.llm.word_ids import encoded_documents
from wirelens.session import ship_package


def cut(length: int, most: int) -> list[int]:
    """Lengths of the pieces of a document, longest first; ``most`` is a power of two."""
    rest = length % most
    return [most] * (length // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2,
           most: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, number[, ids]), one row per piece.

    ``number`` counts the pieces of one length inside the task ``part``.  ``ids`` are little-endian
    unsigned 32-bit.  A null text is empty and becomes one piece that holds the end id.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    ship_package(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"] + ["ids"] * with_ids
    kinds = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part int, number long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, ids, at in encoded_documents(batch.column(1), tokenizer, end_id):
                rows, start, length, crc, total, number, blobs = [], [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    done = 0
                    for size in cut(b - a, most):
                        raw = ids[a + done:a + done + size].tobytes()
                        rows.append(lo + i)
                        start.append(done)
                        length.append(size)
                        crc.append(zlib.crc32(raw))
                        total.append(b - a)
                        number.append(seen.get(size, 0))
                        seen[size] = number[-1] + 1
                        done += size
                        if with_ids:
                            blobs.append(raw)
                whole = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *whole,
                           pa.array(np.full(len(rows), part, np.int32)), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, names)
    return own.mapInArrow(run, kinds)


def pack(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``pieces`` with sequence_id (buckets in rising length, gapless from 0) and offset (always 0).

    Rows with equal or null ids are packed one by one.  An empty table gives no pieces.
    """
    cut_up = landed(pieces(docs, tokenizer, **options), "pieces")
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_bucket = Window.partitionBy("length").orderBy("part")
    before = counts.select("length", "part", (F.sum("n").over(by_bucket) - F.col("n")).alias("in_bucket"))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n"))  # at most log2(most) + 1 rows
    base = sizes.select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("base"))
    first = before.join(base, "length").select("length", "part", (F.col("in_bucket") + F.col("base")).alias("first"))
    return cut_up.join(first, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("number")).withColumn(
        "offset", F.lit(0).cast("long")).drop("part", "number", "first")


def write_sequences(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the token ids of all sequences as Parquet, one folder per length."""
    pack(docs, tokenizer, with_ids=True, **options).write.partitionBy("length").parquet(path)
