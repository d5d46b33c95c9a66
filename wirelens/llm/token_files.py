"""Token ids in binary files, with document boundaries in Elias-Fano code.

Documents are range-partitioned by id; each task writes one file: the concatenated ids of its
documents (16 or 32 bits each), then two monotone lists in Elias-Fano code, the token offset at which
every document ends and the document ids.  A list of n values below u takes about 2 + log2(u / n) bits a
value; a select table over the upper bits gives any value without decoding the list.  Files are read
back by memory map or through the file system that Spark names.

    file:    ids | ends | doc ids | footer | footer length (8 bytes) | magic (8 bytes)
    list:    upper bits (unary, bit-packed) | lower bits (packed) | select samples (every 256th one, 8 bytes)
"""

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wirelens.llm.common import file_system, landed, publish
from wirelens.llm.word_ids import encoded_documents
from wirelens.session import scratch_folder, ship_package

MAGIC, STEP = b"EFTOKEN1", 256


def ef_encode(values: np.ndarray) -> tuple[bytes, dict]:
    """Elias-Fano code of non-decreasing integers."""
    n = len(values)
    base = int(values[0]) if n else 0
    rel = (values.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64)))
    top = int(rel[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    ones = (rel >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
    upper[ones] = True
    bits = (rel[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(bool) if low else np.zeros((n, 0), bool)
    parts = [np.packbits(upper, bitorder="little").tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes(),
             ones[::STEP].astype("<i8").tobytes()]
    return b"".join(parts), {"n": n, "base": base, "low": low, "bytes": [len(p) for p in parts]}


class EliasFano:
    """Read access to one list; ``raw`` may be a memory map."""

    def __init__(self, raw: np.ndarray, head: dict):
        a, b, c = head["bytes"]
        self.n, self.low, self.base = head["n"], head["low"], head["base"]
        self.upper, self.lower = raw[:a], raw[a:a + b]
        self.samples = raw[a + b:a + b + c].view("<i8") if c else np.zeros(0, np.int64)

    def _join(self, upper: np.ndarray, first: int) -> np.ndarray:
        n = len(upper)
        bits = np.unpackbits(self.lower[first * self.low // 8:], count=n * self.low + first * self.low % 8, bitorder="little")
        bits = bits[first * self.low % 8:].reshape(n, self.low).astype(np.uint64)
        low = (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if self.low else np.zeros(n, np.uint64)
        whole = (upper.astype(np.uint64) << np.uint64(self.low)) | low
        return (whole + np.uint64(self.base % (1 << 64))).view(np.int64)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, over at most ``STEP`` ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // STEP])
        need, byte = i % STEP, at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.upper[byte:byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > need:
                place = byte * 8 + int(ones[need])
                return int(self._join(np.array([place - i]), i)[0])
            need, byte, skip = need - len(ones), byte + 64, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n]
        return self._join(ones - np.arange(self.n), 0)


class TokenFile:
    """One file: document boundaries by select, ids as an array."""

    def __init__(self, raw: np.ndarray):
        if raw[-8:].tobytes() != MAGIC:
            raise ValueError("not a whole token file")
        size = int(raw[-16:-8].view("<i8")[0])
        head = json.loads(raw[-16 - size:-16].tobytes())
        self.nulls, self.n = head["null_ids"], head["ends"]["n"]
        self.ids = raw[:head["ids"]].view(head["kind"])
        at = head["ids"] + head["gap"]
        self.ends = EliasFano(raw[at:], head["ends"])
        self.doc_ids = EliasFano(raw[at + sum(head["ends"]["bytes"]):], head["doc_ids"])

    @classmethod
    def open(cls, uri: str) -> "TokenFile":
        fs, path = file_system(uri)
        if fs.type_name == "local":
            return cls(np.memmap(path, np.uint8, "r"))
        with fs.open_input_file(path) as f:
            return cls(np.frombuffer(f.read_buffer(), np.uint8))

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                      end_id: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Write all documents in ascending id order; returns (part, path, documents, tokens), one row per file.

    Null ids come first, rows with equal ids follow each other in the order of their texts' hashes; a null
    text is empty and holds the end id alone.  An empty table writes no file.  Ids must be integers.
    """
    ship_package(docs.sparkSession)
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        fs, base = file_system(folder)
        path = f"{base}/part-{part:06d}.tok"
        ends, ids, nulls, tokens = [], [], 0, 0

        def write(out):
            nonlocal nulls, tokens
            for batch in (b for group in ([first], batches) for b in group):
                nulls += batch.column(0).null_count
                ids.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
                for _, found, at in encoded_documents(batch.column(1), tokenizer, end_id):
                    out.write(found.astype(kind).tobytes())
                    ends.append(at[1:] + tokens)
                    tokens += len(found)
            pad = -(tokens * int(kind[-1])) % 8
            out.write(bytes(pad))
            ends_raw, ends_head = ef_encode(np.concatenate(ends))
            ids_raw, ids_head = ef_encode(np.concatenate(ids))
            out.write(ends_raw + ids_raw)
            head = json.dumps({"kind": kind, "ids": tokens * int(kind[-1]), "gap": pad, "ends": ends_head,
                               "doc_ids": ids_head, "null_ids": nulls})
            out.write(head.encode() + len(head).to_bytes(8, "little") + MAGIC)
        publish(fs, path, f"{context.taskAttemptId()}", write)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.tok"],
                                          "documents": [sum(map(len, ends))], "tokens": [tokens]})
    return landed(ordered.mapInArrow(run, "part int, path string, documents long, tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over little-endian 32-bit ids.
    """
    ship_package(files.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = TokenFile.open(row["path"])
                ends, known = held.ends.all(), held.doc_ids.all()
                begins = np.append(0, ends[:-1])
                for lo in range(0, held.n, 50_000):
                    span = range(lo, min(lo + 50_000, held.n))
                    crc = [zlib.crc32(held.ids[begins[i]:ends[i]].astype("<u4").tobytes()) for i in span]
                    names = [None if i < held.nulls else int(known[i - held.nulls]) for i in span]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(names, pa.int64()), "start": begins[lo:span.stop] + row["base"],
                        "n_tokens": (ends - begins)[lo:span.stop], "ids_crc32": pa.array(crc, pa.int64())})
    spread = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")  # kept apart, small as the rows are
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return read_token_files(write_token_files(docs, scratch_folder(docs.sparkSession, "tokens"), tokenizer, **options))
