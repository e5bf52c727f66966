"""Token ids in fixed-width bit-packed files that can be read at any block.

A file holds blocks of `block` ids, each of the fewest bits its vocabulary needs, the first bit of an id
first; the last block is filled up with zero bits. Behind the blocks come, as little-endian numbers, the
documents (id, whether it has one, place of its first id in the file), the blocks' offsets and a fixed
trailer. Every block but the last has the same size, yet its offset is stored, so that a reader needs
nothing but the trailer. Files are written and read through `pyarrow.fs`, so that their folder may be any
store Arrow knows (a shared mount, HDFS, S3).

Rules: a null text is empty and still has its end id; rows with equal doc_id keep one entry each, in the
order of their texts; a null doc_id comes first. No documents give no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.common import stored
from daytrail.llm.tokens import encoder

BLOCK = 8192
TRAILER = struct.Struct("<8sIIQQQ")  # magic, bits, ids in a block, ids, documents, blocks
MAGIC = b"IDBITS01"
DOC = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("start", "<i8")])


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    bit = ids.astype(">u4")[:, None].view(np.uint8)
    return np.packbits(np.unpackbits(bit, axis=1)[:, 32 - bits:].ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    bit = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - bits:] = bit
    return np.packbits(whole, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Blocks go out as they fill; the index, 24 bytes a document, is kept until the end."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest, self.n, self.at = np.zeros(0, np.uint32), 0, 0
        self.docs: list[tuple[int, int, int]] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, int(doc_id is not None), self.n))
        self.n += len(ids)
        held = np.concatenate((self.rest, ids))
        for k in range(0, len(held) - self.block + 1, self.block):
            self._write(held[k:k + self.block])
        self.rest = held[len(held) - len(held) % self.block:]

    def _write(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest)
        self.stream.write(np.array(self.docs, DOC).tobytes())
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.bits, self.block, self.n, len(self.docs), len(self.offsets)))
        self.stream.close()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, file, size: int):
        self.file = file
        magic, self.bits, self.block, self.n, n_docs, n_blocks = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("no file of packed ids")
        tail = n_docs * DOC.itemsize + n_blocks * 8
        index = self._at(size - TRAILER.size - tail, tail)
        self.docs = np.frombuffer(index, DOC, n_docs)
        self.offsets = np.frombuffer(index, "<u8", n_blocks, n_docs * DOC.itemsize)
        self.end = size - TRAILER.size - tail

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids `start` to `end` of the file, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        to = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        data = self._at(int(self.offsets[first]), to - int(self.offsets[first]))
        held = unpack(data, self.bits, min(self.n, (last + 1) * self.block) - first * self.block)
        return held[start - first * self.block:end - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order, reading about `most` ids at a time."""
        starts = np.append(self.docs["start"], self.n)
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
            held = self.ids(int(starts[i]), int(starts[j]))
            for k in range(i, j):
                doc_id = int(self.docs["doc_id"][k]) if self.docs["known"][k] else None
                yield doc_id, held[starts[k] - starts[i]:starts[k + 1] - starts[i]]
            i = j


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write every document's ids, in ascending doc_id order over the files, one file a partition.

    Returns (part, path, bytes, n_docs, n_tokens), a row a file. A file appears under its name only when
    it is whole, so a task that runs again replaces its file by the same bytes.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, part = encoder(tokenizer), None, TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}.ids"
        attempt = f"{base}/.{uuid.uuid4().hex}"
        for batch in batches:
            at, ids_of = 0, batch["doc_id"].to_pylist()
            for ids, counts in coder.encode(batch["text"]):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = Writer(store.open_output_stream(attempt), bits_for(coder.vocabulary))
                ends = np.cumsum(counts).tolist()
                for start, stop in zip([0, *ends], ends):
                    writer.add(ids_of[at], np.concatenate((ids[start:stop], end)))
                    at += 1
        if writer is not None:
            writer.close()
            size = store.get_file_info(attempt).size
            store.move(attempt, path)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/part-{part:06d}.ids", "bytes": size,
                                               "n_docs": len(writer.docs), "n_tokens": writer.n}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(write, "part LONG, path STRING, bytes LONG, n_docs LONG, n_tokens LONG")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32), each task reading its files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    reader = Reader(file, row["bytes"])
                    out, start = [], row["before"]
                    for doc_id, ids in reader.documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    # One row a file, so that the running sum over all of them is small.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = placed.select("path", "bytes", "before").repartition(max(1, files.count()), "path")  # a task for each file
    return spread.mapInArrow(read, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=list(names))


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files, then read every document back from them."""
    return read_ids(stored(write_ids(docs, folder, tokenizer, end_id), "id-files"))
