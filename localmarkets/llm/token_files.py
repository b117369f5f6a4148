"""Fixed-width bit-packed token files.

A file: blocks of bit-packed ids, then a footer. Each id takes ``bits`` bits, the fewest that hold
the vocabulary; id i of a block is in bits i*bits to (i+1)*bits of the block's little-endian bit
string, and each block starts at a byte. Footer, all little-endian: byte offset of each block (u64);
doc id (i64), null flag (u8) and id count (u64) of each document; then blocks, documents, ids a
block, ids and bits (5 x u64) and the magic bytes. Readers find any id by its block's offset.

Files are written in the shared folder in ascending doc_id order, under a name of the attempt and then
renamed, so a task that runs again leaves whole files only. A task begins a new file after
``FILE_BYTES``, so a file holds little more than that and one document. They are read back with
Spark's binaryFile source.

Defined results: a null text is an empty document (the end id only); null ids come first; repeated
ids are separate documents in the order of a hash of their texts; an empty table writes no file and gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.llm.encoding import encoded, encoder
from localmarkets.shared import cut, shared_path

MAGIC = b"BITIDS01"
BLOCK_IDS = 1 << 16
#: Packed bytes after which a task begins a new file.
FILE_BYTES = 16 << 20


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Writer:
    """Appends documents; blocks leave for the stream as they fill."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at, self.rest = stream, bits, 0, np.zeros(0, np.uint32)
        self.offsets, self.docs, self.nulls, self.counts = [], [], [], []

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.stream.write(data := pack(ids, self.bits))
        self.at += len(data)

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += [d or 0 for d in docs]
        self.nulls += [d is None for d in docs]
        self.counts += counts.tolist()
        rest = np.concatenate([self.rest, ids])
        full = len(rest) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, full, BLOCK_IDS):
            self._block(rest[i : i + BLOCK_IDS])
        self.rest = rest[full:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        parts = (np.array(self.offsets, "<u8"), np.array(self.docs, "<i8"), np.array(self.nulls, "u1"), np.array(self.counts, "<u8"))
        tail = np.array([len(self.offsets), len(self.docs), BLOCK_IDS, sum(self.counts), self.bits], "<u8")
        self.stream.write(b"".join([*[p.tobytes() for p in parts], tail.tobytes(), MAGIC]))


class Reader:
    def __init__(self, data: bytes | memoryview):
        if bytes(data[-8:]) != MAGIC:
            raise ValueError("not a token file")
        blocks, docs, self.block_ids, self.n, self.bits = np.frombuffer(data[-48:-8], "<u8").astype(np.int64).tolist()
        at = len(data) - 48 - blocks * 8 - docs * 17
        self.data, self.end = data, at
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        self.docs = np.frombuffer(data, "<i8", docs, at := at + blocks * 8)
        self.nulls = np.frombuffer(data, "u1", docs, at := at + docs * 8)
        self.counts = np.frombuffer(data, "<u8", docs, at + docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file: only their blocks are unpacked."""
        out = []
        for b in range(start // self.block_ids, -(-stop // self.block_ids)):
            first, n = b * self.block_ids, min(self.block_ids, self.n - b * self.block_ids)
            end = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
            out.append(unpack(self.data[int(self.offsets[b]) : end], n, self.bits)[max(0, start - first) : stop - first])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files and return their list: part (in order), file, n_docs, n_ids, before (ids of all earlier files)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        filesystem, folder = _filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        trial, writer, number = f"{folder}/_try-{task.taskAttemptId()}", None, 0

        def ended_file() -> pa.RecordBatch:
            part = task.partitionId() << 24 | number
            name = f"part-{part:016d}.ids"
            writer.close()
            writer.stream.close()
            if filesystem.get_file_info(f"{folder}/{name}").is_file:  # of an attempt whose list was lost
                filesystem.delete_file(f"{folder}/{name}")
            filesystem.move(trial, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.counts)]})

        for docs, ids, counts in encoded(batches, vocabulary):
            if writer is None:
                writer = Writer(filesystem.open_output_stream(trial), width(max(end_id + 1, encoder(vocabulary).tokenizer.get_vocab_size())))
            writer.add(docs.to_pylist(), *ended(ids, counts, end_id))
            if writer.at >= file_bytes:
                yield ended_file()
                writer, number = None, number + 1
        if writer is not None:
            yield ended_file()

    # The hash deals the rows of one id, or of none, to more than one task.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    files = cut(ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "token-file-list")
    # One row a file.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("before", F.sum("n_ids").over(earlier) - F.col("n_ids"))


def read_tokens(spark, path: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                file = Reader(memoryview(data.as_buffer()))
                starts = np.concatenate([[0], np.cumsum(file.counts)])
                for at in range(0, len(file.docs), 4096):
                    few = slice(at, min(at + 4096, len(file.docs)))
                    first, last = int(starts[at]), int(starts[few.stop])
                    ids = file.ids(first, last)
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts[few] - first, starts[at + 1 : few.stop + 1] - first, strict=True)]
                    docs = pa.array(file.docs[few].astype(np.int64), mask=file.nulls[few].astype(bool))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([int(Path(name.as_py()).name[5:-4])] * len(crc)), "doc_id": docs, "at": pa.array(starts[few]), "n_tokens": pa.array(file.counts[few]), "ids_crc32": pa.array(crc, pa.int64())})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path).select("path", "content")
    rows = found.mapInArrow(read, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("part", "before"), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    files = cut(write_tokens(docs, vocabulary, path, end_id), "token-file-starts")
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, path, files)
