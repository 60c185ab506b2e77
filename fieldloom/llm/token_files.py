"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds consecutive documents in ascending id order:

* data frames: zstandard frames of ids, little-endian unsigned 32-bit; a frame holds whole documents, and a document of
  more than FRAME_IDS ids several frames of its own,
* the index: a skippable frame with the compressed document ids, null marks and numbers of ids,
* the seek table: a skippable frame with the compressed size, the content size and a checksum (low 32 bits of XXH64) of
  each data frame, then their number, a descriptor and a magic number. Any zstandard tool decompresses the file to its
  ids.

A reader takes the seek table and the index from the end, and decompresses and verifies only the frames that hold
requested documents. Files are written under a name of their own and renamed when complete, so a repeated or lost task
leaves no half file.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.places import opened, qualified
from fieldloom.llm.tokens import encoder, packed

#: Ids of a frame at most, but for a single document's rest: 1 MB.
FRAME_IDS = 1 << 18
#: Fixed: magic numbers of the zstandard seekable format, the descriptor for checksums, and a skippable frame's.
SEEK_FRAME, SEEK_MAGIC, CHECKSUMS, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x80, 0x184D2A50
LEVEL = 3
#: Characters of a text by which rows of one id are dealt over tasks.
PREFIX = 64


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class FrameWriter:
    """Writes one file: documents are added in order, then the file is closed."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.waiting: list[bytes] = []
        self.bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids, self.lengths = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.bytes and self.bytes + len(ids) > self.frame_bytes:
            self.flush()
        for at in range(0, len(ids), self.frame_bytes):
            self.waiting.append(ids[at : at + self.frame_bytes])
            self.bytes += len(self.waiting[-1])
            if self.bytes >= self.frame_bytes:
                self.flush()
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)

    def flush(self) -> None:
        if self.bytes:
            content = b"".join(self.waiting)
            frame = self.compress(content)
            self.out.write(frame)
            self.frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.waiting, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([i is not None for i in self.ids], "<i8")
        index = np.concatenate([np.array([i or 0 for i in self.ids], "<i8"), known, np.array(self.lengths, "<i8")])
        self.out.write(_skippable(INDEX_FRAME, self.compress(index.astype("<i8").tobytes())))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(_skippable(SEEK_FRAME, entries + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)))


class FrameReader:
    """Reads one file; `read` yields (position, doc_id, start in the file, ids) of all or of the wanted documents."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, kind, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or kind != CHECKSUMS:
            raise ValueError("no seek table")
        table = np.frombuffer(source.read_at(12 * count, end - 9 - 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.file_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.bytes_at = np.concatenate([[0], np.cumsum(table[:, 1])])
        index_at, table_at = int(self.file_at[-1]), end - 17 - 12 * count
        magic, size = struct.unpack("<II", source.read_at(8, index_at))
        if magic != INDEX_FRAME or index_at + 8 + size != table_at:
            raise ValueError("no index")
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read_at(size, index_at + 8)), "<i8").reshape(3, -1)
        self.ids = [int(i) if k else None for i, k in zip(index[0], index[1], strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(index[2])])
        self.decompressed = 0
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self._held[0] != number:
            at, to = int(self.file_at[number]), int(self.file_at[number + 1])
            content = zstandard.ZstdDecompressor().decompress(self.source.read_at(to - at, at))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[number]:
                raise ValueError(f"frame {number} is damaged")
            self._held = (number, content)
            self.decompressed += 1
        return self._held[1]

    def read(self, wanted: set[int] | None = None):
        for n, doc_id in enumerate(self.ids):
            if wanted is not None and doc_id not in wanted:
                continue
            at, to = 4 * int(self.starts[n]), 4 * int(self.starts[n + 1])
            parts, number = [], int(np.searchsorted(self.bytes_at, at, "right")) - 1
            while at < to:
                base, past = int(self.bytes_at[number]), int(self.bytes_at[number + 1])
                parts.append(self.frame(number)[at - base : min(to, past) - base])
                at, number = min(to, past), number + 1
            yield n, doc_id, int(self.starts[n]), b"".join(parts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[int, int, int]]:
    """Encode all documents and write them in ascending id order; (file number, documents, ids) of each file, in order.

    Null ids come first; rows of one id are ordered by text. Null text counts as empty, and each document ends with
    `end_id`. Texts are encoded whole. Other columns are not read. An empty table writes no file. The folder is a new one;
    what lost attempts of a task leave there is removed in the end.
    """
    spark, end = docs.sparkSession, packed([end_id])
    folder = qualified(spark, folder)

    def write(batches):
        encode, place, shard = encoder(tokenizer).encode, None, TaskContext.get().partitionId()
        for batch in batches:
            if place is None and batch.num_rows:
                files, path = opened(folder)
                files.create_dir(path, recursive=True)
                place = f"{path}/.{uuid.uuid4().hex}"
                out = files.open_output_stream(place, compression=None)
                writer = FrameWriter(out)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, encode(text.as_py()) + end)
        if place is not None:
            writer.close()
            out.close()
            target = f"{path}/{shard:08d}.ids.zst"
            # A lost attempt of this task may have come as far as here; not every file system renames onto a file.
            if files.get_file_info(target).type == arrow_fs.FileType.File:
                files.delete_file(target)
            files.move(place, target)
            row = [[shard], [len(writer.ids)], [sum(writer.lengths)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["file", "documents", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # Texts that begin alike go on beside each other, so that many rows of one id, or without id, are dealt over tasks.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    written = sorted(tuple(r) for r in ordered.mapInArrow(write, "file long, documents long, ids long").collect())
    files, path = opened(folder)
    for left in files.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)):
        if left.base_name.startswith("."):
            files.delete_file(left.path)
    return written


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, int, int]], wanted: set[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of the wanted ones; start is the number of ids before, in all files."""
    before, listed, folder = 0, [], qualified(spark, folder)
    for number, _, ids in files:
        listed.append((number, before))
        before += ids

    def read(batches):
        for batch in batches:
            for number, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, path = opened(folder)
                with place.open_input_file(f"{path}/{number:08d}.ids.zst") as source:
                    rows, size = [], 0
                    for _, doc_id, start, ids in FrameReader(source).read(wanted):
                        rows.append((doc_id, base + start, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    table = spark.createDataFrame(listed, "file long, before long")
    return table.repartitionByRange(max(1, len(listed)), "file").mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))
