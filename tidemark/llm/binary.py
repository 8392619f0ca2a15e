"""Token ids in binary files of independent zstandard frames.

A file holds one frame for each document, a skippable frame with the document
ids, and a trailing seek table in the public seekable format: for each frame
its compressed and decompressed size and a checksum (the low 32 bits of
xxHash64 of the decompressed bytes). A reader takes the table from the end of
the file and decompresses only the frames of the documents asked for.

Files are written below the shared folder through Arrow's file systems, under a
temporary name that is then moved, so a task that is run again leaves the same
file. Files are in order of doc_id, and so are the documents in each.

Defined results: a null or empty text is the end id alone; rows with a null
doc_id come first; repeated ids stand beside each other, equal texts in any
order; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialise, scratch_path
from tidemark.llm.tokens import default_path, word_tokenizer

END = 2
#: Fixed values of the public seekable format: skippable frame numbers, footer number, table flags.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Id that stands for a null doc_id in the index.
NULL_ID = -(2**63)


class Writer:
    """Appends documents to an open binary file."""

    def __init__(self, out, level: int = 1):
        self.out = out
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False)
        self.table: list[bytes] = []
        self.ids: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # The index is an entry of the table too, without decompressed bytes, so that sizes add up to the file's.
        rows = self.table + [struct.pack("<III", 8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(rows) + struct.pack("<IBI", len(rows), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


class Reader:
    """Random access to the documents of a binary file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, flags, number = struct.unpack("<IBI", self._at(end - 9, 9))
        if number != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        rows = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.size, self.full, self.sum = rows[:-1].T
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.frombuffer(self._at(int(self.start[-1]) + 8, int(rows[-1, 0]) - 8), "<i8")
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, start: int, count: int) -> bytes:
        self.source.seek(start)
        return self.source.read(count)

    def __len__(self) -> int:
        return len(self.ids)

    def _open(self, k: int, frame: bytes) -> bytes:
        ids = self.zstd.decompress(frame, max_output_size=int(self.full[k])) if self.full[k] else b""
        if len(ids) != self.full[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sum[k]:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def document(self, k: int) -> bytes:
        """The ids of the k-th document; reads and decompresses its frame only."""
        return self._open(k, self._at(int(self.start[k]), int(self.size[k])))

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of all documents with this id."""
        lo, hi = np.searchsorted(self.ids, doc_id), np.searchsorted(self.ids, doc_id, "right")
        return [self.document(k) for k in range(lo, hi)]

    def scan(self, block: int = 8 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, by reads of about `block` bytes."""
        k = 0
        while k < len(self):
            last = max(k + 1, int(np.searchsorted(self.start, self.start[k] + block, "right")) - 1)
            base, raw = int(self.start[k]), self._at(int(self.start[k]), int(self.start[last] - self.start[k]))
            for i in range(k, last):
                at = int(self.start[i]) - base
                own = int(self.ids[i])
                yield None if own == NULL_ID else own, self._open(i, raw[at : at + int(self.size[i])])
            k = last


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, files: int | None = None) -> DataFrame:
    """Write every document's ids below `path`; returns file, n_docs, n_ids per file in order, lazily.

    docs is dealt out by ranges of doc_id; file k holds the k-th range.
    """
    tokenizer = tokenizer or default_path()
    files = files or max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        own, part, attempt = word_tokenizer(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        temp, name, out = f"{base}/.part-{part:06d}-{attempt}", f"part-{part:06d}.ids.zst", None
        end = END.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                for doc_id, ids in zip(rows.column(0).to_pylist(), own.encode_all(rows.column(1).to_pylist())):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        stream = store.open_output_stream(temp)
                        out = Writer(stream)
                    out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            stream.close()
            store.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([f"{path}/{name}"]), pa.array([len(out.ids)]), pa.array([out.n_ids])],
                ["number", "file", "n_docs", "n_ids"],
            )

    # A hash of the text parts the rows of one id, or of none, where they are many.
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return (
        own.repartitionByRange(files, F.asc_nulls_first("doc_id"), "mark")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "mark")
        .select("doc_id", "text")
        .mapInArrow(lean(run, "words"), "number bigint, file string, n_docs bigint, n_ids bigint")
    )


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files named in a manifest.

    The manifest has a row for each file, so the running sum over it is small.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, base = _store(file)
                rows = []
                with store.open_input_file(base) as source:
                    for doc_id, ids in Reader(source).scan():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return (
        placed.select("file", "start", "number")
        .repartition(max(1, manifest.rdd.getNumPartitions()), "number")
        .select("file", "start")
        .mapInArrow(lean(run, "words"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents and read the files back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    manifest = materialise(write(docs, path, tokenizer), "token-manifest")
    return read(manifest)
