"""Best-fit packing of token pieces into fixed-length sequences.

Documents longer than a sequence are cut; every whole sequence is a bin of its
own. The rest is packed hierarchically: each partition packs its items by
best fit, largest first, and emits the bins that are nearly full; the underfull
bins go on as items of the next round, where fewer tasks merge the rest of
several partitions, and so on to the top of the tree. A bin carries its
members, so the rounds need no join. Work of a task is bounded: a round has as
many tasks as keep each below ITEMS bins.

Defined results: a null or empty text is one piece of the end id alone;
repeated rows are packed each; equal lengths are packed in order of their ids;
null ids come first; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialise
from tidemark.llm.tokens import default_path, word_tokenizer

LENGTH = 2048
END = 0
#: Bins with at most this many free places are emitted before the last round.
NEARLY = 4
#: Partitions that a task of the next round merges.
FAN_IN = 8
#: Rounds at the same number of tasks end when this share of bins is left open.
LEAST_GAIN = 0.995
#: Open bins that a task takes at most.
ITEMS = 100_000

_MEMBER = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
)
_SCHEMA = (
    "bin bigint, fill int, closed boolean, "
    "members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
)


def best_fit(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers; items in the given order, each to the bin that it fits best.

    The free places of open bins are bits of one number, so the best fit is a
    shift and a lowest bit. Among equal bins the last one opened is taken.
    """
    bins: list[list[int]] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i, size in enumerate(sizes):
        fits = free >> size
        if size <= capacity and fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by[room].pop()
            if not open_by[room]:
                free &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        left = room - size
        if left > 0:
            open_by[left].append(b)
            free |= 1 << left
    return bins


#: Columns of pieces: doc_id and whether it is null, piece, start, length, ids_crc32.
_COLUMNS = (np.int64, np.bool_, np.int32, np.int64, np.int64, np.int64)
Pieces = tuple[np.ndarray, ...]


def cut(doc_id: int | None, ids: bytes) -> list[tuple]:
    """(doc_id, whether it is null, piece, start, length, ids_crc32) of a document's ids, given as bytes."""
    out = []
    for piece, at in enumerate(range(0, len(ids), 4 * LENGTH)):
        part = ids[at : at + 4 * LENGTH]
        out.append((doc_id or 0, doc_id is None, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    return out


def columns(rows: list[tuple]) -> Pieces:
    return tuple(np.array(c, t) for c, t in zip(zip(*rows), _COLUMNS)) if rows else tuple(np.zeros(0, t) for t in _COLUMNS)


def _pack(members: Pieces, ends: np.ndarray, first_bin: int, last: bool) -> pa.RecordBatch:
    """A batch of bins from items; item k is the pieces up to ends[k], which stay together."""
    doc, null, piece, start, length, crc = members
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = np.add.reduceat(length, begins) if len(ends) else np.zeros(0, np.int64)
    # Largest first; equal ones by the id, null first, and piece of their first member.
    order = np.lexsort((crc[begins], piece[begins], doc[begins], ~null[begins], -size))
    packed = best_fit(size[order].tolist())
    taken = order[np.fromiter((i for b in packed for i in b), np.int64, len(order))]
    many = (ends - begins)[taken]
    flat = np.repeat(begins[taken] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(taken) else begins
    item_cuts = np.cumsum([0, *map(len, packed)])
    offsets = np.concatenate([[0], np.cumsum(many)])[item_cuts].astype(np.int32)
    fill = np.add.reduceat(length[flat], offsets[:-1]) if len(packed) else size
    # Gapless places: the running length, from 0 at the first member of each bin.
    before = np.cumsum(length[flat]) - length[flat]
    place = before - np.repeat(before[offsets[:-1]], np.diff(offsets)) if len(packed) else before
    ids = pa.array(doc[flat], mask=null[flat])
    values = pa.StructArray.from_arrays(
        [ids, *[pa.array(c[flat]) for c in (piece, start, length, crc)], pa.array(place)], fields=list(_MEMBER)
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first_bin, first_bin + len(packed))),
            pa.array(fill.astype(np.int32)),
            pa.array((fill >= LENGTH - NEARLY) | last),
            pa.ListArray.from_arrays(pa.array(offsets), values),
        ],
        ["bin", "fill", "closed", "members"],
    )


def _chunks(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def pieces_to_bins(docs: DataFrame, path: str) -> DataFrame:
    """Round 0: tokens, pieces and best fit inside each partition of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(path)
        first, held, n = (TaskContext.get().partitionId() << 32), [], 0
        for batch in batches:
            for part in _chunks(batch, 512):
                whole, rest = [], []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode_all(part.column(1).to_pylist())):
                    for piece in cut(doc_id, ids + END.to_bytes(4, "little")):
                        (whole if piece[4] == LENGTH else rest).append(piece)
                if whole:
                    yield (out := _pack(columns(whole), np.arange(1, len(whole) + 1), first, False))
                    first += out.num_rows
                held.append(columns(rest))
                n += len(rest)
                if n >= 4 * ITEMS:
                    yield from _chunks(out := _pack(_joined(held), np.arange(1, n + 1), first, False))
                    first, held, n = first + out.num_rows, [], 0
        if n:
            yield from _chunks(_pack(_joined(held), np.arange(1, n + 1), first, False))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(run, "words"), _SCHEMA)


def _joined(parts: list[Pieces]) -> Pieces:
    return tuple(np.concatenate(c) for c in zip(*parts))


def merge_round(bins: DataFrame, tasks: int, number: int, last: bool) -> DataFrame:
    """Open bins as items of best fit, in `tasks` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, many = (number << 56) | (TaskContext.get().partitionId() << 32), [], []
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ids = flat.field(0)
            held.append(
                (
                    ids.fill_null(0).to_numpy(zero_copy_only=False),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    *[flat.field(k).to_numpy(zero_copy_only=False) for k in range(1, 5)],
                )
            )
            many.append(lists.value_lengths().to_numpy(zero_copy_only=False))
        if held and sum(map(len, many)):
            yield from _chunks(_pack(_joined(held), np.cumsum(np.concatenate(many)), first, last))

    # By a hash of the bin's number, which is unique: even, and the same again if a task is lost.
    return bins.select("members", "bin").repartition(tasks, F.xxhash64("bin")).select("members").mapInArrow(lean(run, "words"), _SCHEMA)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    path = path or default_path()
    level = materialise(pieces_to_bins(docs, path), "packing-0")
    done = [level.filter("closed")]
    left = level.filter("not closed")
    tasks, number = level.rdd.getNumPartitions(), 0
    n = left.count()
    while n:
        number += 1
        before, tasks = tasks, max(1, -(-tasks // FAN_IN), -(-n // ITEMS))
        level = materialise(merge_round(left, tasks, number, False), f"packing-{number}")
        after = level.filter("not closed").count()
        # The top of the tree; with more open bins than one task takes, when a round of newly dealt bins closes no more.
        if tasks == 1 or (tasks >= before and after >= LEAST_GAIN * n):
            done.append(level)
            break
        done.append(level.filter("closed"))
        left, n = level.filter("not closed"), after
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"
    )
