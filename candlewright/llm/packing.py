"""Operator 3: bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows.  A document's pieces (whole windows first,
then the rest) are placed best-fit: into the open window with the least room that still holds
them.  Where none does and no window is free, the fullest window is topped up with the head of
the piece, so that it closes without padding, and is emitted; the tail is placed again.  When a
partition ends, its open windows are leftovers.  Leftovers of many partitions meet in a few merge
tasks, which pack them again by the same rule; what remains open there is cut at powers of two,
lengths that need no padding.  Every id lies in exactly one piece.

Memory of a task: the open windows and one batch.  A merge task reads at most ``MERGED``
partitions' open windows, whatever the size of the input.

Cases: null and empty texts are the end id alone; very long texts are cut; an empty table gives
no rows; repeated rows are packed once each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import batch, keyed, rows_of, Scratch
from candlewright.llm.encoding import encoder

MERGED = 64
_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
_PIECES = pa.schema(_COLUMNS)
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Packer:
    """The open windows of one task."""

    def __init__(self, size: int, windows: int, first_id: int, part: int, with_ids: bool):
        self.size, self.windows, self.next_id, self.part, self.with_ids = size, windows, first_id, part, with_ids
        self.open: list[list] = []  # [ids used, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], left: bool = False) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            keep = ids.tobytes() if left or self.with_ids else None
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, None if left else self.next_id, offset, self.part, keep))
            offset += len(ids)
        self.next_id += not left

    def add(self, doc_id: int, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self._emit([(doc_id, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.size]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(window := [0, []])
            else:
                window = max(self.open, key=lambda w: w[0])
            take = min(len(ids), self.size - window[0])
            window[1].append((doc_id, start, total, ids[:take]))
            window[0] += take
            start, ids = start + take, ids[take:]
            if window[0] == self.size:
                self.open.remove(window)
                self._emit(window[1])

    def leave(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, left=True)
        self.open = []

    def finish(self) -> None:
        """Cut what is open at powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        self.open = []
        left = sum(len(p[3]) for p in pieces)
        while left:
            room = min(self.size, 1 << left.bit_length() - 1)
            left -= room
            inside = []
            while room:
                doc_id, start, total, ids = pieces[0]
                inside.append((doc_id, start, total, ids[:room]))
                if len(ids) > room:
                    pieces[0] = (doc_id, start + room, total, ids[room:])
                else:
                    pieces.pop(0)
                room -= len(inside[-1][3])
            self._emit(inside)

    def taken(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        return batch(_PIECES, *(list(c) for c in zip(*rows, strict=True))) if rows else None


def _base(part: int) -> int:
    """Ids of sequences by the task that makes them; merge tasks lie beyond all others."""
    return part << 32


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "byte", size: int = 2048, windows: int = 32, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    where asked for, the ids themselves as little-endian integers of the tokenizer's width."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op3")
    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        part = TaskContext.get().partitionId()
        packer = Packer(size, windows, _base(part), part, with_ids)
        for piece in rows_of(batches):
            for doc_id, ids in zip(piece.column(0).to_pylist(), encode.encode(piece.column(1).to_pylist()), strict=True):
                packer.add(doc_id, 0, len(ids) + 1, np.append(ids, encode.dtype.type(end_id)))
            if (out := packer.taken()) is not None:
                yield out
        packer.leave()
        if (out := packer.taken()) is not None:
            yield out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        packer = Packer(size, windows, _base((1 << 30) + number), number, with_ids)
        for piece in rows_of(batches, rows=256):
            for doc_id, start, n, total, ids in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True):
                packer.add(doc_id, start, total, np.frombuffer(ids, f"<u{len(ids) // n}"))
            if (out := packer.taken()) is not None:
                yield out
        packer.finish()
        if (out := packer.taken()) is not None:
            yield out

    placed = scratch.save(keyed(docs).mapInArrow(online, PIECES_SCHEMA), "placed")
    left = placed.where("sequence_id IS NULL")
    parts = left.agg(F.max("part")).first()[0]
    groups = (parts or 0) // MERGED + 1
    left = left.repartition(groups, F.floor(F.col("part") / MERGED)).sortWithinPartitions("part", "doc_id", "start")
    merged = scratch.save(left.mapInArrow(merge, PIECES_SCHEMA), "merged")
    out = placed.where("sequence_id IS NOT NULL").unionByName(merged).drop("part")
    return out if with_ids else out.drop("ids")
