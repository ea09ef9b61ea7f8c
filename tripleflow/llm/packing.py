"""Packing token ids of documents into windows of fixed length, with bounded memory.

Each partition holds at most ``open_windows`` windows.  A document goes where it fits with
the least room left; where it fits nowhere, a new window is opened, or, when all are open,
the fullest is topped up with the head of the document and emitted.  What is still open at
the end of a partition is merged with the leftovers of neighbouring partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import id_and_text, per_worker, written
from tripleflow.llm.wordmemo import WordMemo

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)
MERGED_FROM = 1 << 30  # sequences of merged leftovers are numbered as if by partitions from here


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes  # unsigned 32-bit little-endian

    def head(self, n: int) -> Piece:
        return self._replace(ids=self.ids[: 4 * n])

    def rest(self, n: int) -> Piece:
        return self._replace(start=self.start + n, ids=self.ids[4 * n :])


class OpenWindows:
    """The open windows of one partition."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.room: list[tuple[int, int]] = []  # (tokens free, number), sorted
        self.pieces: dict[int, list[Piece]] = {}
        self.opened = 0

    def _put(self, at: int, piece: Piece) -> list[Piece] | None:
        """Into the window at this place of the order; the window, if that fills it."""
        free, number = self.room.pop(at)
        self.pieces[number].append(piece)
        free -= len(piece.ids) // 4
        if free:
            insort(self.room, (free, number))
            return None
        return self.pieces.pop(number)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place one document; yields the windows that are complete."""
        while piece.ids:
            n = len(piece.ids) // 4
            if n >= self.window:
                yield [piece.head(self.window)]
                piece = piece.rest(self.window)
                continue
            at = bisect_left(self.room, (n, -1))
            if at == len(self.room):
                if len(self.room) == self.most:
                    free = self.room[0][0]
                    yield self._put(0, piece.head(free))
                    piece = piece.rest(free)
                    continue
                insort(self.room, (self.window, self.opened))
                self.pieces[self.opened] = []
                self.opened += 1
                at = len(self.room) - 1
            if full := self._put(at, piece):
                yield full
            return

    def left(self) -> list[list[Piece]]:
        return [self.pieces[number] for _, number in self.room]


def concatenated(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Pieces one after the other, cut where a window ends; the last window may be short."""
    now, free = [], window
    for piece in pieces:
        while piece.ids:
            head = piece.head(free)
            now.append(head)
            piece = piece.rest(free)
            free -= len(head.ids) // 4
            if not free:
                yield now
                now, free = [], window
    if now:
        yield now


def _rows(windows: list[list[Piece]], numbers: list[int]) -> list[list]:
    out: list[list] = [[] for _ in range(7)]
    for pieces, number in zip(windows, numbers, strict=True):
        offset = 0
        for p in pieces:
            n = len(p.ids) // 4
            for column, value in zip(out, (p.doc_id, p.start, n, p.doc_tokens, number, offset, p.ids), strict=True):
                column.append(value)
            offset += n
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    open_windows: int = 32,
    merge_partitions: int = 32,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids, each id in one piece.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``offset`` is the
    piece's place in its sequence, without gaps.  Only the last sequence of every
    ``merge_partitions`` partitions can be short.  A null or empty text is its end id alone;
    rows are packed one by one, so repeated rows and null ids are kept as they come.  Packing
    is decided once and written to the shared folder, so no later step sees another packing.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = per_worker(WordMemo, tokenizer, "word")
        part = TaskContext.get().partitionId()
        end, serial = np.array([end_id], memo.type).tobytes(), 0
        state = OpenWindows(window, open_windows)

        def batch_of(windows: list[list[Piece]], is_open: bool) -> pa.RecordBatch:
            nonlocal serial
            numbers = [(part << 32) + serial + k for k in range(len(windows))]
            serial += len(windows)
            columns = [pa.array(c, k) for c, k in zip(_rows(windows, numbers), kinds, strict=True)]
            marks = pa.array([is_open] * len(columns[0]), pa.bool_())
            return pa.record_batch([*columns, marks], [*names, "open"])

        full: list[list[Piece]] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                encoded = memo.ids(some.column(1).to_pylist())
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    wide = np.frombuffer(ids + end, memo.type).astype("<u4").tobytes()
                    full += state.add(Piece(doc_id, 0, len(wide) // 4, wide))
                if full:
                    yield batch_of(full, False)
                full = []
        if rest := state.left():
            yield batch_of(rest, True)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        ids = [None if pd.isna(d) else int(d) for d in rows.doc_id]
        pieces = [Piece(*p) for p in zip(ids, rows.start, rows.doc_tokens, rows.ids, strict=True)]
        windows = list(concatenated(pieces, window))
        first = (MERGED_FROM + int(rows.merged_as.iloc[0])) << 32
        out = _rows(windows, [first + k for k in range(len(windows))])
        return pd.DataFrame(dict(zip(names, out, strict=True)), dtype=object)

    packed = written(
        id_and_text(docs).mapInArrow(pack, PIECES + ", open boolean"), "packing"
    )
    part = F.shiftright("sequence_id", 32)
    leftovers = packed.where("open").withColumn("merged_as", F.floor(part / merge_partitions))
    return (
        packed.where("not open").drop("open")
        .unionByName(leftovers.drop("open").groupBy("merged_as").applyInPandas(merge, PIECES))
    )


def pieces_with_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pack_documents(docs, tokenizer, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
