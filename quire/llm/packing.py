"""Bounded-space online packing of token documents into fixed windows.

Each partition streams its documents once and holds a fixed number of open windows. A piece goes to the window that it fills best. When
it fits none, the fullest window is emitted - after its gap, if worth a cut, takes the head of the piece - and a new window opens. At the
end the leftovers are merged: pieces are laid end to end in windows, and only the last window of a partition is short, padded to a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import raw_texts, small_batches
from quire.llm.subwords import ids_of

#: Pieces that one partition may number: its sequence ids are partition << 40 plus a count.
PARTITION_BITS = 40


class Packer:
    """The open windows of one partition. Pieces are (document, start, ids); windows come out as lists of pieces."""

    def __init__(self, window: int, open_windows: int, least_cut: int):
        self.window, self.most, self.least_cut = window, open_windows, least_cut
        self.open: list[list[tuple]] = []
        self.room: list[int] = []

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Places a document's ids and gives the windows that this completes."""
        start = 0
        while len(ids) - start >= self.window:
            yield [(doc, start, ids[start : start + self.window])]
            start += self.window
        if start < len(ids):
            yield from self._place(doc, start, ids[start:])

    def _place(self, doc: object, start: int, piece: np.ndarray) -> Iterator[list[tuple]]:
        n = len(piece)
        best = min((i for i, r in enumerate(self.room) if r >= n), key=self.room.__getitem__, default=-1)
        if best < 0 and len(self.open) == self.most:
            full = min(range(self.most), key=self.room.__getitem__)
            window, gap = self.open.pop(full), self.room.pop(full)
            if gap >= self.least_cut:
                window.append((doc, start, piece[:gap]))
                start, piece, n = start + gap, piece[gap:], n - gap
            yield window
            best = min((i for i, r in enumerate(self.room) if r >= n), key=self.room.__getitem__, default=-1)
        if best < 0:
            self.open.append([])
            self.room.append(self.window)
            best = len(self.open) - 1
        self.open[best].append((doc, start, piece))
        self.room[best] -= n
        if not self.room[best]:
            self.room.pop(best)
            yield self.open.pop(best)

    def merge(self) -> Iterator[list[tuple]]:
        """The leftovers, fullest first, laid end to end with cuts; all windows but the last are full."""
        window, room = [], self.window
        for k in np.argsort(self.room, kind="stable"):
            for doc, start, piece in self.open[k]:
                while len(piece):
                    head = piece[:room]
                    window.append((doc, start, head))
                    start, piece, room = start + len(head), piece[len(head) :], room - len(head)
                    if not room:
                        yield window
                        window, room = [], self.window
        if window:
            yield window
        self.open, self.room = [], []


def pack(docs: DataFrame, window: int = 2048, open_windows: int = 32, least_cut: int = 32, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids BINARY, doc_tokens, sequence_id, offset, padded): a row for each piece of a document.

    ids holds the piece as little-endian unsigned 32-bit integers. Every document ends with end_id, so a null or empty text is one id.
    Offsets run from 0 in each sequence without gaps; padded is the length that the sequence is padded to. Rows that repeat an id are
    documents of their own. A partition without rows gives none. One pass, no shuffle; a rerun of a task packs its partition alike.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, open_windows, least_cut)
        number = TaskContext.get().partitionId() << PARTITION_BITS
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            total = sum(len(x[2]) for x in pieces)
            padded = window if total > window // 2 else 1 << (total - 1).bit_length()
            offset = 0
            for (doc, tokens), start, ids in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), tokens, number, offset, padded))
                offset += len(ids)
            number += 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = list(zip(*rows, strict=True))
                rows.clear()
                kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded"]
        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids = np.append(ids_of(raw.decode("utf-8", "replace"), folder), np.uint32(end_id)).astype("<u4")
                for pieces in packer.add((doc, len(ids)), ids):
                    close(pieces)
                    if len(rows) >= 2048:
                        yield from out()
        for pieces in packer.merge():
            close(pieces)
        yield from out()

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint")
