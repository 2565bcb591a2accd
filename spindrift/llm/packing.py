"""Packing of token streams into fixed windows by online Sum-of-Squares bin packing.

Each task packs the documents it reads, in the order it reads them, so nothing is shuffled. A document's
whole windows are cut off first; its remainder goes to the fill level h for which the sum of squares of
N(h), the number of open windows filled to h, becomes least. N is one array of `window` counters. When
`max_open` windows are open, and at the end, open windows are topped up by cutting what the emptiest hold,
which leaves one partly filled window for each task at most and bounds the memory.

Defined cases: a null text counts as empty and is packed as its end id alone; the string of a special token in a
text is that token, as in the tokenizers library; repeated rows are packed each; null ids are carried; an empty table gives no pieces; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices

WINDOW, END_ID = 2048, 1
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by fill level. A piece is (doc, start, ids as bytes); closed windows are lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = 4096):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.closed: list[list] = []

    def level_for(self, size: int) -> int:
        """The fill level whose choice makes the sum of squares least; of equals the fullest, 0 for a new window."""
        n, room = self.count, self.window - size
        levels = np.flatnonzero(n[1 : room + 1]) + 1
        if not len(levels):
            return 0
        # half the change of the sum, less what all choices share: a filled window counts no more
        change = n[levels + size] - n[levels] + 1.0
        if levels[-1] == room:
            change[-1] = 0.5 - n[room]
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= n[size] + 0.5 else 0

    def add(self, doc, ids: bytes) -> None:
        size, start = len(ids) // 4, 0
        while size - start >= self.window:
            self.closed.append([(doc, start, ids[4 * start : 4 * (start + self.window)])])
            start += self.window
        rest = size - start
        if not rest:
            return
        h = self.level_for(rest)
        if h:
            held = self.levels[h].pop()
            self.count[h] -= 1
            self.open -= 1
        else:
            held = []
        held.append((doc, start, ids[4 * start :]))
        self._put(h + rest, held)
        if self.open > self.max_open:
            self.consolidate()

    def _put(self, fill: int, held: list) -> None:
        if fill == self.window:
            self.closed.append(held)
        else:
            self.levels[fill].append(held)
            self.count[fill] += 1
            self.open += 1

    def consolidate(self) -> None:
        """Top up the fullest open windows by cutting the pieces of the emptiest; one stays open at most."""
        pool = [held for level in reversed(self.levels) for held in level]
        self.levels = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.open = 0
        first, last = 0, len(pool) - 1
        while first <= last:
            held = pool[first]
            room = self.window - sum(len(p[2]) for p in held) // 4
            while room and last > first:
                giver = pool[last]
                doc, start, ids = giver.pop()
                size = len(ids) // 4
                taken = min(room, size)
                held.append((doc, start, ids[: 4 * taken]))
                if taken < size:
                    giver.append((doc, start + taken, ids[4 * taken :]))
                room -= taken
                if not giver:
                    last -= 1
            self._put(self.window - room, held)
            first += 1

    def finish(self) -> None:
        self.consolidate()
        self.closed.extend(held for level in self.levels for held in level)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, keep_cache: bool = True) -> DataFrame:
    """One row per piece: document, place in it, checksum, sequence and offset there; with_ids adds the ids as bytes.

    keep_cache=False halves a worker's table of pieces and empties it at the end of each task, for jobs of other work.
    """
    path = tokenizer or tokens.default_path()
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def rows(done: list[list], first: int) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        for k, held in enumerate(done):
            offset = 0
            for (doc, size), start, ids in held:
                n = len(ids) // 4
                for column, x in zip(out, (doc, start, n, zlib.crc32(ids), size, first + k, offset, ids), strict=True):
                    column.append(x)
                offset += n
        arrays = [pa.array(x, pa.int64()) for x in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        yield pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path, tokens.CACHE_PIECES if keep_cache else tokens.CACHE_PIECES // 2), np.array([end_id], "<u4").tobytes()
        packer = SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                ids += end
                packer.add((doc, len(ids) // 4), ids)
                if len(packer.closed) >= 2000:
                    yield from rows(packer.closed, sequence)
                    sequence += len(packer.closed)
                    packer.closed.clear()
        if not keep_cache:
            encoder.forget()
        packer.finish()
        yield from rows(packer.closed, sequence)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)
