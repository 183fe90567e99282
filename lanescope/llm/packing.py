"""Sum-of-squares online packing of token ids into windows of fixed length.

Each task packs its own documents as they come. A document's full windows leave at once; what is over goes to the
fill level that makes the sum of squared counts of partially filled windows least, by one look at the level array (the
count of open windows at each level), so items fill complementary gaps without looking ahead. When the task's
documents end, or more than `max_open` windows are open, what the open windows hold is cut anew at window ends, which
leaves one partially filled window. Texts are not shuffled; sequence ids carry the task's number in their upper half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches
from .textbytes import slices
from .tokens import encoder, vocabulary

WINDOW, END, MAX_OPEN = 2048, 1, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """add() and finish() yield pieces (doc, start, ids, doc_tokens, sequence, offset) of windows that are done."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.made, self.open = window, max_open, 0, 0
        self.count = np.zeros(window + 1, np.int64)  # the level array; nothing is ever open at 0 or `window`
        self.at: list[list[list]] = [[] for _ in range(window + 1)]  # open windows by level: lists of pieces

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose choice makes the sum of squares least; the fullest of equals."""
        room = self.window - size
        here, there = self.count[1 : room + 1], self.count[1 + size : self.window + 1]
        change = 2 * (there - here) + 2
        if room:
            change[-1] -= 1  # a window that becomes full no longer counts
        new = 2 * int(self.count[size]) + 1
        change = np.where(here > 0, change, new + 1)
        if room and (least := int(change.min())) <= new:
            return room - int(np.argmax(change[::-1] == least))
        return 0

    def _done(self, pieces: list) -> Iterator[tuple]:
        at, number = 0, self.made
        self.made += 1
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, number, at
            at += len(ids)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, full = len(ids), len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            yield from self._done([(doc, a, ids[a : a + self.window], total)])
        if size := total - full:
            level = self.level_for(size)
            pieces = self.at[level].pop() if level else []
            self.count[level] -= level > 0
            self.open += not level
            pieces.append((doc, full, ids[full:].copy(), total))
            if level + size == self.window:
                self.open -= 1
                yield from self._done(pieces)
            else:
                self.at[level + size].append(pieces)
                self.count[level + size] += 1
            if self.open > self.max_open:
                yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        """Cuts what is open anew; full windows first, then the one that is not."""
        pieces: list = []
        used = 0
        for level in range(self.window, 0, -1):
            for group in self.at[level]:
                for doc, start, ids, total in group:
                    while len(ids):
                        part = ids[: self.window - used]
                        pieces.append((doc, start, part, total))
                        start, ids, used = start + len(part), ids[len(part) :], used + len(part)
                        if used == self.window:
                            yield from self._done(pieces)
                            pieces, used = [], 0
            self.at[level] = []
        self.count[:], self.open = 0, 0
        if pieces:
            yield from self._done(pieces)


def packed(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = END, window: int = WINDOW, max_open: int = MAX_OPEN, spaces_matter: bool = False, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece (PIECES, and ids array<int> if with_ids). Every id of every row lies in exactly one piece.

    Null texts are empty: their end id alone. Rows that repeat a doc_id are documents of their own. An empty table
    gives no pieces. Other columns are ignored.
    """
    vocab = vocabulary_path or vocabulary("word_bpe_49k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocab, spaces_matter), Packer(window, max_open)
        first = TaskContext.get().partitionId() << 32

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = [[f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found], [zlib.crc32(f[2].astype("<u4").tobytes()) for f in found], [f[3] for f in found], [first + f[4] for f in found], [f[5] for f in found]]
            out = [pa.array(c, pa.int64()) for c in cols] + ([pa.array([f[2].tolist() for f in found], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            for part in slices(batch, 1, 400_000):
                found: list[tuple] = []
                ids, n = enc.encode(part.column(1))
                for name, own in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    found += packer.add(name, np.append(own, np.uint32(end_id)))
                if found:
                    yield rows(found)
        if found := list(packer.finish()):
            yield rows(found)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return modest_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(pack, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
