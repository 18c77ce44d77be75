"""Harmonic packing of token streams into sequences.

Class k holds pieces of capacity/k ids and fills a bin with exactly k of them.
The capacity is a power of two and only its power-of-two fractions are used as
classes, so a document is cut into whole sequences plus the binary digits of
what remains, and every full bin has no padding.  Each task fills its own bins;
the few bins that are open at the end of a task are split into shorter
sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import slices, tidy

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences that one task can number.
PER_TASK = 1 << 40


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, longest first."""
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(capacity.bit_length() - 1)) if n & 1 << k]


class Bins:
    """Open bins of one task: for each piece length the rows that wait for the bin to be full."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next = capacity, task * PER_TASK
        self.open: dict[int, list[tuple]] = {}

    def put(self, length: int, row: tuple) -> list[tuple]:
        """Adds a piece; returns the rows of its bin if that is full now."""
        own = self.open.setdefault(length, [])
        own.append(row)
        if len(own) * length < self.capacity:
            return []
        del self.open[length]
        return self.close(own, length)

    def close(self, rows: list[tuple], length: int) -> list[tuple]:
        number, self.next = self.next, self.next + 1
        return [(*row, number, k * length) for k, row in enumerate(rows)]

    def rest(self) -> list[tuple]:
        """Closes all bins, in sequences of power-of-two length."""
        out = []
        for length, rows in sorted(self.open.items()):
            while rows:
                n = 1 << (len(rows).bit_length() - 1)
                out += self.close(rows[:n], length)
                rows = rows[n:]
        self.open = {}
        return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; null and empty texts are that id
    alone.  Every id is in one piece, the pieces of a sequence are gapless from
    offset 0, and a sequence has ``capacity`` ids or another power of two, so
    nothing is padded.  Repeated rows are packed as often as they occur.  There
    is no shuffle and a repeated task gives the same numbers.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(byte_bpe.file_bytes(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    last = end_id.to_bytes(4, "little")

    def run(batches):
        bpe = byte_bpe.load(vocabulary, shared.value)
        bins = Bins(capacity, TaskContext.get().partitionId())

        def batch(rows: list[tuple]):
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind_of = None
        for b in slices(batches, 1):
            kind_of, rows = b.column(0).type, []
            texts = (x if x is not None else "" for x in b.column(1).to_pylist())
            for doc, ids in zip(b.column(0).to_pylist(), bpe.encode(texts), strict=True):
                ids += last
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    rows += bins.put(length, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    start += length
            yield batch(rows)
        if kind_of is not None:
            yield batch(bins.rest())
        tidy()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
