"""Best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.tokens import encoded_rows

LENGTH = 2048
OPEN_BINS = 1024
LOOK_AHEAD = 1024  # documents that are read before their pieces are placed
MOST_BYTES = 1 << 24  # ids held for that
END = 0
EMIT = 2000  # pieces per output batch

SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids binary, "
    "sequence_id bigint, offset bigint"
)


class OpenBins:
    """Bounded-space online best fit.

    Bit ``f`` of ``bits`` is set while an open bin has ``f`` free places, so the best bin for a
    piece is the lowest set bit at or above its length. At most ``limit`` bins are open: before one
    more is opened, the fullest is closed.
    """

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.bits = 0
        self.free: dict[int, list[int]] = {}
        self.opened = self.open = 0

    def _take(self, free: int) -> int:
        bins = self.free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``size`` places."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.length, self.opened
            self.opened += 1
            self.open += 1
        left = free - size
        if left:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.length - free


def pieces_of(size: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first takes the remainder."""
    first = size % length
    cuts = [(0, first)] if first else []
    return cuts + [(start, length) for start in range(first, size, length)]


def _looked_ahead(
    docs: Iterator[tuple[int | None, bytes]], length: int
) -> Iterator[list[tuple[int | None, int, int, bytes]]]:
    """(doc_id, piece, start, ids) of some documents at a time, longest pieces first."""
    pieces, held, count = [], 0, 0
    for name, ids in docs:
        for piece, (start, size) in enumerate(pieces_of(len(ids) // 4, length)):
            pieces.append((name, piece, start, ids[4 * start : 4 * (start + size)]))
        held, count = held + len(ids), count + 1
        if count == LOOK_AHEAD or held > MOST_BYTES:
            yield sorted(pieces, key=lambda p: -len(p[3]))
            pieces, held, count = [], 0, 0
    yield sorted(pieces, key=lambda p: -len(p[3]))


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, open_bins: int = OPEN_BINS, end: int = END,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids, sequence_id, offset).

    A document is its ids and ``end``. Only documents longer than ``length`` are cut. Each task
    packs the rows of its partition as they come, ``LOOK_AHEAD`` documents at a time and of these
    the longest pieces first, and keeps ``open_bins`` open sequences. So nothing is shuffled or
    gathered; what is left open at the end costs each partition a few sequences,
    whatever its size. ``ids`` are little-endian unsigned 32-bit. A sequence belongs to one
    partition, so a task that is run again yields its sequences anew.

    Null or empty text is the end id alone. Null ids, ties and repeated rows are packed like any
    row. An empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins, rows = OpenBins(length, open_bins), []
        for pieces in _looked_ahead(encoded_rows(batches, tokenizer, end), length):
            for name, piece, start, part in pieces:
                size = len(part) // 4
                number, offset = bins.place(size)
                rows.append((name, piece, start, size, part, base + number, offset))
                if len(rows) == EMIT:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pack, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "sequence_id", "offset",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids, lengths), pieces in the order of their offset."""
    part = F.struct("offset", "ids", "length")
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate(
        "parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"])
    )
    return grouped.select(
        "sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths")
    )
