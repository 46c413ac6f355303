"""Best-fit-decreasing packing of token sequences.

Documents are encoded and cut into pieces of at most ``ROOM`` ids. Best-fit
decreasing takes the longest piece left and puts it into the open bin with the
least room that holds it. Pieces of one length are alike, so the whole corpus is
packed from the number of pieces of each length: at most ``ROOM`` rows, whatever
the size of the data. Bins alike are handled together, and a segment tree over
the room left finds the tightest in logarithmic time. The plan says, for ranges of
each length's pieces, into which bins they go; pieces then meet the plan.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segeval.llm.tokens import END_ID, encoder
from segeval.scratch import materialize

ROOM = 1024


class RoomTree:
    """Segment tree over the room left in bins: how many groups of bins have it."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self._count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self._count[at] += by
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some group has."""
        at = least + self.size
        if not self._count[at]:
            # Up to the first subtree on the right that holds something, then down its left edge.
            while at > 1 and (at & 1 or not self._count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self._count[2 * at] else 2 * at + 1
        return at - self.size


def plan_bins(counts: dict[int, int], most: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over piece counts by length.

    Returns ranges ``(length, first, past, bin, offset)``: the pieces of that length with
    the ordinals from ``first`` on go to the bins from ``bin`` on, one each, at ``offset``.
    """
    tree = RoomTree(most)
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: first bin, number of bins
    plan = []
    opened = 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # As piece after piece would: each new bin is filled before the next is opened.
                fits = most // length
                size, each = (left // fits, fits) if left >= fits else (1, left)
                start, room = opened, most
                opened += size
            else:
                start, size = groups[room].pop()
                tree.add(room, -1)
                if size > left:
                    groups[room].append((start + left, size - left))
                    tree.add(room, 1)
                    size = left
                each = 1
            for _ in range(each):
                plan.append((length, first, first + size, start, most - room))
                room -= length
                first += size
                left -= size
            if room:
                groups[room].append((start, size))
                tree.add(room, 1)
    return plan


def cut(length: int, most: int = ROOM) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: full ones from the end, the first may be shorter."""
    first = length % most or most
    return [(0, min(first, length)), *((start, most) for start in range(first, length, most))]


def add_pieces(docs: DataFrame, keys: list[str], tokenizer: str, most: int = ROOM) -> DataFrame:
    """One row per piece: ``keys, piece, start, length, ids_crc32``, and ``part, nth``: its task and its number among
    that task's pieces of the same length."""
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("__text"))
    end = END_ID.to_bytes(4, "little")
    names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            source, columns = [], [[] for _ in names]
            for at, ids in enumerate(encode(t.as_py() for t in batch.column("__text"))):
                ids += end
                for number, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    source.append(at)
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for column, value in zip(columns, (number, start, length, crc, part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            given = [batch.column(k).take(pa.array(source, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*given, *map(pa.array, columns, kinds)], [*keys, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(pieces, f"{schema}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, keys: list[str], tokenizer: str, most: int = ROOM) -> DataFrame:
    """``keys, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    # Written once: a piece's number within its task is settled by the file that holds it.
    pieces = materialize(add_pieces(docs, keys, tokenizer, most), "pieces")
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("pieces"))
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("part")) - F.col("pieces")
    parts = materialize(parts.select(F.col("length").alias("__length"), F.col("part").alias("__part"), "pieces", before.alias("before")), "parts")
    counts = {r[0]: r[1] for r in parts.groupBy("__length").agg(F.sum("pieces")).collect()}
    plan = docs.sparkSession.createDataFrame(plan_bins(counts, most), "of long, first long, past long, bin long, at long")
    numbered = pieces.join(parts, (F.col("length") == F.col("__length")) & (F.col("part") == F.col("__part")))
    numbered = numbered.withColumn("ordinal", F.col("before") + F.col("nth"))
    # A row per length and group of bins alike: bounded by ROOM, not by the data.
    within = (F.col("length") == F.col("of")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("past"))
    placed = numbered.join(F.broadcast(plan), within)
    sequence = F.col("bin") + F.col("ordinal") - F.col("first")
    return placed.select(*keys, "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("at").alias("offset"))
