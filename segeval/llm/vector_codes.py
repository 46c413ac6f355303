"""Short codes of vectors: each of four parts is replaced by the number of its nearest codebook entry.

Codebooks are learnt by Lloyd's rounds in whole numbers. The nearest entry is found
by slicing and intersecting. For each dimension the entries' coordinates are sorted,
and beside each place stands a bit mask of the entries before it. An initial radius
comes from the nearest of a few probes: no nearest entry lies further away. In each
dimension the coordinates within the radius are one range of the sorted ones, and the
masks at its ends give the entries in it; the masks of all dimensions are ANDed as
64-bit words. What is left holds every nearest entry, ties included, and distances
are computed for those alone.

Sums of a round are taken within each task, then per entry and position; codebooks,
``ENTRIES`` vectors whatever the number of rows, go through the driver.

Edge cases: vectors that are null or hold a null, a NaN or an infinite component are
left out. A vector shorter than the longest, and a length that four does not divide, count
as filled up with zeros. With fewer rows than entries there are fewer entries. Rows without
``vec_id`` come last, rows of equal ``vec_id`` in the order of their vectors. An empty table
gives an empty result. Numbers beyond 64 bits are computed exactly; an error that does
not fit a long, or a component of 1e34 and more, raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import finite
from segeval.scratch import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
PROBES = 16

#: Components up to this size keep squared distances of long vectors within 64 bits.
SMALL = 1 << 24
LARGEST = 10**34

#: Pairs of vectors and entries that are compared at a time.
PAIRS = 1 << 18


def scaled_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, v``: whole components as doubles, which hold them exactly, all vectors of one length."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & F.forall(x, finite)
    # Beyond 2^52 a double is whole already, and `floor` would not hold it.
    v = F.transform(x, lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale))
    kept = vectors.where(whole).select("vec_id", "label", v.alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    length = -(-longest // parts) * parts
    filled = F.concat("v", F.array_repeat(F.lit(0.0), length - F.size("v")))
    return kept.select("vec_id", "label", F.when(F.size("v") < length, filled).otherwise(F.col("v")).alias("v"))


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers if their squares fit, else as Python integers."""
    most = np.abs(values).max(initial=0.0)
    if most < SMALL:
        return values.astype(np.int64)
    if most >= LARGEST:
        raise ValueError("a component is too large")
    out = np.empty(values.shape, dtype=object)
    out.reshape(-1)[:] = [int(x) for x in values.reshape(-1).tolist()]
    return out


def _root(squares: np.ndarray) -> np.ndarray:
    """A whole number that is no smaller than the root, by a little more than one at most."""
    if squares.dtype == object:
        out = np.empty(squares.shape, dtype=object)
        out[:] = [math.isqrt(s) + 1 for s in squares.tolist()]
        return out
    return np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1


class Slices:
    """One part's codebook: sorted coordinates, each with the mask of the entries before it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        count, width = entries.shape
        self.order = np.sort(entries, axis=0)
        self.masks = np.zeros((width, count + 1, -(-count // 64)), dtype=np.uint64)
        for d in range(width):
            seen = np.zeros(self.masks.shape[2], dtype=np.uint64)
            for place, entry in enumerate(np.argsort(entries[:, d], kind="stable").tolist()):
                seen[entry // 64] |= np.uint64(1) << np.uint64(entry % 64)
                self.masks[d, place + 1] = seen
        self.probes = entries[:: max(1, count // PROBES)]

    def candidates(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A row of bits per vector: the entries whose every coordinate is within the radius."""
        count, width = self.entries.shape
        found = np.broadcast_to(self.masks[0, -1] if width else _all_bits(count), (len(rows), -(-count // 64))).copy()
        for d in range(width):
            low = np.searchsorted(self.order[:, d], rows[:, d] - radius, "left")
            high = np.searchsorted(self.order[:, d], rows[:, d] + radius, "right")
            found &= self.masks[d][high] & ~self.masks[d][low]
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        return bits[:, :count]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each vector, the lowest if several are, and the squared distance."""
        if rows.dtype != self.entries.dtype:
            return Slices(self.entries.astype(object)).nearest(rows.astype(object))
        codes, squares = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=rows.dtype)]
        for begin in range(0, len(rows), max(1, PAIRS // len(self.entries))):
            some = rows[begin : begin + max(1, PAIRS // len(self.entries))]
            known = ((some[:, None, :] - self.probes[None]) ** 2).sum(axis=2).min(axis=1)
            row, entry = np.nonzero(self.candidates(some, _root(known)))
            square = ((some[row] - self.entries[entry]) ** 2).sum(axis=1)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(square, starts)
            hits = np.flatnonzero(square == np.repeat(least, np.diff(starts, append=len(row))))
            first = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
            codes.append(entry[first])
            squares.append(least)
        return np.concatenate(codes), np.concatenate(squares)


def _all_bits(count: int) -> np.ndarray:
    bits = np.zeros(-(-count // 64) * 64, dtype=np.uint8)
    bits[:count] = 1
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return _integers(values.reshape(batch.num_rows, width))


def _parts(rows: np.ndarray, books: list[Slices]) -> list[np.ndarray]:
    return np.split(rows, len(books), axis=1) if rows.shape[1] else [rows] * len(books)


def _first_books(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    listed = first.column("v").to_pylist()
    values = np.array(listed, dtype=np.float64).reshape(len(listed), len(listed[0]) if listed else 0)
    return _parts(_integers(values), [None] * parts)


def _improved(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the rounded-down mean of the parts nearest to it."""
    width = sum(b.shape[1] for b in books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            rows = _rows(batch, width)
            for part, (some, one) in enumerate(zip(_parts(rows, slices), slices)):
                codes, _ = one.nearest(some)
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                # Python integers hold sums of any number of rows.
                sums = np.add.reduceat(some[order], starts, axis=0) if len(used) else some[:0]
                for code, count, total in zip(used.tolist(), np.diff(starts, append=len(order)).tolist(), sums.tolist()):
                    held = totals.setdefault((part, code), [0, [0] * len(total)])
                    held[0] += count
                    held[1] = [a + b for a, b in zip(held[1], total)]
        keys = list(totals)
        table = {
            "part": pa.array([k[0] for k in keys], pa.int32()),
            "entry": pa.array([k[1] for k in keys], pa.int32()),
            "members": pa.array([totals[k][0] for k in keys], pa.int64()),
            "sums": pa.array([[Decimal(x) for x in totals[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0))),
        }
        yield pa.RecordBatch.from_pydict(table)

    tasks = kept.select("v").mapInArrow(summed, "part int, entry int, members long, sums array<decimal(38,0)>")
    each = tasks.select("part", "entry", "members", F.posexplode("sums").alias("position", "value"))
    means = each.groupBy("part", "entry", "position").agg(F.sum("members").alias("members"), F.sum("value").alias("value"))
    out = [b.astype(object) for b in books]
    for row in means.collect():
        out[row["part"]][row["entry"], row["position"]] = int(row["value"]) // row["members"]
    return [b.astype(np.int64) if np.abs(b).max(initial=0) < SMALL else b for b in out]


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook for each part, after Lloyd's rounds over all of ``scaled_vectors``."""
    books = _first_books(kept, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = _improved(kept, books)
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def assigned(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error``: numbers of the nearest entries, two hex digits each, and the sum of their squared distances."""
    width = sum(b.shape[1] for b in books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            found = [one.nearest(some) for some, one in zip(_parts(_rows(batch, width), slices), slices)]
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*[codes.tolist() for codes, _ in found])]
            errors = [sum(row) for row in zip(*[squares.tolist() for _, squares in found])]
            if max(errors, default=0) >= 1 << 63:
                raise ValueError("a vector's error does not fit a long")
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    schema = kept.drop("v").schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(encode, schema)


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``. Codebooks are learnt when this is called."""
    kept = materialize(scaled_vectors(vectors, parts=parts), "vectors")
    books = codebooks(kept, parts, entries, rounds)
    coded = materialize(assigned(kept, books), "codes")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
