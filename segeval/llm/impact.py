"""Exact top-k inner products with an impact-ordered index, processed a score at a time.

Vectors of whole numbers are dealt into blocks. A block's index quantises every
component to a level of equal width and holds, for each dimension, its rows in the
order of their levels: one posting segment per level. On a query, a segment's
impact is the query's component times the level, counted from the dimension's
worst level for this query (components may be negative, so a query meets a
dimension from one end or the other). Segments are processed by descending impact
over all dimensions; rows add up what their segments are sure to give. What a row
may gain beyond that is bounded by the width of a level in each dimension and by
the highest segment of each dimension that is still open. Processing stops only
when that proves that all but a few rows cannot be members, or when all is
processed; the rows left are scored exactly.

Edge cases: vectors that are null, or hold null or non-finite components, take no
part, and neither do rows without ``vec_id``, which no result could name. Vectors with a
component beyond ``LIMIT`` lie in blocks of their own and are scored one by one in integers
of any length, as are queries with such a component; a score among the best that does not
fit a long raises ValueError. Vectors of different lengths do not meet. An empty vector
scores 0. Equal scores go to the smaller ``vec_id``; rows of equal ``vec_id`` and vector are
told apart by nothing and both count. Query rows of equal id are one query, with the
best scores of any of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segeval.functions.expr import finite
from segeval.scratch import materialize

SCALE = 1024
K = 10

#: Largest magnitude of a component after scaling that the index takes.
LIMIT = 1 << 28

#: Components of one block of the index, about, and queries that meet a block together.
BLOCK_VALUES = 8192 * 64
QUERY_ROWS = 512

#: Levels that the range of components of a block is cut into.
LEVELS = 64

#: Times that a search looks whether it may stop.
STOPS = 4


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dims``: components times ``SCALE``, rounded down, of the vectors that take part, as doubles, which hold them exactly."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.isnotnull("vec_id") & F.isnotnull("x")).where(F.forall("x", finite))
    # Beyond 2^52 a double is whole already, and `floor` would not hold it.
    v = F.transform("x", lambda x: F.when(F.abs(x * SCALE) < float(1 << 52), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return rows.select("vec_id", v.alias("v"), F.size("x").alias("dims"))


def _wide(values: np.ndarray) -> bool:
    return bool(np.abs(values).max(initial=0.0) > LIMIT)


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    out = np.empty(values.shape, dtype=object)
    out.reshape(-1)[:] = [int(x) for x in values.reshape(-1).tolist()]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class BlockIndex:
    """Postings of a block of rows: by dimension, places of rows by ascending level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows.astype(np.int64)
        self.floor = rows.min(axis=0).astype(np.int64)
        self.width = max(1, -(-int((rows.max(axis=0) - self.floor).max(initial=0) + 1) // LEVELS))
        levels = (rows - self.floor) // self.width
        places = np.argsort(levels, axis=0, kind="stable")
        self.places = np.ascontiguousarray(places.T)
        self.levels = np.ascontiguousarray(np.take_along_axis(levels, places, axis=0).T)
        # Where each dimension's segments begin; the last entry is the end.
        self.begins = np.stack([np.searchsorted(of, np.arange(LEVELS + 1)) for of in self.levels]).reshape(-1, LEVELS + 1)

    def pack(self) -> bytes:
        small = (self.rows.astype("<i4"), self.places.astype("<i4"), self.levels.astype("u1"))
        return pickle.dumps((self.ids, self.floor, self.width, self.begins, *small))

    @classmethod
    def unpack(cls, held: bytes) -> BlockIndex:
        self = cls.__new__(cls)
        self.ids, self.floor, self.width, self.begins, rows, places, levels = pickle.loads(held)
        self.rows, self.places, self.levels = (x.astype(np.int64) for x in (rows, places, levels))
        return self

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all rows that may be among the ``k`` best but the query's own id."""
        q = query.astype(np.float64)
        up = q >= 0
        top = self.floor + self.width * LEVELS - 1
        weight = np.abs(q) * self.width
        score = np.full(len(self.ids), np.where(up, q * self.floor, q * top).sum())
        inside = (np.abs(q) * (self.width - 1)).sum()
        others = np.flatnonzero(self.ids != own)
        # Impacts of all segments above the worst one; equal steps by their number are near-equal steps of work.
        impacts = np.sort(np.outer(weight, np.arange(1, LEVELS)), axis=None)[::-1]
        least = [impacts[min(len(impacts), (i + 1) * len(impacts) // STOPS) - 1] for i in range(STOPS)] if len(impacts) else []
        open_rank = np.full(len(q), LEVELS - 1)  # the highest rank of each dimension that is not processed yet
        candidates = others
        for bar in least:
            rank = np.maximum(np.ceil(np.divide(bar, weight, out=np.full(len(q), float(LEVELS)), where=weight > 0)), 1)
            rank = np.minimum(rank.astype(np.int64), open_rank + 1)
            for d in np.flatnonzero(rank <= open_rank).tolist():
                low, high = rank[d], open_rank[d]
                if up[d]:
                    a, b = self.begins[d, low], self.begins[d, high + 1]
                    ranks = self.levels[d, a:b]
                else:
                    a, b = self.begins[d, LEVELS - 1 - high], self.begins[d, LEVELS - low]
                    ranks = LEVELS - 1 - self.levels[d, a:b]
                score[self.places[d, a:b]] += weight[d] * ranks
            open_rank = rank - 1
            if len(others) > k:
                reached = score[others]
                # Doubles round sums of very large products; a proof allows for that.
                rounding = 1e-12 * (weight.sum() * LEVELS + np.abs(q * self.floor).sum())
                proven = np.partition(reached, len(others) - k)[len(others) - k]
                candidates = others[reached + inside + (weight * open_rank).sum() >= proven - rounding]
            if len(candidates) <= 4 * k:
                break
        return candidates, self.rows[candidates] @ query.astype(np.int64)


class WideBlock:
    """Rows that the index cannot take: all are candidates, and scores are exact integers of any length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, _exact(rows)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        others = np.flatnonzero(self.ids != own)
        return others, self.rows[others].dot(_exact(query)) if len(query) else np.zeros(len(others), dtype=np.int64)


def _unpacked(held: bytes) -> BlockIndex | WideBlock:
    return WideBlock(*pickle.loads(held[1:])) if held[:1] == b"w" else BlockIndex.unpack(held[1:])


def _packed(block: pa.Table) -> pa.Table:
    dims = block.column("dims")[0].as_py()
    ids = block.column("vec_id").to_numpy()
    by_id = np.argsort(ids, kind="stable")
    rows = _matrix(block.column("v"), dims)[by_id]
    held = b"w" + pickle.dumps((ids[by_id], rows)) if _wide(rows) else b"i" + BlockIndex(ids[by_id], rows.astype(np.int64)).pack()
    number = block.column("block")[0].as_py()
    return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([number], pa.int32()), "index": pa.array([held], pa.binary())})


def build_index(whole: DataFrame) -> DataFrame:
    """One row per block: ``dims, block, index``. Every vector is in one block.

    ``whole`` is a written table of ``whole_vectors`` with a number ``lot`` for each row, which keeps
    rows of one id apart.
    """
    values = whole.agg(F.sum("dims")).first()[0] or 0
    blocks = max(1, -(-values // BLOCK_VALUES))
    wide = F.exists("v", lambda x: F.abs(x) > float(LIMIT))
    block = F.pmod(F.xxhash64("vec_id", "lot"), F.lit(blocks)).cast("int")
    dealt = whole.select("vec_id", "v", "dims", F.when(wide, -1 - block).otherwise(block).alias("block"))
    packed = dealt.groupBy("dims", "block").applyInArrow(_packed, "dims int, block int, index binary")
    return materialize(packed, "index")


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    for batch in batches:
        out: list[list] = [[], [], []]
        for row in range(batch.num_rows):
            dims, block, index, query_ids, queries = (batch.column(i)[row].as_py() for i in range(5))
            if held is None or held[0] != (dims, block):
                held = ((dims, block), _unpacked(index))
            for query_id, query in zip(query_ids, np.array(queries, dtype=np.float64).reshape(len(query_ids), dims)):
                of = WideBlock(held[1].ids, held[1].rows) if _wide(query) else held[1]
                found, scores = of.search(query, query_id, k)
                if scores.dtype == object:
                    best = np.array(sorted(range(len(found)), key=lambda i: (-scores[i], of.ids[found[i]]))[:k], dtype=np.int64)
                    if any(not -(1 << 63) <= s < 1 << 63 for s in scores[best].tolist()):
                        raise ValueError("a score does not fit a long")
                else:
                    best = np.lexsort((held[1].ids[found], -scores))[:k]
                out[0] += [query_id] * len(best)
                out[1] += held[1].ids[found[best]].tolist()
                out[2] += scores[best].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors for each query but its own id.

    Both tables have ``vec_id`` and ``embedding``. Queries meet blocks of the index in groups, so
    what moves is each query group once per block; each meeting returns ``k`` rows per query.
    """
    whole = materialize(whole_vectors(vectors).withColumn("lot", F.monotonically_increasing_id()), "vectors")
    asked = materialize(whole_vectors(queries), "queries")
    index = build_index(whole)
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    # Rows of equal id ask the same question only if their vectors are equal.
    grouped = asked.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)))
    grouped = grouped.groupBy("dims", "part").agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("queries"))
    blocks = index.select("dims", "block").groupBy("dims").agg(F.collect_list("block").alias("blocks"))
    meetings = grouped.join(blocks, "dims").select("dims", F.explode("blocks").alias("block"), "query_ids", "queries")
    pairs = index.join(meetings, ["dims", "block"]).select("dims", "block", "index", "query_ids", "queries")
    # A search costs far more than moving a block, so meetings are spread.
    pairs = pairs.repartition("dims", "block", F.get("query_ids", F.lit(0)))
    found = pairs.mapInArrow(lambda batches: _searched(batches, k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
