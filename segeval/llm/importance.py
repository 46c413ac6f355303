"""Importance resampling towards a target distribution of hashed n-grams.

Every run of one to three words is a feature, and a feature's bucket is its CRC-32
modulo ``BUCKETS``. A bucket's gain is the logarithm of how much likelier the target
has it than the source. A document's weight is the sum of gains over its features,
and weight plus Gumbel noise is its score: the highest scores are a sample without
replacement.

The CRC of a run follows from those of its words: appending ``n`` bytes to a text is a
linear map of its CRC. So distinct words are hashed once per task, and runs are
combined in whole arrays.

Ranks are exact, by parallel sorting by regular sampling: each partition of scored
rows is sorted and written as a run; every run gives samples at regular places, from a
start of its own; regular places among the sorted samples are the splitters; rows are
exchanged by splitter and merged, each segment on its own; counts of the segments
before it give the first rank of a segment. Segments wholly behind the last drawn
rank are not exchanged.

Edge cases: a null or empty text has no feature and weight 0. A null ``doc_id`` has the
noise of an empty one and comes last among equal scores. Rows of equal score and
``doc_id`` are ranked in the order of their runs, which are written. An empty table
gives an empty result; against an empty target all gains come from smoothing.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segeval.scratch import materialize

BUCKETS = 10_000
ORDERS = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42

#: Regular samples of all runs together, and segments between splitters; both bound what the driver holds.
SAMPLES = 1 << 16
SEGMENT_ROWS = 1 << 20
MIN_SEGMENTS, MAX_SEGMENTS = 512, 4096

#: Words that a task keeps, and words that are combined at a time.
KEPT_WORDS = 500_000
CHUNK_WORDS = 1 << 18

_SPACE = [b for b in range(128) if not chr(b).isalnum()]
_FOLD = bytes.maketrans(bytes([*range(65, 91), *_SPACE]), bytes([*range(97, 123), *[32] * len(_SPACE)]))


def words(text: str) -> list[bytes]:
    """Words as UTF-8: ASCII letters in lower case, digits, and all characters beyond ASCII."""
    return text.encode().translate(_FOLD).split()


class _Words(dict):
    """Number of each distinct word; ``new`` are those met since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class FeatureHasher:
    """CRC-32 of all runs of one to three words, from those of the words."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._words = _Words()
        self._alone = np.zeros(0, dtype=np.uint32)
        self._after = np.zeros(0, dtype=np.uint32)
        self._shift = np.zeros(0, dtype=np.int64)
        self._lengths: dict[int, int] = {}
        self._tables = np.zeros((0, 4, 256), dtype=np.uint32)

    @staticmethod
    def _table(length: int) -> np.ndarray:
        """What ``length`` more zero bytes make of a CRC, byte by byte of the CRC."""
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        value = np.arange(256)
        table = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            image = np.uint32(zlib.crc32(zeros, 1 << bit) ^ none)
            table[bit // 8] ^= np.where(value >> (bit % 8) & 1, image, np.uint32(0))
        return table

    def _learn(self) -> None:
        new = self._words.new
        lengths = [len(w) + 1 for w in new]
        tables = []
        for length in lengths:
            if length not in self._lengths:
                self._lengths[length] = len(self._lengths)
                tables.append(self._table(length))
        if tables:
            self._tables = np.concatenate([self._tables, np.stack(tables)])
        crc = zlib.crc32
        self._alone = np.concatenate([self._alone, np.array([crc(w) for w in new], dtype=np.uint32)])
        self._after = np.concatenate([self._after, np.array([crc(b" " + w) for w in new], dtype=np.uint32)])
        self._shift = np.concatenate([self._shift, np.array([self._lengths[n] for n in lengths], dtype=np.int64)])
        new.clear()

    def _append(self, run: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRC of each run with a blank and a word after it."""
        at, tables = self._shift[word], self._tables
        out = self._after[word].copy()
        for byte in range(4):
            out ^= tables[at, byte, run >> np.uint32(8 * byte) & np.uint32(255)]
        return out

    def hashes(self, listed: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """CRC of every feature of some word lists, and the list it belongs to."""
        counts = np.array([len(w) for w in listed], dtype=np.int64)
        flat = [w for one in listed for w in one]
        word = np.fromiter(map(self._words.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self._words.new:
            self._learn()
        owner = np.repeat(np.arange(len(listed)), counts)
        run = self._alone[word]
        found, owners = [run], [owner]
        for order in range(1, ORDERS):
            same = owner[order:] == owner[:-order]
            run = self._append(run[:-1] if len(run) else run, word[order:])
            found.append(run[same])
            owners.append(owner[order:][same])
        if len(self._words) > KEPT_WORDS:
            self._forget()
        return np.concatenate(found), np.concatenate(owners)


def _chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Word lists of the texts in order, many short ones at a time."""
    chunk: list[list[bytes]] = []
    size = 0
    for text in texts:
        chunk.append(words(text or ""))
        size += len(chunk[-1])
        if size >= CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``text`` values by bucket. One row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = FeatureHasher(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for chunk in _chunks(batch.column("text").to_pylist()):
                total += np.bincount(hasher.hashes(chunk)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "features"])

    rows = texts.select("text").mapInArrow(count, "bucket int, features long").groupBy("bucket").agg(F.sum("features").alias("features"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows.collect():
        out[row["bucket"]] = row["features"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed share in the target over that in the source, rounded down."""
    s_all, t_all, size = float(source.sum()), float(target.sum()), len(source)
    pairs = zip(source.astype(float).tolist(), target.astype(float).tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in pairs], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a Gumbel variate that the id and the seed decide, rounded down."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, id: str = "doc_id", min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``id, n_features, weight, score`` and whether a document is long enough to be drawn, as ``eligible``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = FeatureHasher()
        for batch in batches:
            sizes, weights = [], []
            for chunk in _chunks(batch.column("text").to_pylist()):
                crcs, owner = hasher.hashes(chunk)
                # Sums stay far below 2^53, so doubles hold them exactly.
                weights.append(np.bincount(owner, weights=gains[crcs % np.uint32(len(gains))], minlength=len(chunk)))
                sizes += map(len, chunk)
            n = np.array(sizes, dtype=np.int64)
            n_features = sum((np.maximum(n - order, 0) for order in range(ORDERS)), np.zeros_like(n))
            weight = np.concatenate([*weights, np.zeros(0)]).astype(np.int64)
            drawn = np.array([noise(i, seed) for i in batch.column("id").to_pylist()], dtype=np.int64)
            columns = [batch.column("id"), pa.array(n_features), pa.array(weight), pa.array(weight + drawn), pa.array(n >= min_words)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_features", "weight", "score", "eligible"])

    rows = docs.select(F.col(id).cast("long").alias("id"), "text")
    return rows.mapInArrow(scored, "id long, n_features long, weight long, score long, eligible boolean")


def _order_key(score: Column, id: Column) -> list[Column]:
    return [F.desc(score), F.asc_nulls_last(id)]


#: What rows are merged by.
_MERGED = ("score", "id", "run", "at")


def _keys(score: list[int], id: list[int | None], run: list[int], at: list[int]) -> Iterator[tuple]:
    """Keys in the order of ranks."""
    return ((-s, i is None, i or 0, r, a) for s, i, r, a in zip(score, id, run, at))


def drawn_ranks(scored: DataFrame, draw: Callable[[int], int]) -> DataFrame:
    """``scored`` with ``rank`` from 1 among eligible rows by descending score, then ``id``; null beyond ``draw(rows)``.

    Parallel sorting by regular sampling. Runs, counts and samples are made when this is called; the
    driver holds the samples and one number per segment.
    """
    names = scored.columns
    runs = scored.sortWithinPartitions(F.desc("eligible"), *_order_key("score", "id"))
    place = F.monotonically_increasing_id()
    runs = runs.withColumns({"run": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)})
    runs = materialize(runs, "runs")
    rows = runs.where("eligible").count()
    wanted = draw(rows)

    # Regular places in each run; a run's first one depends on its number, so that short runs count as well.
    step = max(1, rows // SAMPLES)
    start = F.pmod(F.xxhash64("run"), F.lit(step))
    sampled = runs.where(F.col("eligible") & (F.pmod(F.col("at") + start, F.lit(step)) == 0)).select(*_MERGED).toArrow()
    samples = sorted(_keys(*[sampled.column(c).to_pylist() for c in _MERGED]))
    segments = min(MAX_SEGMENTS, max(MIN_SEGMENTS, rows // SEGMENT_ROWS))
    splitters = [samples[len(samples) * i // segments] for i in range(1, segments)] if samples else []

    @F.arrow_udf("int")
    def segment(score: pa.Array, id: pa.Array, run: pa.Array, at: pa.Array) -> pa.Array:
        keys = _keys(score.to_pylist(), id.to_pylist(), run.to_pylist(), at.to_pylist())
        return pa.array([bisect.bisect_right(splitters, k) for k in keys], pa.int32())

    # The function meets all rows; a row that is not eligible may lack a score.
    dealt = runs.withColumn("segment", F.when(F.col("eligible"), segment(F.coalesce("score", F.lit(0)), "id", "run", "at")))
    counts = {r["segment"]: r["count"] for r in dealt.where("eligible").groupBy("segment").count().collect()}
    before, last = [], -1
    total = 0
    for number in range(segments):
        before.append(total)
        last = number if total < wanted else last
        total += counts.get(number, 0)

    exchanged = F.col("eligible") & (F.col("segment") <= last)
    merged = Window.partitionBy("segment").orderBy(*_order_key("score", "id"), "run", "at")
    rank = F.get(F.lit(before), F.col("segment")).cast("long") + F.row_number().over(merged)
    ranked = dealt.where(exchanged).select(*names, rank.alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = dealt.where(~F.coalesce(exchanged, F.lit(False))).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null for rows that are not drawn.

    ``percent`` of the rows with at least ``min_words`` words are drawn. Texts are read twice: for the counts of
    ``docs``, and for the scores. Runs jobs when it is called.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = score_documents(docs, gains, id, min_words, seed)
    ranked = drawn_ranks(scored, lambda rows: percent * rows // 100)
    return ranked.select(F.col("id").alias(id), "n_features", "weight", "score", "rank")
