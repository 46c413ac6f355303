"""Document fingerprints from closed syncmers.

A run of ``K`` code points is an anchor if the smallest of its inner runs of
``S`` code points is its first or its last one. The choice looks at nothing
outside the run, so an edit moves or removes only the anchors it touches. The
fingerprint of a text holds its ``SKETCH`` smallest distinct anchor hashes; two
fingerprints estimate the Jaccard similarity of the texts' anchors.

Edge cases: a null text is an empty one; an empty text has the empty fingerprint,
which is like itself and unlike any other; a text without an anchor (shorter than
``K``, mostly) has one made of the whole text. Rows of equal ``doc_id`` are put in
the order of their texts; rows without one come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 16
S = 6
SKETCH = 128

#: Hex digits of one anchor hash in a fingerprint.
DIGITS = 10

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _hashes(points: np.ndarray, starts: np.ndarray | None, length: int) -> np.ndarray:
    """Hash of the run of ``length`` code points at each start, or at every position."""
    count = len(points) - length + 1
    total = np.zeros(count if starts is None else len(starts), dtype=np.uint64)
    for j in range(length):
        total *= _MULTIPLIER
        total += points[j : j + count] if starts is None else points[starts + j]
    return _mixed(total)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text, in text order."""
    # One is added so that leading zeros count.
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    if len(points) >= K:
        inner = _hashes(points, None, S)
        width, least, span = K - S + 1, inner, 1
        while span < width:  # minima of windows of doubling width
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        last = inner[width - 1 :]
        chosen = np.flatnonzero((inner[: len(least)] == least) | (last == least))
        if len(chosen):
            return chosen, _hashes(points, chosen, K)
    if not len(points):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.zeros(1, dtype=np.int64), _hashes(points, np.zeros(1, dtype=np.int64), len(points))


def sketch(text: str) -> np.ndarray:
    """The smallest distinct anchor hashes, ascending."""
    shift = np.uint64(64 - 4 * DIGITS)
    return np.unique(anchors(text)[1] >> shift)[:SKETCH]


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard estimate: the share of the smallest hashes of both that both hold."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    both = np.concatenate([left, right])
    both.sort()
    same = both[1:] == both[:-1]
    distinct = both[np.concatenate([[True], ~same])][:SKETCH]
    shared = both[1:][same]
    return float(np.searchsorted(shared, distinct[-1], side="right")) / len(distinct)


def fingerprint(hashes: np.ndarray) -> str:
    return "".join(f"{h:0{DIGITS}x}" for h in hashes.tolist())


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it. Every bucket ends with a copy of the first row of the bucket below."""
    held: tuple | None = None  # the row that waits for the next one
    first: tuple | None = None
    bucket = None

    def pair(row: tuple, following: tuple) -> tuple:
        doc_id, text, own = row
        edited = edit(text, following[1])
        changed = own if edited == text else sketch(edited)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed),
            likeness(own, changed), likeness(own, following[2]),
        )

    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")]
        for b, tail, doc_id, text in zip(*columns):
            if b != bucket:
                if held is not None:  # the only bucket there is: its first row follows its last
                    rows.append(pair(held, first))
                bucket, held, first = b, None, None
            if tail and held is None:
                continue
            row = (doc_id, text, sketch(text))
            if held is not None:
                rows.append(pair(held, row))
            held, first = (None if tail else row), first or row
        if rows:
            yield packed(rows)
    if held is not None:
        yield packed([pair(held, first)])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the next document's beginning replaces its end.

    "Next" follows descending ``doc_id``; the first document follows the last. The
    table is dealt once, into ranges of ``doc_id``. The first row of each range
    goes to the range before it as well, so ranges are compared independently and
    rows stream through a task. The cuts between ranges are twice as many as
    shuffle partitions, whatever the size of the table; finding them runs a job
    over the ids alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The largest id of each range is a cut, so every cut is an id, and the last one is the largest of all.
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange(buckets, "doc_id")
    found = ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("last")).collect()
    cuts = np.unique(np.array([row["last"] for row in found], dtype=np.int64))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the number of the range, plus one for the row at its upper end."""
        at = np.searchsorted(cuts, ids)
        top = cuts[np.minimum(at, len(cuts) - 1)] == ids.to_numpy() if len(cuts) else 0 * at
        return pd.Series(2 * at + top)

    def target(number, tail: bool):
        return F.struct(number.cast("int").alias("bucket"), F.lit(tail).alias("tail"))

    number = F.shiftright("place", 1)
    above = (number + 1) % max(1, len(cuts))
    targets = F.when(F.col("place") % 2 == 1, F.array(target(number, False), target(above, True)))
    dealt = (
        rows.withColumn("place", F.when(F.isnull("doc_id"), 0).otherwise(place(F.coalesce("doc_id", F.lit(0)))))
        .select("doc_id", "text", F.inline(targets.otherwise(F.array(target(number, False)))))
        .repartitionById(max(1, len(cuts)), "bucket")
        .sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    )
    return dealt.mapInArrow(_compare, RESULT)
