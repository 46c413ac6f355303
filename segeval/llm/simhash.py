"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family of bit masks (Pagh 2016): every bit position draws a non-zero
vector of ``radius + 1`` bits, and each non-zero vector ``v`` gives the mask of the
positions whose vectors have an odd overlap with ``v``. Two fingerprints that
differ in at most ``radius`` positions agree under at least one mask, since some
``v`` is orthogonal to all the vectors drawn at those positions. So tables keyed
by the masked fingerprints miss no pair.

Links are found among fingerprints that share a table's key with another one. No
pair is listed: such a fingerprint gives one row for itself and for each flip of
one bit that the mask leaves free. Two fingerprints with a row in common differ
in at most two bits, and two that differ in at most two bits outside the mask
have one, so the smallest fingerprint of each row stands for all of them. A row
has 65 different fingerprints at most, however many documents there are.

Edge cases: a null text is an empty one; texts without a word have the
fingerprint 0 and link like any other; equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segeval.llm.components import components
from segeval.scratch import materialize

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42

#: Shingles whose bits are counted at a time, which bounds the memory of a very long text.
_BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    # On bytes, lower() and split() know ASCII letters and white space only.
    words = text.encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, _BLOCK):
        part = words[start : min(start + _BLOCK, count) + SHINGLE - 1]
        if len(part) < SHINGLE:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*[part[i:] for i in range(SHINGLE)]))
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 if there is none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[start : start + _BLOCK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        columns = [c for c in batch.schema.names if c != "text"]
        arrays = [batch.column(c) for c in columns] + [pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, [*columns, "bits"])


def add_fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``bits``, the fingerprint as a signed long."""
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(_fingerprints, f"{schema}, bits long")


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits."""
    drawn = np.random.default_rng(seed).integers(1, 1 << (radius + 1), BITS)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = [int(v & int(m)).bit_count() & 1 for m in drawn]
        masks.append(sum(1 << i for i, o in enumerate(odd) if o))
    return masks


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``bits`` that connect all those within two bits of each other."""
    tables = F.array(
        *[
            F.struct(
                F.lit(number).alias("table"),
                F.col("bits").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key"),
                # A zero flip is the fingerprint itself.
                F.array(*[F.lit(_signed(f)).cast("long") for f in [0, *(1 << i for i in range(BITS) if not mask >> i & 1)]]).alias("flips"),
            )
            for number, mask in enumerate(covering_masks())
        ]
    )
    keyed = distinct.select("bits", F.inline(tables))
    # The smallest and the largest member tell whether a key has more than one.
    ends = distinct.select("bits", F.inline(F.transform(tables, lambda t: F.struct(t["table"].alias("table"), t["key"].alias("key")))))
    ends = ends.groupBy("table", "key").agg(F.min("bits").alias("low"), F.max("bits").alias("high"))
    shared = materialize(ends.where("low != high").select("table", "key"), "keys")
    members = keyed.join(shared, ["table", "key"], "left_semi")
    rows = members.select("bits", F.explode("flips").alias("flip")).distinct()
    rows = materialize(rows.select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("near")), "rows")
    stars = rows.groupBy("near").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low != high")
    stars = materialize(stars.select("near", F.col("low").alias("b")), "stars")
    return rows.join(stars, "near").where("bits != b").select(F.col("bits").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys``, ``bits`` and ``component_id``: the smallest ``label`` that links reach.

    ``label`` is one of ``keys``. Rows without one take part and are never the smallest; a
    component of such rows alone has none.
    """
    prints = materialize(add_fingerprints(docs, keys), "fingerprints")
    return grouped(prints, keys, label, near_links)


def grouped(prints: DataFrame, keys: list[str], label: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` with ``component_id``; ``links`` gives ``a, b`` for distinct ``bits``."""
    distinct = materialize(prints.groupBy("bits").agg(F.min(label).alias("least"), F.count("*").alias("copies")), "distinct")
    roots = materialize(components(links(distinct.select("bits"))), "roots")
    linked = distinct.join(roots, F.col("bits") == F.col("node"))
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("least")), "least")
    linked = roots.join(least, "root").select(F.col("node").alias("bits"), F.col("least").alias("component_id"))
    copied = distinct.join(roots, F.col("bits") == F.col("node"), "left_anti").where("copies > 1")
    classes = materialize(linked.union(copied.select("bits", "least")).withColumnRenamed("bits", "of"), "classes")
    # A fingerprint that is not listed belongs to one row alone.
    joined = prints.join(classes, F.col("bits") == F.col("of"), "left")
    alone = F.when(F.isnull("of"), F.col(label)).otherwise(F.col("component_id"))
    return joined.select(*keys, "bits", alone.alias("component_id"))
