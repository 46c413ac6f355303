"""Clipped n-gram matches between two texts, counted for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from segeval.functions import units

# Units counted at once; longer batches are counted in several slices, whose arrays stay in the processor's caches.
_UNITS_PER_SLICE = 1 << 18


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the number of them per text."""
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points.astype(np.int64), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Batch-wide ids of the blank-separated words of all texts, and their number per text."""
    split = pc.split_pattern(texts, " ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    ids = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = ~np.repeat(empty, lengths)
    return ids[keep], np.where(empty, 0, lengths)


def _coded(units: np.ndarray, lengths: np.ndarray, alphabet_of: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the units with a 0 after each text, the places of those that are not 0, and the pair of each place."""
    codes = np.zeros(len(units) + len(lengths), dtype=np.int64)
    pairs = np.repeat(owner, lengths)
    at = np.arange(len(units)) + pairs
    codes[at] = numbers = alphabet_of[units]
    known = numbers > 0
    return codes, at[known], pairs[known]


def matches_per_order(units: np.ndarray, lengths: np.ndarray, orders: int) -> np.ndarray:
    """``min`` of the two n-gram counts, summed per pair and order.

    ``units`` holds the first texts of all pairs followed by the second texts,
    ``lengths`` their sizes in the same order. An n-gram can only match if the
    one it extends matched, so each order looks at surviving positions only.
    """
    pairs = len(lengths) // 2
    out = np.zeros((pairs, orders), dtype=np.int64)
    middle = int(lengths[:pairs].sum())
    if not middle or middle == len(units):
        return out
    # Only units of second texts can match. All others are number 0, as are the ends of texts.
    alphabet_of = np.zeros(int(units.max()) + 1, dtype=np.int64)
    alphabet_of[units[middle:]] = 1
    alphabet = np.flatnonzero(alphabet_of)
    alphabet_of[alphabet] = np.arange(1, len(alphabet) + 1)
    size, owner = len(alphabet) + 1, np.arange(pairs)
    first, second = (_coded(u, n, alphabet_of, owner) for u, n in ((units[:middle], lengths[:pairs]), (units[middle:], lengths[pairs:])))
    # Grams are numbered per pair, starting from one empty gram for each pair.
    pair_of = owner
    for n in range(orders):
        keys = []
        for codes, at, gram in (first, second):
            unit = codes[at + n]
            if n:
                inside = unit > 0
                at, gram, unit = at[inside], gram[inside], unit[inside]
            keys.append((at, gram * size + unit))
        (at, left), (other, right) = keys
        span = len(pair_of) * size
        if span <= 8 * (len(left) + len(right)) + 65536:
            clipped = np.minimum(np.bincount(left, minlength=span), np.bincount(right, minlength=span))
            found = np.flatnonzero(clipped)
            clipped = clipped[found]
            numbers = np.full(span, -1)
            numbers[found] = np.arange(len(found))
            left, right = numbers[left], numbers[right]
        else:
            found, right, counts = np.unique(right, return_inverse=True, return_counts=True)
            place = np.minimum(np.searchsorted(found, left), max(len(found) - 1, 0))
            left = np.where(found[place] == left, place, -1) if len(found) else np.full(len(left), -1)
            clipped = np.minimum(np.bincount(left[left >= 0], minlength=len(found)), counts)
            matched = clipped > 0
            numbers = np.where(matched, np.cumsum(matched) - 1, -1)
            left, right = np.where(left >= 0, numbers[left], -1) if len(found) else left, numbers[right]
            found, clipped = found[matched], clipped[matched]
        if not len(found):
            break
        pair_of = pair_of[found // size]
        out[:, n] = np.bincount(pair_of, weights=clipped, minlength=pairs)
        alive, others = left >= 0, right >= 0
        first, second = (first[0], at[alive], left[alive]), (second[0], other[others], right[others])
    return out


def _count(left: pa.Array, right: pa.Array, orders: int, split) -> pa.Array:
    rows = []
    sizes = np.cumsum(pc.add(pc.utf8_length(left), pc.utf8_length(right)).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(left):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + _UNITS_PER_SLICE, side="right")))
        both = pa.concat_arrays([left[start:stop], right[start:stop]])
        units, lengths = split(both)
        matches = matches_per_order(units, lengths, orders)
        rows.append(np.column_stack([matches, lengths[: stop - start], lengths[stop - start :]]))
        start = stop
    width = orders + 2
    flat = np.concatenate(rows).reshape(-1) if rows else np.zeros(0, dtype=np.int64)
    offsets = np.arange(0, len(left) * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def character_matches(left: Column, right: Column, orders: int) -> Column:
    """``ARRAY<BIGINT>``: clipped matches of character n-grams of order 1 to ``orders``, then both text lengths."""

    @F.arrow_udf("array<bigint>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return _count(a, b, orders, _characters)

    return count(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))


def word_matches(left: Column, right: Column, orders: int) -> Column:
    """The same for words, in texts whose words are separated by single blanks."""

    @F.arrow_udf("array<bigint>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return _count(a, b, orders, _words)

    return count(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))


def _words_of(split: Callable[[pa.Array], units.Words]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = split(texts)
        return found.places.astype(np.int64), found.lengths

    return numbered


# How whole texts are split into the units whose n-grams are counted.
SPLITS = {"bleu": _words_of(units.bleu_words), "chrf": _words_of(units.chrf_words), "chrf_characters": units.characters}


def text_matches(left: Column, right: Column, split: str, orders: int) -> Column:
    """``ARRAY<BIGINT>`` as above, for whole texts that are split in the same pass."""

    @F.arrow_udf("array<bigint>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return _count(a.fill_null(""), b.fill_null(""), orders, SPLITS[split])

    return count(left, right)
