"""Word-level edit distance and longest common subsequence, counted in Arrow batches.

Both are bit-parallel over integers of any length: one bit per token of one side,
one step per token of the other. So a pair of n and m tokens takes about n * m / 64
machine operations, in memory linear in n, and there is no limit on either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from segeval.functions import units
from segeval.functions.stem import stem_numbers
from segeval.functions.units import Words

#: Tokens of a side that fit a machine word.
BITS = 64

#: Words of a short side up to which pairs go side by side; integers of any length are as fast beyond.
LANES = 32

#: Words of all pairs that go side by side, about; their arrays stay in the processor's caches.
LANES_AT_ONCE = 1 << 12

#: Tokens of the pairs that are compared at a time, about.
TOKENS = 1 << 22

#: Bytes of the texts that are split at a time, about.
BYTES = 1 << 21

#: Pairs that must be left for one step of all to take less time than a step of each.
TOGETHER = 16


def _masks(tokens: list) -> dict:
    """For every token, an integer with a bit at each of its positions."""
    masks: dict = {}
    bytes_of: dict[str, list[int]] = {}
    for position, token in enumerate(tokens):
        bytes_of.setdefault(token, []).append(position)
    for token, positions in bytes_of.items():
        if len(positions) < 8:
            mask = 0
            for position in positions:
                mask |= 1 << position
        else:  # one pass over a buffer instead of one long integer per occurrence
            buffer = bytearray(positions[-1] // 8 + 1)
            for position in positions:
                buffer[position >> 3] |= 1 << (position & 7)
            mask = int.from_bytes(buffer, "little")
        masks[token] = mask
    return masks


def common_length(left: list, right: list) -> int:
    """Length of the longest common subsequence (Hyyro 2004)."""
    short, long = sorted((left, right), key=len)
    masks, full = _masks(short), (1 << len(short)) - 1
    state = full
    for token in long:
        mask = masks.get(token)
        if mask:
            matched = state & mask
            state = ((state + matched) | (state - matched)) & full
    return len(short) - state.bit_count()


def edit_distance(left: list, right: list) -> int:
    """Insertions, deletions and substitutions (Myers 1999)."""
    short, long = sorted((left, right), key=len)
    if not short:
        return len(long)
    masks, full, last = _masks(short), (1 << len(short)) - 1, 1 << (len(short) - 1)
    up, down, distance = full, 0, len(short)
    for token in long:
        equal = masks.get(token, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise = ((rise << 1) | 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
    return distance


def edit_distances(left: list[np.ndarray], right: list[np.ndarray]) -> list[int]:
    """``edit_distance`` of many pairs of token numbers."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right)]
    return _in_lanes(pairs, _edits_in_lanes, edit_distance)


def common_lengths(left: list[np.ndarray], right: list[np.ndarray]) -> list[int]:
    """``common_length`` of many pairs of token numbers."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right)]
    return _in_lanes(pairs, _common_in_lanes, common_length)


def _in_lanes(pairs: list[tuple], many: Callable[[list[tuple]], np.ndarray], one: Callable[[list, list], int]) -> list[int]:
    """Pairs with a short side of up to ``BITS * LANES`` tokens go side by side, a lane for every ``BITS`` of these."""
    found = np.zeros(len(pairs), dtype=np.int64)
    lanes = np.array([-(-len(x) // BITS) for x, _ in pairs], dtype=np.int64)
    steps = np.array([len(y) for _, y in pairs], dtype=np.int64) + lanes
    # The longest come first, so that those still running are always the first ones.
    order = np.argsort(-steps, kind="stable")
    order = order[(lanes[order] <= LANES) & (lanes[order] > 0)][TOGETHER - 1 :]
    side = np.zeros(len(pairs), dtype=bool)
    side[order] = True
    group = np.cumsum(lanes[order]) // LANES_AT_ONCE
    for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(some):
            found[some] = many([pairs[i] for i in some.tolist()])
    for i in np.flatnonzero(~side).tolist():
        found[i] = one(pairs[i][0].tolist(), pairs[i][1].tolist())
    return found.tolist()


class _Lanes:
    """Pairs side by side, in the order of their last steps.

    Every lane holds ``BITS`` tokens of a pair's short side. Lane ``w`` takes the long side's token ``t`` in step
    ``t + w``, one step after the lane before it, so that what that lane carries over is there by then.
    """

    def __init__(self, pairs: list[tuple], known: bool):
        """``known`` leaves out the tokens of long sides that their short sides lack."""
        n = len(pairs)
        sizes, lengths = (np.array([len(p[side]) for p in pairs], dtype=np.int64) for side in (0, 1))
        tokens, others = (np.concatenate([p[side] for p in pairs]).astype(np.int64) for side in (0, 1))
        numbers = np.unique(tokens)
        span = len(numbers) + 1
        number_of = np.zeros(max(int(tokens.max()), int(others.max(initial=0))) + 1, dtype=np.int64)
        number_of[numbers] = np.arange(1, span)
        width = -(-sizes // BITS)
        # For every token of a pair's short side, a row with the bits of its positions, a word for each lane. Row 0 is empty.
        keys = np.repeat(np.arange(n) * span, sizes) + number_of[tokens]
        position = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(keys, kind="stable")
        keys, position = keys[order], position[order]
        new = np.append(True, keys[1:] != keys[:-1])
        distinct = keys[new]
        widths = width[distinct // span]
        row = np.cumsum(widths) - widths + int(width.max())
        word = row[np.cumsum(new) - 1] + position // BITS
        changed = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        self.masks = np.zeros(int(row[-1] + widths[-1]), dtype=np.uint64)
        self.masks[word[changed]] = np.bitwise_or.reduceat(np.uint64(1) << (position % BITS).astype(np.uint64), changed)
        owner = np.repeat(np.arange(n), lengths)
        wanted = owner * span + number_of[others]
        if n * span <= 1 << 22:
            row_of = np.zeros(n * span, dtype=np.int64)
            row_of[distinct] = row
            rows = row_of[wanted]
        else:
            at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
            rows = np.where(distinct[at] == wanted, row[at], 0)
        if known:
            owner, rows = owner[rows > 0], rows[rows > 0]
            lengths = np.bincount(owner, minlength=n)
            self.order = np.argsort(-(lengths + width), kind="stable")
        else:
            self.order = np.arange(n)
        # As many empty rows before each long side as its pair has lanes, so that a lane waits for its turn on those, and after it.
        room = lengths + 2 * width
        begins = np.cumsum(room) - room + width
        self.rows = np.zeros(int(room.sum()), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        self.rows[np.arange(len(rows)) + np.repeat(begins - starts, lengths)] = rows
        begins, width = begins[self.order], width[self.order]
        self.sizes, self.lengths = sizes[self.order], lengths[self.order]
        self.last = np.cumsum(width) - 1
        self.first = self.last - width + 1
        self.word = np.arange(int(width.sum())) - np.repeat(self.first, width)
        self.place = np.repeat(begins, width) - self.word
        # The pairs that still run in each step.
        ends = self.lengths + width - 1
        self.running = np.searchsorted(-ends, -np.arange(int(ends[0])), side="left").tolist()

    def steps(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each step: the running pairs, their lanes, and the bits of the token that each lane takes."""
        for k in self.running:
            lanes = int(self.last[k - 1]) + 1
            row = self.rows.take(self.place[:lanes])
            row += self.word[:lanes]  # the empty row is as wide as any
            self.place[:lanes] += 1
            yield k, lanes, self.masks.take(row)


def _edits_in_lanes(pairs: list[tuple]) -> np.ndarray:
    """The steps of ``edit_distance``: a lane hands on whether its last bit rises or falls."""
    lanes = _Lanes(pairs, known=False)
    one, top = np.uint64(1), np.uint64(BITS - 1)
    ends = ((lanes.sizes - 1) % BITS).astype(np.uint64)
    up, down = np.full(len(lanes.word), ~np.uint64(0)), np.zeros(len(lanes.word), dtype=np.uint64)
    # What each lane gets from the one before it; the first lane of a pair always rises.
    rises, falls = np.zeros(len(up) + 1, dtype=np.uint64), np.zeros(len(up) + 1, dtype=np.uint64)
    rises[lanes.first] = one
    distance = lanes.sizes.copy()
    for k, n, equal in lanes.steps():
        u, d = up[:n], down[:n]
        vertical = equal | d
        equal |= falls[:n]
        horizontal = equal & u
        horizontal += u
        horizontal ^= u
        horizontal |= equal
        fall = u & horizontal
        horizontal |= u
        rise = np.invert(horizontal, out=horizontal)
        rise |= d
        last, first, end = lanes.last[:k], lanes.first[:k], ends[:k]
        distance[:k] += ((rise[last] >> end) & one).astype(np.int64) - ((fall[last] >> end) & one).astype(np.int64)
        out_rise, out_fall = rise >> top, fall >> top
        rise <<= one
        rise |= rises[:n]
        fall <<= one
        fall |= falls[:n]
        np.bitwise_and(rise, vertical, out=d)
        vertical |= rise
        np.bitwise_or(fall, np.invert(vertical, out=vertical), out=u)
        rises[1 : n + 1], falls[1 : n + 1] = out_rise, out_fall
        rises[first], falls[first] = one, 0
    found = np.empty_like(distance)
    found[lanes.order] = distance
    return found


def _common_in_lanes(pairs: list[tuple]) -> np.ndarray:
    """The steps of ``common_length``: a lane hands on the carry of its sum."""
    lanes = _Lanes(pairs, known=True)
    state = np.full(len(lanes.word), ~np.uint64(0))
    carries = np.zeros(len(state) + 1, dtype=np.uint64)
    for k, n, mask in lanes.steps():
        s, c = state[:n], carries[:n]
        mask &= s
        total = s + mask
        over = total < s
        total += c
        over |= total < c
        mask ^= s
        np.bitwise_or(total, mask, out=s)
        carries[1 : n + 1] = over
        carries[lanes.first[:k]] = 0
    # Bits behind the last token are never cleared.
    found = np.empty(len(pairs), dtype=np.int64)
    found[lanes.order] = np.add.reduceat(np.bitwise_count(~state).astype(np.int64), lanes.first)
    return found


def _coded(left: pa.Array, right: pa.Array) -> tuple[list, np.ndarray, list, list]:
    """The distinct tokens of all lists, the number of the token at each place, and every list's places, by side; None for a missing list."""
    # A batch at once: token by token, reading lists takes longer than comparing them.
    coded = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode(null_encoding="encode")
    places = coded.indices.to_numpy()
    ends = np.cumsum(np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (left, right)]), dtype=np.int64)
    missing = [*left.is_null().to_pylist(), *right.is_null().to_pylist()]
    parts = [None if none else (a, b) for none, a, b in zip(missing, [0, *ends[:-1].tolist()], ends.tolist())]
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), places, parts[: len(left)], parts[len(left) :]


def _in_batches(left: Column, right: Column, kind: str, measure: Callable[[list, np.ndarray, list[tuple]], list]) -> Column:
    """``measure`` gets the distinct tokens, the token number of each place, and the places of both sides of every whole pair."""

    @F.arrow_udf(kind)
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        tokens, places, x, y = _coded(a, b)
        whole = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        found = iter(measure(tokens, places, whole))
        values = [None if p is None or q is None else next(found) for p, q in zip(x, y)]
        return pa.array(values, pa.int32() if kind == "int" else pa.float64())

    return count(left, right)


def _measured(left: Column, right: Column, kind: str, measure: Callable[[list, list], float]) -> Column:
    def each(tokens: list, places: np.ndarray, pairs: list[tuple]) -> list:
        def listed(part: tuple[int, int]) -> list:
            return [tokens[i] for i in places[part[0] : part[1]].tolist()]

        return [measure(listed(p), listed(q)) for p, q in pairs]

    return _in_batches(left, right, kind, each)


def word_edits(left: Column, right: Column) -> Column:
    """Edits between two token arrays."""
    return _in_batches(left, right, "int", lambda tokens, places, pairs: _distances(places, pairs))


def _distances(places: np.ndarray, pairs: list[tuple]) -> list[int]:
    return _compared(places, pairs, edit_distances)


def _compared(places: np.ndarray, pairs: list[tuple], compare: Callable[[list, list], list[int]]) -> list[int]:
    found: list[int] = []
    tokens, some = 0, []
    for n, ((a, b), (c, d)) in enumerate(pairs, 1):
        some.append((places[a:b], places[c:d]))
        tokens += b - a + d - c
        if tokens >= TOKENS or n == len(pairs):
            found += compare(*map(list, zip(*some)))
            tokens, some = 0, []
    return found


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays."""
    return _in_batches(left, right, "int", lambda tokens, places, pairs: _compared(places, pairs, common_lengths))


def _of_texts(
    left: Column,
    right: Column,
    split: Callable[[pa.Array], Words],
    places: Callable[[Words], np.ndarray],
    compare: Callable[[list, list], list[int]],
    score: Callable[[int, int, int], float],
) -> Column:
    """``score`` of what ``compare`` finds for a pair of whole texts, and of their numbers of words."""

    @F.arrow_udf("double")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = a.fill_null(""), b.fill_null("")
        sizes = np.cumsum(pc.add(pc.binary_length(a), pc.binary_length(b)).to_numpy(zero_copy_only=False), dtype=np.int64)
        values: list[float] = []
        x: list[np.ndarray] = []
        y: list[np.ndarray] = []
        start = tokens = 0
        while start < len(a):
            # Words are numbered for a few texts at a time, so that the distinct ones stay in the processor's caches.
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + BYTES, side="right")))
            words = split(pa.concat_arrays([a[start:stop], b[start:stop]]))
            texts = np.split(places(words), np.cumsum(words.lengths)[:-1])
            x += texts[: stop - start]
            y += texts[stop - start :]
            start, tokens = stop, tokens + len(words.places)
            if tokens >= TOKENS or start == len(a):
                values += [score(n, len(h), len(r)) for n, h, r in zip(compare(x, y), x, y)]
                x, y, tokens = [], [], 0
        return pa.array(values, pa.float64())

    return count(left, right)


def edit_rate(hypothesis: Column, reference: Column) -> Column:
    """Edits per 100 reference words of two texts; against no words, 100 for any hypothesis word and 0 for none."""

    def rate(edits: int, hyp: int, ref: int) -> float:
        return 100.0 * edits / ref if ref else 100.0 if hyp else 0.0

    return _of_texts(hypothesis, reference, units.words, lambda words: words.places, edit_distances, rate)


def overlap_f1(hypothesis: Column, reference: Column, stem: bool, ascii_only: bool = True) -> Column:
    """F1 of the longest common subsequence of two lower-case texts' words, of their stems if wanted.

    Words are runs of ``a-z0-9``, or else, of texts with nothing else between them, what blanks separate.
    """

    def places(words: Words) -> np.ndarray:
        return stem_numbers(words.distinct)[words.places] if stem and len(words.distinct) else words.places

    def f1(common: int, hyp: int, ref: int) -> float:
        return 2.0 * common / (hyp + ref) if hyp and ref else 0.0

    return _of_texts(hypothesis, reference, units.rouge_words if ascii_only else units.words, places, common_lengths, f1)
