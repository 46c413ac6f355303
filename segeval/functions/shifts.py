"""Word edits where moving a run of words counts as one edit.

The greedy search of Snover et al. (2006): as long as moving a run of words that stands
in the reference lowers the edit distance, the best such move is made. Distances are
exact, also those of long texts. One pass keeps the bit columns of the edit table;
a move is judged from the first word that it changes up to where the columns agree again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column

from segeval.functions.sequence import _masks, _measured

# Fixed values of the published search: words of a run, places between the run and its
# copy in the reference, and moves tried for a text, all rounds together.
LONGEST_RUN = 10
FARTHEST = 50
MOST_TRIED = 1000


class _Table:
    """The edit table of a text against a fixed reference, a column per word of the text."""

    def __init__(self, reference: list) -> None:
        self.reference = reference
        self.size = len(reference)
        self.full = (1 << self.size) - 1
        self.masks = _masks(reference)
        self.places: dict = defaultdict(list)
        for place, token in enumerate(reference):
            self.places[token].append(place)

    def step(self, token, up: int, down: int) -> tuple[int, int, int, int]:
        """Next column: bits where it rises and falls downwards, and where it rises and falls against the last one."""
        equal = self.masks.get(token, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = down | (self.full & ~(horizontal | up))
        fall = up & horizontal
        high, low = ((rise << 1) | 1) & self.full, (fall << 1) & self.full
        return low | (self.full & ~(vertical | high)), high & vertical, rise, fall

    def _change(self, rise: int, fall: int) -> int:
        return (rise >> (self.size - 1) & 1) - (fall >> (self.size - 1) & 1)

    def fill(self, words: list) -> None:
        self.words = words
        self.columns = [(self.full, 0, 0, 0)]
        self.distances = [self.size]
        for token in words:
            up, down, rise, fall = self.step(token, *self.columns[-1][:2])
            self.columns.append((up, down, rise, fall))
            self.distances.append(self.distances[-1] + self._change(rise, fall))

    def gain(self, moved: list, first: int, last: int) -> int:
        """By how much the distance falls with ``moved`` in place of the words; they differ in ``first`` to ``last`` only."""
        up, down = self.columns[first][:2]
        distance = self.distances[first]
        for at in range(first, len(moved)):
            up, down, rise, fall = self.step(moved[at], up, down)
            distance += self._change(rise, fall)
            if at >= last and (up, down) == self.columns[at + 1][:2]:
                # From here on both tables change alike.
                return self.distances[at + 1] - distance
        return self.distances[-1] - distance

    def align(self) -> tuple[list[int], list[bool], list[bool]]:
        """For every reference word the last word of the text up to it, and which words of the text and the reference are wrong.

        Among ways of equal cost, words are exchanged first, then words of the text left out.
        """
        at, wrong, wrong_reference = [-1] * self.size, [False] * len(self.words), [False] * self.size
        i, j = len(self.words), self.size
        while j:
            bit = 1 << (j - 1)
            across = i and bool(self.columns[i][2] & bit) - bool(self.columns[i][3] & bit)
            before = i and bool(self.columns[i - 1][0] & bit) - bool(self.columns[i - 1][1] & bit)
            same = i and self.words[i - 1] == self.reference[j - 1]
            if i and (same or across + before == 1):
                at[j - 1] = i - 1
                wrong[i - 1] = wrong_reference[j - 1] = not same
                i, j = i - 1, j - 1
            elif i and across == 1:
                wrong[i - 1] = True
                i -= 1
            else:
                at[j - 1] = i - 1
                wrong_reference[j - 1] = True
                j -= 1
        wrong[:i] = [True] * i
        return at, wrong, wrong_reference

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """Start in the text, start in the reference, and length of equal runs, every part of a run on its own."""
        for start, token in enumerate(self.words):
            for place in self.places.get(token, ()):
                if abs(place - start) <= FARTHEST:
                    length = 1
                    yield start, place, length
                    while (
                        length < LONGEST_RUN
                        and max(start, place - self.size + len(self.words)) + length < len(self.words)
                        and self.words[start + length] == self.reference[place + length]
                    ):
                        length += 1
                        yield start, place, length


def _goals(at: list[int], place: int, length: int) -> list[int]:
    """Where a run may go: in front of the reference words it equals, or behind each of them, without repeats."""
    goals: list[int] = []
    for offset in range(-1, length):
        goal = 0 if place + offset < 0 else at[place + offset] + 1
        if not goals or goal != goals[-1]:
            goals.append(goal)
    return goals


def _best_move(table: _Table, tried: int) -> tuple[int, list, int]:
    """Gain of the best move and the words after it, and how many moves have been tried by now."""
    at, wrong, wrong_reference = table.align()
    best: tuple = (0,)
    words = table.words
    for start, place, length in table.runs():
        useless = not any(wrong[start : start + length]) or not any(wrong_reference[place : place + length])
        if useless or start <= at[place] < start + length:
            continue
        rest = words[:start] + words[start + length :]
        for goal in _goals(at, place, length):
            # A goal behind the run lies among the words left; one inside it moves the run on by as many words.
            to = min(goal - length if goal > start + length else goal, len(rest))
            moved = rest[:to] + words[start : start + length] + rest[to:]
            gain = table.gain(moved, min(start, to), max(start, to) + length - 1)
            tried += 1
            # The longest of equally good runs, then the first one, to the first place.
            best = max(best, (gain, length, -start, -goal, moved), key=lambda b: b[:4]) if gain > 0 else best
        if tried >= MOST_TRIED:
            break
    return best[0], best[-1] if best[0] else words, tried


def shift_edits(hypothesis: list, reference: list) -> int:
    """Moves, insertions, deletions and substitutions that the search finds."""
    if not hypothesis or not reference:
        return len(hypothesis) or len(reference)
    table = _Table(reference)
    table.fill(hypothesis)
    moves = tried = 0
    while table.distances[-1]:
        gain, words, tried = _best_move(table, tried)
        if gain <= 0 or tried >= MOST_TRIED:
            break
        moves += 1
        table.fill(words)
    return moves + table.distances[-1]


def shift_rate(hypothesis: Column, reference: Column) -> Column:
    """Edits with moves per 100 reference tokens; against no tokens, 100 for any hypothesis token and 0 for none."""

    def rate(h: list, r: list) -> float:
        return 100.0 * shift_edits(h, r) / len(r) if r else 100.0 if h else 0.0

    return _measured(hypothesis, reference, "double", rate)
