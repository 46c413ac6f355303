"""Words and characters of all texts of an Arrow batch, found by looking at its bytes at once.

Every function gives what the tokeniser of the same name in ``functions.text`` gives
text by text. Patterns there take most of the time of a metric, so the metrics use
these; all classes of characters are ASCII but for white space, so bytes suffice.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from segeval.functions.text import OTHER_SPACES, TOKENS_13A

# Lead bytes of white space beyond ASCII, and the sequences that follow them.
_WIDE_SPACES: dict[int, list[bytes]] = {}
for _space in OTHER_SPACES:
    if _space > "\x7f":
        _WIDE_SPACES.setdefault(_space.encode()[0], []).append(_space.encode()[1:])


def _class(characters: str) -> np.ndarray:
    """For every byte, whether it is one of the ASCII characters."""
    members = np.zeros(256, dtype=bool)
    members[[ord(c) for c in characters if c < "\x80"]] = True
    return members


_SPACE = _class(" " + OTHER_SPACES)
_WIDE_LEAD = np.isin(np.arange(256), list(_WIDE_SPACES))
_DIGIT = _class(string.digits)
_PUNCTUATION = _class(string.punctuation)
_ALPHANUMERIC = _class(string.ascii_lowercase + string.digits)
# Marks that 13a always splits off; full stop, comma and hyphen depend on their neighbours.
_MARKS_13A = _class("".join(c for c in string.punctuation if c not in "',-."))
_STOPS_13A = _class(".,")


@dataclass
class Words:
    """Distinct words as bytes, the number of the word at each place, and the words per text."""

    distinct: pa.Array
    places: np.ndarray
    lengths: np.ndarray


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a blank after each, and the place behind each blank."""
    listed = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    ends = np.cumsum([len(t) + 1 for t in listed], dtype=np.int64)
    return np.frombuffer(b" ".join([*listed, b""]), dtype=np.uint8), ends


def _spaces(data: np.ndarray) -> np.ndarray:
    found = _SPACE[data]
    leads = np.flatnonzero(_WIDE_LEAD[data])
    if len(leads):
        padded = np.append(data, np.zeros(2, dtype=np.uint8))
        for lead, tails in _WIDE_SPACES.items():
            at = leads[data[leads] == lead]
            for tail in tails:
                hits = at
                for n, byte in enumerate(tail, 1):
                    hits = hits[padded[hits + n] == byte]
                for n in range(len(tail) + 1):
                    found[hits + n] = True
    return found


def _cut(data: np.ndarray, ends: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> Words:
    """Words from the bytes inside of them and the places where they start."""
    kept = data[inside]
    at = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(before[at] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    upto = np.searchsorted(at, ends)
    return Words(coded.dictionary, coded.indices.to_numpy(), np.diff(upto, prepend=0))


def _starts(inside: np.ndarray) -> np.ndarray:
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return starts


def words(texts: pa.Array) -> Words:
    """White-space tokens."""
    data, ends = joined(texts)
    inside = ~_spaces(data)
    return _cut(data, ends, inside, _starts(inside))


def rouge_words(texts: pa.Array) -> Words:
    """Runs of ``a-z0-9`` in lower-case texts."""
    data, ends = joined(texts)
    inside = _ALPHANUMERIC[data]
    return _cut(data, ends, inside, _starts(inside))


def chrf_words(texts: pa.Array) -> Words:
    """White-space tokens, one punctuation mark split off the end, else the start."""
    data, ends = joined(texts)
    inside = ~_spaces(data)
    starts = _starts(inside)
    first = np.flatnonzero(starts)
    # Every text is followed by a blank, so no word reaches the end of the bytes.
    last = np.flatnonzero(inside[:-1] & ~inside[1:])
    longer = last > first
    tail = longer & _PUNCTUATION[data[last]]
    head = longer & ~tail & _PUNCTUATION[data[first]]
    starts[last[tail]] = True
    starts[first[head] + 1] = True
    return _cut(data, ends, inside, starts)


def bleu_words(texts: pa.Array) -> Words:
    """13a tokens, case kept."""
    data, ends = joined(pa.array([_replaced_13a(t) for t in texts.to_pylist()], pa.string()))
    inside = ~_spaces(data)
    starts = _starts(inside)
    if len(data):
        splits = _splits_13a(data)
        # A split is a gap before the byte; it starts a word unless the byte is no part of one.
        starts |= splits & inside
    return _cut(data, ends, inside, starts)


def _replaced_13a(text: str) -> str:
    text = text.rstrip(" " + OTHER_SPACES)
    for old, new in TOKENS_13A:
        text = text.replace(old, new)
    return text


def _splits_13a(data: np.ndarray) -> np.ndarray:
    """Whether the patterns of 13a put a blank before each byte; every text ends in a blank."""
    splits = np.zeros(len(data) + 1, dtype=bool)
    marks = np.flatnonzero(_MARKS_13A[data])
    splits[marks] = splits[marks + 1] = True
    digit = np.append(_DIGIT[data], False)  # the byte before the first one is none, as is the one behind the last
    # A hyphen after a digit.
    hyphens = np.flatnonzero(data == ord("-"))
    hyphens = hyphens[digit[hyphens - 1]]
    splits[hyphens] = splits[hyphens + 1] = True
    # Stops and commas. The patterns meet a run of them from its left in pairs: all stops of a run come apart, and the run
    # stays with a digit at an end only as the parity of its length and the other end say.
    stops = np.flatnonzero(_STOPS_13A[data])
    if len(stops):
        splits[stops[1:][np.diff(stops) == 1]] = True
        run = np.flatnonzero(np.diff(stops, prepend=-2) > 1)
        first, length = stops[run], np.diff(np.append(run, len(stops)))
        behind = first + length
        after, before = digit[first - 1], digit[behind]
        splits[first[~(after & before & (length == 1))]] = True
        splits[behind[~(before & (after == (length % 2 == 1)))]] = True
    return splits[:-1]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts without white space, and their number per text."""
    data, ends = joined(texts)
    inside = ~_spaces(data)
    kept = data[inside]
    leads = inside & ((data & 0xC0) != 0x80)
    lengths = np.diff(np.concatenate(([0], np.cumsum(leads)))[ends], prepend=0)
    if not len(kept) or kept.max() < 0x80:
        return kept.astype(np.int64), lengths
    points = kept.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(points, dtype=np.uint32).astype(np.int64), lengths
