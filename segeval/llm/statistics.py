"""Statistics of a document's text that tell prose from junk."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

#: Groups of ASCII characters that are counted apart (fixed values).
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\n",
    b".",
    b",;:",
    b"!?",
    b"'\"()-",
    b"|/\\<>[]{}",
    b"#$%&*+=@^_~`",
)

_CODES = np.full(256, len(_GROUPS), dtype=np.uint8)
for _number, _group in enumerate(_GROUPS):
    _CODES[list(_group)] = _number

NAMES = (
    *(f"group_{i}" for i in range(len(_GROUPS) + 1)),
    "chars", "entropy", "packed", "words", "word_length", "longest_word", "distinct_words", "top_word", "top_five_words",
    "repeated_next", "ends_in_symbol", "upper_words", "lines", "distinct_lines", "line_words", "longest_line",
    "worst_symbol_line", "worst_upper_line", "worst_repeat_line", "worst_bar_line",
)

_SYMBOL_END = frozenset(b"#$%&*+=@^_~`!|")


def statistics(text: str) -> list[float]:
    """One number for each of ``NAMES``. Of an empty text, all are 0. Time and memory are linear in the text."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(_CODES[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_GROUPS) + 1)
    shares = (counts / len(raw)).tolist()
    letters = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = letters[letters > 0] / len(raw)
    entropy = float(-(letters * np.log2(letters)).sum())
    packed = len(zlib.compress(raw, 1)) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    common = Counter(words)
    top = [c for _, c in common.most_common(5)] or [0]
    longest = max(map(len, words), default=0)
    again = sum(map(bytes.__eq__, words, words[1:]))
    symbols = sum(w[-1] in _SYMBOL_END for w in words)
    upper = sum(map(bytes.isupper, words))
    lines = raw.split(b"\n")
    worst = [0.0, 0.0, 0.0, 0.0]
    for line in lines:  # junk may fill one passage only
        of = line.split()
        m = len(of)
        if m >= 5:
            found = (
                sum(w[-1] in _SYMBOL_END for w in of) / m,
                sum(map(bytes.isupper, of)) / m,
                1 - len(set(of)) / m,
                line.count(b"|") / m,
            )
            worst = list(map(max, worst, found))
    return [
        *shares, math.log1p(len(text)), entropy, packed, math.log1p(len(words)), sum(map(len, words)) / n, float(longest),
        len(common) / n, top[0] / n, sum(top) / n, again / n, symbols / n, upper / n, math.log1p(len(lines)),
        len(set(lines)) / len(lines), len(words) / len(lines), math.log1p(max(map(len, lines))), *worst,
    ]
