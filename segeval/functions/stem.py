"""Porter stemming (Porter 1980, with the usual later departures), once per distinct token of a worker.

Words are lower-case. A ``y`` that acts as a consonant is written ``Y`` while a
word is being stemmed, so that every condition of the algorithm becomes a plain
regular expression over vowels and consonants.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems that a worker remembers.
REMEMBERED = 1 << 17

_V, _C = "[aeiouy]", "[^aeiouy]"
_MEASURE_ABOVE_0 = f"{_C}*{_V}+{_C}.*"
_MEASURE_ABOVE_1 = f"{_C}*{_V}+{_C}+{_V}+{_C}.*"
_MEASURE_IS_1 = f"^{_C}*{_V}+{_C}+{_V}*$"
_SHORT_END = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$"

# Patterns are compiled once; looking them up by their text takes longer than matching a word.
_ABOVE_0, _ABOVE_1 = re.compile(_MEASURE_ABOVE_0), re.compile(_MEASURE_ABOVE_1)
_ABOVE_0_L, _ABOVE_1_L = re.compile(f"(?:{_MEASURE_ABOVE_0})(?<=l)"), re.compile(f"(?:{_MEASURE_ABOVE_1})(?<=l)")
_ABOVE_1_ST = re.compile(f"(?:{_MEASURE_ABOVE_1})(?<=[st])")
_IS_1, _SHORT, _VOWEL = re.compile(_MEASURE_IS_1), re.compile(_SHORT_END), re.compile(_V)
_NEEDS_E, _DOUBLE, _LAST = re.compile("(?:at|bl|iz)$"), re.compile(rf"(?:({_C})\1|yY)$"), re.compile("[^lsz]$")
_Y_AFTER_C = re.compile(f"^(.+{_C})y$")

# Words with their own stem.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}

# Suffix and replacement, the first suffix that fits decides.
STEP_2 = [
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent"]
STEP_4_AFTER_ION = ["ou", "ism", "ate", "iti", "ous", "ive", "ize"]

def _by_end(suffixes: list, end) -> dict[str, list]:
    """The suffixes by their last letter, in their order."""
    found: dict[str, list] = {}
    for suffix in suffixes:
        found.setdefault(end(suffix), []).append(suffix)
    return found


_STEP_2 = _by_end(STEP_2, lambda pair: pair[0][-1])
_STEP_3 = _by_end(STEP_3, lambda pair: pair[0][-1])
_STEP_4 = _by_end([*STEP_4, "ion", *STEP_4_AFTER_ION], lambda suffix: suffix[-1])

# The last letters that some step looks for; any other ASCII word is its own stem.
_ENDS_1 = frozenset("sey")
_ENDS_2 = frozenset(s[-2:] for s in ("ed", "ing", "logi", "ll", "ion", *(s for s, _ in STEP_2 + STEP_3), *STEP_4, *STEP_4_AFTER_ION))


def _rewrite(word: str, stem: re.Pattern, suffix: str, new: str) -> str:
    """Replace ``suffix``, the word's end, by ``new`` if what precedes it fits ``stem``."""
    before = word[: -len(suffix)]
    return before + new if stem.fullmatch(before) else word


def _mark_consonant_y(word: str) -> str:
    return re.sub("(^|[aeiou])y", r"\1Y", word).replace("yy", "yY") if "y" in word else word


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _repaired(stem: str) -> str:
    if _NEEDS_E.search(stem):
        return stem + "e"
    if _DOUBLE.search(stem):
        return _LAST.sub("", stem)
    if _IS_1.search(stem) and _SHORT.search(stem):
        return stem + "e"
    return stem


def _past_and_gerund(word: str) -> str:
    if word[-1:] not in "dg":
        return word
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return _rewrite(word, _ABOVE_0, "eed", "ee")
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return _repaired(stem) if _VOWEL.search(stem) else word
    return word


def _final_y(word: str) -> str:
    return _Y_AFTER_C.sub(r"\1i", word) if word.endswith("y") else word


def _double_suffix(word: str) -> str:
    if word[-1:] not in "ilmnrs":
        return word
    # "-alli" loses two letters first and is then looked at again as "-al".
    if word.endswith("alli"):
        word = _rewrite(word, _ABOVE_0, "alli", "al")
    for suffix, new in _STEP_2.get(word[-1:], ()):
        if word.endswith(suffix):
            return _rewrite(word, _ABOVE_0, suffix, new)
    return _rewrite(word, _ABOVE_0_L, "ogi", "og") if word.endswith("logi") else word


def _third(word: str) -> str:
    for suffix, new in _STEP_3.get(word[-1:], ()):
        if word.endswith(suffix):
            return _rewrite(word, _ABOVE_0, suffix, new)
    return word


def _fourth(word: str) -> str:
    for suffix in _STEP_4.get(word[-1:], ()):
        if word.endswith(suffix):
            return _rewrite(word, _ABOVE_1_ST if suffix == "ion" else _ABOVE_1, suffix, "")
    return word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    stem = word[:-1]
    short = _IS_1.search(stem) and not _SHORT.search(stem)
    return stem if _ABOVE_1.match(stem) or short else word


def _double_l(word: str) -> str:
    return _rewrite(word, _ABOVE_1_L, "l", "") if word.endswith("ll") else word


_STEPS = (_mark_consonant_y, _plural, _past_and_gerund, _final_y, _double_suffix, _third, _fourth, _final_e, _double_l)

_stems: dict[str, str] = {}


def stem_word(word: str, longer_than: int = 3) -> str:
    """The stem of a word of more than ``longer_than`` characters; a shorter word stays."""
    if len(word) <= max(longer_than, 2) or (word[-1] not in _ENDS_1 and word[-2:] not in _ENDS_2 and word.isascii()):
        return word
    if word not in _stems:
        if len(_stems) >= REMEMBERED:
            _stems.clear()
        stem = IRREGULAR.get(word)
        if stem is None:
            stem = word
            for step in _STEPS:
                stem = step(stem)
            stem = stem.lower()
        _stems[word] = stem
    return _stems[word]


def stem_all(tokens: list[str], longer_than: int = 3) -> list[str]:
    return [stem_word(t, longer_than) for t in tokens]


def _may_change(words: pa.Array) -> np.ndarray:
    """Which of the words, as bytes, are not ASCII, or end like one that some step changes."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    # Two bytes before the first word, for words of less.
    padded = np.zeros(int(offsets[-1] - offsets[0]) + 2, dtype=np.uint8)
    if len(padded) > 2:
        padded[2:] = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0] + 2
    wide = np.concatenate(([0], np.cumsum(padded >= 0x80)))[ends]
    last, pair = padded[ends - 1], padded[ends - 2].astype(np.int64) << 8 | padded[ends - 1]
    ends_1 = [ord(c) for c in _ENDS_1]
    ends_2 = [ord(s[0]) << 8 | ord(s[1]) for s in _ENDS_2]
    return np.isin(last, ends_1) | np.isin(pair, ends_2) | (np.diff(wide, prepend=0) > 0)


def stem_numbers(words: pa.Array) -> np.ndarray:
    """For every word, given as bytes, the number of its stem: the same for words of the same stem."""
    at = np.flatnonzero(_may_change(words))
    stems = pa.array(stem_all(words.take(pa.array(at)).cast(pa.string()).to_pylist()), pa.string()).cast(pa.binary())
    numbers = pa.concat_arrays([words, stems]).dictionary_encode().indices.to_numpy()
    found = numbers[: len(words)].copy()
    found[at] = numbers[len(words) :]
    return found


def porter_stem(tokens: Column, longer_than: int = 3) -> Column:
    """Stem the tokens of an array that have more than ``longer_than`` characters."""

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else stem_all(x, longer_than) for x in lists.to_pylist()], pa.list_(pa.string()))

    return stems(tokens)
