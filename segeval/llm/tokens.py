"""Token ids of whole texts by a public tokenizer file, with the words a worker has met kept in memory.

Byte-level BPE cuts a text before every single space and around every single
line break, and never merges across such a cut. So the ids of a text are the ids
of its words in turn, and each distinct word needs to be encoded only once. A
text with other white space (runs, tabs, no-break spaces) is encoded in one piece.
"""

from __future__ import annotations

import os
import string
import sys
import types
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id written after each document.
END_ID = 2

#: Words that a worker keeps for good, and words that it keeps until that many more have come.
KEPT_WORDS = 200_000
PASSING_WORDS = 200_000

#: New words that are encoded as one text.
WORDS_A_TEXT = 64

#: Marks at a word's end that are looked up apart.
MARKS = ".,"

#: Characters of text that are cut into words at a time.
CHUNK_CHARS = 2_000_000

# ASCII white space other than single blanks and line breaks between words (fixed values).
_LETTERS = frozenset(string.ascii_letters)
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_ASCII_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


def _plain(text: str) -> bool:
    """Whether every white space is one blank or line break between two words."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    odd = any(s in text for s in _PAIRS) or any(s in text for s in _ASCII_SPACE)
    if odd or text.isascii():
        return not odd
    # No other white space of Unicode, and not the one character that older tables count as white space.
    return len(text.split()) == text.count(" ") + text.count("\n") + 1 and "\u180e" not in text


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the workers side by side
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kept: dict[str, bytes] = {}
        self._passing: list[str] = []
        (self._break,) = self._tokenizer.encode("\n", add_special_tokens=False).ids
        # Marks that are cut off after a letter: a word and its mark are encoded apart, so that fewer words are kept.
        self._marks = {m: self._whole(m) for m in MARKS if self._is_cut_off(m)}
        # A vocabulary with added tokens could join words; then every text is encoded whole.
        self._added = tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())

    def _is_cut_off(self, mark: str) -> bool:
        cutter = self._tokenizer.pre_tokenizer
        return cutter is not None and [at for _, at in cutter.pre_tokenize_str(f" a{mark} b\na{mark}\n")] == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7), (7, 8), (8, 9)]

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. A word stands for itself after a blank, or after the line break it starts with."""
        lines = [w if w[0] == "\n" else "\n " + w for w in words]
        texts = ["".join(lines[i : i + WORDS_A_TEXT]) for i in range(0, len(lines), WORDS_A_TEXT)]
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        starts = np.flatnonzero(ids == self._break)
        if len(starts) != len(words):
            raise ValueError("the tokenizer does not cut texts at line breaks")
        ends = np.append(starts[1:], len(ids))
        raw = ids.tobytes()
        for word, a, b in zip(words, starts.tolist(), ends.tolist()):
            self._kept[word] = raw[4 * (a if word[0] == "\n" else a + 1) : 4 * b]
        if len(self._kept) > KEPT_WORDS + len(self._passing):
            self._passing += words

    def _forget(self) -> None:
        if len(self._passing) > PASSING_WORDS:
            for word in self._passing:
                self._kept.pop(word, None)
            self._passing = []

    def _chunk(self, texts: list[str]) -> list[bytes]:
        # The first word of a text has nothing before it: it is encoded as after a line break, which goes again.
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        bare = [w[:-1] if w[-1:] in self._marks and w[-2:-1] in _LETTERS else w for w in words]
        missing = {w for w in bare if w not in self._kept}
        if missing:
            self._learn(list(missing))
        kept, marks = self._kept, self._marks
        found = [kept[b] if b is w else kept[b] + marks[w[-1]] for w, b in zip(words, bare)]
        self._forget()
        sizes = np.array([len(ids) // 4 for ids in found])
        starts = np.cumsum(sizes) - sizes
        # The ids of each distinct word go to all its places.
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        place = np.repeat(starts[which] - ends + lengths, lengths) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(found), dtype="<u4")[place].tobytes()
        bounds = np.append(0, ends)[cut.offsets.to_numpy()].tolist()
        return [raw[4 * (a + 1) : 4 * b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        chunk: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if chunk:
                out.extend(self._chunk(chunk))
            chunk.clear()
            size = 0

        for text in texts:
            if _plain(text) and not any(a in text for a in self._added):
                chunk.append(text)
                size += len(text)
                if size >= CHUNK_CHARS:
                    flush()
            else:
                flush()
                out.append(self._whole(text))
        flush()
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, loaded once per Python worker."""
    held = sys.modules.setdefault("_segeval_encoders", types.ModuleType("_segeval_encoders"))
    if not hasattr(held, "by_path"):
        held.by_path = {}
    if path not in held.by_path:
        held.by_path[path] = WordEncoder(path)
    return held.by_path[path]
