"""Tokenisers as chains of built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware whitespace splitting removes, the plain blank aside.
OTHER_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Rewrite rules of the mteval-v13a tokeniser, applied in this order.
TOKENS_13A = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
# The tokeniser's first class holds the blank as well. It is left out here: padding a blank with blanks changes
# nothing once blanks are squeezed, and matching every blank of a text takes most of the time.
SPLITS_13A = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]

# ASCII punctuation split off the ends of a chrF word.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim both ends."""
    # Characters are mapped without a pattern; single blanks, by far the most common case, are not matched at all.
    blanks = F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))
    return F.trim(F.regexp_replace(blanks, "  +", " "))


def words(text: Column) -> Column:
    """Whitespace tokens; an empty text gives an empty array."""
    clean = squeeze(text)
    return F.filter(F.split(clean, " "), lambda t: t != "")


def bleu_text(text: Column) -> Column:
    """Text as 13a tokens joined by single blanks, case kept."""
    out = F.rtrim(text, F.lit(" " + OTHER_SPACES))
    for old, new in TOKENS_13A:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, new in SPLITS_13A:
        out = F.regexp_replace(out, pattern, new)
    return squeeze(out)


def chrf_characters(text: Column) -> Column:
    """Text without any whitespace."""
    return F.translate(text, " " + OTHER_SPACES, "")


def chrf_text(text: Column) -> Column:
    """Words joined by blanks, with one punctuation mark split off the end, else the start."""
    out = squeeze(text)
    # A trailing mark wins over a leading one, so a word split at its end is
    # marked with a control character (whitespace was squeezed, it cannot occur).
    out = F.regexp_replace(out, rf"(?<=[^ ])({PUNCTUATION})(?= |$)", "\u001c$1")
    out = F.regexp_replace(out, rf"(?<= |^)({PUNCTUATION})(?=[^ \x1C]+(?: |$))", "$1\u001c")
    return F.replace(out, F.lit("\u001c"), F.lit(" "))


def edit_words(text: Column) -> Column:
    """Lower-cased whitespace tokens, punctuation kept."""
    return words(F.lower(text))


def rouge_words(text: Column, unicode_tokens: bool = False) -> Column:
    """Lower-cased alphanumeric tokens.

    The default keeps only ``a-z0-9``: other letters vanish, which is how the
    standard scorer behaves. ``unicode_tokens`` keeps letters and digits of any script.
    """
    spaced = spaced_words(text) if unicode_tokens else F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def spaced_words(text: Column) -> Column:
    """Lower-cased text with a blank for all that is no letter, mark or digit of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
