"""Prompt rendering and score parsing for judge models."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a score is looked for, in this order. Digits are ASCII here, because digits of other
# scripts are translated before; an optional part after the number would not change what is found, and is left out.
SCORE_PATTERNS = (
    r"\b([0-9]{1,3}(?:\.[0-9]+)?)\b",
    r"Score:\s*([0-9]{1,3}(?:\.[0-9]+)?)",
    r"([0-9]{1,3}(?:\.[0-9]+)?)",
)


def _other_digits() -> tuple[str, str]:
    """All decimal digits outside ASCII, and the ASCII digits they stand for."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def extract_score(answer: Column) -> Column:
    """Score between 0 and 100 in a free-text answer; more than 100 counts as 100, none as 0."""
    plain = F.when(answer.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(answer, *_other_digits())).otherwise(answer)
    found = [F.nullif(F.regexp_extract(plain, "(?U)" + p, 1), F.lit("")) for p in SCORE_PATTERNS]
    return F.least(F.coalesce(F.coalesce(*found).try_cast("double"), F.lit(0.0)), F.lit(100.0))


def render_prompt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders; the inserted texts are never searched for placeholders themselves.

    NULL if any used value is NULL.
    """
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    columns = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*columns)
