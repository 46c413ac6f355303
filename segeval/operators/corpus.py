"""BLEU and chrF++ of whole groups of rows, from counts that add up.

The score of a group is not the mean of its rows' scores: matches and n-grams are
summed first. A row's counts are a short array, summed before any shuffle. Tables of
summed counts can be stored and added to later ones without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segeval.operators import lexical

# Count columns by score column: how a row is counted, how sums are scored, and how many counts there are.
CORPUS_SCORES = {
    "corpus_bleu": (lexical.bleu_counts, lexical.corpus_bleu, 2 * lexical.BLEU_ORDERS + 2),
    "corpus_chrfplusplus": (lexical.chrf_counts, lexical.corpus_chrf, 3 * (lexical.CHRF_CHARACTER_ORDERS + lexical.CHRF_WORD_ORDERS)),
}


def _sums(name: str) -> list[str]:
    return [f"{name}_{i}" for i in range(CORPUS_SCORES[name][2])]


def corpus_counts(
    df: DataFrame, by: list[str], scores: tuple[str, ...] = tuple(CORPUS_SCORES), hypothesis: str = "targetText", reference: str = "referenceText"
) -> DataFrame:
    """``by``, ``n_rows`` and the summed counts of the scores, one row per group. Rows without one of the texts do not count."""
    h, r = F.col(hypothesis), F.col(reference)
    counted = df.where(h.isNotNull() & r.isNotNull()).select(*by, *[CORPUS_SCORES[s][0](h, r).alias(s) for s in scores])
    sums = [F.sum(F.col(s)[i]).alias(c) for s in scores for i, c in enumerate(_sums(s))]
    return counted.groupBy(*by).agg(F.count("*").alias("n_rows"), *sums)


def add_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row per group from rows of ``corpus_counts``, such as those of several days, or of smaller groups."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts.columns if c == "n_rows" or c.startswith("corpus_")])


def corpus_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``n_rows`` and the scores whose counts are there."""
    present = [s for s in CORPUS_SCORES if set(_sums(s)) <= set(counts.columns)]
    return counts.select(*by, "n_rows", *[CORPUS_SCORES[s][1]([F.col(c) for c in _sums(s)]).alias(s) for s in present])
