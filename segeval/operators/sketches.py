"""Mergeable summaries of scores: quantiles, ranks and distinct values from small stored sketches.

``describe`` and ``exact_quantiles`` read all scores. A sketch is made once, per day or
per rater say, stored as a row, and merged with others without reading a score again.
Counts, minima, maxima and sums of a merged row are exact; quantiles and ranks are off by
at most ``rank_error(k)`` of all scores, and the number of distinct values by about
``distinct_error()`` of itself. NaN and NULL are no scores. A group without a score keeps
its row, with a count of 0 and NULL for all else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import nan_to_null

#: Size of a quantile sketch: about 3 k numbers, however many scores it has seen.
K = 800

#: Two to this power are the cells of a distinct sketch.
CELLS_LOG = 12


def rank_error(k: int = K) -> float:
    """Bound of the error of a rank, as a share of all scores, with a probability of 0.99 (Karnin, Lang and Liberty 2016)."""
    return 2.296 / k**0.9021


def distinct_error(cells_log: int = CELLS_LOG) -> float:
    """Three standard errors of the number of distinct values, relative to it."""
    return 3 * 1.04 / math.sqrt(1 << cells_log)


def sketch_scores(df: DataFrame, by: list[str], score: str = "score", k: int = K) -> DataFrame:
    """``by``, exact ``n``, ``total``, ``min``, ``max``, and the binaries ``quantiles`` and ``distinct``.

    Tasks sketch before they shuffle, so a hot group moves one sketch per task.
    """
    # Adding 0.0 turns -0.0 into 0.0, the same value.
    value = nan_to_null(F.col(score)) + F.lit(0.0)
    return df.select(*by, value.alias("__value")).groupBy(*by).agg(
        F.count("__value").alias("n"),
        F.sum("__value").alias("total"),
        F.min("__value").alias("min"),
        F.max("__value").alias("max"),
        F.kll_sketch_agg_double("__value", k).alias("quantiles"),
        F.hll_sketch_agg(F.when(F.col("__value").isNotNull(), F.xxhash64("__value")), CELLS_LOG).alias("distinct"),
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group from rows of ``sketch_scores``, such as those of several days, or of smaller groups."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def _of_scores(value: Column) -> Column:
    """NULL where a group has no score; an empty sketch is an error to ask."""
    return F.when(F.col("n") > 0, value)


def sketch_summary(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by``, ``n``, ``mean``, ``min``, ``max``, ``n_distinct`` and a quantile for each of ``shares``, by its name.

    A quantile is a score that occurs: the least one that at least the share of all scores do not exceed.
    """
    quantiles = [_of_scores(F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(name) for name, q in shares.items()]
    return sketches.select(
        *by,
        "n",
        _of_scores(F.col("total") / F.col("n")).alias("mean"),
        "min",
        "max",
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        *quantiles,
    )


def share_up_to(score: Column | float) -> Column:
    """Share of a sketch's scores that do not exceed ``score``, for use in a ``select`` over sketches."""
    asked = score if isinstance(score, Column) else F.lit(float(score))
    return _of_scores(F.kll_sketch_get_rank_double("quantiles", asked))
