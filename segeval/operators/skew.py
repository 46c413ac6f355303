"""Joins and windows that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.scratch import materialize

# Rows of a hot group are spread over this many shuffle groups.
SPREAD = 512


def spread_lane(columns: list[str]) -> Column:
    """Lane number from 1 that depends on the row's content only, so a retried task repeats it."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int") + 1


def join_written(big: DataFrame, small: DataFrame, key: str, how: str = "inner", name: str = "lookup") -> DataFrame:
    """Join ``big`` to ``small``, an aggregate with one row per ``key`` that is written first.

    Spark then knows the size of ``small`` and broadcasts it only if that is below
    the session's threshold. Otherwise both sides are shuffled by nothing but the
    join, which lets adaptive execution split the partition of a hot key; an
    aggregate joined in place would forbid that. ``small`` is also computed once only.
    """
    return big.join(materialize(small, name), key, how)
