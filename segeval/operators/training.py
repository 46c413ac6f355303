"""Training and validation tables for a learned metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import nan_to_null
from segeval.operators.ratings import keep_active_raters, require_columns

RENAMED = {"sourceText": "src", "targetText": "mt", "referenceText": "ref"}


def _z_score(df: DataFrame, column: str) -> Column:
    """Z-score over the whole table, by sample deviation; NULL if that is zero or undefined."""
    value = nan_to_null(F.col(column))
    stats = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
    return F.try_divide(value - stats["mean"], stats["std"])


def training_set(
    df: DataFrame,
    score: str = "llm_reference_based_score_noisy",
    drop: tuple[str, ...] = ("llm_reference_based_score",),
    language_pair: str = "en-ka",
    domain: str = "corp_dict",
) -> DataFrame:
    """Rename the texts, standardise ``score`` over the whole table and keep it as ``raw``."""
    require_columns(df, [*RENAMED, score])
    return (
        df.select("*", F.lit(language_pair).alias("lp"), _z_score(df, score).alias("score"))
        .withColumnsRenamed({**RENAMED, score: "raw"})
        .drop(*drop)
        .withColumns({"annotators": F.lit(0), "domain": F.lit(domain)})
    )


def validation_set(df: DataFrame, more_than: int = 5, rater: str = "createdBy_id", language_pair: str = "en-ka") -> DataFrame:
    """Keep raters with more than ``more_than`` rows and standardise their scores together."""
    require_columns(df, [*RENAMED, "score", rater])
    kept = keep_active_raters(df, more_than + 1, rater).withColumnRenamed("score", "raw")
    return kept.select("*", F.lit(language_pair).alias("lp"), _z_score(kept, "raw").alias("score")).withColumnsRenamed(RENAMED)
