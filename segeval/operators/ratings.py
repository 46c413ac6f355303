"""Assemble rated text pairs, filter raters and standardise their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import nan_to_null
from segeval.operators.skew import join_written
from segeval.scratch import materialize

TEXT_COLUMNS = ("sourceText", "targetText", "referenceText")
RATED_COLUMNS = ("score", "item_id", "createdBy_id", "sourceText", "targetText", "targetID")


def require_columns(df: DataFrame, columns) -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise ``ValueError`` if ``df`` is empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def join_ratings(ratings: DataFrame, text_pairs: DataFrame) -> DataFrame:
    """Inner join of rating rows to the text pair they rate (``item_id = id``)."""
    pairs = text_pairs.select(F.col("id").alias("item_id"), "sourceText", "targetText", "targetID")
    return ratings.select("score", "item_id", "createdBy_id").join(pairs, "item_id").select(*RATED_COLUMNS)


def _text_key(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def latest_references(references: DataFrame, key: str = "en", value: str = "ka", position: str = "pos") -> DataFrame:
    """``__text, __found, referenceText``: one reference per digest of a source text; of several, the one at the highest position."""
    return (
        references.where(F.col(key).isNotNull())
        .select(_text_key(key).alias("__text"), F.col(value).alias("referenceText"), F.col(position).alias("__position"))
        .groupBy("__text")
        .agg(F.lit(True).alias("__found"), F.max_by("referenceText", "__position").alias("referenceText"))
    )


def add_reference(
    pairs: DataFrame,
    references: DataFrame,
    key: str = "en",
    value: str = "ka",
    position: str = "pos",
    strict: bool = True,
) -> DataFrame:
    """Attach ``referenceText`` by source text.

    A source text without a reference fails the job in strict mode, when the
    row is read; otherwise it gets NULL. Texts are matched by their digest, so
    the shuffle key stays short.
    """
    keyed = pairs.withColumn("__text", _text_key("sourceText"))
    joined = join_written(keyed, latest_references(references, key, value, position), "__text", "left", "references")
    reference = F.col("referenceText")
    if strict:
        unknown = F.concat(
            F.lit("source text not found in reference data: "), F.coalesce("sourceText", F.lit("NULL"))
        )
        reference = F.when(F.col("__found"), reference).otherwise(F.raise_error(unknown))
    return joined.select(*pairs.columns, reference.alias("referenceText"))


def missing_references(pairs: DataFrame, references: DataFrame, key: str = "en") -> DataFrame:
    """Distinct source texts of ``pairs`` that have no reference, with their row counts."""
    keyed = pairs.withColumn("__text", _text_key("sourceText"))
    wanted = keyed.groupBy("__text").agg(F.first("sourceText").alias("sourceText"), F.count("*").alias("n_rows"))
    known = references.where(F.col(key).isNotNull()).select(_text_key(key).alias("__text")).distinct()
    return wanted.join(known, "__text", "left_anti").select("sourceText", "n_rows")


def drop_null_texts(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    """Keep rows whose required texts are all present."""
    require_columns(df, columns)
    return df.na.drop(subset=list(columns))


def rater_stats(df: DataFrame, rater: str = "createdBy_id", score: str = "score") -> DataFrame:
    """Per rater: rows, scored rows, mean, sample standard deviation, min and max. NULL raters are left out."""
    value = nan_to_null(F.col(score))
    return (
        df.where(F.col(rater).isNotNull())
        .groupBy(rater)
        .agg(
            F.count("*").alias("n_rows"),
            F.count(value).alias("n_scores"),
            F.avg(value).alias("mean_score"),
            F.stddev_samp(value).alias("std_score"),
            F.min(value).alias("min_score"),
            F.max(value).alias("max_score"),
        )
    )


def keep_active_raters(df: DataFrame, at_least: int, rater: str = "createdBy_id") -> DataFrame:
    """Rows of raters with at least ``at_least`` rows; rows without a rater go. No such rater is an error."""
    counts = df.where(F.col(rater).isNotNull()).groupBy(rater).agg(F.count("*").alias("n_rows"))
    kept = materialize(counts.where(F.col("n_rows") >= at_least).select(rater), "raters")
    require_rows(kept, f"no rater has at least {at_least} rows")
    return df.join(kept, rater, "left_semi").select(*df.columns)


def standardize_by_rater(
    df: DataFrame,
    at_least: int = 5,
    rater: str = "createdBy_id",
    score: str = "score",
    output: str = "standardized_score",
) -> DataFrame:
    """Drop raters with fewer than ``at_least`` rows and z-score the rest within each rater.

    A rater whose scores are all equal gets 0.0; a rater with one row or one
    score gets NULL. Without a rater column the score is passed through. No rater
    left is an error. The statistics are written when this is called.
    """
    if rater not in df.columns:
        return df.withColumn(output, nan_to_null(F.col(score)))
    stats = materialize(rater_stats(df, rater, score).where(F.col("n_rows") >= at_least), "rater-stats")
    require_rows(stats, f"no rater has at least {at_least} rows")
    joined = df.join(stats, rater)
    value = nan_to_null(F.col(score))
    z = (
        F.when(F.col("n_scores") < 2, F.lit(None).cast("double"))
        .when(F.col("min_score") == F.col("max_score"), F.lit(0.0))
        .otherwise((value - F.col("mean_score")) / F.col("std_score"))
    )
    return joined.select(*df.columns, z.alias(output))


def rater_audit(df: DataFrame, at_least: int = 5, rater: str = "createdBy_id") -> DataFrame:
    """One row: raters and rows before and after the filter, and what it removed."""
    counts = df.groupBy(rater).agg(F.count("*").alias("n"))
    known = F.col(rater).isNotNull()
    kept = known & (F.col("n") >= at_least)
    zero = F.lit(0).cast("long")
    return counts.agg(
        F.coalesce(F.sum("n"), zero).alias("rows_before"),
        F.count_if(known).alias("raters_before"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), zero).alias("rows_after"),
        F.count_if(kept).alias("raters_after"),
    ).select(
        "*",
        (F.col("raters_before") - F.col("raters_after")).alias("removed_raters"),
        (F.col("rows_before") - F.col("rows_after")).alias("removed_rows"),
        F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, F.col("rows_before")).alias("removed_percent"),
    )
