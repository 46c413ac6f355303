"""Metric registry, scoring of text pairs, and joining scores back to their rows."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import score_column
from segeval.functions.worker import held
from segeval.operators import lexical
from segeval.operators.order import first_rows
from segeval.operators.profile import to_long
from segeval.scratch import materialize

# A metric maps the hypothesis, reference and source columns to a score column.
Metric = Callable[[Column, Column, Column], Column]

# A metric over the whole table maps (row_id and the three texts) to (row_id, score).
TableMetric = Callable[[DataFrame], DataFrame]

_METRICS: dict[str, Metric] = {}
_TABLE_METRICS: dict[str, TableMetric] = {}


def register_metric(name: str, metric: Metric) -> None:
    """Make a metric available by name. It may be built from SQL functions or a pandas or Arrow UDF."""
    _METRICS[name] = metric


def register_table_metric(name: str, metric: TableMetric) -> None:
    """Make a metric available by name that needs more than one row, such as corpus statistics. ``evaluate`` runs it."""
    _TABLE_METRICS[name] = metric


def unregister_metric(name: str) -> None:
    """Forget a metric; an unknown name is ignored."""
    _METRICS.pop(name, None)
    _TABLE_METRICS.pop(name, None)


def metric_names() -> list[str]:
    return [*_METRICS, *_TABLE_METRICS]


def is_table_metric(name: str) -> bool:
    return name in _TABLE_METRICS


def table_scores(df: DataFrame, name: str) -> DataFrame:
    """``(row_id, metric, score)`` of a metric over the whole table."""
    return _TABLE_METRICS[name](df).select("row_id", F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))


def select_metrics(requested: list[str] | None = None) -> list[str]:
    """Known names among the requested ones, in their order. Unknown ones are reported; none left is an error."""
    if requested is None:
        return metric_names()
    unknown = [m for m in requested if m not in metric_names()]
    if unknown:
        warnings.warn(f"unknown metrics are skipped: {unknown}; known: {metric_names()}", stacklevel=2)
    known = [m for m in requested if m in metric_names()]
    if not known:
        raise ValueError("no valid metrics specified")
    return known


register_metric("BLEU", lambda hyp, ref, src: lexical.bleu(hyp, ref))
register_metric("CHRF++", lambda hyp, ref, src: lexical.chrf_plus_plus(hyp, ref))
register_metric("WER", lambda hyp, ref, src: lexical.word_edit_score(hyp, ref))
register_metric("TER", lambda hyp, ref, src: lexical.translation_edit_score(hyp, ref))
register_metric("ROUGE", lambda hyp, ref, src: lexical.rouge_l(hyp, ref))


def spread_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Shuffle rows evenly before per-row work.

    Scoring a text costs far more than moving it, and input files or earlier
    joins may leave most texts in a few partitions. Rows are spread by their
    id, never by their text, so copies of one text do not meet.
    """
    # An explicit number keeps the partitions from being merged for their small size.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key) if key in df.columns else df.repartition(partitions)


def add_scores(
    df: DataFrame,
    metrics: list[str] | None = None,
    hypothesis: str = "targetText",
    reference: str = "referenceText",
    source: str = "sourceText",
    spread: bool = False,
) -> DataFrame:
    """Add one ``<metric>_score`` column per metric; all metrics share one pass over the texts.

    Rows are scored where they are. ``spread`` shuffles them, texts included, first; that is for input in a few
    partitions only, whose texts cost more to score than to move.
    """
    if spread:
        df = spread_rows(df)
    texts = [F.col(hypothesis), F.col(reference), F.col(source) if source in df.columns else F.lit(None).cast("string")]
    return df.select("*", *[_METRICS[m](*texts).cast("double").alias(score_column(m)) for m in select_metrics(metrics)])


def scores_once(
    df: DataFrame,
    metrics: list[str] | None = None,
    key: str = "row_id",
    hypothesis: str = "targetText",
    reference: str = "referenceText",
    source: str = "sourceText",
) -> DataFrame:
    """``key, scored_key`` and the score columns: rows with the same texts are scored once, as the row ``scored_key``.

    Texts are compared by their SHA-256, and no more than that is shuffled to find equal ones. The rows that need no
    scoring are then left out where the texts are: their ids are a written table, which Spark broadcasts if it
    is below the session's threshold; if it is larger, so is the work it saves. ``key`` must be unique.
    """
    present = [c for c in (hypothesis, reference, source) if c in df.columns]
    # Lengths keep texts apart, and a missing text differs from an empty one.
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in present]
    rows = materialize(df.select(key, F.unhex(F.sha2(F.concat(*parts), 256)).alias("digest")), "digests")
    firsts = materialize(rows.groupBy("digest").agg(F.min(key).alias("scored_key"), F.count("*").alias("rows")), "firsts")
    repeated = firsts.where("rows > 1").select("digest", "scored_key")
    others = materialize(rows.join(repeated, "digest").where(F.col(key) != F.col("scored_key")).select(key), "repeats")
    names = select_metrics(metrics)
    scored = add_scores(df.join(others, key, "left_anti"), names, hypothesis, reference, source)
    columns = [score_column(m) for m in names]
    scored = scored.select(F.col(key).alias("scored_key"), *columns)
    by_digest = materialize(firsts.drop("rows").join(scored, "scored_key"), "distinct-scores")
    return rows.join(by_digest, "digest").select(key, "scored_key", *columns)


def scores_long(df: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """``(keys, metric, score)`` from the wide score columns, under the metrics' own names."""
    renamed = df.select(*keys, *[F.col(score_column(m)).alias(m) for m in metrics])
    return to_long(renamed, metrics, keys)


def widen_scores(scores: DataFrame, metrics: list[str], key: str = "row_id") -> DataFrame:
    """Long scores to one row per key with a ``<metric>_score`` column for each listed metric."""
    wide = scores.groupBy(key).pivot("metric", metrics).agg(F.first("score"))
    return wide.select(key, *[F.col(f"`{m}`").alias(score_column(m)) for m in metrics])


def attach_scores(df: DataFrame, scores: DataFrame, metrics: list[str], key: str = "row_id") -> DataFrame:
    """Left join of long scores onto their rows by key; a row without a score gets NULL."""
    return df.join(widen_scores(scores, metrics, key), key, "left")


def _as_scores(output: Any, rows: int) -> list[float]:
    """Scores from the shapes models return: an object with ``scores``, an array or list, or one number for all."""
    values = np.asarray(getattr(output, "scores", output), dtype=float).reshape(-1)
    return (np.repeat(values, rows) if len(values) == 1 else values).tolist()


def model_score(
    hypothesis: Column,
    reference: Column,
    source: Column,
    load: Callable[[], Callable[[list[dict[str, str]]], Any]],
    batch_size: int = 8,
    on_failure: str = "fail",
) -> Column:
    """Score with a model: ``load`` returns a function over ``{src, mt, ref}`` rows.

    ``load`` runs once per Python worker, however many tasks the worker gets. ``on_failure="zero"`` scores the rows of a failing call 0.0 instead of failing the job.
    """
    if on_failure not in ("fail", "zero"):
        raise ValueError(f"unsupported failure policy: {on_failure}")

    # Functions reach the workers by value, so what they hold tells loaders apart.
    loader = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = held(("model", loader), load)
        for src, mt, ref in batches:
            rows = [{"src": s, "mt": h, "ref": r} for s, h, r in zip(src, mt, ref)]
            scores: list[float] = []
            for start in range(0, len(rows), batch_size):
                part = rows[start : start + batch_size]
                try:
                    scores += _as_scores(model(part), len(part))
                except Exception:
                    if on_failure == "fail":
                        raise
                    scores += [0.0] * len(part)
            yield pd.Series(scores, dtype="float64")

    return score(source, hypothesis, reference)


def fill_with_mean(scored: DataFrame, column: str = "score") -> DataFrame:
    """Replace missing scores by the mean of the present ones and mark them in ``is_imputed``.

    ``scored`` is read twice; write it first if it is costly to compute.
    """
    mean = scored.agg(F.avg(column)).scalar()
    return scored.withColumns({"is_imputed": F.col(column).isNull(), column: F.coalesce(column, mean)})


def score_first_rows(
    df: DataFrame, n: int, score: Callable[[DataFrame], DataFrame], key: str = "row_id", column: str = "score"
) -> DataFrame:
    """Score the ``n`` rows with the smallest keys; the other rows get the mean of those scores.

    ``score`` adds ``column``. The scored rows are written once, so a costly
    model runs once per row.
    """
    head = materialize(score(first_rows(df, n, key)), "scored")
    last = head.agg(F.max(key)).scalar()
    rest = df.where(F.col(key) > last).withColumn(column, F.lit(None).cast("double"))
    return fill_with_mean(head.unionByName(rest), column)
