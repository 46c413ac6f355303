"""From rated texts to ranked metrics."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import score_column
from segeval.functions.significance import significance_class
from segeval.operators.correlation import COEFFICIENTS, correlations
from segeval.operators.profile import metric_summary
from segeval.operators.ranking import average_correlation, with_ordinal
from segeval.operators.ratings import TEXT_COLUMNS, drop_null_texts, require_rows, standardize_by_rater
from segeval.operators.scoring import add_scores, is_table_metric, scores_long, scores_once, select_metrics, table_scores
from segeval.scratch import materialize
from segeval.sources.csv import write_csv
from segeval.sources.scores import add_to_store, read_store, write_summary


HUMAN_DIGITS = 12


@dataclass
class Evaluation:
    """Results of a run. ``scores`` is written to the scratch folder; ``failed`` has the error of each metric left out."""

    metrics: list[str]
    scores: DataFrame
    correlations: DataFrame
    summary: DataFrame
    failed: dict[str, str] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """One row per metric: coefficients, p-values, their average and the significance class."""
        p_values = [F.col(f"p_value_{c}") for c in COEFFICIENTS]
        return self.correlations.select(
            "*",
            average_correlation().alias("avg_correlation"),
            F.least(*p_values).alias("min_p_value"),
            significance_class(*p_values).alias("significance"),
        )

    def wide(self) -> DataFrame:
        """``(row_id, human_score, <metric>_score ...)``."""
        of_metric = [F.first(F.when(F.col("metric") == m, F.col("score")), ignorenulls=True).alias(score_column(m)) for m in self.metrics]
        return self.scores.groupBy("row_id").agg(F.first("human").alias("human_score"), *of_metric)

    def save(self, data_path: str, summary_path: str, available: list[str]) -> None:
        """Write the wide table as CSV and the summary as JSON, to two separate paths."""
        write_csv(self.wide().drop("row_id"), data_path)
        write_summary(self.correlations, self.summary, available, self.metrics, summary_path)


def _fill_store(texts: DataFrame, names: list[str], store: str, spread: bool, once: bool) -> None:
    """Score the rows that a score store lacks, one metric after the other, each with a commit of its own."""
    spark = texts.sparkSession
    ids = texts.select("row_id")
    for name in names:
        # Only ids are compared with what is there; texts stay where they are if all of a metric's rows are open.
        stored = read_store(spark, store).where(F.col("metric") == name).select("row_id")
        if stored.isEmpty():
            todo = texts
        else:
            left = materialize(ids.join(stored, "row_id", "left_anti"), "open-rows")
            if left.isEmpty():
                continue
            todo = texts.join(left, "row_id", "left_semi")
        # A metric over the whole table always sees all of it.
        scored = table_scores(texts, name).join(todo.select("row_id"), "row_id", "left_semi") if is_table_metric(name) else _row_scores(todo, [name], spread, once)
        add_to_store(scored, store)


def _row_scores(texts: DataFrame, names: list[str], spread: bool, once: bool) -> DataFrame:
    """``row_id, metric, score`` of metrics that look at one row at a time."""
    scored = scores_once(texts, names) if once else add_scores(texts, names, spread=spread)
    return scores_long(scored, names, ["row_id"])


def _written_scores(
    texts: DataFrame, human: DataFrame, names: list[str], spread: bool, once: bool = False, store: str | None = None
) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Long scores with the human ones, the metrics that worked, and the errors of the others.

    All metrics share one pass over the texts. If it fails, each metric gets a
    pass of its own, and one that fails again is reported and left out.
    """

    def written(some: list[str]) -> DataFrame:
        # Texts stay where they are; ids and scores alone are shuffled to meet the human scores.
        if store is not None:
            _fill_store(texts, some, store, spread, once)
            wanted = read_store(texts.sparkSession, store).where(F.col("metric").isin(some))
            # Only rows that are complete now count, also if the store has more.
            wanted = wanted.join(texts.select("row_id"), "row_id", "left_semi")
            return materialize(human.join(wanted, "row_id").select("row_id", "human", "metric", "score"), "metric-scores")
        by_row = [m for m in some if not is_table_metric(m)]
        parts = []
        if by_row:
            scored = scores_once(texts, by_row) if once else add_scores(texts, by_row, spread=spread).drop(*TEXT_COLUMNS)
            parts.append(scores_long(scored.join(human, "row_id"), by_row, ["row_id", "human"]))
        parts += [human.join(table_scores(texts, m), "row_id").select("row_id", "human", "metric", "score") for m in some if m not in by_row]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return materialize(table, "metric-scores")

    try:
        return written(names), names, {}
    except PySparkException as error:
        if len(names) == 1:
            raise ValueError(f"no metric could be scored; {names[0]}: {error}") from error
    parts, failed = {}, {}
    for name in names:
        try:
            parts[name] = written([name])
        except PySparkException as error:
            failed[name] = str(error)
            warnings.warn(f"{name} failed and is left out: {error}", stacklevel=3)
    if not parts:
        raise ValueError(f"no metric could be scored: {failed}")
    first, *others = parts.values()
    for part in others:
        first = first.unionByName(part)
    return first, list(parts), failed


def evaluate(
    rated: DataFrame,
    metrics: list[str] | None = None,
    at_least: int = 5,
    extra_scores: DataFrame | None = None,
    extra_metrics: tuple[str, ...] = (),
    spread: bool = False,
    once: bool = False,
    store: str | None = None,
) -> Evaluation:
    """Standardise ratings per rater, score all rows, and correlate each metric with the ratings.

    ``rated`` has a unique ``row_id``, ``score``, the three texts and usually
    ``createdBy_id``. ``extra_scores`` holds ``(row_id, metric, score)`` of the
    ``extra_metrics``, computed elsewhere, such as judge or model scores. A metric
    that fails is reported and left out; no rater, no complete row or no metric
    left is an error. ``spread`` shuffles the texts before they are scored, for
    input in a few partitions only. ``once`` scores rows with the same texts once. ``store`` is the path of a score
    store: scores that it holds are taken from there, and new ones are added metric by metric, so that a run goes on
    where an earlier one ended.
    """
    names = select_metrics(metrics)
    # Raters are judged by all their rows, also those whose texts are incomplete.
    # Only ids and scores are shuffled for that.
    ids = [c for c in ("row_id", "createdBy_id", "score") if c in rated.columns]
    human = standardize_by_rater(rated.select(*ids), at_least).select(
        "row_id",
        # Scores of different raters that are equal on paper may differ in their
        # last bits, depending on the order of summation. Rounding keeps them tied.
        F.round("standardized_score", HUMAN_DIGITS).alias("human"),
    )
    texts = drop_null_texts(rated.select("row_id", *TEXT_COLUMNS))
    scores, names, failed = _written_scores(texts, materialize(human, "human-scores"), names, spread, once, store)
    require_rows(scores, "no row has all texts and a rater who is kept")
    if extra_scores is not None:
        extra = extra_scores.where(F.col("metric").isin(*extra_metrics)).select("row_id", "metric", "score")
        scores = scores.unionByName(human.join(extra, "row_id").select(*scores.columns))
        scores = materialize(scores, "metric-scores")
        names = names + [m for m in extra_metrics if m not in names]
    listed = scores.sparkSession.createDataFrame([(m,) for m in names], "metric string")
    table = with_ordinal(correlations(scores, listed), names)
    return Evaluation(names, scores, table, metric_summary(scores), failed)
