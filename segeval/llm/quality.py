"""Quality classifier: boosted trees over document statistics.

Statistics of whole texts are computed once and written to the scratch folder.
The trees are fitted on the driver on about ``SAMPLE`` labelled rows at most, chosen by
a hash of ``doc_id``; scoring runs on the executors.

Edge cases: a null text is an empty one and gets the score of all-zero statistics;
labels without a document, null labels and labels of a null ``doc_id`` are not
used; without labels of both kinds every score is the share of label 1 (a half
if there is none). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.llm.boosting import Forest, Settings, fit
from segeval.llm.statistics import NAMES, statistics
from segeval.scratch import materialize

#: Bound of the labelled rows that the trees are fitted on: beyond it, each row is chosen by a hash with this expected number.
SAMPLE = 30_000

#: Scores from here on predict label 1.
CUT = 0.3

HELD_OUT_PARTS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c != "__text"]
        values = np.array([statistics(t.as_py()) for t in batch.column("__text")], dtype=np.float64).reshape(-1, len(NAMES))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "statistics"])


def add_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``statistics``, an array of doubles in the order of ``NAMES``."""
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(_measured, f"{schema}, statistics array<double>")


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, settings: Settings = Settings()) -> Forest:
    """Fit on the labelled rows that are not held out. ``labels`` has ``doc_id`` and ``quality``."""
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("quality"))
    known = measured.join(marks, F.col("doc_id") == F.col("__id")).where(~held_out())
    known = materialize(known.select("doc_id", "statistics", "quality"), "labelled")
    count = known.count()
    if count > sample:
        known = known.where(_share("doc_id") < sample / count)
    return _fitted(known, settings)


def train_on_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, settings: Settings = Settings()) -> Forest:
    """Fit as ``train`` does, but choose about ``sample`` labels first, by a hash of ``doc_id``, and measure only their texts.

    Equal rows count once. Rows of one ``doc_id`` are chosen by a hash of their own where they are too many.
    """
    marks = labels.where("quality in (0, 1)").where(~held_out()).select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("quality"))
    marks = materialize(marks.where("__id is not null").distinct(), "labels")
    count = marks.count()
    chosen = marks.where(_share("__id") < sample / count) if count > sample else marks
    # About ``sample`` ids and labels at most, whatever the size of the tables.
    texts = docs.join(F.broadcast(chosen.select("__id").distinct()), F.col("doc_id") == F.col("__id"), "left_semi")
    known = add_statistics(texts, ["doc_id"]).distinct().join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    known = materialize(known.select("doc_id", "statistics", "quality"), "labelled")
    count = known.count()
    if count > sample:
        known = known.where(_share("doc_id", "statistics") < sample / count)
    return _fitted(known, settings)


def _share(*columns: str) -> Column:
    """A number from 0 to 1 that the columns fix."""
    return F.pmod(F.xxhash64(F.lit("fit"), *columns), F.lit(1 << 20)) / float(1 << 20)


def _fitted(known: DataFrame, settings: Settings) -> Forest:
    # Sums of doubles depend on the order, so the rows get a fixed one.
    table = known.select("doc_id", "quality", "statistics").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(table.column("statistics").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit(x, table.column("quality").to_numpy(), settings)


def score(measured: DataFrame, forest: Forest, keys: list[str]) -> DataFrame:
    """``keys`` and ``score``, the probability of label 1."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            arrays = [batch.column(c) for c in keys] + [pa.array(forest.predict(x))]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.select(*keys).schema)
    return measured.select(*keys, "statistics").mapInArrow(scored, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from trees fitted on the other documents' labels."""
    measured = materialize(add_statistics(docs, ["doc_id"]), "statistics")
    scores = score(measured, train(measured, labels, sample), ["doc_id"])
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
