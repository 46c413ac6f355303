"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A store keeps, for each line key, the number of documents that hold it and the
largest ``doc_id`` among them. It takes documents in batches. A batch's keys are
anti-joined with the runs, which tells the new keys from the known ones, and both
go into a run of the batch's own, sorted by hash. Runs of one level are merged into
one of the next when there are ``FANOUT`` of them, so a key is rewritten a
logarithmic number of times and a lookup meets few runs.

Edge cases: a null or empty text is one empty line; a document counts once for a
key however often it holds it, and rows of equal ``doc_id`` are one document. A row
without ``doc_id`` does not count, and loses the lines that are dropped elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import let
from segeval.scratch import materialize

#: Keys of at least so many code points in at least so many documents are dropped.
LEAST_CHARS = 40
LEAST_DOCS = 5

BATCHES = 4
FANOUT = 2

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    # Lower-casing touches A-Z only where all is ASCII, and is much faster there.
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, pos, h1, h2`` of the lines whose keys are long enough. ``mark`` tells texts of a document apart."""
    lines = docs.select(
        F.col("doc_id"), F.xxhash64(_text()).alias("mark"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= LEAST_CHARS)
    # Two hashes from different seeds make up 128 bits.
    return keyed.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The levelled runs: rows of ``h1, h2, docs, keeper, fresh``; ``fresh`` marks a key's first run."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.sortWithinPartitions("h1", "h2"), name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.union(run)
        return rows.groupBy("h1", "h2").agg(
            F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh")
        )

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of ``doc_id, h1, h2``. A document must be in one batch only."""
        batch = hashes.where("doc_id is not null").select("doc_id", "h1", "h2").distinct()
        counts = batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        known = None
        for run in self.runs():
            keys = run.where("fresh").select("h1", "h2")
            known = keys if known is None else known.union(keys)
        if known is None:
            added = counts.withColumn("fresh", F.lit(True))
        else:
            counts = materialize(counts, "batch")
            new = counts.join(known, ["h1", "h2"], "left_anti").withColumn("fresh", F.lit(True))
            old = counts.join(known, ["h1", "h2"], "left_semi").withColumn("fresh", F.lit(False))
            added = new.union(old)
        self._place(self._write(added, "run-0"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merged(self.levels[level]), f"run-{level + 1}")
            self.levels[level] = []
            self._place(merged, level + 1)

    def frequent(self, least_docs: int) -> DataFrame:
        """``h1, h2, keeper`` of the keys in at least so many documents."""
        return self._merged(self.runs()).where(F.col("docs") >= least_docs).select("h1", "h2", "keeper")


def drop_repeated_lines(docs: DataFrame, columns: list[str], batches: int = BATCHES) -> DataFrame:
    """``columns`` of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text that is left.

    Lines whose key is long enough and in enough documents go, except in the largest ``doc_id`` that holds it.
    Only line numbers meet the texts again: one shuffle carries texts.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    hashes = materialize(line_hashes(docs).withColumn("batch", batch), "lines")
    store = LineRuns()
    for number in range(batches):
        store.add(hashes.where(F.col("batch") == number))
    frequent = materialize(store.frequent(LEAST_DOCS), "frequent")
    repeated = hashes.join(frequent, ["h1", "h2"]).where("doc_id is null or doc_id < keeper")
    drops = repeated.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    drops = materialize(drops.toDF("__id", "__mark", "__drop"), "drops")
    texts = docs.select(*columns, F.col("doc_id").alias("__doc"), _text().alias("__text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__mark"))
    joined = texts.join(drops, same, "left")

    def remaining(lines: Column) -> Column:
        """The lines between dropped ones, gap by gap, so that the work grows with the number of lines."""
        begins = F.concat(F.array(F.lit(0)), F.transform("__drop", lambda place: place + 1))
        ends = F.concat("__drop", F.array(F.size(lines)))
        gaps = F.transform(F.arrays_zip(begins, ends), lambda g: F.slice(lines, g["0"] + 1, g["1"] - g["0"]))
        return F.array_join(F.flatten(gaps), "\n")

    return joined.select(
        *columns,
        F.size(F.split("__text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.isnull("__drop"), F.col("__text")).otherwise(let(F.split("__text", "\n"), remaining)).alias("kept"),
    )
