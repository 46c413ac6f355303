"""Sketches against exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from segeval.operators.sketches import distinct_error, merge_sketches, rank_error, share_up_to, sketch_scores, sketch_summary
from segeval.scratch import materialize

SHARES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}


def within(values, quantile, share):
    below = sum(v < quantile for v in values) / len(values)
    up_to = sum(v <= quantile for v in values) / len(values)
    return below - rank_error() <= share <= up_to + rank_error()


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(5)
    rows = [("smooth", i % 7, rng.gauss(0, 1)) for i in range(30_000)]
    rows += [("tied", i % 3, float(rng.randint(0, 4))) for i in range(9_000)]
    return rows + [("one", 0, 2.5)]


def test_merged_sketches_keep_their_error(spark, drawn):
    df = spark.createDataFrame(drawn, "metric string, day int, score double")
    stored = materialize(sketch_scores(df, ["metric", "day"]), "sketches")
    assert stored.count() == 7 + 3 + 1
    for r in sketch_summary(merge_sketches(stored, ["metric"]), ["metric"], SHARES).collect():
        values = [v for m, _, v in drawn if m == r.metric]
        assert (r.n, r.min, r.max) == (len(values), min(values), max(values))
        assert r.mean == pytest.approx(sum(values) / len(values))
        assert abs(r.n_distinct - len(set(values))) <= distinct_error() * len(set(values))
        assert all(within(values, r[name], share) for name, share in SHARES.items())


def test_a_third_merge_gives_the_same_counts(spark, drawn):
    df = spark.createDataFrame(drawn, "metric string, day int, score double")
    days = merge_sketches(sketch_scores(df, ["metric", "day"]), ["day"])
    assert days.count() == 7
    whole = sketch_summary(merge_sketches(days.withColumn("all", F.lit(1)), ["all"]), ["all"], SHARES).first()
    values = [v for _, _, v in drawn]
    assert whole.n == len(values) and all(within(values, whole[name], share) for name, share in SHARES.items())


def test_shares(spark, drawn):
    df = spark.createDataFrame(drawn, "metric string, day int, score double")
    got = {r.metric: r.share for r in sketch_scores(df, ["metric"]).select("metric", share_up_to(1.0).alias("share")).collect()}
    for metric, share in got.items():
        values = [v for m, _, v in drawn if m == metric]
        assert abs(share - sum(v <= 1.0 for v in values) / len(values)) <= rank_error()


def test_no_scores(spark):
    rows = [("none", None), ("none", float("nan")), ("some", 1.0), ("some", None), ("zero", 0.0), ("zero", -0.0)]
    df = spark.createDataFrame(rows, "metric string, score double")
    sketches = merge_sketches(sketch_scores(df, ["metric"]), ["metric"])
    got = {r.metric: (r.n, r["mean"], r.n_distinct, r.p50) for r in sketch_summary(sketches, ["metric"], SHARES).collect()}
    assert got == {"none": (0, None, 0, None), "some": (1, 1.0, 1, 1.0), "zero": (2, 0.0, 1, 0.0)}
    nothing = sketch_summary(sketch_scores(df.limit(0), ["metric"]), ["metric"], SHARES)
    assert nothing.count() == 0
