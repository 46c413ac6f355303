"""Ranks, quantiles and correlations against brute force, for both ways of summing up."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segeval.functions import significance
from segeval.operators import correlation, grouped, order
from segeval.operators.correlation import correlations, group_correlations, inversion_weight, kendall, pearson, spearman

# Published agreement of seven metrics with 400 human ratings: coefficients and p-values.
PUBLISHED = {
    "BLEU": (0.41253725916627315, 0.4970869658576367, 0.34367144072659206, 7.214194179751286e-18, 2.3620535583474933e-26, 1.4756230459261417e-24),
    "CHRF++": (0.7393956529935526, 0.6902891557716426, 0.49754460679680124, 2.2468825751296902e-70, 6.70001707737081e-58, 1.2400540291370285e-49),
    "TER": (0.4663163143501393, 0.4426484084662219, 0.31060868163736044, 5.470521049337105e-23, 1.2705131767665172e-20, 1.2554129545849973e-19),
    "ROUGE": (0.11363267703473415, 0.06332186374025343, 0.04825391774726266, 0.023031736869825473, 0.2063224657730854, 0.20990548503916795),
    "COMET": (0.8668976464904077, 0.7587276552650158, 0.5635619744436586, 2.1347252175289784e-122, 4.308881050536059e-76, 3.6292544334234776e-63),
    "LLM-Reference-Based": (0.8520635609111975, 0.7981336101142978, 0.6597472378104414, 6.0162169037158386e-114, 1.307201925985514e-89, 2.2286674368190174e-69),
    "LLM-Reference-Free": (0.8253995552618525, 0.7640025996513699, 0.6225510605804014, 7.274597187008529e-101, 9.544242353328977e-78, 5.663168285914872e-66),
}


def brute(x, y):
    i, j = np.triu_indices(len(x), 1)
    dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    tau = (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    return np.corrcoef(x, y)[0, 1], np.corrcoef(rx, ry)[0, 1], tau, int((dx * dy < 0).sum())


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    out = {}
    for name, (n, vx, vy) in {"ties": (300, 5, 400), "free": (250, 10**6, 10**6), "tiny": (20, 10**6, 10**6), "binary": (250, 3, 2)}.items():
        out[name] = rng.integers(0, vx, n).astype(float), rng.integers(0, vy, n).astype(float)
    # A third of the rows share one value on either side.
    x, y = rng.integers(0, 90, 1500).astype(float), rng.integers(0, 70, 1500).astype(float)
    out["hot"] = np.where(rng.random(1500) < 0.35, 40, x), np.where(rng.random(1500) < 0.35, 3, y)
    return out


@pytest.fixture(scope="module")
def long_table(spark, samples):
    rows = [(m, float(a), float(b)) for m, (x, y) in samples.items() for a, b in zip(x, y)]
    rows += [("ties", None, 1.0), ("ties", float("nan"), 2.0), ("ties", 1.0, float("inf"))]
    return spark.createDataFrame(rows, "metric string, score double, human double")


@pytest.mark.parametrize("rows_per_bin", [40, 1 << 17], ids=["many bins", "few bins"])
def test_coefficients_equal_brute_force(long_table, samples, monkeypatch, rows_per_bin):
    monkeypatch.setattr(correlation, "ROWS_PER_BIN", rows_per_bin)
    got = {r.metric: r for r in correlations(long_table.repartition(3)).collect()}
    pairs = {r.metric: r for r in kendall(long_table).collect()}
    assert set(got) == set(samples)
    for name, (x, y) in samples.items():
        r, rho, tau, discordant = brute(x, y)
        assert (got[name].pearson, got[name].spearman, got[name].kendall) == pytest.approx((r, rho, tau), abs=1e-12)
        assert got[name].n == len(x)
        assert pairs[name].discordant == discordant


def test_single_coefficients(long_table, samples):
    p = {r.metric: r.pearson for r in pearson(long_table).collect()}
    s = {r.metric: r.spearman for r in spearman(long_table).collect()}
    for name, (x, y) in samples.items():
        assert (p[name], s[name]) == pytest.approx(brute(x, y)[:2], abs=1e-12)


def test_guards_and_small_samples(spark):
    data = {
        "constant": [(1, 1), (1, 2), (1, 3)],
        "one": [(1, 1), (None, 2)],
        "line": [(1, 2), (2, 4), (3, 6)],
        "known": [(1, 1), (2, 2), (2, 3), (3, 3)],
        "two": [(1, 5), (2, 6)],
    }
    rows = [(m, None if a is None else float(a), float(b)) for m, pairs in data.items() for a, b in pairs]
    df = spark.createDataFrame(rows, "metric string, score double, human double")
    listed = spark.createDataFrame([(m,) for m in [*data, "unseen"]], "metric string")
    got = {r.metric: r for r in correlations(df, listed).collect()}
    for name in ("constant", "one", "unseen"):
        assert list(got[name])[2:] == [None] * 6
    assert list(got["line"])[2:5] == pytest.approx([1, 1, 1])
    assert got["line"].p_value_kendall == pytest.approx(1 / 3)
    assert got["known"].kendall == pytest.approx(0.8)
    assert (got["two"].pearson, got["two"].p_value_pearson) == pytest.approx((1.0, 1.0))
    assert got["two"].p_value_spearman is None


def test_published_p_values():
    for r, rho, _, p_r, p_rho, _ in PUBLISHED.values():
        assert significance.two_sided_t(r, 400) == pytest.approx(p_r, rel=1e-11)
        assert significance.two_sided_t(rho, 400) == pytest.approx(p_rho, rel=1e-11)


def test_p_values_of_huge_samples_stay_precise():
    # For large n the t distribution meets the normal one.
    n = 10**11
    r = 2.5 / math.sqrt(n)
    assert significance.two_sided_t(r, n) == pytest.approx(math.erfc(2.5 / math.sqrt(2)), rel=1e-6)


def test_exact_kendall_counts_permutations():
    from itertools import permutations

    for n in (3, 4, 5, 6):
        counts = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
        total = n * (n - 1) // 2
        for d in range(total + 1):
            tail = min(d, total - d)
            want = min(1.0, 2 * sum(c <= tail for c in counts) / len(counts))
            assert significance.exact_kendall(n, d) == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4), st.integers(0, 2)), min_size=1, max_size=40))
def test_inversion_weight(rows):
    a, b, w, g = (np.array(c) for c in zip(*rows))
    want = sum(
        w[i] * w[j] for i in range(len(a)) for j in range(len(a)) if g[i] == g[j] and a[i] < a[j] and b[i] > b[j]
    )
    assert inversion_weight(a, b, w.astype(float), g) == want


def test_spearman_ignores_monotone_maps(long_table):
    from pyspark.sql import functions as F

    before = {r.metric: r.spearman for r in spearman(long_table).collect()}
    after = {r.metric: r.spearman for r in spearman(long_table.withColumn("score", F.exp(F.col("score") / 1e6))).collect()}
    assert before == pytest.approx(after)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    for values in (rng.random(501), rng.integers(0, 7, 400).astype(float), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        got = order.exact_quantiles(df, "v", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}).first()
        assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))


@pytest.mark.parametrize("n", [0, 1, 40, 499, 500, 900])
def test_first_rows(spark, n):
    df = spark.range(500).selectExpr("id * 7 AS row_id", "id").repartition(5)
    assert sorted(r.row_id for r in order.first_rows(df, n, "row_id").collect()) == [7 * i for i in range(min(n, 500))]


@pytest.mark.parametrize("rows_at_once", [7, 1 << 16])
@pytest.mark.parametrize("group_rows", [120, 1 << 17])
def test_many_groups(spark, monkeypatch, rows_at_once, group_rows):
    monkeypatch.setattr(grouped, "ROWS_AT_ONCE", rows_at_once)
    monkeypatch.setattr(correlation, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(8)
    groups = {(m, r): (rng.integers(0, 6, n).astype(float), rng.integers(0, 9, n).astype(float)) for m in "ab" for r, n in ((None, 30), (1, 2), (2, 1), (3, 300), (4, 40))}
    groups["b", 5] = (np.ones(20), rng.random(20))
    rows = [(m, r, float(x), float(y)) for (m, r), pairs in groups.items() for x, y in zip(*pairs)] + [("a", 9, None, 1.0), ("a", 1, float("nan"), 2.0)]
    table = spark.createDataFrame(rows, "metric string, rater int, score double, human double").repartition(4)
    got = {(r.metric, r.rater): r for r in group_correlations(table, ["metric", "rater"]).collect()}
    assert set(got) == set(groups)
    whole = {r.metric: r for r in correlations(table.selectExpr("concat(metric, coalesce(cast(rater AS string), 'null')) AS metric", "score", "human")).collect()}
    for (m, r), (x, y) in groups.items():
        row, one = got[m, r], whole[f"{m}{'null' if r is None else r}"]
        assert row.n == len(x)
        for name in correlation.RESULT_COLUMNS[2:]:
            assert row[name] == (None if one[name] is None else pytest.approx(one[name], abs=1e-12)), (m, r, name)
        if len(x) > 2 and r != 5:
            assert (row.pearson, row.spearman, row.kendall) == pytest.approx(brute(x, y)[:3], abs=1e-12)


def test_no_groups(spark):
    empty = spark.createDataFrame([], "metric string, rater int, score double, human double")
    assert group_correlations(empty, ["metric", "rater"]).collect() == []
