"""Rankings of the published results, summaries and histograms."""

import json

import numpy as np
import pytest

from segeval.operators import profile, ranking
from segeval.sources import scores as score_io
from tests.test_agreement import PUBLISHED

NAMES = list(PUBLISHED)


@pytest.fixture(scope="module")
def published(spark):
    columns = "metric string, pearson double, spearman double, kendall double, p_value_pearson double, p_value_spearman double, p_value_kendall double"
    return ranking.with_ordinal(spark.createDataFrame([(m, *v) for m, v in PUBLISHED.items()], columns), NAMES)


def test_best_metrics(published):
    assert tuple(ranking.best_metrics(published).first()) == ("COMET", *["LLM-Reference-Based"] * 3)


def test_top_three(published):
    top = [(r.metric, round(r.avg_correlation, 3)) for r in ranking.top_metrics(published).collect()]
    assert top == [("LLM-Reference-Based", 0.770), ("LLM-Reference-Free", 0.737), ("COMET", 0.730)]


def test_significance(published):
    classes = {r.metric: r.significance for r in ranking.significance(published).collect()}
    assert classes.pop("ROUGE") == "marginally_significant"
    assert set(classes.values()) == {"highly_significant"}


def test_missing_coefficients_and_ties(spark):
    rows = [("b", 0.5, None, 0.1, 0.2), ("a", 0.5, None, 0.1, 0.004), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, "metric string, pearson double, spearman double, kendall double, p double")
    for c in ranking.COEFFICIENTS:
        df = df.withColumn(f"p_value_{c}", df.p)
    df = ranking.with_ordinal(df.drop("p"), ["b", "a", "none"])
    assert tuple(ranking.best_metrics(df).first()) == ("b", None, "b", "b")
    assert [r.metric for r in ranking.top_metrics(df).collect()] == ["b", "a"]
    assert ranking.top_metrics(df).first().avg_correlation == pytest.approx(0.3)
    classes = {r.metric: r.significance for r in ranking.significance(df).collect()}
    assert classes == {"b": "not_significant", "a": "significant", "none": None}


def test_summaries(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 4.0), (3, 6.0, float("nan"))], "row_id long, a double, b double")
    long = profile.to_long(df, ["a", "b"], ["row_id"])
    pop = {r.metric: r for r in profile.metric_summary(long).collect()}
    samp = {r.column_name: r for r in profile.column_summary(df, ["a", "b"]).collect()}
    assert (pop["a"].mean, pop["a"].std_pop, pop["a"]["count"]) == pytest.approx((3, np.std([1, 2, 6]), 3))
    assert samp["a"].std_samp == pytest.approx(np.std([1, 2, 6], ddof=1))
    assert (samp["b"].mean, samp["b"].std_samp, pop["b"].std_pop, samp["b"]["count"]) == (4.0, None, 0.0, 1)


def test_describe(spark):
    values = [1.0, 2.0, 4.0, 8.0, None]
    row = profile.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    s = np.array(values[:4])
    assert list(row) == pytest.approx([4, s.mean(), s.std(ddof=1), 1, *np.quantile(s, [0.25, 0.5, 0.75]), 8])


@pytest.mark.parametrize("values", [[0.0, 1.0, 1.0, 3.5, 20.0], [5.0, 5.0]])
def test_histogram(spark, values):
    rows = profile.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] + [rows[-1].bin_end] == pytest.approx(edges.tolist())


def test_summary_json(spark, published, tmp_path):
    long = spark.createDataFrame([("BLEU", 1.0), ("BLEU", 3.0)], "metric string, score double")
    score_io.write_summary(published, profile.metric_summary(long), [*NAMES, "X"], NAMES, str(tmp_path / "summary"))
    text = "".join(p.read_text() for p in (tmp_path / "summary").glob("part-*"))
    document = json.loads(text)
    assert document["correlation_results"]["COMET"]["pearson"] == PUBLISHED["COMET"][0]
    assert document["summary_statistics"]["BLEU"] == {"mean": 2.0, "std": 1.0, "min": 1.0, "max": 3.0, "count": 2}
    assert document["registry_info"]["available_metrics"][-1] == "X"
