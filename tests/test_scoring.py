"""Metric registry, model scoring, sampling, attaching scores, training tables and whole runs."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segeval.functions.expr import score_column, score_column_expr
from segeval.operators import scoring, training
from segeval.plans.annotate import annotate_csv
from segeval.plans.evaluate import evaluate
from segeval.sources.csv import read_csv, write_csv

TEXTS = "sourceText string, targetText string, referenceText string"


@pytest.fixture
def pairs(spark):
    rows = [(i, f"s{i}", f"word {i} here" if i % 3 else "other", f"word {i} here") for i in range(40)]
    return spark.createDataFrame(rows, f"row_id long, {TEXTS}").repartition(3)


def test_column_names(spark):
    names = {"CHRF++": "chrfplusplus_score", "LLM-Reference-Based": "llm_reference_based_score", "BLEU": "bleu_score"}
    assert {n: score_column(n) for n in names} == names
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", score_column_expr(F.col("n"))).collect()} == names


def test_metric_selection(pairs, monkeypatch):
    monkeypatch.setattr(scoring, "_METRICS", dict(scoring._METRICS))
    scoring.register_metric("Own", lambda hyp, ref, src: F.length(hyp) + F.length(src))
    with pytest.warns(UserWarning, match="Nope"):
        assert scoring.select_metrics(["Own", "Nope", "BLEU"]) == ["Own", "BLEU"]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        scoring.select_metrics(["Nope"])
    row = scoring.add_scores(pairs, ["Own"]).where("row_id = 1").first()
    assert row.own_score == len("word 1 here") + 2


def test_long_and_wide_scores(pairs):
    wide = scoring.add_scores(pairs, ["BLEU", "CHRF++"])
    long = scoring.scores_long(wide, ["BLEU", "CHRF++"], ["row_id"])
    assert long.count() == 80
    back = scoring.attach_scores(pairs.select("row_id"), long.where("row_id < 10 OR metric = 'BLEU'"), ["BLEU", "CHRF++"])
    expected = {r.row_id: (r.bleu_score, r.chrfplusplus_score) for r in wide.collect()}
    for r in back.collect():
        bleu, chrf = expected[r.row_id]
        assert r.bleu_score == bleu and r.chrfplusplus_score == (chrf if r.row_id < 10 else None)


def model(shape):
    def load():
        import numpy as np

        def score(rows):
            assert 1 <= len(rows) <= 8 and set(rows[0]) == {"src", "mt", "ref"}
            values = [float(len(r["mt"])) for r in rows]
            if shape == "attribute":
                return type("Output", (), {"scores": values})()
            if shape == "fails" and any(r["src"] == "s7" for r in rows):
                raise RuntimeError("model failure")
            return np.array(values) if shape == "array" else values

        return score

    return load


def column(shape, **options):
    return scoring.model_score(F.col("targetText"), F.col("referenceText"), F.col("sourceText"), model(shape), **options)


@pytest.mark.parametrize("shape", ["list", "array", "attribute"])
def test_model_output_shapes(pairs, shape):
    rows = pairs.select("targetText", column(shape).alias("v")).collect()
    assert len(rows) == 40 and all(r.v == len(r.targetText) for r in rows)


def test_model_failures(pairs):
    with pytest.raises(PySparkException, match="model failure"):
        pairs.select(column("fails")).collect()
    rows = pairs.select("row_id", "targetText", column("fails", on_failure="zero", batch_size=1).alias("v")).collect()
    assert all(r.v == (0.0 if r.row_id == 7 else len(r.targetText)) for r in rows)
    with pytest.raises(ValueError):
        column("list", on_failure="ignore")


def test_sampled_scores_are_filled_with_their_mean(pairs):
    rows = scoring.score_first_rows(pairs, 10, lambda df: df.withColumn("score", column("list"))).collect()
    known = {r.row_id: r.score for r in rows if not r.is_imputed}
    assert sorted(known) == list(range(10))
    mean = sum(known.values()) / 10
    assert [r.score for r in rows if r.is_imputed] == pytest.approx([mean] * 30)


def test_training_set(spark):
    df = spark.createDataFrame(
        [("s", "t", "r", 1.0, 10.0), ("s", "t", "r", 2.0, 20.0), ("s", "t", "r", 3.0, 60.0)],
        f"{TEXTS}, llm_reference_based_score double, llm_reference_based_score_noisy double",
    )
    out = training.training_set(df)
    assert out.columns == ["src", "mt", "ref", "raw", "lp", "score", "annotators", "domain"]
    rows = out.orderBy("raw").collect()
    assert [r.raw for r in rows] == [10, 20, 60]
    assert [r.score for r in rows] == pytest.approx([(x - 30) / math.sqrt(700) for x in (10, 20, 60)])
    assert {(r.lp, r.annotators, r.domain) for r in rows} == {("en-ka", 0, "corp_dict")}
    same = training.training_set(df.withColumn("llm_reference_based_score_noisy", F.lit(5.0)))
    assert {r.score for r in same.collect()} == {None}


def test_validation_set_needs_more_than_five(spark):
    rows = [("s", "t", "r", float(i), rater) for rater, n in (("a", 5), ("b", 6), (None, 9)) for i in range(n)]
    out = training.validation_set(spark.createDataFrame(rows, f"{TEXTS}, score double, createdBy_id string"))
    got = out.orderBy("raw").collect()
    assert {r.createdBy_id for r in got} == {"b"}
    assert [r.score for r in got] == pytest.approx([(i - 2.5) / math.sqrt(3.5) for i in range(6)])


@pytest.fixture
def rated(pairs):
    score = F.when(F.col("row_id") % 3 > 0, 5.0).otherwise(1.0) + F.col("row_id") / 100
    return pairs.withColumns({"score": score, "createdBy_id": F.col("row_id") % 2})


def test_evaluation(rated, tmp_path):
    extra = rated.select("row_id", F.lit("Judge").alias("metric"), F.col("score"))
    run = evaluate(rated, ["BLEU", "CHRF++"], extra_scores=extra, extra_metrics=("Judge",))
    report = {r.metric: r for r in run.report().collect()}
    assert list(run.metrics) == ["BLEU", "CHRF++", "Judge"] and set(report) == set(run.metrics)
    assert report["Judge"].pearson == pytest.approx(1, abs=1e-3)
    assert report["BLEU"].pearson > 0.9 and report["BLEU"].significance == "highly_significant"
    wide = run.wide()
    assert wide.columns == ["row_id", "human_score", "bleu_score", "chrfplusplus_score", "judge_score"] and wide.count() == 40
    run.save(str(tmp_path / "data"), str(tmp_path / "summary"), scoring.metric_names())
    assert read_csv(rated.sparkSession, str(tmp_path / "data")).count() == 40


def test_incomplete_texts_count_for_the_rater_only(spark):
    rows = [(i, 1, float(i), "s", "t" if i else None, f"r{i}") for i in range(5)]
    rated = spark.createDataFrame(rows, f"row_id long, createdBy_id long, score double, {TEXTS}")
    wide = evaluate(rated, ["WER"], at_least=5).wide().orderBy("row_id").collect()
    assert [r.row_id for r in wide] == [1, 2, 3, 4]
    assert [r.human_score for r in wide] == pytest.approx([(i - 2) / math.sqrt(2.5) for i in (1, 2, 3, 4)])


def test_scratch_folder(spark):
    from segeval import scratch

    class Bare:
        sparkContext = spark.sparkContext
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    assert scratch.scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.scratch_root(Bare) == scratch.scratch_root(Bare) != scratch.scratch_root(spark)
    stored = scratch.materialize(spark.range(5), "numbers")
    assert stored.count() == 5 and scratch.scratch_root(spark) in stored.inputFiles()[0]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from segeval import scratch

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

        def __init__(self, master):
            self.sparkContext = type("Context", (), {"applicationId": f"app {master}", "master": master})

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_root(Cluster(master))
    for master in ("local", "local[4]", "local[*]"):
        assert scratch.scratch_root(Cluster(master))


def test_scratch_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    from segeval import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda session: str(tmp_path / "scratch"))
    scratch.materialize(spark.range(5), "numbers")
    assert list((tmp_path / "scratch").iterdir())
    scratch.clear_scratch(spark)
    assert not (tmp_path / "scratch").exists()


def test_failing_metric_is_reported_and_left_out(rated, monkeypatch):
    monkeypatch.setattr(scoring, "_METRICS", dict(scoring._METRICS))
    scoring.register_metric("Broken", lambda h, r, s: F.when(F.length(h) >= 0, F.raise_error(F.lit("out of order")).cast("double")))
    with pytest.warns(UserWarning, match="Broken failed"):
        run = evaluate(rated, ["Broken", "WER"])
    assert run.metrics == ["WER"] and "out of order" in run.failed["Broken"]
    assert {r.metric for r in run.report().collect()} == {"WER"}
    with pytest.raises(ValueError, match="no metric could be scored"):
        evaluate(rated, ["Broken"])


def test_metric_over_the_whole_table(rated, monkeypatch):
    monkeypatch.setattr(scoring, "_TABLE_METRICS", {})

    def relative_length(df):
        mean = df.agg(F.avg(F.length("targetText"))).scalar()
        return df.select("row_id", (F.length("targetText") / mean).alias("score"))

    scoring.register_table_metric("Relative-Length", relative_length)
    run = evaluate(rated, ["WER", "Relative-Length"])
    got = {r.row_id: r.relative_length_score for r in run.wide().collect()}
    lengths = {r.row_id: len(r.targetText) for r in rated.collect()}
    mean = sum(lengths.values()) / len(lengths)
    assert got == pytest.approx({i: n / mean for i, n in lengths.items()})
    assert run.metrics == ["WER", "Relative-Length"]


def test_nothing_left_is_an_error(rated):
    with pytest.raises(ValueError, match="no rater"):
        evaluate(rated, ["WER"], at_least=100)
    with pytest.raises(ValueError, match="no row"):
        evaluate(rated.withColumn("targetText", F.lit(None).cast("string")), ["WER"])


def test_texts_are_not_shuffled_to_be_scored(rated):
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (rated, scoring.add_scores(rated, ["BLEU", "WER", "ROUGE"]))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_annotated_csv(spark, pairs, tmp_path):
    write_csv(pairs, str(tmp_path / "in"))
    stats = annotate_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["BLEU", "WER"])
    assert {r.column_name: r["count"] for r in stats.collect()} == {"bleu_score": 40, "wer_score": 40}
    out = read_csv(spark, str(tmp_path / "out"))
    assert out.columns == ["row_id", "sourceText", "targetText", "referenceText", "bleu_score", "wer_score"]
    write_csv(pairs.withColumn("targetText", F.lit(None).cast("string")), str(tmp_path / "incomplete"))
    with pytest.raises(ValueError, match="no row of"):
        annotate_csv(spark, str(tmp_path / "incomplete"), str(tmp_path / "never"), ["BLEU"])
    assert not (tmp_path / "never").exists()
