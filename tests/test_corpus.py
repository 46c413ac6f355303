"""Corpus scores, repeated texts, models kept by workers, and stored scores."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segeval.functions.worker import HELD, held
from segeval.operators import corpus, scoring
from segeval.plans.evaluate import evaluate
from segeval.sources import scores as score_io

ROWS = [
    ("a", "the cat sat on the mat", "the cat is on the mat today"),
    ("a", "a dog", "the dog ran away"),
    ("a", "", "nothing here"),
    ("b", "one two three four five", "one two three four five"),
    ("b", "six seven", ""),
    ("c", "x", "y"),
    ("d", None, "missing"),
    (None, "same words here now", "same words here then"),
]
SCHEMA = "grp string, targetText string, referenceText string"


def grams(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def plain_bleu(pairs):
    match, total = [0] * 4, [0] * 4
    for h, r in pairs:
        for n in range(4):
            a, b = grams(h.split(), n + 1), grams(r.split(), n + 1)
            match[n] += sum((a & b).values())
            total[n] += sum(a.values())
    hyp, ref = (sum(len(p[i].split()) for p in pairs) for i in (0, 1))
    if not match[0] or not total[3]:
        return 0.0
    zeros, logs = 0, 0.0
    for m, t in zip(match, total):
        zeros += m == 0
        logs += math.log(100 * (m or 0.5**zeros) / t)
    return math.exp(logs / 4) * (math.exp(1 - ref / hyp) if hyp < ref else 1)


def plain_chrf(pairs):
    stats = []
    for kind, orders in ((lambda t: list(t.replace(" ", "")), 6), (str.split, 2)):
        for n in range(1, orders + 1):
            m = h_all = r_all = 0
            for h, r in pairs:
                a, b = grams(kind(h), n), grams(kind(r), n)
                m, r_all = m + sum((a & b).values()), r_all + sum(b.values())
                h_all += sum(a.values()) if b else 0
            stats.append((m, h_all, r_all))
    used = [s for s in stats if s[1] and s[2]]
    if not used:
        return 0.0
    p, q = (sum(s[0] / s[k] for s in used) / len(used) for k in (1, 2))
    return 500 * p * q / (4 * p + q) if p + q else 0.0


def test_corpus_scores_equal_plain_ones(spark):
    counts = corpus.corpus_counts(spark.createDataFrame(ROWS, SCHEMA).repartition(3), ["grp"])
    got = {r.grp: r for r in corpus.corpus_scores(counts, ["grp"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for name, row in got.items():
        pairs = [(h, r) for g, h, r in ROWS if g == name and h is not None]
        assert row.n_rows == len(pairs)
        assert (row.corpus_bleu, row.corpus_chrfplusplus) == pytest.approx((plain_bleu(pairs), plain_chrf(pairs)))


def test_counts_add_up(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = [corpus.corpus_counts(df.where(F.col("grp") == g), ["grp"]) for g in "abc"]
    whole = corpus.add_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("all", F.lit(1)), ["all"])
    row = corpus.corpus_scores(whole, ["all"]).first()
    pairs = [(h, r) for g, h, r in ROWS if g in ("a", "b", "c")]
    assert (row.n_rows, row.corpus_bleu, row.corpus_chrfplusplus) == (6, pytest.approx(plain_bleu(pairs)), pytest.approx(plain_chrf(pairs)))


def test_sentence_and_corpus_agree_on_one_row(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat is on the mat")], "grp int, targetText string, referenceText string")
    one = scoring.add_scores(df, ["BLEU", "CHRF++"]).first()
    all_ = corpus.corpus_scores(corpus.corpus_counts(df, ["grp"]), ["grp"]).first()
    assert (all_.corpus_bleu, all_.corpus_chrfplusplus) == pytest.approx((one.bleu_score, one.chrfplusplus_score))


def test_equal_texts_are_scored_once(spark, tmp_path):
    texts = [("hot text", "ref", None)] * 30 + [("hot text", "other", None), ("", "ref", None), (None, "ref", None), (None, "ref", ""), ("1:a", "b", None), ("1", "a1:b", None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row_id long, targetText string, referenceText string, sourceText string").repartition(4)

    @F.udf("double")
    def logged(h, r):
        open(tmp_path / f"{os.getpid()}", "a").write("x")
        return float(len(h or "") + 10 * len(r or ""))

    scoring.register_metric("Logged", lambda hyp, ref, src: logged(hyp, ref))
    try:
        got = {r.row_id: r for r in scoring.scores_once(df, ["Logged"]).collect()}
    finally:
        scoring.unregister_metric("Logged")
    assert len(got) == len(texts)
    for i, (h, r, s) in enumerate(texts):
        assert got[i].logged_score == len(h or "") + 10 * len(r)
        assert got[i].scored_key == texts.index((h, r, s))
    assert sum(os.path.getsize(f) for f in tmp_path.iterdir()) == len(set(texts))


def test_texts_stay_out_of_the_exchange(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}", "ref") for i in range(9)], "row_id long, targetText string, referenceText string")
    plan = scoring.scores_once(df, ["WER"])._jdf.queryExecution().executedPlan().toString()
    assert "targetText" not in plan


def test_held_objects(spark):
    made = []
    for key in ("a", "b", "a", *range(HELD), "a"):
        held(("test", key), lambda: made.append(key))
    assert made == ["a", "b", *range(HELD), "a"]


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    def load():
        open(tmp_path / f"{os.getpid()}", "a").write("x")
        return lambda rows: [float(len(r["mt"])) for r in rows]

    df = spark.range(64).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    for _ in range(2):
        score = scoring.model_score(F.col("t"), F.col("t"), F.col("t"), load)
        got = df.repartition(16, "row_id").select("row_id", score.alias("s")).collect()
        assert sorted((r.row_id, r.s) for r in got) == [(i, float(i)) for i in range(64)]
        # 16 tasks and more, and no worker loaded twice within a query.
        assert all(os.path.getsize(f) <= _ + 1 for f in tmp_path.iterdir())


RATED = "row_id long, createdBy_id int, score double, sourceText string, targetText string, referenceText string"


def rated(spark, n=24):
    return spark.createDataFrame([(i, i % 2, float(i % 5), f"s{i}", f"word {i} here", f"word {i % 3} there") for i in range(n)], RATED)


def test_a_run_goes_on_from_stored_scores(spark, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "log"
    log.mkdir()

    @F.udf("double")
    def logged(h):
        open(log / f"{os.getpid()}", "a").write("x")
        return float(h.split()[1])

    def calls():
        return sum(os.path.getsize(f) for f in log.iterdir())

    @F.udf("double")
    def broken(h):
        raise ValueError("out of order")

    scoring.register_metric("Logged", lambda hyp, ref, src: logged(hyp))
    scoring.register_metric("Broken", lambda hyp, ref, src: broken(hyp))
    try:
        evaluate(rated(spark, 14), ["Logged"], store=store)
        assert calls() == 14
        with pytest.warns(UserWarning, match="Broken failed"):
            run = evaluate(rated(spark), ["Logged", "Broken"], store=store)
        # The first metric's scores were committed before the second one failed, and are not computed again.
        assert run.metrics == ["Logged"] and calls() == 24
        again = evaluate(rated(spark), ["Logged"], store=store)
        assert calls() == 24
        assert sorted(map(tuple, again.wide().collect())) == sorted(map(tuple, run.wide().collect()))
        assert {r.row_id: r.logged_score for r in again.wide().collect()} == {i: float(i) for i in range(24)}
    finally:
        scoring.unregister_metric("Logged")
        scoring.unregister_metric("Broken")


def test_evaluate_with_repeated_texts(spark):
    rows = rated(spark).withColumn("targetText", F.lit("word 1 here")).withColumn("sourceText", F.lit("s"))
    once, each = (evaluate(rows, ["WER", "BLEU"], once=o).wide().collect() for o in (True, False))
    assert sorted(map(tuple, once)) == sorted(map(tuple, each))


def test_records_of_score_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(score_io, "RECORD_SCORES", 7)
    scores = spark.range(100).select(F.col("id").alias("row_id"), F.lit("m").alias("metric"), (F.col("id") * 1.5).alias("score"))
    score_io.export_score_files(scores.repartition(5), str(tmp_path / "f"))
    records = spark.read.json(str(tmp_path / "f"))
    assert records.agg(F.max(F.size("scores"))).first()[0] <= 7
    back = score_io.read_score_files(spark, {"m": str(tmp_path / "f")})
    assert sorted((r.row_id, r.score) for r in back.collect()) == [(i, i * 1.5) for i in range(100)]
