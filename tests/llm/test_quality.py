import zlib

import numpy as np

from segeval.llm.boosting import Settings, fit
from segeval.llm.quality import add_statistics, quality_scores, train, train_on_texts
from segeval.llm.statistics import NAMES, statistics
from tests.llm.conftest import prose


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_trees_learn_a_rule_and_their_arrays_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = fit(x[:2000], y[:2000], Settings(trees=30))
    p = forest.predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    for row, want in zip(x[2000:2050], p):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12


def test_one_label_or_none_gives_a_constant():
    assert fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert set(fit(np.ones((5, 2)), np.ones(5)).predict(np.zeros((3, 2)))) == {fit(np.ones((5, 2)), np.ones(5)).predict(np.ones((1, 2)))[0]}
    assert fit(np.ones((9, 2)), np.arange(9) % 2.0).predict(np.ones((1, 2))).shape == (1,)


def test_statistics_of_odd_texts(odd_rows):
    for _, text, _ in odd_rows:
        values = statistics(text or "")
        assert len(values) == len(NAMES) and all(np.isfinite(values))


def test_held_out_accuracy_on_given_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    score, label = (np.array([r[c] for r in rows], dtype=float) for c in ("score", "quality"))
    assert auc(score, label) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_are_never_learned(spark):
    docs = spark.createDataFrame([(i, prose(i) if i % 3 else "### " * 30) for i in range(120)], "doc_id long, text string")
    rows = [(i, int(i % 3 > 0)) for i in range(120)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in rows]
    first, second = (
        {r.doc_id: r.score for r in quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (rows, turned)
    )
    assert first == second and first[0] < 0.3 < first[1]


def test_odd_rows_and_no_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, None), (None, 1), (9, 1), (9, 1), (10**9, 0)], "doc_id long, quality int")
    rows = quality_scores(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_scores(no_docs, labels).collect() == []
    assert {r.score for r in quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_trees_of_chosen_texts_equal_those_of_all(spark):
    docs = spark.createDataFrame([(i, prose(i) if i % 3 else "### " * 30 + str(i)) for i in range(150)] + [(None, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (4, None)], "doc_id long, quality int")
    a, b = train(add_statistics(docs, ["doc_id"]), labels), train_on_texts(docs, labels)
    x = np.array([statistics(prose(i)) for i in range(150, 180)] + [statistics("### " * i) for i in range(30)])
    assert np.array_equal(a.predict(x), b.predict(x)) and a.predict(x)[0] > 0.3 > a.predict(x)[-1]


def test_chosen_texts_are_bounded_even_under_one_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr("segeval.llm.quality.fit", lambda x, y, settings: sizes.append(len(x)) or fit(x, y, settings))
    docs = spark.createDataFrame([(i, prose(i)) for i in range(400)] + [(1, prose(i)) for i in range(400, 1400)] + [(1, "same")] * 1000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    for sample in (50, 10_000):
        train_on_texts(docs, labels, sample)
    assert 0 < sizes[0] < 100 and sizes[1] == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400)) + 1001
