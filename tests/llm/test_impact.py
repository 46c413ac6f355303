import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segeval.llm import impact
from tests.llm import brute


@pytest.mark.parametrize("seed", range(20))
def test_search_keeps_every_member(seed):
    rng = np.random.default_rng(seed)
    n, dims = int(rng.integers(1, 400)), int(rng.integers(1, 12))
    rows = rng.integers(-50, 50, (n, dims)) * int(rng.choice([1, 1, 10**5]))
    rows[rng.random(n) < 0.3] = rows[0]
    ids = rng.permutation(n)
    index = impact.BlockIndex.unpack(impact.BlockIndex(ids, rows).pack())
    for query in [rows[0], rng.integers(-9, 9, dims), np.zeros(dims, dtype=int)]:
        for k in (1, 10):
            found, scores = index.search(query, int(ids[0]), k)
            exact = rows @ query
            assert (scores == exact[found]).all()
            others = [(-int(exact[p]), int(ids[p])) for p in range(n) if p]
            best = sorted((-int(s), int(ids[p])) for p, s in zip(found, scores))[:k]
            assert best == sorted(others)[:k]


def test_search_stops_early():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(4000, 16)) * np.geomspace(1000, 1, 16)
    index = impact.BlockIndex(np.arange(4000), rows.astype(int))
    found, _ = index.search(rows[7].astype(int), 7, 10)
    assert len(found) < 400


def test_queries_over_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK_VALUES", 320)
    monkeypatch.setattr(impact, "QUERY_ROWS", 3)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(50)]  # ties
    rows += [(300, None), (301, [1.0, None, *[0.0] * 6]), (400, [math.nan] * 8), (500, [math.inf] * 8), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [-1.0, 0.5])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, block string")
    got = [tuple(r) for r in impact.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()]
    whole = [(r.vec_id, r.v) for r in impact.whole_vectors(vectors).collect()]
    floats = {r.vec_id: r.embedding for r in vectors.collect()}
    for i, v in whole:
        assert v == [math.floor(1024 * x) for x in floats[i]]
    assert {i for i, _ in whole} == {i for i, _ in rows} - {None, 300, 301, 400, 500}
    want = brute.inner_products(whole, [(i, v) for i, v in whole if i % 100 == 0], 10)
    assert sorted(got) == sorted(want)
    assert impact.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


@pytest.mark.parametrize("left_out, asked", [({101, 102}, [0, 20, 40, 100, 103, 200]), (set(), [0, 20, 40])])
def test_large_components_are_scored_exactly(spark, monkeypatch, left_out, asked):
    monkeypatch.setattr(impact, "BLOCK_VALUES", 100)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e6, -3.0, 0.0, 2.5]), (101, [1e9, 1.0, 1.0, 1.0]), (102, [-1e9] * 4), (103, [300000.0, 1.0, 0.0, 0.0]), (200, [4e5, -1e6, 2.0, 1.0])]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows if i not in left_out]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in impact.top_k(vectors, vectors.where(F.col("vec_id").isin(asked))).collect()]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = brute.inner_products(whole, [(i, v) for i, v in whole if i in asked], 10)
    assert sorted(got) == sorted(want) and {r[2] for r in got} & {100, 101, 102, 103}


def test_a_score_beyond_a_long_is_reported(spark):
    vectors = spark.createDataFrame([(0, [1e12, 0.0]), (1, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        impact.top_k(vectors, vectors).collect()


def test_a_third_of_the_rows_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK_VALUES", 200)
    rng = random.Random(5)
    rows = [(7 if i % 3 == 0 else 1000 + i, [float(rng.randint(-9, 9)) for _ in range(4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    whole = impact.materialize(impact.whole_vectors(vectors).withColumn("lot", F.monotonically_increasing_id()), "v")
    sizes = [len(pickle.loads(r["index"][1:])[0]) for r in impact.build_index(whole).collect()]
    assert sum(sizes) == 300 and max(sizes) < 120
    found = impact.top_k(vectors, vectors.where("vec_id = 1001")).collect()
    query = rows[1][1]
    scores = sorted(((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(query, v)), i) for i, v in rows if i != 1001))[:10]
    assert [(-r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == scores
