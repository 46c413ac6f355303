import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segeval.llm import importance
from segeval.llm.importance import FeatureHasher, drawn_ranks, importance_ranks, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target, min_words=20, percent=5):
    """doc_id: (n_features, weight, score, rank) for distinct ids."""
    of = {i: features(t) for i, t in rows}
    s = Counter(bucket(f) for _, fs in of.values() for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = {}
    for i, (_, fs) in of.items():
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    long = sorted((i for i in of if len(of[i][0]) >= min_words), key=lambda i: (-out[i][2], i is None, i))
    for rank, i in enumerate(long[: percent * len(long) // 100], 1):
        out[i][3] = rank
    return out


def test_words_are_those_of_the_pattern(odd_rows):
    for text in [t or "" for _, t, _ in odd_rows] + ["ÀB_c-D9\x00e\x7ff", "A.B", "Ünï Ö x", "'", "İI"]:
        assert [w.decode() for w in words(text)] == features(text)[0]


@pytest.mark.parametrize("kept", [0, 500_000])
def test_hashes_of_runs_are_crcs(monkeypatch, kept):
    monkeypatch.setattr(importance, "KEPT_WORDS", kept)
    hasher = FeatureHasher()
    for texts in (["", "a", "a b", "one two three four"], ["x" * 70_000 + " y z", "ß é ü ß é", ""], ["one two", "a b c"], []):
        crcs, owner = hasher.hashes([words(t) for t in texts])
        for at, text in enumerate(texts):
            assert sorted(crcs[owner == at].tolist()) == sorted(zlib.crc32(f.encode()) for f in features(text)[1])


def test_result_is_the_plain_one(spark, odd_rows, odd_docs):
    target = ["alpha beta gamma delta", None, "", "pi rho sigma tau tau"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = plain([(i, t) for i, t, _ in odd_rows], target, min_words=3, percent=40)
    found = importance_ranks(odd_docs, goal, percent=40, min_words=3).collect()
    assert {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in found} == want
    assert sum(r["rank"] is not None for r in found) >= 5


def test_empty_tables(spark, odd_rows, odd_docs, no_docs):
    goal = spark.createDataFrame([], "text string")
    assert importance_ranks(no_docs, goal).collect() == []
    want = plain([(i, t) for i, t, _ in odd_rows], [])
    assert {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in importance_ranks(odd_docs, goal).collect()} == want


def test_copies_share_a_score_and_have_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(7, "alpha beta gamma " * 10)] * 40 + [(i, "delta " * 25) for i in range(60)], "doc_id long, text string")
    found = importance_ranks(docs, docs.where("doc_id = 7"), percent=30).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 31))
    assert {r["doc_id"] for r in found if r["rank"]} == {7}


@pytest.mark.parametrize("segments", [1, 7, 64])
@pytest.mark.parametrize("samples", [10, 1 << 16])
def test_ranks_with_ties_and_few_samples(spark, monkeypatch, segments, samples):
    monkeypatch.setattr(importance, "MIN_SEGMENTS", segments)
    monkeypatch.setattr(importance, "SAMPLES", samples)
    rng = np.random.default_rng(3)
    # A third of the rows are equal in score and id; ids beyond 2^53 must stay exact.
    rows = [(5, 9, True)] * 400 + [((1 << 62) + int(i), int(s), bool(e)) for i, s, e in zip(rng.permutation(800), rng.integers(0, 12, 800), rng.random(800) < 0.8)]
    rows += [(None, 11, True), (None, None, False)]
    scored = spark.createDataFrame(rows, "id long, score long, eligible boolean").repartition(5)
    eligible = sorted((-s, i is None, i or 0) for i, s, e in rows if e)
    found = drawn_ranks(scored, lambda n: n // 2).collect()
    assert len(found) == len(rows)
    ranked = sorted((r["rank"], -r["score"], r["id"] is None, r["id"] or 0) for r in found if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, len(eligible) // 2 + 1))
    assert [r[1:] for r in ranked] == eligible[: len(eligible) // 2]


def test_only_drawn_segments_are_exchanged(spark):
    scored = spark.range(1000).select("id", F.col("id").alias("score"), F.lit(True).alias("eligible"))
    assert [r["id"] for r in drawn_ranks(scored, lambda n: 3).where("rank is not null").orderBy("rank").collect()] == [999, 998, 997]
    assert drawn_ranks(scored, lambda n: 0).where("rank is not null").count() == 0
    assert drawn_ranks(scored, lambda n: n).agg(F.max("rank")).first()[0] == 1000
