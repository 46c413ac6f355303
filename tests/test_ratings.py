"""Joins, rater filters and z-scores on hand-worked rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segeval.operators import ratings, skew

RATED = [
    (71.0, 8, 3, "a red door", "une porte rouge", "fr-8"),
    (38.5, 5, 7, "two doors", "deux portes", "fr-5"),
]


@pytest.fixture
def rating_tables(spark):
    rated = spark.createDataFrame([r[:3] for r in RATED] + [(1.0, 9, 103)], "score double, item_id long, createdBy_id long")
    pairs = spark.createDataFrame([(r[1], *r[3:]) for r in RATED], "id long, sourceText string, targetText string, targetID string")
    return rated, pairs


def test_join_ratings(rating_tables):
    out = ratings.join_ratings(*rating_tables)
    assert out.columns == ["score", "item_id", "createdBy_id", "sourceText", "targetText", "targetID"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(RATED)


def test_references_in_row_order(spark, rating_tables):
    refs = spark.createDataFrame([("two doors", "deux portes closes", 0), ("a red door", "la porte rouge", 1)], "en string, ka string, pos long")
    out = ratings.add_reference(ratings.join_ratings(*rating_tables), refs)
    assert {r.sourceText: r.referenceText for r in out.collect()} == {"a red door": "la porte rouge", "two doors": "deux portes closes"}


def test_last_reference_wins_and_may_be_null(spark):
    pairs = spark.createDataFrame([("a",), ("b",)], "sourceText string")
    refs = spark.createDataFrame([("a", "old", 0), ("a", "new", 2), ("b", "x", 0), ("b", None, 5)], "en string, ka string, pos long")
    assert {r[0]: r[1] for r in ratings.add_reference(pairs, refs).collect()} == {"a": "new", "b": None}


def test_missing_reference(spark):
    pairs = spark.createDataFrame([("a",), ("gone",), ("gone",), (None,)], "sourceText string")
    refs = spark.createDataFrame([("a", "x", 0)], "en string, ka string, pos long")
    with pytest.raises(PySparkException, match="source text not found in reference data"):
        ratings.add_reference(pairs, refs).collect()
    lenient = {r[0]: r[1] for r in ratings.add_reference(pairs, refs, strict=False).collect()}
    assert lenient == {"a": "x", "gone": None, None: None}
    missing = {r.sourceText: r.n_rows for r in ratings.missing_references(pairs, refs).collect()}
    assert missing == {"gone": 2, None: 1}


def test_required_columns_and_texts(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", None, "c")], "sourceText string, targetText string, referenceText string")
    assert ratings.drop_null_texts(df).count() == 1
    with pytest.raises(ValueError, match="referenceText"):
        ratings.drop_null_texts(df.drop("referenceText"))
    with pytest.raises(ValueError, match="nothing left"):
        ratings.require_rows(df.where("false"), "nothing left")


RATERS = {
    "a": [1, 2, 3, 4, 5],
    "b": [7] * 5,
    "c": [1, 2, 3, 4],
    None: [1, 2, 3, 4, 5, 6],
    "d": [1, 2, 3, 4, None],
    "e": [7, 7, 7, 7, None],
    "f": [None, None, None, None, 3],
    "g": [1, 2, 3, 4, 5, float("nan")],
}


@pytest.fixture
def rated(spark):
    rows = [(i, rater, float(s) if s is not None else None) for rater, scores in RATERS.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "i long, createdBy_id string, score double")


def test_z_scores(rated):
    got = {}
    for r in ratings.standardize_by_rater(rated, 5).orderBy("i").collect():
        got.setdefault(r.createdBy_id, []).append(r.standardized_score)
    assert got["a"] == pytest.approx([-1.264911, -0.632456, 0, 0.632456, 1.264911], abs=1e-6)
    assert got["b"] == [0.0] * 5
    assert "c" not in got and None not in got
    assert got["d"][:4] == pytest.approx([(x - 2.5) / 1.290994 for x in (1, 2, 3, 4)], abs=1e-6) and got["d"][4] is None
    assert got["e"] == [0.0] * 5
    assert got["f"] == [None] * 5
    assert got["g"][:5] == pytest.approx(got["a"]) and got["g"][5] is None


def test_z_scores_without_raters(rated):
    assert ratings.standardize_by_rater(rated.drop("createdBy_id")).count() == rated.count()


def test_rater_thresholds(rated):
    def kept(n):
        return {r[0] for r in ratings.keep_active_raters(rated, n).select("createdBy_id").distinct().collect()}

    assert kept(5) == {"a", "b", "d", "e", "f", "g"}
    assert kept(6) == {"g"}


def test_audit(rated):
    row = ratings.rater_audit(rated, 5).first().asDict()
    assert (row["rows_before"], row["raters_before"], row["rows_after"], row["raters_after"]) == (41, 7, 31, 6)
    assert (row["removed_raters"], row["removed_rows"]) == (1, 10)
    assert row["removed_percent"] == pytest.approx(1000 / 41)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_with_a_written_table_equals_plain_join(spark, how):
    """A third of the rows share one key."""
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("w"))
    got = skew.join_written(big, small, "k", how)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(big.join(small, "k", how).collect(), key=key)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_ratings_are_read_once_for_statistics_and_once_to_be_standardised(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 10).alias("createdBy_id"), F.rand(1).alias("score"))
    rows.write.parquet(str(tmp_path / "ratings"))
    rated = spark.read.parquet(str(tmp_path / "ratings"))
    # One scan of the ratings and one of the written statistics.
    assert scans(ratings.standardize_by_rater(rated)) == 2


def test_no_rater_left_is_an_error(rated):
    with pytest.raises(ValueError, match="no rater has at least 1000 rows"):
        ratings.standardize_by_rater(rated, 1000)
    with pytest.raises(ValueError, match="no rater has at least 1000 rows"):
        ratings.keep_active_raters(rated, 1000)


def test_references_are_shuffled_by_digest(spark, tmp_path):
    spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "en string, ka string, pos int").write.parquet(str(tmp_path / "r"))
    latest = ratings.latest_references(spark.read.parquet(str(tmp_path / "r")))
    assert "hashpartitioning(en" not in latest._jdf.queryExecution().executedPlan().toString()
    assert [r.referenceText for r in latest.collect()] == ["y"]
