"""CSV, score files and database reads."""

import json
from types import SimpleNamespace

import pytest

from segeval.sources import csv, jdbc, scores


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'sourceText,targetText,referenceText,score\n"a ""q"", b","line\nbreak",007,1.5\nNaN,x,y,2\ns,"",y,3\nn/a.,x,y,bad\n'
    )
    rows = csv.read_pairs_csv(spark, str(path), {"score": "double"}).collect()
    assert [tuple(r) for r in rows] == [('a "q", b', "line\nbreak", "007", 1.5), ("n/a.", "x", "y", None)]
    with pytest.raises(ValueError, match="absent"):
        csv.read_csv(spark, str(path), {"absent": "double"})
    assert csv.read_csv(spark, str(path)).count() == 4


def test_csv_round_trip(spark, tmp_path):
    data = [('say "hi", you', "two\nlines", 1.25), ("back\\slash", "tab\tbed", None)]
    df = spark.createDataFrame(data, "a string, b string, x double")
    csv.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, csv.read_csv(spark, str(tmp_path / "out"), {"x": "double"}).collect())) == sorted(data)


def test_row_ids_are_fixed_by_the_write(spark, tmp_path):
    df = csv.with_row_id(spark.range(100).repartition(3), str(tmp_path / "rows"))
    first = {r.id: r.row_id for r in df.collect()}
    assert len(set(first.values())) == 100
    assert {r.id: r.row_id for r in df.repartition(7).collect()} == first


def test_score_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([("A", 0, 1.5), ("A", 1, None), ("B", 0, 3.0)], "metric string, row_id long, score double")
    scores.write_scores(df, str(tmp_path / "table"))
    assert sorted(scores.read_scores(spark, str(tmp_path / "table")).select("metric", "row_id", "score").collect(), key=str) == sorted(df.collect(), key=str)
    scores.export_score_files(df.where("metric = 'A'"), str(tmp_path / "a"))
    (record,) = [json.loads(x) for p in (tmp_path / "a").glob("part-*") for x in p.read_text().splitlines()]
    assert record == {"metric_name": "A", "scores": [1.5, None], "num_samples": 2, "offset": 0}
    (tmp_path / "b.json").write_text('{\n "metric_name": "B", "scores": [NaN, 2.5], "num_samples": 2\n}')
    with pytest.warns(UserWarning, match="no scores for C"):
        got = scores.read_score_files(spark, {"A": str(tmp_path / "a"), "B": str(tmp_path / "b.json"), "C": str(tmp_path / "none")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 0, 1.5), ("A", 1, None), ("B", 0, None), ("B", 1, 2.5)], key=str)


def test_long_score_lists_are_several_records(spark, tmp_path):
    partitions = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.range(500).selectExpr("'A' AS metric", "id AS row_id", "id * 0.5D AS score")
        scores.export_score_files(df.repartition(3), str(tmp_path / "a"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions)
    records = [json.loads(x) for p in (tmp_path / "a").glob("part-*") for x in p.read_text().splitlines()]
    assert len(records) > 1
    got = scores.read_score_files(spark, {"A": str(tmp_path / "a")}).orderBy("row_id").collect()
    assert [(r.row_id, r.score) for r in got] == [(i, i * 0.5) for i in range(500)]


def test_database_read(spark):
    """Both tables are read in ranges of their row key; only the six columns are kept."""
    ratings = spark.createDataFrame([(4.5, 1, 101, "x")], "score double, item_id long, createdBy_id long, note string")
    pairs = spark.createDataFrame([(1, "s", "t", "t1", 0)], "id long, sourceText string, targetText string, targetID string, extra int")
    calls = []

    def fake(url, table, **options):
        calls.append((url, table, options))
        if table.startswith("(SELECT min"):
            return spark.createDataFrame([(1, 50)], "lo long, hi long")
        return ratings if "result" in table else pairs

    session = SimpleNamespace(read=SimpleNamespace(jdbc=fake))
    out = jdbc.read_rated_pairs(session, "jdbc:x", {"user": "u"}, "results", "pairs", partitions=4)
    assert [tuple(r) for r in out.collect()] == [(4.5, 1, 101, "s", "t", "t1")]
    reads = [c for c in calls if "numPartitions" in c[2]]
    assert [c[2]["column"] for c in reads] == ['"id"', '"id"']
    assert all((c[2]["lowerBound"], c[2]["upperBound"], c[2]["numPartitions"]) == (1, 51, 4) for c in reads)
