import pytest
from pyspark.sql import functions as F

from segeval.llm.lines import LineRuns, drop_repeated_lines, line_hashes
from tests.llm import brute

LINE = "a line that is certainly longer than forty code points, Ä"


def kept(frame):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_odd_rows(odd_docs, odd_rows, no_docs, batches):
    assert kept(drop_repeated_lines(odd_docs, ["doc_id"], batches)) == brute.dedup_lines([(i, t) for i, t, _ in odd_rows])
    assert drop_repeated_lines(no_docs, ["doc_id"], batches).collect() == []


def test_only_ascii_letters_are_lowered(spark):
    rows = [(i, LINE if i % 2 else LINE.upper()) for i in range(8)] + [(20 + i, f"{LINE.lower()}{' ' * i}\n{LINE.lower()}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(drop_repeated_lines(docs, ["doc_id"])) == brute.dedup_lines(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, LINE)] * 3 + [(2, LINE), (3, LINE), (4, LINE + "\nend"), (None, LINE + "\nrest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in drop_repeated_lines(docs, ["doc_id"]).collect())
    more = docs.union(spark.createDataFrame([(5, LINE)], docs.schema))
    got = [(r.doc_id, r.n_dropped, r.kept) for r in drop_repeated_lines(more, ["doc_id"]).collect()]
    want = [(1, 1, "")] * 3 + [(2, 1, ""), (3, 1, ""), (4, 1, "end"), (5, 0, LINE), (None, 1, "rest")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_runs_level_up_and_know_new_keys(spark):
    store = LineRuns(fanout=2)
    seen = set()
    for batch in range(5):
        rows = [(10 * batch + d, f"{LINE} {d % (2 + batch)}") for d in range(8)]
        store.add(line_hashes(spark.createDataFrame(rows, "doc_id long, text string")))
        keys = {t.lower() for _, t in rows}
        seen |= keys
        fresh = sum(run.where("fresh").count() for run in store.runs())
        assert fresh == len(seen)
        assert len(store.runs()) == bin(batch + 1).count("1")
    counts = store.frequent(1)
    assert counts.count() == len(seen) and counts.agg(F.max("keeper")).first()[0] == 47


def test_many_dropped_lines_in_one_text(spark):
    import time

    lines = [f"{LINE} number {i}" for i in range(40_000)]
    text = "\n".join(x for i, line in enumerate(lines) for x in ([line, f"own {i}"] if i % 2 else [line]))
    docs = spark.createDataFrame([(i, text) for i in range(5)] + [(9, "\n".join(lines[:20_000]))], "doc_id long, text string").repartition(6)
    left = drop_repeated_lines(docs, ["doc_id"])
    start = time.perf_counter()
    got = kept(left)
    # Gaps between dropped lines are sliced: the work does not grow with their square.
    assert time.perf_counter() - start < 60
    first = [f"own {i}" for i in range(1, 40_000, 2)]
    assert got[0] == (60_000, 40_000, "\n".join(first)) and got[9][1] == 0
    assert got[4][1] == 20_000 and got[4][2].split("\n")[-1] == "own 39999"
