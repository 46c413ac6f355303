"""Judge requests, score parsing and result joins."""

import json

import pytest
from pyspark.sql import functions as F

from segeval.functions.judging import extract_score, render_prompt
from segeval.operators import judge
from segeval.sources import judge_files

ANSWERS = {
    "90/100": 90,
    "Score: 90": 90,
    "150": 100,
    "-5": 5,
    "1.5abc": 1,
    "Score: 1234": 100,
    "90ქულა": 90,
    "none": 0,
    "": 0,
    "٩٠": 90,
    " 87.25 points": 87.25,
    "12é and 50": 50,
    "The score is 72%": 72,
}


def test_extract_score(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "a string")
    assert {r[0]: r[1] for r in df.select("a", extract_score(F.col("a"))).collect()} == ANSWERS


def test_prompt_is_filled_once(spark):
    df = spark.createDataFrame([("{b}", "%s $1")], "a string, b string")
    assert df.select(render_prompt("A={a} B={b} {c}", a=F.col("a"), b=F.col("b"))).first()[0] == "A={b} B=%s $1 {c}"


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(
        [(3, "src", 'h "quoted"\nline', "ref"), (4, "src", "hyp", None), (5, None, "hyp", "ref")],
        "row_id long, sourceText string, targetText string, referenceText string",
    )


def settings(mode):
    return judge.JudgeSettings(mode, "S:{source} H:{hypothesis}" + (" R:{reference}" if mode == "reference_based" else ""), "m", "sys", "ex", 50)


def test_requests(pairs):
    got = {r.custom_id: json.loads(r.request) for r in judge.judge_requests(pairs, settings("reference_based")).collect()}
    assert set(got) == {f"eval_reference_based_{i}" for i in (3, 4, 5)}
    full = got["eval_reference_based_3"]
    assert full["custom_id"] == "eval_reference_based_3"
    assert full["params"] == {
        "model": "m",
        "max_tokens": 50,
        "temperature": 0,
        "system": "sys",
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "ex"}, {"type": "text", "text": 'S:src H:h "quoted"\nline R:ref'}]}
        ],
    }
    for row_id in (4, 5):
        dummy = got[f"eval_reference_based_{row_id}"]["params"]
        assert (dummy["max_tokens"], dummy["system"], dummy["messages"]) == (10, "Return 0", [{"role": "user", "content": "0"}])


def test_reference_free_requests_need_no_reference(pairs):
    got = {r.custom_id: json.loads(r.request) for r in judge.judge_requests(pairs, settings("reference_free")).collect()}
    assert got["eval_reference_free_4"]["params"]["messages"][0]["content"][1]["text"] == "S:src H:hyp"
    with pytest.raises(ValueError, match="mode"):
        settings("other")


def line(custom_id, status="succeeded", text=None):
    message = {"content": [{"type": "text", "text": text}]} if text is not None else None
    return json.dumps({"custom_id": custom_id, "result": {"type": status, "message": message}})


def test_results_and_join(spark, pairs, tmp_path):
    lines = [
        line("eval_reference_free_3", text="Score: 81"),
        line("eval_reference_free_4", "errored"),
        line("eval_reference_free_4", text="40"),
        line("eval_reference_based_5", text="99"),
        line("eval_reference_free_x", text="99"),
        line("eval_reference_free_77", text="99"),
        "",
    ]
    (tmp_path / "results.jsonl").write_text("\n".join(lines))
    results = judge_files.read_results(spark, str(tmp_path))
    assert results.count() == 6
    got = {r.row_id: (r.score, r.status) for r in judge.join_results(pairs, results, "reference_free").collect()}
    assert got == {3: (81.0, "succeeded"), 4: (40.0, "succeeded"), 5: (0.0, "missing")}
    row = judge.progress(results).first()
    assert (row.succeeded, row.errored, row.expired, row.total) == (5, 1, 0, 6)
    assert row.percent == pytest.approx(500 / 6)


def test_write_requests(pairs, tmp_path):
    judge_files.write_requests(judge.judge_requests(pairs, settings("reference_free")), str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 3 and all(json.loads(x)["custom_id"].startswith("eval_reference_free_") for x in lines)


def test_going_on_from_stored_results(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "row_id long")
    stored = [("eval_m_0", "succeeded", 80.0), ("eval_m_1", "errored", 0.0), ("eval_m_1", "errored", 0.0), ("eval_other_2", "succeeded", 9.0), ("eval_m_x", "succeeded", 9.0)]
    results = spark.createDataFrame(stored, "custom_id string, status string, score double")
    assert sorted(r.row_id for r in judge.without_results(rows, results, "m").collect()) == [2, 3, 4, 5]
    assert sorted(r.row_id for r in judge.without_results(rows, results, "m", retry=True).collect()) == [1, 2, 3, 4, 5]
    filled = judge.join_and_fill(rows, results, rows.where("row_id < 4"), "m").orderBy("row_id").collect()
    assert [(r.score, r.status, r.is_imputed) for r in filled] == [
        (80.0, "succeeded", False), (0.0, "errored", False), (0.0, "missing", False), (0.0, "missing", False),
        (20.0, "not_sent", True), (20.0, "not_sent", True),
    ]
