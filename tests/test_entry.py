"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# One query of each area; set SEGEVAL_ALL_CHECKS=1 to run them all.
SAMPLE = (
    "rating_join reference_lookup_lenient rater_zscore score_histogram20 corr_pvalues bleu_sentence chrf_pp rouge_l_stemmed judge_requests "
    "evaluation_report describe_scores spearman_avg_rank rater_agreement corpus_scores_by_source corpus_scores_added scores_of_distinct_texts "
    "evaluation_resumed registered_table_metric score_files sketched_scores"
)


def chosen():
    names = entry.oracle_sql() if os.environ.get("SEGEVAL_ALL_CHECKS") else SAMPLE.split()
    return [n for n in names if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{entry.SMALL}/{name}.parquet'")
    return connection


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", chosen())
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, entry.SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = [tuple(dict(zip(columns, row))[c] for c in order) for row in cursor.fetchall()]
    got = [tuple(row[c] for c in order) for row in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 4 and "avg_correlation" in df.columns
