import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 int, size int, part string, bits double"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, words=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows (doc_id, text, source) with nulls, empty and long texts, ties and copies. Ids are distinct."""
    line = "this very line stands in many of the documents of the table"
    texts = [None, "", " ", "a", "ab", "\n", "\n\n", "word", "two words", prose(1), prose(1), prose(1), prose(2), "x" * 50_000, "7" * 30_000]
    texts += [f"{prose(10 + i)}\n{line}\n{prose(40 + i, 8)}" for i in range(7)]
    texts += [f"  {line.upper()} \t\n{prose(30)}", f"{line}\n{line}", "Ünïcödé " + prose(31) + " ÀÉÎ ß x", prose(32, 3000)]
    texts += [f"write to ann{i % 2}@mail.example.com or call +1 (555) 010-99{i}9 now, from 10.0.0.{i}" for i in range(8)]
    texts += ["card 4111 1111 1111 1111 and 4111-1111-1111-1112", "a@b a@b.c@d.e x@-.- 1.2.3.4.5.6.7.8 300.1.1.1 +12 345", "tab\tand  two\r\nlines"]
    sources = ["web", "books", None, "code", "", "web"]
    return [(3 * i if i else None, t, sources[i % len(sources)] if i % 3 else "web") for i, t in enumerate(texts)]


@pytest.fixture
def odd_docs(spark, odd_rows):
    """The rows with more columns, some named as helper columns may be."""
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "p", 0.5) for i, t, s in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("doc_id"))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
