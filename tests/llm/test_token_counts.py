import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from segeval.llm import token_counts as counts
from segeval.llm.token_counts import KEY, PieceCounter, distinct_pre_tokens, frequent, key_of, pre_tokens, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text or ""))


ODD = [
    "", " ", "  ", "\n", "\n\n", " \n", "\n ", "a\nb", "a \n b", "a  b", " a", "a ", "▁", "a▁b", "▁▁a", "<s>x</s> <unk>", "<0x0A>", "\t", "a\tb  \r\n",
    "a\x00b", "　x", "ﬁ", "日本語 日本語", "é é", "\U0001f600 \U0001f600", "x" * 5000, " " * 300, "word" * 40 + " " + "word" * 40,
]


def test_pre_tokens_hold_the_text():
    for text in ODD:
        assert "".join(pre_tokens(text)) == (" " + text.replace("▁", " ") if text else "")


def test_pieces_of_pre_tokens_are_those_of_the_text(whole):
    counter = PieceCounter(MODEL)
    for text in ODD:
        assert sum(counter.count(pre_tokens(text)) if text else []) == whole(text), repr(text)


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_counts_are_those_of_whole_texts(spark, odd_rows, odd_docs, whole, head):
    found = token_counts(odd_docs, MODEL, ["doc_id"], limit=20, head=head).collect()
    assert len(found) == len(odd_rows)
    texts = {i: t or "" for i, t, _ in odd_rows}
    for row in found:
        text = texts[row["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), whole(text))
        assert row["over_limit"] == (whole(text) > 20)


def test_odd_texts_copies_and_clashing_keys(spark, whole):
    rows = [(None, t, i, "k") for i, t in enumerate(ODD)] + [(1, "same words", 0, "k")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, `rest` string")
    found = token_counts(docs, MODEL, ["doc_id", "row", "rest"], head=3)
    assert sorted((r["row"], r["n_tokens"]) for r in found.where("doc_id is null").collect()) == [(i, whole(t)) for i, t in enumerate(ODD)]
    assert [r["n_tokens"] for r in found.where("doc_id = 1").collect()] == [whole("same words")] * 4


def test_empty_table(spark, no_docs):
    assert token_counts(no_docs, MODEL, ["doc_id"]).collect() == []


def test_head_is_bounded_and_the_rest_is_rare(spark):
    text = " ".join(["hot"] * 900 + ["warm"] * 50 + [f"w{i}" for i in range(300)])
    counted = distinct_pre_tokens(spark.createDataFrame([(text,), (text,)], "text string"), MODEL).cache()
    assert counted.where("key = ' hot'").first()["places"] == 1800
    assert counted.groupBy("key").count().where("count > 1").count() == 0
    assert set(frequent(counted, 5)) == {" hot", " warm"}
    assert len(frequent(counted, 302)) == 302 and frequent(counted, 1) == {" hot": 1}


def test_long_pre_tokens_go_by_digest(spark, whole):
    long = "x" * (KEY + 1)
    assert key_of(long) != key_of(long + "x") and len(key_of(long * 1000)) < KEY and key_of("short") == "short"
    docs = spark.createDataFrame([(i, f"{long} {long}y") for i in range(6)], "doc_id long, text string")
    assert {r["n_tokens"] for r in token_counts(docs, MODEL, ["doc_id"], head=0).collect()} == {whole(f"{long} {long}y")}


def test_rare_pre_tokens_are_handed_on_before_many_gather(monkeypatch):
    monkeypatch.setattr(counts, "LISTED", 20)
    texts = [" ".join(f"w{i}x{j}" for j in range(i % 9)) + " known" * (i % 3) for i in range(100)]
    columns = {"row": range(100), "of": [{"doc_id": i} for i in range(100)], "n_bytes": [len(t) for t in texts], "text": texts}
    batch = pa.RecordBatch.from_pydict({name: list(values) for name, values in columns.items()})
    found = list(counts._weighed(iter([batch, batch.slice(0, 0)]), {" known": 3}))
    assert len(found) > 10 and all(len(b.column("rest").flatten()) < 20 + 9 for b in found)
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(r["row"], r["of"]["doc_id"], r["n_bytes"], r["known"]) for r in rows] == [(i, i, len(t), 3 * (i % 3)) for i, t in enumerate(texts)]
    assert [[(p["key"], p["n"]) for p in r["rest"]] for r in rows] == [[(f" w{i}x{j}", 1) for j in range(i % 9)] for i in range(100)]


def test_a_model_that_joins_words_is_refused():
    class Joined:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    original = sentencepiece.SentencePieceProcessor
    sentencepiece.SentencePieceProcessor = lambda model_file: Joined()
    try:
        with pytest.raises(ValueError, match="of▁the"):
            PieceCounter(MODEL)
    finally:
        sentencepiece.SentencePieceProcessor = original
