import numpy as np
import public_tokenizers

from segeval.llm.token_files import encode_documents, read_token_files
from segeval.llm.tokens import WordEncoder
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_of_odd_rows(spark, odd_docs, odd_rows, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    rows = {r.doc_id: r for r in encode_documents(odd_docs, PATH, path).collect()}
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (i, _, _), ids in zip(ordered, brute.token_ids([t or "" for _, t, _ in ordered], PATH)):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), brute.crc(ids))
        start += len(ids)
    files = read_token_files(spark, path)
    assert [r.ids for r in files.where("doc_id = 9").collect()] == brute.token_ids([next(t for i, t, _ in odd_rows if i == 9)], PATH)
    assert encode_documents(no_docs, PATH).collect() == []


def test_files_hold_indexes_and_filters(spark, odd_docs, tmp_path):
    path = str(tmp_path / "tokens")
    encode_documents(odd_docs, PATH, path)
    plan = read_token_files(spark, path).where("doc_id = 6").select("ids")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in plan
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = [f.name for f in (tmp_path / "tokens").iterdir() if f.suffix == ".orc"]
    assert names
    kinds = set()
    for name in names:
        file = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() > 0
        data = reader.rows()
        for stripe in reader.getStripes():
            kinds |= {s.getKind().toString() for s in data.readStripeFooter(stripe).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_workers_keep_a_word_once_for_all_its_marks():
    texts = ["word. word, word\nword. Word", "a.b, a., x's. 3.14, 7. (end.) ends... é. z.\ny,", "...", ".", ", .", "word."]
    worker = WordEncoder(PATH)
    found = worker.encode(texts)
    assert [np.frombuffer(ids, dtype="<u4").tolist() + [2] for ids in found] == brute.token_ids(texts, PATH)
    assert {w for w in worker._kept if w.strip("\n").startswith("word")} == {"word", "\nword"}


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b c"), (0, None)], "doc_id long, text string")
    rows = sorted((r.start, r.n_tokens) for r in encode_documents(docs, PATH).collect())
    at = 0
    for start, n in rows:
        assert start == at
        at += n
