import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from tuneforge.llm import queries, token_orc
from tuneforge.llm.queries import tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
ENCODER = token_orc.WordCachedEncoder(tokenizer_path(), 50)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,\x1c\x85  　a'sB1é<|>٣", max_size=30), max_size=4))
def test_cached_words_give_the_tokenizers_ids(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_special_token_text():
    for text in ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>  x."]:
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids_of(text)


def brute(rows):
    start = 0
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*ids_of(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_on_the_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op1_token_orc(spark, SF_SMALL).orderBy("doc_id").collect()]
    assert got == brute(docs)


def test_odd_rows_round_trip(spark, odd_docs, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write_tokens(odd_docs, path, tokenizer_path(), 2)
    tokens = token_orc.read_tokens(spark, path)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in token_orc.digest(tokens).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    starts = sorted((r["start"], r["n_tokens"]) for r in token_orc.with_starts(tokens).collect())
    assert starts == [(r[1], r[2]) for r in brute(rows)]


def test_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write_tokens(make_docs([]), path, tokenizer_path(), 2)
    assert token_orc.digest(token_orc.read_tokens(spark, path)).collect() == []


def test_stripes_and_pruning(spark, make_docs, tmp_path):
    docs = make_docs([(k, f"text number {k} " * 40) for k in range(3000)]).coalesce(1)
    path = tmp_path / "t"
    token_orc.write_tokens(docs, str(path), tokenizer_path(), 2, stripe_bytes=1 << 16)
    files = [orc.ORCFile(f) for f in path.glob("*.orc")]
    assert sum(f.nstripes for f in files) > len(files)
    assert sum(f.nrows for f in files) == 3000
    one = token_orc.read_tokens(spark, str(path)).where("doc_id = 1234")
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.first()["ids"] == [*ids_of("text number 1234 " * 40), 2]


def test_files_hold_run_lengths_row_indexes_and_bloom_filters(spark, make_docs, tmp_path):
    """Read from the stripe footers by the ORC library itself: encodings and streams of every stripe."""
    path = tmp_path / "t"
    token_orc.write_tokens(make_docs([(k, f"text number {k} " * 40) for k in range(3000)]).coalesce(1), str(path), tokenizer_path(), 2, stripe_bytes=1 << 16)
    jvm, stripes, compressed = spark._jvm, 0, 0
    for f in path.glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows, names = reader.rows(), list(reader.getSchema().getFieldNames())
        doc_id = reader.getSchema().getChildren()[names.index("doc_id")].getId()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = [(s.getColumn(), s.getKind().toString(), s.getLength()) for s in footer.getStreamsList()]
            kinds = [c.getKind().toString() for c in footer.getColumnsList()]
            assert kinds[0] == "DIRECT" and set(kinds[1:]) == {"DIRECT_V2"}  # the row itself, then integer run-length coding (version 2)
            assert {c for c, kind, _ in streams if kind == "ROW_INDEX"} == set(range(len(kinds)))
            assert [c for c, kind, n in streams if kind == "BLOOM_FILTER_UTF8" and n > 0] == [doc_id]
            stripes += 1
            compressed += sum(n for _, kind, n in streams if kind == "DATA")
        rows.close()
    n_ids = sum(r["n_tokens"] for r in token_orc.read_tokens(spark, str(path)).collect())
    assert stripes > 1 and compressed < 2 * n_ids  # four bytes an id without coding


def test_new_words_in_one_call_are_told_apart():
    texts = [" ".join(f"word{k}é" for k in range(2000)), "a <|endoftext|> b " + " ".join("xyz."[: 1 + k % 4] for k in range(50)), " lead", ""]
    encoder = token_orc.WordCachedEncoder(tokenizer_path(), 100)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids_of(t) for t in texts]


def test_known_words_are_compared_and_take_little_memory():
    words = pa.array([f"word{k}" for k in range(100_000)], pa.large_string())
    known = token_orc.KnownWords()
    known.add(words.slice(0, 60_000).take(pa.array(range(60_000))))
    known.add(words.take(pa.array(range(60_000, 100_000))))
    assert known.find(words).tolist() == list(range(100_000))
    assert known.find(token_orc._plain(["word7", "none", "word99999x"])).tolist() == [7, -1, -1]
    known.hashes[:] = known.hashes[0]  # all words alike by their hash
    assert set(known.find(words)) <= {-1, int(known.numbers[0])}
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    encoder = token_orc.WordCachedEncoder(tokenizer_path(), 200_000)
    encoder._forget()
    held = tracemalloc.get_traced_memory()[0]
    encoder.encode_column(pa.array([" ".join(["a", *words.to_pylist()])]))
    held = tracemalloc.get_traced_memory()[0] - held + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(encoder.words) == 100_000 and held < 80 * 100_000  # 150 bytes a word in a dict


def test_workers_drop_the_encoder_with_its_job(spark, make_docs, tmp_path):
    """Later jobs in the same worker processes do not carry the words of an earlier one."""
    def alive(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "WordCachedEncoder" for x in gc.get_objects())], pa.int64())], names=["n"])

    token_orc.write_tokens(make_docs([(k, f"text number {k} " * 40) for k in range(400)]).repartition(8), str(tmp_path / "t"), tokenizer_path(), 2)
    assert sum(r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(alive, "n long").collect()) == 0
