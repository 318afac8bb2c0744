"""Token files: the code round-trips, damage is found, ids equal the tokenizer's, read back whole."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokenfile as T

P = pytest.importorskip("public_tokenizers").path(T.TOKENIZER)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 1000, T.BLOCK, T.BLOCK + 7, 3 * T.BLOCK - 1])
def test_code_round_trips(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32), np.full(n, 7, np.uint32), rng.integers(0, 49_408, n).astype(np.uint32)):
        data = T.pack(ids, {"a": 1})
        assert (T.unpack(data) == ids).all() and T.header(data)[0]["a"] == 1
        if n > T.BLOCK:
            assert (T.unpack(data, 1, 1) == ids[T.BLOCK : 2 * T.BLOCK]).all()


def test_size_and_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.5, 300_000), 49_000).astype(np.uint32)
    data = T.pack(ids, {})
    p = np.bincount(ids) / len(ids)
    assert len(data) < 1.05 * -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8 + 20_000
    for at in (5, 20, len(data) - 9):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises((ValueError, zlib.error)):
            T.unpack(bytes(bad))


def test_read_back(spark, tmp_path):
    rows = [(5, "The quick  brown\tfox, isn't it? 12 ÀÉ ß"), (2, None), (3, ""), (9, "x" * 3000), (7, 'a "b" <|endoftext|> ' * 400), (4, "İ Σας  nb é 漢字"), (5, "again"), (None, "none")]
    T.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), P, shard_ids=500)
    got = T.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    t, start = Tokenizer.from_file(P), 0
    want = {}
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == [None, 2, 3, 4, 5, 5, 7, 9]
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    T.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), P)
    assert T.read(spark, str(tmp_path / "e")).count() == 0


def test_words_make_texts():
    t, e = Tokenizer.from_file(P), T.Encoder(P, 1)
    texts = ["", " a b ", "don't  stop\nwe'll", "ÑOÑO. foo,bar baz", "á ́b 's"]
    ids, sizes = e(pa.array(texts))
    assert ids.tolist() == [x for s in texts for x in [*t.encode(s, add_special_tokens=False).ids, 1]]
    assert sizes.tolist() == [len(t.encode(s, add_special_tokens=False).ids) + 1 for s in texts]


def test_small_memory_gives_the_same_ids():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the given tables")
    table = pq.read_table(path).sort_by("doc_id")
    texts = [t or "" for t in table["text"].to_pylist()] + ["x<|endoftext|>y <|startoftext|>", "it's 'some o'clock 12a3 ½ ²", "ÀÈ ﬁne ŒŸ naïve_é", "a\x00b \x1cc"]
    want = [[*e.ids, 1] for e in Tokenizer.from_file(P).encode_batch_fast(texts, add_special_tokens=False)]
    for remember in (1_000_000, 50):
        encode, got = T.Encoder(P, 1, remember), []
        for batch in T.sliced([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})], 20_000):
            ids, sizes = encode(batch.column(1))
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want and len(encode.words) < max(remember, 20_000)


def test_whole_table_is_read_back(spark):
    import os

    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("needs the given tables")
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{where}/documents.parquet").collect())
    t, start, want = Tokenizer.from_file(P), 0, []
    for d, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.query(spark, where).collect())) == want


def test_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c", 1, 2, "x"), (1, "a", 3, 4, "y")], "doc_id long, text string, part int, n_tokens int, container string")
    T.write(docs, str(tmp_path / "c"), P)
    got = T.read(spark, str(tmp_path / "c")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 2), (2, 2, 3)]
