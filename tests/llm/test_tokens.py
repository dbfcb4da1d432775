import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wordloom.llm import bpe, huffman
from wordloom.llm.tokens import Words

DATA = "/root/testdata/sf0.001"
EXTRA = ["", "  a  b ", "\n\n x", " ", " 's", "'re", "a 's b", "日本語 テスト x  y", "x" * 3000, "don't  won't\t\tz ", "\x1c a", "a　 b", "🎉🎉 é", "<|endoftext|> hi"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(spark, n=150):
    return [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(n).collect()]


def test_columns_of_texts_equal_the_library(spark, vocabulary, library):
    all_ = texts(spark) + EXTRA
    for words in (Words(vocabulary.encode_many), Words(vocabulary.encode_many, keep=50)):
        for _ in range(2):
            ids, counts = words.encode_texts(pa.array(all_))
            want = [library.encode_ordinary(t) for t in all_]
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_appends_and_edits_are_exact(spark, vocabulary, library):
    rng, all_ = random.Random(3), texts(spark, 30)
    for _ in range(400):
        d = rng.choice(all_).encode()[: rng.randint(0, 80)]
        p = bpe.Prefixes(vocabulary, d[:20])
        p.append(d[20:])
        a = rng.randint(0, len(d))
        b = min(len(d), a + rng.randint(0, 5))
        new = rng.choice([b"", b"ab", b"\xff", " é".encode()])
        p.edit(a, b, new)
        fresh = bpe.Prefixes(vocabulary, d[:a] + new + d[b:])
        assert (p.last, p.sizes) == (fresh.last, fresh.sizes)
        t = rng.choice(all_)[: rng.randint(0, 200)] + rng.choice(EXTRA)
        a = rng.randint(0, len(t))
        b = min(len(t), a + rng.choice([0, 1, 30]))
        new = rng.choice(["", "x", " ", "  ", "'re", "\n", " th"])
        assert vocabulary.re_encode(t, library.encode_ordinary(t), a, b, new) == (t[:a] + new + t[b:], library.encode_ordinary(t[:a] + new + t[b:]))


def test_an_edit_stops_early(vocabulary):
    p = bpe.Prefixes(vocabulary, b"abcdefghij" * 400)
    assert p.edit(5, 6, b"zz") < 600


def test_query_equals_the_library(spark, library):
    from wordloom.llm.queries import QUERIES

    want = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = library.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_odd_rows_encode_and_decode(odd, none, library):
    rows = bpe.decode(bpe.encode(odd)).collect()
    want = sorted(((r.doc_id, (r.text or "").encode()) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in rows), key=str) == want
    assert {tuple(r.ids) for r in bpe.encode(odd, arrays=True).collect()} == {tuple(library.encode_ordinary(t.decode())) for _, t in want}
    assert bpe.encode(none).count() == 0
    assert bpe.encode(odd).columns == ["doc_id", "n_tokens", "ids"]


def test_decode_of_nulls_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, np.array([0], "<u4").tobytes())], "doc_id long, ids binary")
    assert [None if r.decoded is None else len(r.decoded) for r in bpe.decode(rows).orderBy("doc_id").collect()] == [None, 0, 1]
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe.decode(spark.createDataFrame([(1, np.array([60000], "<u4").tobytes())], "doc_id long, ids binary")).collect()


def test_replace_in_tables(spark, library):
    coded = lambda t: np.array(library.encode_ordinary(t), "<u4").tobytes()
    rows = [(1, "ab cd ef", coded("ab cd ef"), 8, None, " more"), (2, "ab cd ef", coded("ab cd ef"), 3, 5, None), (3, None, None, None, None, "x y"), (4, "abc", coded("abc"), 99, 100, "d")]
    got = bpe.replace(spark.createDataFrame(rows, "doc_id long, text string, ids binary, start int, end int, new string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["ab cd ef more", "ab  ef", "x y", "abcd"]
    assert all(bytes(r.ids) == coded(r.text) for r in got)


def test_codes_are_prefix_free_and_short_enough():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 50_000), 40_000).astype(np.uint32)
    counts = {int(i): int(n) for i, n in enumerate(np.bincount(ids)) if n}
    for limit in (16, 20):
        lengths = huffman.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0 ** -n for n in lengths.values()) <= 1
        code = huffman.Code(lengths)
        for n in (1, 511, 512, 513, 50_000):
            data, marks = code.encode(ids[:n])
            assert (code.decode(data, n, marks) == ids[:n]).all()
    assert huffman.code_lengths({}) == {} and huffman.code_lengths({5: 9}) == {5: 1}
    with pytest.raises(ValueError):
        huffman.code_lengths({i: 1 for i in range(5)}, 2)


def test_token_files_give_every_document_back(spark):
    from wordloom.llm.queries import QUERIES

    t = Tokenizer.from_file(huffman.TOKENIZER)
    t.encode_special_tokens = True
    at = 0
    rows = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*t.encode(d.text, add_special_tokens=False).ids, 0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows(odd, none):
    rows = huffman.read_tokens(huffman.write_tokens(odd)).orderBy("start").collect()
    assert len(rows) == odd.count()
    assert [r.id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda x: -1 if x is None else x)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert huffman.read_tokens(huffman.write_tokens(none)).count() == 0


def test_blocks_are_read_alone(spark, monkeypatch, tmp_path):
    from pyarrow import fs

    monkeypatch.setattr(huffman, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 300, n).astype("<u2").tobytes()) for k, n in enumerate([0, 1, 2500, 7, 999, 4000])]
    code = huffman.Code(huffman.code_lengths({k: 300 - k for k in range(300)}))
    huffman._write(fs.LocalFileSystem(), str(tmp_path / "f"), code, "<u2", iter(docs))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        file = huffman.TokenFile(f)
        whole = np.concatenate([np.frombuffer(d, "<u2") for _, d in docs])
        assert (file.block(3) == whole[3000:4000]).all()
        assert [(d, x.astype("<u2").tobytes()) for d, x in file.documents()] == docs


def test_added_tokens_as_a_plain_call_gives_them():
    t = Tokenizer.from_file(huffman.TOKENIZER)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "one two", "<|endoftext|> hi", "x <|endoftext |> y"]
    ids, lengths = huffman._words(huffman.TOKENIZER).encode_texts(pa.array(texts))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert 50256 in ids


@pytest.mark.parametrize("spaced", ["of the vocabulary", "none", "wrong"])
def test_words_in_runs_get_the_ids_of_a_plain_call(spark, spaced):
    t = Tokenizer.from_file(huffman.TOKENIZER)
    known = huffman._words(huffman.TOKENIZER)
    marks = {"of the vocabulary": known.spaced, "none": None, "wrong": np.zeros_like(known.spaced)}[spaced]
    words = Words(known.encode, whole=known.whole, spaced=marks)
    all_ = [*texts(spark), *EXTRA, "a\n", "\nfoo bar\n", "tab\tin words", "Ġx Ġ Ġ", "x " * 500 + "x", "é" * 70 + " \U0001f389 9's"]
    want = [t.encode(x, add_special_tokens=False).ids for x in all_]
    for _ in range(2):
        ids, lengths = words.encode_texts(pa.array(all_))
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
