import hashlib
import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpora import corpus, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from gridstone.llm import bpe, token_file, tokens
from gridstone.llm.queries import tokenizer_path
from gridstone.llm.tokens import Chunked, Memo, Vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_path())


def test_ids_and_decoding_equal_the_library(spark, library):
    texts = corpus()
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(spark, texts), bpe.Bpe(tokenizer_path(), words=50), texts=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), bpe.Bpe(tokenizer_path())).count() == 0


@given(st.text(max_size=60) | st.lists(st.sampled_from([" ", "a", "é", "'s", "\n", "\x85", "\x1c", "12", "<|endoftext|>", "?!", "　", "ⅷ"]), max_size=20).map("".join))
@settings(max_examples=300, deadline=None)
def test_own_merging_equals_the_library(text):
    from tokenizers import Tokenizer

    from gridstone.llm.tokens import per_process

    library = per_process("test-library", lambda: Tokenizer.from_file(tokenizer_path()))
    vocabulary = per_process("test-vocabulary", lambda: Vocabulary(tokenizer_path()))
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    parts = vocabulary.parts(text)
    assert "".join(parts) == text
    assert vocabulary.encode(text) == library.encode(text, add_special_tokens=False).ids
    chunks = Chunked.of(pa.array([text, text]))
    assert [i for k in chunks.number for i in vocabulary.encode(chunks.raw(k).decode())] == 2 * vocabulary.encode(text)
    assert sum(len(chunks.raw(k)) for k in chunks.number[chunks.cuts[1] :]) == len(text.encode())


def test_every_code_point_equals_the_library(vocabulary, library, tmp_path):
    """As a letter before a contraction, in words, between spaces: by own merging and by the library on distinct chunks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    own = bpe.Encoder(bpe.Bpe(tokenizer_path(), memo=1 << 30), str(tmp_path / "none"))
    chunked = token_file.LibraryEncoder(tokenizer_path(), 1 << 30)
    for at in range(0, len(points), 20_000):
        texts = [f"{c}'s a{c}1 {c}{c} b {c}" for c in points[at : at + 20_000]]
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        column = pa.array(texts)
        assert [joined for _, joined, _ in own(column)] == ["".join(f"{i}," for i in ids).encode() for ids in want]
        ids, cuts = chunked(column)
        assert ids.tolist() == [i for x in want for i in x] and np.diff(cuts).tolist() == list(map(len, want))


def test_lexicon(tmp_path):
    words = {w.encode(): [i, i + 1] if i % 2 else [i] for i, w in enumerate(["a", "ab", "abs", "nation", "station", "ration", "é", "ationx", ""])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    assert {w: lexicon.get(w) for w in words} == words
    assert all(lexicon.get(w.encode()) is None for w in ("b", "abss", "natio", "stations", "zz"))
    one, three = len(bpe.compile_lexicon({b"nation": [1]})), len(bpe.compile_lexicon({b"nation": [1], b"station": [1], b"ration": [1]}))
    assert three < 2 * one  # endings are shared
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "none")).get(b"a") is None


def test_memo_keeps_words_in_use():
    memo = Memo(4)
    for w in "abcdefg":
        keys = [w, "a"]
        for i in memo.unknown(keys):
            memo.now[keys[i]] = keys[i]
    assert memo.unknown(["a"]) == [] and len(memo.now) <= 4


@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_elias_fano(steps, scale):
    values = np.cumsum(np.array(steps, np.int64) * 10**scale)
    coded = token_file.EliasFano.encode(values)
    assert coded.all().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert sum(map(len, token_file.EliasFano.encode(values).parts())) * 8 / 10_000 < 2 + np.log2(1000) + 2


def test_block_round_trip():
    for top in (100, 70_000):
        ids = np.random.default_rng(2).integers(0, top, 500)
        for names in ([None, -5, -5, 1 << 40], [7, 7, 8, 9], [None] * 4, [-(1 << 63), 0, 1, (1 << 63) - 1]):
            coded, back, doc_ids = token_file.read_block(token_file.write_block(np.array([0, 10, 10, 500]), ids, names))
            assert back.tolist() == ids.tolist() and coded.all().tolist() == [0, 10, 10, 500] and doc_ids == names
    with pytest.raises(ValueError):
        token_file.read_block(b"x" * 80)


def test_token_index_equals_the_library(spark, library):
    texts = corpus()
    p = token_file.TokenFiles(tokenizer_path(), block_ids=2000)
    docs = documents(spark, texts)
    got = sorted(token_file.token_index(docs.repartition(5), p).collect())
    at = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    blocks = token_file.write_token_files(docs, p)
    assert blocks.count() > 1 and blocks.agg({"n_ids": "sum"}).first()[0] == at
    assert token_file.token_index(empty(spark), p).count() == 0
    odd = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a"), (None, None)], "doc_id long, text string")
    rows = token_file.token_index(odd, p).collect()
    assert sorted(r["start"] for r in rows) in ([0, 1, 3, 5], [0, 2, 3, 5])


def test_word_counting_holds_little():
    """What an earlier operator left in a worker goes first, and 8 MB of text are counted in less than 100 MB."""
    tokens.latest_per_process("heavy", "earlier", lambda: bytearray(1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words and some more " * 40] * 8_000)], names=["text"])
    tracemalloc.start()
    counts = {}
    for part in bpe.count_words(iter([batch])):
        for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            counts[word] = counts.get(word, 0) + n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens._LOADED["heavy"][1] is None
    assert counts[b" some"] == 8_000 * 79 and counts[b"some"] == 8_000 and counts[b" "] == 8_000
    assert peak < 100 << 20
