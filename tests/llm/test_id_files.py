"""Simple-8b code: round trips, escapes, random access, and whole files."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm import id_files
from flowlens.llm.tokens import PieceEncoder
from flowlens.plans.workspace import work_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
VALUE = st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**60), st.integers(0, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(VALUE, min_size=1, max_size=300), max_size=6))
def test_round_trip(runs):
    sizes = np.array([len(r) for r in runs], np.int64)
    values = np.array([v for r in runs for v in r], np.uint64)
    words, first, at, escaped = id_files.pack(values, sizes)
    assert (id_files.unpack(words, at, escaped) == values).all()
    assert len(at) == int((values >> np.uint64(60) > 0).sum())
    for k, run in enumerate(runs):  # every run begins a word
        end = first[k + 1] if k + 1 < len(runs) else len(words)
        start = int(sizes[:k].sum())
        inside = (at >= start) & (at < start + len(run))
        assert id_files.unpack(words[first[k]:end], at[inside] - start, escaped[inside]).tolist() == run


def test_runs_of_zeros_and_small_values_are_dense():
    words, *_ = id_files.pack(np.zeros(480, np.uint64), np.array([480]))
    assert len(words) == 2
    words, *_ = id_files.pack(np.ones(120, np.uint64), np.array([120]))
    assert len(words) == 2
    words, *_ = id_files.pack(np.full(300, 30_000, np.uint64), np.array([300]))
    assert len(words) == 75


@pytest.mark.parametrize("block_ids", [40, 65_536])
def test_file_of_documents(spark, monkeypatch, block_ids):
    monkeypatch.setattr(id_files, "BLOCK_IDS", block_ids)
    texts = ["", None, "Plain words, here.", "long " * 4000, "É ß ñ 中 12", "tie"] * 7
    rows = [(3 * k - 20, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (1, "same id", 1), (1, "same id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(6)
    path = work_folder(spark, "ids")
    id_files.write_ids(docs, path, PATH)
    found = [tuple(r) for r in id_files.read_ids(spark, path).collect()]
    tokenizer = Tokenizer.from_file(PATH)
    start, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_in_texts(name):
    path = public_tokenizers.path(name)
    texts = ["a <|endoftext|> b", "<|startoftext|>One.<|endoftext|>", "x<|ENDOFTEXT|> <|EndOfText|>, y", "A<|endoftext|>.",
             "<|endoftext|", "plain  words <|endoftext|>", "a <|ENDOFTEXT|> b"]
    ids, sizes = PieceEncoder(path).encode(texts)
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert any(i in want[0] for i in (49407, 50256))


def test_documents_with_special_tokens(spark):
    texts = ["a <|endoftext|> b", "after", "<|startoftext|>X <|ENDOFTEXT|>", "end"]
    path = work_folder(spark, "ids")
    id_files.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    start, want = 0, []
    for doc, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in id_files.read_ids(spark, path).collect()) == want


def test_empty_table(spark):
    path = work_folder(spark, "ids")
    id_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert id_files.read_ids(spark, path).count() == 0
