"""Registered corpus queries: SQL checks where there are any, shapes for all."""

import pytest

import compare
from flowlens.llm.catalog import CHECKS, QUERIES

SAMPLE = "/root/testdata/sf0.001"
COLUMNS = {
    "op4_near_duplicates": {"doc_id", "n_shingles", "component_id"},
    "op5_exact_search": {"query_id", "rank", "vec_id", "score"},
    "op6_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_quality_votes": {
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    },
    "op9_id_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op11_languages": {"doc_id", "held_out", "lang_pred", "score"},
    "op12_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op13_lexical_ranking": {"item_id", "rank", "doc_id", "score"},
}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SAMPLE)


def test_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SAMPLE)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    if name in CHECKS:
        assert compare.difference(df, duck, CHECKS[name]) is None
    elif name not in ("op1_tool_calls", "op6_packing", "op8_mixing", "op12_whitening"):  # those may have more rows than the table
        assert df.count() == spark.read.parquet(f"{SAMPLE}/documents.parquet").count()
    else:
        assert df.count() > 0
