"""Registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    checks, exact_search, id_files, languages, lexical_ranking, licenses, line_windows, mixing, near_duplicates, packing, pseudonyms, quality_votes, tool_calls, whitening,
)
from flowlens.plans.workspace import work_folder

DEMONSTRATION_KEY = "flowlens-demonstration-key"  # a real job passes its own secret


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, directory: str) -> DataFrame:
    """Calls and results of every conversation, linked, ordered and validated."""
    calls, results, schemas = tool_calls.conversation_calls(_table(spark, directory, "conversations"))
    return tool_calls.ordered(tool_calls.link_tool_calls(calls, results, schemas))


def op2_line_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return line_windows.remove_repeats(docs, removed="n_removed_lines")


def op3_pseudonyms(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with keyed pseudonyms for personal numbers, dates and addresses."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, DEMONSTRATION_KEY)


def op4_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """Class of every document under 5-word shingles and a similarity of 0.8."""
    return near_duplicates.document_classes(_table(spark, directory, "documents"))


def op5_exact_search(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 best matches of every twentieth vector among all others."""
    return exact_search.search(_table(spark, directory, "embeddings"), F.col("id") % 20 == 0)


def op6_packing(spark: SparkSession, directory: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    return packing.pack_documents(
        _table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op7_quality_votes(spark: SparkSession, directory: str) -> DataFrame:
    """Counts, base rule and weak-supervision verdict of every document."""
    return quality_votes.document_quality(_table(spark, directory, "documents"))


def op8_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """Every copy of every document in the temperature mix of all sources."""
    return mixing.mixed_documents(_table(spark, directory, "documents"))


def op9_id_files(spark: SparkSession, directory: str) -> DataFrame:
    """Ids of all documents written as files, read back and digested per document."""
    path = work_folder(spark, "token-ids")
    id_files.write_ids(_table(spark, directory, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return id_files.read_ids(spark, path)


def op10_licenses(spark: SparkSession, directory: str) -> DataFrame:
    """The best-matching licence notice of every document."""
    return licenses.document_licenses(_table(spark, directory, "documents"))


def op11_languages(spark: SparkSession, directory: str) -> DataFrame:
    """Language of every document by character models learned from the labelled ones that are not held out."""
    return languages.identify(_table(spark, directory, "documents"))


def op12_whitening(spark: SparkSession, directory: str) -> DataFrame:
    """Every vector whitened along the 32 leading components."""
    return whitening.whiten(_table(spark, directory, "embeddings"))


def op13_lexical_ranking(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_ranking.rank_documents(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_line_windows": op2_line_windows,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_exact_search": op5_exact_search,
    "op6_packing": op6_packing,
    "op7_quality_votes": op7_quality_votes,
    "op8_mixing": op8_mixing,
    "op9_id_files": op9_id_files,
    "op10_licenses": op10_licenses,
    "op11_languages": op11_languages,
    "op12_whitening": op12_whitening,
    "op13_lexical_ranking": op13_lexical_ranking,
}

# The others run iterated estimates, keyed hashes, tokenizers or JSON schemas, which
# SQL cannot express; tests compare them with brute-force versions.
CHECKS = {
    "op2_line_windows": checks.LINE_WINDOWS,
    "op4_near_duplicates": checks.NEAR_DUPLICATES,
    "op5_exact_search": checks.EXACT_SEARCH,
    "op10_licenses": checks.LICENSES,
    "op13_lexical_ranking": checks.LEXICAL_RANKING,
}
