"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import read, shared_path
from .decontamination import find_contamination
from .lexical_search import search
from .license_scan import scan_licenses
from .mixing import mix_report
from .near_dedup import near_duplicates
from .prefix_trie import rebuilt_trie
from .quality_rules import quality_report
from .sharding import read_shards, shard_digest, shuffle_into_shards, write_shards
from .simhash import simhash_duplicates
from .substring_dedup import dedup_substrings, substring_digest
from .suffix_dedup import dedup_repeated_bytes, removed_digest
from .token_output import read_token_digests, write_tokens
from .warc_revisits import records_of_pages, resolve_revisits

TOKENIZER = "word_bpe_49k.json"


def token_rows(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the tokens of ``docs`` in the block format, in the shared folder, and read them back."""
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or public_tokenizers.path(TOKENIZER))
    return read_token_digests(spark, path)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digest(dedup_repeated_bytes(read(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(dedup_substrings(read(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded, path = shuffle_into_shards(read(spark, sf_dir, "documents")), shared_path(spark, "shards")
    write_shards(sharded, path)
    return shard_digest(read_shards(spark, path, sharded.schema))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(records_of_pages(read(spark, sf_dir, "pages")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(read(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_mixing, op3_suffix_dedup, op4_decontamination, op5_near_dedup, op6_license_scan,
        op7_substring_dedup, op8_sharding, op9_quality_rules, op10_warc_revisits,
        op11_lexical_search, op12_prefix_trie, op13_simhash_dedup,
    )
}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
