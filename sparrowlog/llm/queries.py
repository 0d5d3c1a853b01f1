"""The registered queries of this folder, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlog.llm import common, conversation_trie, html_text, jaccard, lang_id, lm_score, lsh_forest, media_ts, oracles, packing, quality, quotes, spelling, tiling, token_counts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(modulus: int) -> Column:
    return common.remainder(F.col("doc_id"), modulus) == 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out(4))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


def pack(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"), held_out(7))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{common.shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.read_documents(media_ts.store_documents(read(spark, sf_dir, "documents")))


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read(spark, sf_dir, "documents"), held_out(4))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(read(spark, sf_dir, "conversations"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read(spark, sf_dir, "documents"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build_trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_html_text, op3_jaccard, op4_packing, op5_lm_score, op6_token_counts, op7_media, op8_tiling, op9_language, op10_quotes, op11_spelling, op12_lsh_forest, op13_conversation_trie)}
ORACLES: dict[str, str] = {"op11_spelling": oracles.SPELLING, "op12_lsh_forest": oracles.NEAR_DUPLICATES, "op13_conversation_trie": oracles.CONVERSATION_TRIE}
