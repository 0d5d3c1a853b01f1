"""Token counts through a digest cache.

Each text is normalised in a way that leaves its count alone (runs of space, tab, line feed and carriage return become one
space, outer ones go) and hashed. The cache is a Parquet table of (content, tokenizer, n_tokens), where ``tokenizer`` is the
digest of the tokenizer's file and the library's version. Contents that the cache lacks are made distinct, encoded once and
appended; every row then joins to its count, the counts of very frequent contents by broadcast (``common.join_one``). Repeated appends of one key do no harm, as a key has one count.

Nulls count as the empty text (0 tokens); repeated rows each get their count; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import join_one, materialise, slices

CACHE = "content string, tokenizer string, n_tokens long"
_LOADED: dict[str, tuple[object, dict[str, int]]] = {}


def tokenizer_version(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def counts_of(texts: list[str], path: str, most: int = 400_000) -> list[int]:
    """Tokens of each text. The tokenizer never joins characters across a space, so pieces between spaces are counted
    once and remembered (up to ``most`` short ones in a worker; then memory starts afresh)."""
    if path not in _LOADED:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = (Tokenizer.from_file(path), {"": 0})
    tokenizer, known = _LOADED[path]
    if len(known) > most:
        known.clear()
        known[""] = 0
    pieces = [x.split(" ") for x in texts]
    missing = list({p for row in pieces for p in row if p not in known})
    fresh = {}
    for a, b in slices([len(p) for p in missing], 1_000_000):
        fresh.update(zip(missing[a:b], map(len, tokenizer.encode_batch_fast(missing[a:b], add_special_tokens=False)), strict=True))
    out = []
    for row in pieces:
        try:
            out.append(sum(map(known.__getitem__, row)))
        except KeyError:
            out.append(sum(fresh[p] if p in fresh else known[p] for p in row))
    known.update((p, n) for p, n in fresh.items() if len(p) <= 40)
    return out


def encode_misses(path: str, version: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts], 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([version] * (b - a)), pa.array(counts_of(texts[a:b], path), pa.int64())], ["content", "tokenizer", "n_tokens"])

    return run


def read_cache(spark, cache: str, version: str) -> DataFrame | None:
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # nothing has been appended yet
        return None
    return table.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of (doc_id, text); appends to the cache at the path ``cache``."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(plain, 256).alias("content"), plain.alias("plain"))
    # written without the texts, as the counts meet these rows twice
    keyed = materialise(rows.drop("plain"), "token-rows")
    contents = keyed.groupBy("content").agg(F.count("*").alias("n_rows"))
    have = read_cache(spark, cache, version)
    misses = rows.select("content", "plain")
    if have is not None:
        misses = misses.join(have, "content", "left_anti")
    misses.dropDuplicates(["content"]).mapInArrow(encode_misses(tokenizer_path, version), CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    counted = materialise(contents.join(read_cache(spark, cache, version), "content"), "token-counts")
    n = F.col("n_tokens").cast("long")
    return join_one(keyed, counted, "content", "n_rows").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
