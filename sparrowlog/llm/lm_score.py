"""Language-model scoring: code length of whole texts under a byte-context PPM trie, beside an add-one unigram base.

``score_documents`` learns from the rows that a mask selects and scores every row. Both models see the same stream: A-Z in
lower case, words joined by one space and a final space and end symbol. Nulls and white space only count as the empty text,
which has the end token alone. Rows that repeat are counted and scored each time; extra columns are ignored. An empty
training set leaves the uniform model and a base of (0+1)/(0+1*(0+1)).

Words are compared by a 64-bit hash. Words that hold at least one part in 2^20 of all tokens are broadcast (there can be no
more than 2^20 of them); the rest of each document's words meet their counts in a shuffle join. So do the contexts: the most
frequent ones are broadcast, at most ``parts``, the others meet their values in a join (``ppm.rare_sums``); none is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm import ppm
from sparrowlog.llm.common import canonical, found_in, materialise, slices, sums, utf8, word_hashes

COUNTS = "kind byte, key long, n long"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>, grams array<long>, gram_times array<int>"


def stream(text: bytes) -> bytes:
    """What is coded: each word and a space after it."""
    text = canonical(text)
    return text + b" " if text else b""


def count_tokens_and_contexts(order: int, slice_bytes: int = 4_000_000):
    """A map over (utf8) giving counts of words (kind 1), packed contexts (kind 0), texts (2) and symbols (3)."""

    def run(batches):
        seen = {"texts": 0, "symbols": 0}

        def each():
            for batch in batches:
                texts = [canonical(x) for x in batch.column(0).to_pylist()]
                for a, b in slices([len(x) for x in texts], slice_bytes):
                    yield texts[a:b]

        def both():
            """Arrays of contexts; words are put aside on the way."""
            for texts in each():
                words.append(word_hashes(texts)[0])
                packed, _ = ppm.grams([x + b" " if x else x for x in texts], order)
                seen["texts"] += len(texts)
                seen["symbols"] += len(packed)
                yield packed

        words: list[np.ndarray] = []

        def rows(kind, keys, counts):
            for i in range(0, len(keys), 500_000):
                k = keys[i : i + 500_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[i : i + 500_000].astype(np.int64))], ["kind", "key", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, counts in ppm.tally(squeeze(both(), words, held)):
            yield from rows(0, keys, counts)
        for keys, counts in [ppm.merged(held)] if held else []:
            yield from rows(1, keys, counts)
        if seen["texts"]:
            yield from rows(2, np.zeros(1, np.uint64), np.array([seen["texts"]]))
            yield from rows(3, np.zeros(1, np.uint64), np.array([seen["symbols"]]))

    return run


def squeeze(contexts, words: list[np.ndarray], held: list) -> object:
    """Pass arrays of contexts through; fold the words put aside with each into ``held``, now and then merged."""
    for x in contexts:
        while words:
            held.append(np.unique(words.pop(), return_counts=True))
        if sum(len(k) for k, _ in held) > 3_000_000:
            held[:] = [ppm.merged(held)]
        yield x


def score_batches(model, order: int, slice_bytes: int = 2_000_000):
    """A map over (doc_id, held_out, utf8); model: broadcast (known contexts, sorted words, their log10 of count + 1)."""

    def run(batches):
        from pyspark import TaskContext

        contexts, frequent, logs = model.value
        memo, row = ppm.Memo([contexts]), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [canonical(x) for x in batch.column(2).to_pylist()]
            for a, b in slices([len(x) for x in texts], slice_bytes):
                part = texts[a:b]
                words, n_words = word_hashes(part)
                packed, n_symbols = ppm.grams([x + b" " if x else x for x in part], order)
                score, grams, gram_times = ppm.sums_and_rest(memo, packed, n_symbols)
                hit, at = found_in(frequent, words)
                base = sums(np.where(hit, logs[at] if len(logs) else 0.0, 0.0), n_words)
                known = sums(hit.astype(np.float64), n_words).astype(np.int64)
                rare, times = ppm.lists(*ppm.rare_of(words[~hit], np.repeat(np.arange(len(part)), n_words)[~hit], len(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(part))), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n_words + 1), pa.array(known), pa.array(base), pa.array(score[:, 0]), rare, times, grams, gram_times],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times", "grams", "gram_times"],
                )
                row += len(part)

    return run


def score_documents(docs: DataFrame, held_out: Column, order: int = 5, parts: int = 1 << 21, frequent_parts: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), utf8(F.col("text")).alias("utf8"))
    counted = rows.filter(~F.col("held_out")).select("utf8").mapInArrow(count_tokens_and_contexts(order), COUNTS)
    counts = materialise(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    total = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    of = lambda kind, name: total[kind][name] if kind in total else 0
    texts = of(2, "n")
    tokens, vocabulary = of(1, "n") + texts, of(1, "distinct") + (texts > 0)
    edges = counts.filter("kind = 0").select(F.lit(0).alias("group"), F.col("key").alias("gram"), "n")
    short = spark.sparkContext.broadcast(ppm.short_levels(edges, 1))
    contexts = ppm.known(edges, short, order, 1, parts)
    floor = of(1, "n") / frequent_parts
    common = counts.filter(F.col("kind") == 1).filter(F.col("n") >= floor).select("key", "n").toArrow()
    keys, n = np.asarray(common["key"]).view(np.uint64), np.asarray(common["n"])
    by_key = np.argsort(keys)
    model = spark.sparkContext.broadcast((contexts, keys[by_key], np.log10(n[by_key] + 1.0)))
    scored = materialise(rows.mapInArrow(score_batches(model, order), SCORED), "lm-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    rest = rest.join(counts.filter(F.col("kind") == 1).filter(F.col("n") < floor).select("key", "n"), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_base"), F.sum("times").alias("rare_known"))
    far = ppm.rare_sums(scored, edges, short, order, 1)
    end = math.log10(texts + 1)
    return scored.drop("rare", "times", "grams", "gram_times").join(rest, "row", "left").join(far, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(tokens + vocabulary + 1))).alias("base_score"),
        ((F.col("score") + F.coalesce("rare_0", F.lit(0.0))) / math.log(10)).alias("score"),
    )
