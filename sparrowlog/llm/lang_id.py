"""Language identification by prediction by partial matching.

One byte-context trie a language is learned from the labelled rows that a mask selects and then frozen. A text's exact code
length under each trie is summed over the whole text (letters in lower case, white space as one space); the shortest wins,
ties go to the first name. ``score`` is the posterior of the winner under equal priors, and ``bits_per_byte`` its rate.

Null texts and texts without a letter are ``und`` with score 0, as is everything where there is nothing to learn from. Repeated
rows count as often as they occur; extra columns are ignored. No counted context is left
out, however little text its language has: the values under all languages of the most frequent ones are broadcast, ``parts``
values at most, and a text's other positions meet theirs in a shuffle join (``ppm.rare_sums``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm import ppm
from sparrowlog.llm.common import canonical, materialise, slices, utf8

COUNTS = "group int, gram long, n long"
SUMS = "row long, doc_id long, held_out boolean, letters boolean, text_md5 string, trained boolean, n_symbols long, sums array<double>, grams array<long>, gram_times array<int>"


def count_contexts(order: int):
    """A map over (group, utf8): counts of packed contexts of each group."""

    def run(batches):
        shift = np.uint64(8 * (order + 1))

        def contexts():
            for batch in batches:
                groups = batch.column(0).to_numpy()
                texts = [canonical(x) for x in batch.column(1).to_pylist()]
                for a, b in slices([len(x) for x in texts], 4_000_000):
                    packed, n = ppm.grams(texts[a:b], order)
                    yield packed | (np.repeat(groups[a:b], n).astype(np.uint64) << shift)

        def rows(group, gram, n):
            return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["group", "gram", "n"])

        for keys, n in ppm.tally(contexts()):
            for i in range(0, len(keys), 500_000):
                k = keys[i : i + 500_000]
                yield rows((k >> shift).astype(np.int32), (k & np.uint64((1 << int(shift)) - 1)).astype(np.int64), n[i : i + 500_000])

    return run


def sum_batches(model, order: int):
    """A map over (doc_id, held_out, utf8, has_letter, text_md5, trained): a sum of known values for each language, and the positions without one."""

    def run(batches):
        from pyspark import TaskContext

        memo, row = ppm.Memo([model.value]), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [canonical(x) for x in batch.column(2).to_pylist()]
            for a, b in slices([len(x) for x in texts], 2_000_000):
                packed, n = ppm.grams(texts[a:b], order)
                total, grams, times = ppm.sums_and_rest(memo, packed, n)
                offsets = pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), *[batch.column(k).slice(a, b - a) for k in (0, 1, 3, 4, 5)], pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(total.ravel())), grams, times],
                    ["row", "doc_id", "held_out", "letters", "text_md5", "trained", "n_symbols", "sums", "grams", "gram_times"],
                )
                row += b - a

    return run


def predict_batches(names: list[str]):
    """A map over (doc_id, held_out, has_letter, text_md5, trained, symbols, sums): the language of the greatest sum."""

    def run(batches):
        for batch in batches:
            letters, n = batch.column(2).to_pylist(), batch.column(5).to_numpy()
            if names:
                total = batch.column(6).flatten().to_numpy().reshape(-1, len(names))
                best = total.argmax(axis=1)
                top = total.max(axis=1)
                sure = 1 / np.exp(total - top[:, None]).sum(axis=1)
                rate = -top / n / math.log(2)
                out = [(names[best[i]], float(sure[i]), float(rate[i])) if letters[i] else ("und", 0.0, None) for i in range(len(n))]
            else:
                out = [("und", 0.0, None)] * len(n)
            lang, score, bits = zip(*out, strict=True) if out else ([], [], [])
            columns = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), batch.column(5), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "n_symbols", "text_md5", "trained"])

    return run


def identify(docs: DataFrame, held_out: Column, order: int = 4, parts: int = 1 << 22) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte, n_symbols, text_md5 and trained (learned from) of every row of (doc_id, text, lang)."""
    spark = docs.sparkSession
    data = F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    labelled = docs.filter(~held_out & F.col("lang").isNotNull())
    names = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), data.alias("data"), letters.alias("letters"), F.md5(utf8(F.col("text"))).alias("text_md5"), (~held_out & F.col("lang").isNotNull()).alias("trained"))
    scored = rows.select("doc_id", "held_out", "letters", "text_md5", "trained", F.lit(1).cast("long").alias("n_symbols"), F.array().cast("array<double>").alias("sums"))
    if names:
        number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.col("lang")]
        counted = labelled.select(number.alias("group"), data.alias("data")).mapInArrow(count_contexts(order), COUNTS)
        counts = materialise(counted.groupBy("group", "gram").agg(F.sum("n").alias("n")), "lang-counts")
        short = spark.sparkContext.broadcast(ppm.short_levels(counts, len(names)))
        shared = spark.sparkContext.broadcast(ppm.known(counts, short, order, len(names), parts // len(names)))
        first = materialise(rows.mapInArrow(sum_batches(shared, order), SUMS), "lang-sums")
        far = ppm.rare_sums(first, counts, short, order, len(names))
        total = F.array(*[F.col("sums")[g] + F.coalesce(f"rare_{g}", F.lit(0.0)) for g in range(len(names))])
        scored = first.join(far, "row", "left").select("doc_id", "held_out", "letters", "text_md5", "trained", "n_symbols", total.alias("sums"))
    return scored.mapInArrow(predict_batches(names), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double, n_symbols long, text_md5 string, trained boolean")


def without_language(found: DataFrame, reach: float = 4.0, bits: float = 16.0) -> DataFrame:
    """The rows of ``identify``'s result that are in no learned language: without a letter, or coded at a rate that lies
    ``reach`` times as far above the median of its language's training rows as their 99th percentile does. The first ``bits``
    of each text don't count, as the first symbols of a short text cost most."""
    rate = F.greatest(F.col("bits_per_byte") - bits / F.col("n_symbols"), F.lit(0.0))
    usual = found.filter(F.col("trained") & F.col("bits_per_byte").isNotNull()).groupBy("lang_pred").agg(F.percentile_approx(rate, [0.5, 0.99], 100_000).alias("q"))
    usual = usual.select("lang_pred", (F.col("q")[0] + reach * (F.col("q")[1] - F.col("q")[0])).alias("most"))
    # the broadcast has a row for each learned language
    return found.join(F.broadcast(usual), "lang_pred", "left").filter((F.col("lang_pred") == "und") | (rate > F.col("most"))).drop("most")
