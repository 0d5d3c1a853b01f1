"""Spelling variants by full neighbourhood generation.

Words are counted over whole texts; one word in 31 of a document loses a letter first, as the contract says. Every word's
neighbourhood is made whole: each distinct deletion, replacement and insertion over the alphabet that the vocabulary shows.
Candidates join the vocabulary by equality of strings, so no distance is ever computed and what joins is near.

Most candidates are no words. They are made as 64-bit codes first (a rolling code changes in constant time under one edit) and
looked up in a bit table of the vocabulary's codes; only those that hit are spelled out and joined. The table takes 16 bits a
word and at most 2^``bits`` (2^28: 32 MB) in all, at which it is broadcast; beyond that more candidates pass and the join still
decides, so results are the same.

A word's form is its near word of most occurrences (ties: least in code-point order), if it occurs ``ratio`` times as often or
more; the root follows forms by pointer jumping. Null texts have no words, a null doc_id counts as the empty text in the hash,
repeated rows count each, extra columns are ignored, an empty table gives no words. Words of any length are handled: a batch of
candidates is cut by edit positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import U64, materialise, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PROBES, SITES = (7, 29, 43), 8192


def count_words(docs: DataFrame, least_length: int, least_count: int, modulus: int) -> DataFrame:
    """(word, n) of the vocabulary of (doc_id, text)."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    rows = rows.select(F.concat_ws(":", "doc_id", F.translate("run", UPPER, LOWER)).alias("key"), F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.col("key").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def value(points: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point."""
    return mix(points.astype(np.uint64) + U64(0x51ED270B))


def powers(n: int) -> np.ndarray:
    """BASE to the power of 0 .. n."""
    out = np.full(n + 1, BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Code points of a batch of words, one after another, and sums of value * BASE^position up to each."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.power = powers(int(self.lengths.max(initial=0)) + 1)
        inside = np.arange(len(self.points)) - np.repeat(self.starts, self.lengths)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value(self.points) * self.power[inside], dtype=np.uint64)])

    def codes(self) -> np.ndarray:
        return mix(self.sums[self.starts + self.lengths] - self.sums[self.starts])


def slots(codes: np.ndarray, bits: int, shift: int) -> np.ndarray:
    """The bits that a probe looks at."""
    return ((codes >> U64(shift)) ^ (codes << U64(17))) & U64((1 << bits) - 1)


def filter_batches(bits: int):
    """(word) to (slot, bits): parts of the bit table, 64 bits each."""

    def run(batches):
        for batch in batches:
            codes = Words(batch.column(0).to_pylist()).codes()
            at = np.concatenate([slots(codes, bits, shift) for shift in PROBES])
            slot, inverse = np.unique(at >> U64(6), return_inverse=True)
            out = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(out, inverse, U64(1) << (at & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(out.view(np.int64))], ["slot", "bits"])

    return run


def bit_table(words: DataFrame, bits: int) -> bytes:
    """The bit table of (word); its size is 2^bits bits whatever the vocabulary."""
    parts = words.select("word").mapInArrow(filter_batches(bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[parts.column("slot").to_numpy()] = parts.column("bits").to_numpy()
    return out.tobytes()


def neighbour_batches(alphabet: list[int], table, bits: int, least_length: int):
    """(id, word) to (id, near): candidates of each word's neighbourhood that hit the bit table."""

    def passed(codes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        codes, at = mix(codes.ravel()), None
        for shift in PROBES:
            slot = slots(codes if at is None else codes[at], bits, shift)
            hit = np.flatnonzero((bitmap[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at

    def run(batches):
        bitmap = np.frombuffer(table.value, np.uint8)
        letters = np.array(alphabet, np.int64)
        values, signs = value(letters), [chr(x) for x in alphabet]
        for batch in batches:
            ids, w = batch.column(0).to_pylist(), Words(batch.column(1).to_pylist())
            sites = w.lengths + 1
            ends = np.cumsum(sites)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, SITES):
                site = np.arange(begin, min(begin + SITES, int(ends[-1])))
                word = np.searchsorted(ends, site, "right")
                i = site - (ends[word] - sites[word])
                first, length = w.starts[word], w.lengths[word]
                inner = i < length
                own = np.where(inner, w.points[np.minimum(first + i, len(w.points) - 1)], -1)
                before = w.sums[first + i] - w.sums[first]
                after = w.sums[first + length] - w.sums[first + i]
                step = value(own) * w.power[i]
                out: list[tuple[int, str]] = []
                # deletions, of the first of equal letters in a row
                last = np.where(i > 0, w.points[np.maximum(first + i - 1, 0)], -1)
                rows = np.flatnonzero(inner & (own != last) & (length > least_length))
                for k in rows[passed(before[rows] + (after[rows] - step[rows]) * INVERSE, bitmap)].tolist():
                    x, p = w.words[word[k]], i[k]
                    out.append((ids[word[k]], x[:p] + x[p + 1 :]))
                # replacements, and insertions before a letter that differs
                added = values[None, :] * w.power[i][:, None]
                other = letters[None, :] != own[:, None]
                for rows, codes, skip in ((np.flatnonzero(inner), (before + after - step)[:, None] + added, 1), (np.arange(len(site)), (before + after * BASE)[:, None] + added, 0)):
                    r, c = np.nonzero(other[rows])
                    at = passed(codes[rows][r, c], bitmap)
                    for k, letter in zip(rows[r[at]].tolist(), c[at].tolist(), strict=True):
                        x, p = w.words[word[k]], i[k]
                        out.append((ids[word[k]], x[:p] + signs[letter] + x[p + skip :]))
                if out:
                    a, b = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], ["id", "near"])

    return run


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers double in each round."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        far = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        state = materialise(state.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, modulus: int = 31, bits: int = 28, words_per_task: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (doc_id, text)."""
    spark = docs.sparkSession
    words = materialise(count_words(docs, least_length, least_count, modulus).withColumn("id", F.monotonically_increasing_id()), "words")
    # code points of words are those of the counted runs, so at most 26 + 64
    alphabet = sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect())
    n = words.count()
    bits = min(max(16 * n, 1 << 10).bit_length(), bits)
    table = spark.sparkContext.broadcast(bit_table(words, bits))
    found = words.select("id", "word").repartition(-(-n // words_per_task) or 1, "id").mapInArrow(neighbour_batches(alphabet, table, bits, least_length), "id long, near string")
    near = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best")
    of = words.join(near.groupBy("id").agg(F.count("*").alias("n_near"), best), "id", "left")
    formed = -F.col("best.order") >= ratio * F.col("n")
    of = of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.order")).alias("form_n"))
    of = materialise(of, "forms")
    return of.join(roots(of.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
