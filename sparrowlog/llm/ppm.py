"""Prediction by partial matching over bytes with frozen statistics.

A context trie is held as one table of (context + symbol, count) a level: a context of ``order`` bytes and its symbol are
packed big-endian in one integer, and the table of a shorter context follows by dropping the oldest byte. A text is
preceded by ``order`` bytes 0xFE and ended by 0xFF; neither byte occurs in UTF-8, so every symbol has a whole context.

Counting is a Spark aggregation, and every counted edge takes part in the result. Positions whose longest edge is among the
most frequent (at most so many as a broadcast may hold) are looked up in a broadcast table of exact values. The others, with
how often a text has each, meet their values in a shuffle join (``rare_sums``). Values are computed in tasks that each get
all edges of some contexts: all that share their last ``BASE`` bytes lie in one task, which is all that the levels from ``BASE``
need of one another, and the levels below it, bounded by the alphabet and not by the input, are broadcast.

Probability (escape method D with full exclusion): in a context with total n, d distinct symbols and c occurrences of the
symbol, (c - 1/2) / n if it was seen there; else the escape is what remains, symbols seen there are excluded from all
shorter contexts, and the next shorter context decides. What no context knows is uniform over the symbols left of 257.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import U64, found_in, materialise, sums

START, END, SYMBOLS, BASE = b"\xfe", b"\xff", 257, 3


def grams(docs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed context and symbol at each position of each text, its end included, and the positions a text has."""
    counts = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    if not docs:
        return np.zeros(0, np.uint64), counts
    blob = START * order + (END + START * order).join(docs) + END + bytes(8)
    n = len(blob) - 8
    at_byte = np.ndarray(n, ">u8", blob, 0, (1,)).astype(np.uint64) >> U64(64 - 8 * (order + 1))
    keep = np.ones(n - order, bool)
    ends = np.cumsum(counts + order) - order  # after each text: the next text's start bytes
    keep[(ends[:-1, None] + np.arange(order)).ravel()] = False
    return at_byte[: n - order][keep], counts


def tally(parts: Iterable[np.ndarray], most: int = 4_000_000) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Distinct values and counts of the arrays, merged as they come so that memory stays bounded."""
    held, size = [], 0
    for x in parts:
        held.append(np.unique(x, return_counts=True))
        size += len(held[-1][0])
        if size > most:
            held = [merged(held)]
            size = len(held[0][0])
            if size > most // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield merged(held)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Trie:
    """A frozen context trie; ``logp`` gives the natural logarithm of the probability of packed positions."""

    width = 1

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], symbols: int = 0, texts: int = 0, whole: bool = False):
        """levels: sorted packed edges and counts, level 0 first; symbols and texts: how many were counted; whole: each context
        that is there has all its edges, so their sum is its total."""
        self.levels = [(k.astype(np.uint64), n.astype(np.float64)) for k, n in levels]
        self.contexts = []
        for j, (keys, counts) in enumerate(self.levels):
            if not len(keys):
                self.contexts.append((keys, *[np.zeros(0)] * 4))
                continue
            above = keys >> U64(8)
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            own = above[first]
            distinct = np.diff(np.concatenate([first, [len(keys)]])).astype(np.float64)
            kept = np.add.reduceat(counts, first)
            if whole:
                total = kept
            elif j == 0:
                total = np.array([float(symbols)])
            else:
                hit, at = found_in(self.levels[j - 1][0], own)
                total = np.maximum(np.where(hit, self.levels[j - 1][1][at], float(texts)), kept)
            if j == 0:
                shorter = np.zeros(1)
            else:
                _, at = found_in(self.levels[j - 1][0], keys & U64((1 << 8 * j) - 1))
                shorter = np.add.reduceat(self.levels[j - 1][1][at], first)
            self.contexts.append((own, total, distinct, shorter, kept))

    def logp(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted))
        open_, mass, seen = np.arange(len(wanted)), np.zeros(len(wanted)), np.zeros(len(wanted))
        for j in range(len(self.levels) - 1, -1, -1):
            part = wanted[open_] & U64((1 << 8 * (j + 1)) - 1)
            hit, at = found_in(self.contexts[j][0], part >> U64(8))
            rows = np.flatnonzero(hit)
            if not len(rows):
                continue
            at, who, part = at[rows], open_[rows], part[rows]
            _, total, distinct, shorter, kept = (x[at] for x in self.contexts[j])
            n, d, new = total - mass[who], distinct - seen[who], kept - mass[who]
            known, edge = found_in(self.levels[j][0], part)
            useful = d > 0
            coded, escaped = known & useful, ~known & useful
            out[who[coded]] += np.log((self.levels[j][1][edge[coded]] - 0.5) / n[coded])
            out[who[escaped]] += np.log((n[escaped] - new[escaped] + d[escaped] / 2) / n[escaped])
            mass[who[~known]], seen[who[~known]] = shorter[~known], distinct[~known]
            done = np.zeros(len(open_), bool)
            done[rows[coded]] = True
            open_ = open_[~done]
        out[open_] -= np.log(SYMBOLS - seen[open_])
        return out


class Known:
    """Sorted packed positions and their values, a column for each group; nan for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.width = keys, values, values.shape[1]

    def logp(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full((len(wanted), self.width), np.nan)
        hit, at = found_in(self.keys, wanted)
        out[hit] = self.values[at[hit]]
        return out


class Memo:
    """A direct-mapped table of packed positions and their values, as the same few contexts return again and again."""

    def __init__(self, tries: list[Trie] | list[Known], bits: int = 20):
        self.tries, self.shift = tries, U64(64 - bits)
        self.keys = np.full(1 << bits, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.values = np.zeros((1 << bits, sum(t.width for t in tries)), np.float32)

    def logp(self, wanted: np.ndarray) -> np.ndarray:
        """A row for each position, a column for each trie."""
        slot = ((wanted * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = self.values[slot]
        missing = np.flatnonzero(self.keys[slot] != wanted)
        if len(missing):
            fresh, back = np.unique(wanted[missing], return_inverse=True)
            values = np.concatenate([t.logp(fresh).reshape(len(fresh), -1) for t in self.tries], axis=1).astype(np.float32)
            out[missing] = values[back]
            slot = ((fresh * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            self.keys[slot], self.values[slot] = fresh, values
        return out


def folded(keys: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a shorter level."""
    short, back = np.unique(keys & U64((1 << 8 * (level + 1)) - 1), return_inverse=True)
    return short, np.bincount(back, counts, len(short))


def short_levels(counts: DataFrame, groups: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The levels below ``BASE`` of each group."""
    table = counts.groupBy("group", F.col("gram").bitwiseAND(F.lit((1 << 8 * BASE) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    group, gram, n = np.asarray(table["group"]), np.asarray(table["gram"]).astype(np.uint64), np.asarray(table["n"])
    return [[folded(gram[group == g], n[group == g], j) for j in range(BASE)] for g in range(groups)]


def value_batches(short, order: int, groups: int):
    """A map over (group, gram, n), where n is 0 for wanted grams: these and their values, from all edges of their contexts."""

    def run(batches):
        held = [[np.zeros(0, np.int64)] * 3]
        held += [[batch.column(k).to_numpy() for k in range(3)] for batch in batches]
        group, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        gram = gram.astype(np.uint64)
        wanted, values = np.unique(gram[n == 0]), []
        for g in range(groups if len(wanted) else 0):
            rows = (group == g) & (n > 0)
            long = [folded(gram[rows], n[rows], j) for j in range(BASE, order + 1)]
            values.append(Trie(short.value[g] + long, whole=True).logp(wanted))
        flat = np.stack(values, axis=1) if values else np.zeros((0, groups))
        for i in range(0, len(wanted), 100_000):
            part = flat[i : i + 100_000]
            offsets = pa.array(np.arange(0, part.size + 1, groups, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(wanted[i : i + 100_000].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["gram", "logs"])

    return run


def values(counts: DataFrame, wanted: DataFrame, short, order: int, groups: int, rows_per_task: int = 1_000_000) -> DataFrame:
    """(gram, logs): the exact values in each group of the wanted (gram), from (group, gram, n) of all longest edges."""
    both = counts.select("group", "gram", "n").unionByName(wanted.select(F.lit(-1).alias("group"), "gram", F.lit(0).cast("long").alias("n")))
    tasks = max(1, -(-(counts.count() + wanted.count()) // rows_per_task))
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * BASE) - 1))
    return both.repartition(tasks, context).mapInArrow(value_batches(short, order, groups), "gram long, logs array<double>")


def known(counts: DataFrame, short, order: int, groups: int, most: int) -> Known:
    """The table to broadcast: all edges of at least some number of sightings in all groups, the least power of two that leaves ``most``."""
    sightings = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    bits = {r["bits"]: r["count"] for r in sightings.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}
    least = next(b for b in range(1, 65) if sum(k for x, k in bits.items() if x >= b) <= most)
    frequent = materialise(sightings.filter(F.length(F.bin("n")) >= least).select("gram"), "ppm-frequent")
    table = values(counts, frequent, short, order, groups).toArrow().combine_chunks()
    keys, logs = np.asarray(table["gram"]).astype(np.uint64), np.zeros((0, groups))
    if len(keys):
        logs = table["logs"].combine_chunks().flatten().to_numpy().reshape(-1, groups)
    by_key = np.argsort(keys)
    return Known(keys[by_key], logs[by_key].astype(np.float32))


def rare_sums(scored: DataFrame, counts: DataFrame, short, order: int, groups: int) -> DataFrame:
    """(row, rare_0, rare_1, ...): for each group the sum of values over the (grams, gram_times) of each row that has any."""
    rest = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    wanted = materialise(rest.select("gram").distinct(), "ppm-wanted")
    found = materialise(values(counts, wanted, short, order, groups), "ppm-values")
    return rest.join(found, "gram").groupBy("row").agg(*[F.sum(F.col("times") * F.col("logs")[g]).alias(f"rare_{g}") for g in range(groups)])


def rare_of(items: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of each owner, how often each occurs, and the distinct items an owner has."""
    order = np.lexsort((items, owners))
    items, owners = items[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], (items[1:] != items[:-1]) | (owners[1:] != owners[:-1])])) if len(items) else np.zeros(0, np.int64)
    return items[first], np.diff(np.concatenate([first, [len(items)]])), np.bincount(owners[first], minlength=n)


def lists(items: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(items.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def sums_and_rest(memo: Memo, packed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """A row for each text and a column for each group with the sum of known values; the grams without one, and their times."""
    logs = memo.logp(packed).astype(np.float64)
    lost = np.isnan(logs[:, 0])
    logs[lost] = 0.0
    total = np.stack([sums(logs[:, g], counts) for g in range(logs.shape[1])], axis=1)
    return total, *lists(*rare_of(packed[lost], np.repeat(np.arange(len(counts)), counts)[lost], len(counts)))
