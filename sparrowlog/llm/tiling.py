"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words (A-Z in lower case, other ASCII characters but letters and digits are borders).
Runs of ``least`` words that both share are seeds; for each document and item that share seeds enough to cover ``coverage`` of
the item, the longest unmarked match is found by running Karp-Rabin over windows, checked word by word, marked, and so on
until no match of ``least`` words is left. Tiles never overlap, and their order is free, so reordered passages count in full.
An item is in a document if its tiles cover at least ``coverage`` of its words.

Items with the same text are one text until the end. Where all of them have at most ``most_bytes`` (checked), their seeds are
broadcast and join within a map over the documents, which moves no document. Beyond that, the seeds of documents and items meet
in a shuffle join, behind a filter of fixed size, and only pairs that share enough seeds get their two texts.

Null texts are empty; an item with fewer than ``least`` words is sought as a whole; items without words match nothing. A null
item_id or doc_id stays null. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import U64, found_in, join_one, materialise, mix, shingle_hashes, slices, utf8, word_hashes

BASE = 0x9E3779B97F4A7C15
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "doc_id long, text_md5 string, number long, n_tokens long, matched long, tiles int, longest int, coverage double"
SLOTS = 1 << 26


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(PLAIN).lower().split())


class Rolling:
    """Karp-Rabin hashes of the runs of any length of one array of words, and which words are marked."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        power, inverse = (np.full(len(words) + 1, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power, dtype=np.uint64)[:-1], dtype=np.uint64)])

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``size`` words without a marked one."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[size:] == before[:n])
        return at, (self.total[at + size] - self.total[at]) * self.inverse[at]


def longest_match(doc: Rolling, item: Rolling, least: int, most: int) -> int:
    """The greatest length up to ``most`` of an unmarked run in both, 0 under ``least``; a run's part is in both as well."""

    def both(size: int) -> bool:
        return bool(np.isin(doc.free(size)[1], item.free(size)[1]).any())

    if most < least or not both(least):
        return 0
    low, high = least, least + 1
    while high <= most and both(high):
        low, high = high, 2 * high
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if both(middle) else (low, middle)
    return low


def tile(doc_words: np.ndarray, item_words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of two arrays of word hashes, longest first, then by place.

    Each round marks all tiles of the longest length, so there are fewer rounds than lengths; in a round no start in the
    item is looked at again once it is taken, so periodic texts cost no more than others."""
    doc, item, out = Rolling(doc_words), Rolling(item_words), []
    size = min(len(doc_words), len(item_words))
    while size := longest_match(doc, item, least, size):
        (p, x), (q, y) = doc.free(size), item.free(size)
        p, x = p[np.isin(x, y)], x[np.isin(x, y)]
        order = np.argsort(y, kind="stable")
        places, first = q[order], np.searchsorted(y[order], x)
        last, seen, border = np.searchsorted(y[order], x, "right"), {}, 0
        for at, low, high in zip(p.tolist(), first.tolist(), last.tolist(), strict=True):
            if at < border:
                continue
            k = seen.get(low, low)
            while k < high and item.marked[places[k] : places[k] + size].any():
                k += 1
            seen[low] = k
            for start in places[k:high].tolist():
                if not item.marked[start : start + size].any() and (doc_words[at : at + size] == item_words[start : start + size]).all():
                    item.marked[start : start + size] = doc.marked[at : at + size] = True
                    out.append((at, start, size))
                    border = at + size
                    break
        if not out or out[-1][2] != size:  # equal hashes of different runs
            size -= 1
    return out


class Benchmark:
    """Texts as word hashes, and the seeds of all of them with where they are."""

    def __init__(self, items: list[tuple[int, bytes]], least: int):
        self.ids = [i for i, _ in items]
        texts = [plain(x) for _, x in items]
        words, counts = word_hashes(texts)
        self.words = np.split(words, np.cumsum(counts)[:-1]) if len(texts) else []
        self.short = {int(k): len(w) for k, w in enumerate(self.words) if 0 < len(w) < least}
        seeds, owner, place = seeds_of(texts, counts, least)
        order = np.lexsort((place, owner, seeds))
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]


def seeds_of(texts: list[bytes], counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of each run of ``least`` words of texts with so many words."""
    seeds, runs = shingle_hashes(texts, least)
    seeds = seeds[np.repeat(counts >= least, runs)]
    runs = runs * (counts >= least)
    return seeds, np.repeat(np.arange(len(texts)), runs), np.arange(len(seeds)) - np.repeat(np.cumsum(runs) - runs, runs)


def found_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def search_batches(benchmark, least: int, coverage: float):
    """A map over (doc_id, utf8) giving the texts of the benchmark that a document holds."""

    def run(batches):
        b: Benchmark = benchmark.value
        for batch in batches:
            data = batch.column(1).to_pylist()
            texts = [plain(x) for x in data]
            for begin, end in slices([len(x) for x in texts], 2_000_000):
                out = []
                words, counts = word_hashes(texts[begin:end])
                starts = np.cumsum(counts) - counts
                hashes, runs = shingle_hashes(texts[begin:end], least)
                run_starts = np.cumsum(runs) - runs
                hit, _ = found_in(b.seeds, hashes)

                def put(d, k, tiles, begin=begin, out=out, batch=batch, data=data):
                    out.append(row(batch.column(0)[begin + int(d)].as_py(), data[begin + int(d)], b.ids[k], len(b.words[k]), tiles))

                total = np.concatenate([[0], np.cumsum(hit)])
                for d in np.flatnonzero((total[run_starts + runs] > total[run_starts]) & (counts >= least)):
                    at = np.flatnonzero(hit[run_starts[d] : run_starts[d] + runs[d]])
                    for k, tiles in matches(b, words[starts[d] : starts[d] + counts[d]], at, hashes[run_starts[d] :][at], least, coverage):
                        put(d, k, tiles)
                for k, size in b.short.items():
                    for d in holds(words, counts, starts, b.words[k], size):
                        put(d, k, [(0, 0, size)])
                if out:
                    yield found_rows(out)

    return run


def row(doc_id, data: bytes, number: int, n: int, tiles: list[tuple[int, int, int]]) -> tuple:
    matched = sum(t[2] for t in tiles)
    return doc_id, hashlib.md5(data).hexdigest(), number, n, matched, len(tiles), max(t[2] for t in tiles), matched / n


def holds(words: np.ndarray, counts: np.ndarray, starts: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """Documents that hold an item that is too short for a seed."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    ok = words[: len(words) - size + 1] == item[0]
    for i in range(1, size):
        ok = ok & (words[i : len(words) - size + 1 + i] == item[i])
    at = np.flatnonzero(ok)
    doc = np.searchsorted(starts, at, "right") - 1
    return np.unique(doc[at + size <= starts[doc] + counts[doc]])


def matches(b: Benchmark, words: np.ndarray, at: np.ndarray, seeds: np.ndarray, least: int, coverage: float):
    """(text, tiles) of the benchmark's texts that the document's seeds can cover and whose tiles do."""
    own = np.unique(seeds)
    low, high = np.searchsorted(b.seeds, own), np.searchsorted(b.seeds, own, "right")
    n = high - low
    entry = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    entry = entry[np.lexsort((b.place[entry], b.owner[entry]))]
    owner, place = b.owner[entry], b.place[entry]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    reach = np.full(len(owner), least)
    reach[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(place), least), least)
    covered = np.add.reduceat(reach, first)
    for k, begin, end, words_covered in zip(owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(owner)], covered.tolist(), strict=True):
        if words_covered >= coverage * len(b.words[k]):
            tiles = tiles_between(words, at[np.isin(seeds, b.seeds[entry[begin:end]])], b.words[k], least)
            if sum(t[2] for t in tiles) >= coverage * len(b.words[k]):
                yield k, tiles


def tiles_between(words: np.ndarray, at: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles of a document's words, of which runs that match begin at ``at`` only."""
    kept = np.unique((at[:, None] + np.arange(least)).ravel())
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    # words between seeds match nothing of this item: one border stands for them
    return tile(np.insert(words[kept], gaps, mix(np.arange(1, len(gaps) + 1, dtype=np.uint64))), item, least)


def seed_batches(least: int, slots=None):
    """A map over (key, utf8) giving (key, seed, n_words): the distinct seeds of each text; ``slots``: only those in the filter."""

    def run(batches):
        bits = slots.value if slots else None
        for batch in batches:
            texts = [plain(x) for x in batch.column(1).to_pylist()]
            for begin, end in slices([len(x) for x in texts], 1_000_000):
                counts = word_hashes(texts[begin:end])[1]
                seeds, owner, _ = seeds_of(texts[begin:end], counts, least)
                if bits is not None:
                    slot = (seeds & U64(SLOTS - 1)).astype(np.int64)
                    passed = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & U64(1) > 0
                    seeds, owner = seeds[passed], owner[passed]
                if len(seeds):
                    both = np.unique(np.stack([owner.astype(np.uint64), seeds], axis=1), axis=0)
                    who = both[:, 0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who + begin)), pa.array(both[:, 1].view(np.int64)), pa.array(counts[who])], ["key", "seed", "n_words"])

    return run


def pair_batches(least: int, coverage: float):
    """A map over (doc_id, utf8, number, utf8 of the benchmark's text) giving the pairs whose tiles cover enough."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, data, number, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, item = (word_hashes([plain(x)])[0] for x in (data, text))
                seeds, others = (shingle_hashes([plain(x)], least)[0] for x in (data, text))
                at = np.flatnonzero(np.isin(seeds, others)) if len(words) >= least else np.zeros(0, np.int64)
                tiles = tiles_between(words, at, item, least) if len(at) else []
                if tiles and sum(t[2] for t in tiles) >= coverage * len(item):
                    out.append(row(doc_id, data, number, len(item), tiles))
            if out:
                yield found_rows(out)

    return run


def count_batches(batches):
    """(number, utf8) with the words of each text."""
    for batch in batches:
        n = [len(plain(x).split()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["number", "data", "n_words"])


def by_seed_join(rows: DataFrame, texts: DataFrame, least: int, coverage: float) -> DataFrame:
    """The found pairs of ``rows`` (doc_id, data) and ``texts`` (number, data), by a shuffle join of their seeds."""
    index = materialise(texts.select(F.col("number").alias("key"), "data").mapInArrow(seed_batches(least), "key long, seed long, n_words long"), "benchmark-seeds")
    slot = F.col("seed").bitwiseAND(F.lit(SLOTS - 1))
    table = index.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")).alias("bits")).toArrow()  # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS // 64, np.uint64)
    bits[np.asarray(table["slot"])] = np.asarray(table["bits"]).view(np.uint64)
    slots = rows.sparkSession.sparkContext.broadcast(bits)
    digest = F.sha2("data", 256)
    hits = rows.select(digest.alias("key"), "data").mapInArrow(seed_batches(least, slots), "key string, seed long, n_words long").select("key", "seed").distinct()
    hits = materialise(hits, "seed-hits")
    holders = index.groupBy("seed").agg(F.collect_list(F.struct(F.col("key").alias("number"), "n_words")).alias("items"))
    holders = materialise(holders.join(hits.groupBy("seed").agg(F.count("*").alias("weight")), "seed"), "seed-holders")
    both = join_one(hits, holders, "seed", "weight").select("key", F.explode("items").alias("i")).groupBy("key", "i.number").agg(F.count("*").alias("n"), F.first("i.n_words").alias("n_words"))
    # a tile of w words has w - least + 1 seeds, which is w / least or more
    pairs = materialise(both.filter(F.col("n") * least >= coverage * F.col("n_words")).select("key", "number"), "seed-pairs")
    wanted = pairs.groupBy("number").agg(F.count("*").alias("weight")).join(texts.select("number", F.col("data").alias("item")), "number")
    pairs = join_one(pairs, materialise(wanted, "seed-items"), "number", "weight").select("key", "number", "item")
    found = rows.withColumn("key", digest).join(pairs, "key").select("doc_id", "data", "number", "item")
    return found.mapInArrow(pair_batches(least, coverage), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.6, most_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, n_tokens, matched, tiles, longest, coverage and text_md5 for each document of (doc_id, text) and each item
    of (item_id, text) that it holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("data"))
    texts = items.select("data").distinct().withColumn("number", F.monotonically_increasing_id()).select("number", "data")
    texts = materialise(texts.mapInArrow(count_batches, "number long, data binary, n_words long"), "benchmark-texts").filter("n_words > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data"))
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size <= most_bytes:
        held = Benchmark([tuple(r) for r in texts.select("number", "data").orderBy("number").collect()], least)
        found = rows.mapInArrow(search_batches(spark.sparkContext.broadcast(held), least, coverage), FOUND)
    else:
        found = by_seed_join(rows, texts.filter(F.col("n_words") >= least), least, coverage)
        for n in range(1, least):  # an item that is shorter than a seed is a seed of its own length
            found = found.unionByName(by_seed_join(rows, texts.filter(F.col("n_words") == n), n, 1.0))
    named = texts.join(items, "data").groupBy("number").agg(F.collect_list(F.struct("item_id")).alias("item_ids"))
    if size <= most_bytes:
        found = found.join(F.broadcast(named), "number")
    else:  # an item that very many documents hold is broadcast
        found = materialise(found, "found")
        named = materialise(named.join(found.groupBy("number").agg(F.count("*").alias("weight")), "number"), "found-items")
        found = join_one(found, named, "number", "weight")
    return found.withColumn("item_id", F.explode("item_ids.item_id")).select("doc_id", "item_id", "n_tokens", "matched", "tiles", "longest", "coverage", "text_md5")
