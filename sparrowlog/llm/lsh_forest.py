"""Near-duplicate classes by an LSH forest.

Texts are sets of hashed runs of five words (lower case A-Z, split at white space); a shorter text with words is one run. Texts
with the same words are one text first, so copies are never paired. Each text has 128 MinHash values; 32 sorted orders of it
(each starts with four values of its own, then two more) are the trees of the forest.

1. Each order is sorted, and a text's neighbours there are candidates if their longest common prefix has four values or more.
   Each text is verified against its ``best`` candidates (by orders shared, then longest prefix) on whole sets. These links
   connect nearly all that belongs together, with work linear in the texts.
2. A region of an order (texts of one prefix) that holds one class only is done. In the others, texts of different classes are
   compared, first by signature, then those that stay on whole sets. A region is as shallow as its number of texts allows: four
   values deep, and five or six where more than ``dense`` texts share fewer. No pair of one class is looked at again, so a region
   of one large class and some others costs what the others cost.

A pair at the threshold shares no region with probability 1e-10 (dense regions: 5e-6, the least shared depth being six), and is
dropped by its signature with 1e-6 at most. Nothing is capped: classes of any number of texts are dealt out in pairs of chunks of
at most about ``chunk`` texts and ``chunk_bytes`` bytes of sets.

Null and empty texts, and those without a word, have no set and link to nothing, not even to each other. Rows that repeat are
copies and share a class. A null doc_id stays null and names a class only if no row of it has an id; then all its rows are kept.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import canonical, join_one, materialise, shingle_hashes, slices, utf8
from sparrowlog.llm.components import components
from sparrowlog.llm.jaccard import VALUES, WIDTH, by_block, forest, set_batches, signatures, together, verified

ORDERS, SHALLOW, DEEP, STEP, DEPTH_AT = 32, 4, 6, 32, 56
#: For each order the places of its values in the signature: its own four, then two that start orders far from it.
PLACES = np.array([[4 * t, 4 * t + 1, 4 * t + 2, 4 * t + 3, (4 * t + 44) % VALUES, (4 * t + 77) % VALUES] for t in range(ORDERS)])


def sign_batches(batches):
    """(doc_id, row, utf8) to (doc_id, row, digest, runs, signature, body): body is the text's words joined by one space, packed."""
    packed = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [canonical(x) for x in batch.column(2).to_pylist()]
        for a, b in slices([len(x) for x in texts], 1_000_000):
            hashes, counts = shingle_hashes(texts[a:b], WIDTH)
            data = signatures(hashes, counts).tobytes()
            distinct = [len(np.unique(x)) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            digests = [hashlib.sha256(x).digest() for x in texts[a:b]]
            columns = [pa.array(digests, pa.binary()), pa.array(distinct, pa.int64()), pa.array([data[i : i + VALUES] for i in range(0, len(data), VALUES)], pa.binary()), pa.array(list(map(packed, texts[a:b])), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "row", "digest", "runs", "signature", "body"])


def order_batches(batches):
    """(key, signature) to (label, key): a row for each order; a label is the order's number and its six values."""
    shifts = np.arange(DEEP - 1, -1, -1, dtype=np.int64) * 8
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
        labels = (s[:, PLACES].astype(np.int64) << shifts).sum(axis=2) | (np.arange(ORDERS, dtype=np.int64) << 8 * DEEP)
        yield pa.RecordBatch.from_arrays([pa.array(labels.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), ORDERS))], ["label", "key"])


def region(label: Column, depth: int) -> Column:
    """The region of a label, with its depth in the bits above the order's."""
    return F.shiftright(label, 8 * (DEEP - depth)).bitwiseOR(F.lit(depth << DEPTH_AT))


def order_of(bucket: np.ndarray) -> np.ndarray:
    """The order that a region is of."""
    return (bucket & ((1 << DEPTH_AT) - 1)) >> 8 * (bucket >> DEPTH_AT)


def near_batches(batches):
    """A task's rows (label, key) in the order of labels to (label, key, other, prefix) of those that share a region with the row
    before or after; other is the key after, if it shares it. A task's first and last row come out too, as their neighbours may
    lie in other tasks."""
    held = np.zeros((0, 2), np.int64)
    first, shared = True, False  # of the held row: whether it is the first, and shares with the one before it

    def out(rows: np.ndarray, prefix: np.ndarray, keep: np.ndarray, after: np.ndarray):
        at = np.flatnonzero(keep)
        others = pa.array(after[at], mask=prefix[at] == 0)
        return pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(rows[at, 1]), others, pa.array(prefix[at])], ["label", "key", "other", "prefix"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
        differs = rows[1:, 0] ^ rows[:-1, 0]
        prefix = sum((differs >> 8 * k == 0).astype(np.int64) for k in range(DEEP - SHALLOW + 1))  # 1: four values alike, 3: six
        before = np.concatenate([[int(shared)], prefix[:-1]]) if len(prefix) else prefix
        keep = (prefix > 0) | (before > 0)
        if first and len(keep):
            keep[0] = True
        if len(keep):
            yield out(rows[:-1], prefix, keep, rows[1:, 1])
            first, shared = False, bool(prefix[-1])
        held = rows[-1:]
    if len(held):
        yield out(held, np.zeros(1, np.int64), np.ones(1, bool), held[:, 1])


def least_equal(threshold: float, lost: float = 1e-6) -> list[int]:
    """For 32, 64, ... values: the most that fewer equal ones than this have a probability under ``lost`` at the threshold."""
    p, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while below + comb(n, m) * p**m * (1 - p) ** (n - m) < lost:
            below += comb(n, m) * p**m * (1 - p) ** (n - m)
            m += 1
        out.append(m)
    return out


class Block:
    """Rows (bucket, lo, hi, chunk, key, class, signature, ...) of whole blocks."""

    def __init__(self, table: pa.Table):
        self.bucket, self.lo, self.hi, self.chunk, self.key, self.of = (np.asarray(table.column(i)) for i in range(6))
        self.signatures = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(-1, VALUES)
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.lo[1:] != self.lo[:-1]) | (self.hi[1:] != self.hi[:-1])
        self.number = np.cumsum(np.concatenate([[0], new]))

    def unseen(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs in regions, whether they share no deepest region of an order before: there they are compared as well."""
        order, s, open_ = order_of(self.bucket[left]), self.signatures, np.arange(len(left))
        seen = np.zeros(len(left), bool)
        for t, places in enumerate(PLACES):
            open_ = open_[order[open_] > t]
            if not len(open_):
                break
            same = (s[left[open_, None], places] == s[right[open_, None], places]).all(axis=1)
            seen[open_[same]] = True
            open_ = open_[~same]
        return ~seen

    def survivors(self, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block, of different classes, that their signatures leave."""
        s = self.signatures
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, len(self.key)):
            a = np.flatnonzero(self.number[:-d] == self.number[d:])
            if not len(a):
                break
            a = a[(self.of[a] != self.of[a + d]) & ((self.lo[a] == self.hi[a]) | (self.chunk[a] != self.chunk[a + d]))]
            same = np.zeros(len(a), np.int64)
            for k, least in enumerate(need):
                same += (s[a, k * STEP : (k + 1) * STEP] == s[a + d, k * STEP : (k + 1) * STEP]).sum(axis=1)
                a, same = a[same >= least], same[same >= least]
            left.append(a)
            right.append(a + d)
        return np.concatenate(left), np.concatenate(right)


def deal(rows: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """Rows (bucket, key, class, runs, signature) in blocks of pairs of chunks. A bucket's largest class is never paired with
    itself: its chunks come after the others' and meet these only."""
    by_class = rows.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("runs").alias("runs"))
    most = F.max(F.struct("n", "class", "runs"))
    sizes = by_class.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), most.alias("most")).filter("n > most.n")

    def chunks(n: Column, runs: Column) -> Column:
        return F.ceil(F.greatest(n / chunk, runs * 8 / chunk_bytes)).cast("int")

    sizes = materialise(sizes.select("bucket", "n", F.col("most.class").alias("major"), chunks(F.col("n") - F.col("most.n"), F.col("runs") - F.col("most.runs")).alias("minors"), chunks(F.col("most.n"), F.col("most.runs")).alias("majors")), "sizes")
    placed = join_one(rows, sizes, "bucket", "n").withColumn("is_major", F.col("class") == F.col("major"))
    h = F.xxhash64("key")
    placed = placed.withColumn("chunk", F.when(F.col("is_major"), F.col("minors") + F.pmod(h, F.col("majors"))).otherwise(F.pmod(h, F.col("minors"))).cast("int"))
    ends = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    placed = placed.withColumn("i", F.explode(F.sequence(F.lit(0), ends)))
    return together(placed.select("bucket", F.least("chunk", "i").alias("lo"), F.greatest("chunk", "i").alias("hi"), "chunk", "key", "class", "signature"))


def class_forest(of: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of linked classes, and the class that each row's class is connected to."""
    names, at = np.unique(of, return_inverse=True)
    label = forest(len(names), at[left], at[right])
    rows = np.union1d(left, right)
    return rows, names[label[at[rows]]]


def span_batches(need: list[int]):
    """Rows of blocks to (key, class, root) of the texts of which a pair stays; classes and roots span the pairs. A pair counts in
    the first order that shows it for sure, so a text of a large group comes out in few orders, and once for several blocks."""

    def run(batches):
        for table in by_block(batches, 3, 4000):
            block = Block(table)
            left, right = block.survivors(need)
            fresh = block.unseen(left, right)
            rows, root = class_forest(block.of, left[fresh], right[fresh])
            at = np.unique(block.key[rows], return_index=True)[1]
            rows, root = rows[at], root[at]
            yield pa.RecordBatch.from_arrays([pa.array(block.key[rows]), pa.array(block.of[rows]), pa.array(root)], ["key", "class", "root"])

    return run


def paired_batches(need: list[int]):
    """Rows of blocks to those of texts of which a pair stays in that block."""

    def run(batches):
        for table in by_block(batches, 3, 2000):
            rows = np.union1d(*Block(table).survivors(need))
            if len(rows):
                yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    return run


def verify_batches(need: list[int], threshold: float):
    """Rows of blocks with members to edges (a, b) between classes that span the verified links."""

    def run(batches):
        for table in by_block(batches, 3, 512):
            block = Block(table)
            left, right = block.survivors(need)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(7).to_pylist()]
            stay = verified(sets, left, right, threshold)
            rows, root = class_forest(block.of, left[stay], right[stay])
            edges = np.unique(np.stack([block.of[rows], root]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    return run


def star_batches(threshold: float):
    """Rows (owner, key, members), those of an owner together, to the verified links (a, b) of each owner with its others."""

    def run(batches):
        for table in by_block(batches, 1, 512):
            owner, key = np.asarray(table.column(0)), np.asarray(table.column(1))
            sets = [np.frombuffer(x, np.uint64) for x in table.column(2).to_pylist()]
            heads = np.flatnonzero(owner == key)
            at = heads[np.searchsorted(owner[heads], owner)]
            right = np.flatnonzero(owner != key)
            stay = right[verified(sets, at[right], right, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(key[stay]), pa.array(owner[stay])], ["a", "b"])

    return run


def unresolved(rows: DataFrame, dense: int) -> DataFrame:
    """Rows (label, key, class) of regions with more than one class, with the region as ``bucket``: as deep as it must be."""
    out = None
    for depth in range(SHALLOW, DEEP + 1):
        at = rows.withColumn("bucket", region(F.col("label"), depth))
        sizes = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
        sizes = materialise(sizes.filter("least < most").select("bucket", "n"), "regions")
        placed = materialise(join_one(at, sizes, "bucket", "n"), "placed")
        settled = placed if depth == DEEP else placed.filter(F.col("n") <= dense)
        out = settled if out is None else out.unionByName(settled)
        rows = placed.filter(F.col("n") > dense).drop("bucket", "n")
        if depth == DEEP or rows.isEmpty():
            return out.select("bucket", "key", "class")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, best: int = 2, dense: int = 8192, chunk: int = 256, chunk_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8(F.col("text")).alias("data"))
    signed = materialise(rows.mapInArrow(sign_batches, "doc_id long, row long, digest binary, runs long, signature binary, body binary"), "signed")
    # a text goes by the least row that holds it
    one = [F.min("row").alias("key"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("signature").alias("signature")]
    texts = materialise(signed.filter("runs > 0").groupBy("digest").agg(*one), "texts")
    orders = texts.select("key", "signature").mapInArrow(order_batches, "label long, key long").repartitionByRange("label", "key").sortWithinPartitions("label", "key")
    near = materialise(orders.mapInArrow(near_batches, "label long, key long, other long, prefix long"), "near")
    # by merging at every size, as what is near grows with the input
    bodies = signed.select(F.col("row").alias("key"), "body").join(near.select("key").distinct().hint("merge"), "key", "left_semi")
    bodies = materialise(bodies, "bodies")
    links = nearest_links(bodies, near, threshold, best)
    classes = components(links).toDF("key", "class")
    links = links.unionByName(other_links(bodies, texts, near, classes, threshold, dense, chunk, chunk_bytes))
    classes = components(links).toDF("key", "class")
    of = texts.select("key", "digest", "first_id", "copies").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    of = materialise(of, "classes")
    least = of.groupBy("class").agg(F.min("first_id").alias("component_id"))
    of = materialise(of.join(least, "class").select("digest", "component_id", "copies"), "of")
    linked = join_one(signed.filter("runs > 0").select("doc_id", "runs", "digest"), of, "digest", "copies")
    alone = signed.filter("runs = 0").withColumn("component_id", F.col("doc_id"))
    both = linked.select("doc_id", "runs", "component_id").unionByName(alone.select("doc_id", "runs", "component_id"))
    return both.select("doc_id", F.col("runs").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unpacked_batches(batches):
    """(key, body) to (key, members)."""
    unpacked = zstandard.ZstdDecompressor().decompress
    return set_batches(pa.RecordBatch.from_arrays([x.column(0), pa.array(list(map(unpacked, x.column(1).to_pylist())), pa.binary())], ["key", "body"]) for x in batches)


def sets(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, members) of the texts of the distinct ``keys``."""
    return bodies.join(keys.hint("merge"), "key", "left_semi").mapInArrow(unpacked_batches, "key long, members binary")


def nearest_links(bodies: DataFrame, near: DataFrame, threshold: float, best: int) -> DataFrame:
    """(a, b): verified links of each text with its best neighbours. A text is neighbour of 64 at most, so no key is hot."""
    after = near.filter("other IS NOT NULL").select("key", "other", "prefix")
    both = after.unionByName(after.select(F.col("other").alias("key"), F.col("key").alias("other"), "prefix"))
    scored = both.groupBy("key", "other").agg(F.struct(F.count("*").alias("n"), F.max("prefix").alias("prefix")).alias("score"))
    ranks = F.slice(F.sort_array(F.collect_list(F.struct("score.n", "score.prefix", "other")), asc=False), 1, best)
    pairs = scored.groupBy("key").agg(ranks.alias("r")).select(F.col("key").alias("owner"), F.explode("r.other").alias("key"))
    # a pair that chose each other is verified once
    pairs = pairs.select(F.least("owner", "key").alias("owner"), F.greatest("owner", "key").alias("key")).distinct()
    pairs = materialise(pairs, "pairs")
    asked = pairs.unionByName(pairs.select("owner", F.col("owner").alias("key")).distinct())
    stars = asked.join(sets(bodies, asked.select("key").distinct()), "key").select("owner", "key", "members").repartition("owner").sortWithinPartitions("owner", "key")
    return materialise(stars.mapInArrow(star_batches(threshold), "a long, b long"), "links")


def other_links(bodies: DataFrame, texts: DataFrame, near: DataFrame, classes: DataFrame, threshold: float, dense: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """(a, b): verified links between texts of different classes that share a region."""
    need = least_equal(threshold)
    rows = materialise(near.select("label", "key").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key")), "classed")
    open_ = materialise(unresolved(rows, dense).join(texts.select("key", "runs", "signature"), "key"), "open")
    spans = materialise(deal(open_, chunk, chunk_bytes).mapInArrow(span_batches(need), "key long, class long, root long"), "candidates")
    nodes = spans.select("key", "class").distinct().join(texts.select("key", "runs", "signature"), "key")
    # classes that candidates connect are one group
    groups = components(spans.select(F.col("class").alias("a"), F.col("root").alias("b"))).toDF("class", "bucket")
    sizes = materialise(groups.join(nodes.groupBy("class").agg(F.count("*").alias("n")), "class"), "sizes")
    members = materialise(join_one(materialise(nodes, "nodes"), sizes, "class", "n").drop("n"), "groups")
    dealt = deal(members, chunk, chunk_bytes)
    kept = materialise(dealt.mapInArrow(paired_batches(need), dealt.schema), "paired")
    checked = together(kept.join(sets(bodies, kept.select("key").distinct()), "key")).select(*kept.columns, "members")
    return materialise(checked.mapInArrow(verify_batches(need, threshold), "a long, b long"), "links")
