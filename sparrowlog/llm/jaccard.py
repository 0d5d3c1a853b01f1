"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of hashed runs of five words (lower case A-Z, split at white space); a shorter text with words is one run.
Equal texts (by SHA-256) form one class first, so copies are never paired. 128 MinHash values of 8 bits make 32 bands of
four; texts that share a band are candidates, each pair looked at in its first common band only. Values are compared 16 at a
time, and a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold is under
``tolerance``. The pairs that stay, and no others, are verified exactly on their whole sets; the verified links connect
classes.

Buckets are dealt out in pairs of chunks of at most about ``chunk`` texts, and a task keeps no more than one such pair. A block
gives back a spanning forest of the pairs that stay; their components are groups, which hold all texts that one text can link to.
Groups are dealt out likewise, also bounded by ``chunk_bytes`` bytes of sets: first with signatures only, to see which texts have
a pair that stays in which block, then with the sets of just these texts, to verify just these pairs. No row is ever a pair, so
rows never grow with the square of a group; a block gives back link counts and a spanning forest. A pair at the threshold
shares no band with probability 5e-8; nothing is capped.

Null texts are empty texts; texts without a word link to nothing but their exact copies. Rows that repeat are copies. A null
doc_id stays null and never names a class unless it is alone. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import canonical, join_one, materialise, shingle_hashes, slices, utf8
from sparrowlog.llm.components import components

VALUES, ROWS, STEP, WIDTH = 128, 4, 16, 5
BANDS = VALUES // ROWS
BLOCK = ("bucket", "lo", "hi", "chunk", "key", "signature")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = (_RANDOM.integers(1, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_MASKS = _RANDOM.integers(0, 2**32, VALUES, dtype=np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of MinHash values (one byte each) for each set; sets without members have zeros."""
    out = np.zeros((len(counts), VALUES), np.uint8)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            least = np.minimum.reduceat((low ^ _MASKS[k]) * _FACTORS[k], starts)
            out[full, k] = ((least * np.uint32(0x85EBCA6B)) ^ (least >> np.uint32(13))) >> np.uint32(24)
    return out


def sign_batches(batches):
    """(doc_id, digest, utf8) to (doc_id, digest, runs, signature)."""
    for batch in batches:
        texts = [canonical(x) for x in batch.column(2).to_pylist()]
        for a, b in slices([len(x) for x in texts], 1_000_000):
            hashes, counts = shingle_hashes(texts[a:b], WIDTH)
            data = signatures(hashes, counts).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts), pa.array([data[i : i + VALUES] for i in range(0, len(data), VALUES)], pa.binary())], ["doc_id", "digest", "runs", "signature"])


def band_batches(batches):
    """(key, signature) to (bucket, key), a row for each band."""
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, BANDS)
        yield pa.RecordBatch.from_arrays([pa.array((s.astype(np.int64) | (np.arange(BANDS, dtype=np.int64) << 32)).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "key"])


def set_batches(batches):
    """(key, utf8) to (key, members): the sorted set of a text's runs."""
    for batch in batches:
        texts = [canonical(x) for x in batch.column(1).to_pylist()]
        for a, b in slices([len(x) for x in texts], 1_000_000):
            hashes, counts = shingle_hashes(texts[a:b], WIDTH)
            sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["key", "members"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values: the fewest equal ones with which a pair stays."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    log_same, log_other = np.log(grid + (1 - grid) / 256), np.log((1 - grid) * 255 / 256)
    above, out = grid >= threshold, []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            w = m * log_same + (n - m) * log_other
            w = np.exp(w - w.max())
            if w[above].sum() / w.sum() >= tolerance:
                out.append(m)
                break
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows (bucket, key, n_chunks, ...) of each bucket out to pairs of chunks (lo, hi)."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("n_chunks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return together(dealt.withColumn("lo", F.least("chunk", "i")).withColumn("hi", F.greatest("chunk", "i")))


def together(rows: DataFrame) -> DataFrame:
    """Each block's rows one after another in one task."""
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "key")


def by_block(batches, width: int, most: int):
    """Tables of whole blocks (the first ``width`` columns name one) of about ``most`` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table):
        names = [np.asarray(table.column(i)) for i in range(width)]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
        return int(change[-1]) if len(change) else 0

    for batch in batches:
        for i in range(0, batch.num_rows, most):
            held.append(batch.slice(i, most))
            rows += held[-1].num_rows
            if rows >= most:
                table = pa.Table.from_batches(held)
                at = cut(table)
                if at:
                    yield table.slice(0, at)
                    held = table.slice(at).to_batches()
                    rows = table.num_rows - at
    if rows:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Block:
    """Rows (bucket or group, lo, hi, chunk, key, signature, ...) of whole blocks, and their pairs that survive pruning."""

    def __init__(self, table: pa.Table):
        self.bucket, self.lo, self.hi, self.chunk, self.key = (np.asarray(table.column(i)) for i in range(5))
        self.signatures = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, VALUES)
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.lo[1:] != self.lo[:-1]) | (self.hi[1:] != self.hi[:-1])
        self.number = np.cumsum(np.concatenate([[0], new]))

    def survivors(self, need: list[int], banded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block that share a band and stay; banded: only those whose first common band is the bucket's."""
        s, bands, band = self.signatures, self.signatures.view("<u4"), self.bucket >> 32
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, len(self.key)):
            a = np.flatnonzero(self.number[:-d] == self.number[d:])
            if not len(a):
                break
            a = a[(self.lo[a] == self.hi[a]) | (self.chunk[a] != self.chunk[a + d])]
            common = bands[a] == bands[a + d]
            a = a[common.argmax(axis=1) == band[a]] if banded else a[common.any(axis=1)]
            same = np.zeros(len(a), np.int64)
            for k, least in enumerate(need):
                same += (s[a, k * STEP : (k + 1) * STEP] == s[a + d, k * STEP : (k + 1) * STEP]).sum(axis=1)
                stay = same >= least
                a, same = a[stay], same[stay]
            left.append(a)
            right.append(a + d)
        return np.concatenate(left), np.concatenate(right)


def candidate_batches(need: list[int]):
    """Rows of blocks of buckets to edges (a, b) that span the pairs that stay."""

    def run(batches):
        for table in by_block(batches, 3, 4000):
            block = Block(table)
            left, right = block.survivors(need, True)
            if len(left):
                nodes, at = np.unique(block.key, return_inverse=True)
                label = forest(len(nodes), at[left], at[right])
                linked = np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["a", "b"])

    return run


def paired_batches(need: list[int]):
    """Rows of blocks of groups to those of texts of which a pair stays in that block."""

    def run(batches):
        for table in by_block(batches, 3, 2000):
            rows = np.union1d(*Block(table).survivors(need, False))
            if len(rows):
                yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    return run


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of the threshold or more."""
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    sizes = np.array([len(x) for x in sets])
    members, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(members), np.int32)
    order = np.argsort(left, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
        i, others = left[rows[0]], right[rows]
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        n = sizes[others]
        begins = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(starts[others] - begins, n)
        common = np.add.reduceat(mark[ids[at]], begins)
        mark[own] = 0
        out[rows] = common >= threshold * (sizes[i] + n - common) - 1e-9
    return out


def verify_batches(need: list[int], threshold: float):
    """(bucket, lo, hi, chunk, key, signature, members), sorted by block, to (key, links, root): verified links and a forest."""

    def run(batches):
        for table in by_block(batches, 3, 512):
            block = Block(table)
            left, right = block.survivors(need, False)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(6).to_pylist()]
            stay = verified(sets, left, right, threshold)
            left, right = left[stay], right[stay]
            if len(left):
                n = np.bincount(left, minlength=len(sets)) + np.bincount(right, minlength=len(sets))
                label = forest(len(sets), left, right)
                yield pa.RecordBatch.from_arrays([pa.array(block.key[n > 0]), pa.array(n[n > 0]), pa.array(block.key[label[n > 0]])], ["key", "links", "root"])

    return run


def similar_documents(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5, chunk: int = 256, chunk_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, class_id (least doc_id of the connected group), n_links (other different texts at the threshold), n_copies (rows
    with the same text), kept and text_sha256 of every row of (doc_id, text). Kept are the rows with the least id of a class that
    hold the text named by it: that of the least id, of several the least by digest, in a class without ids the least by digest."""
    data = utf8(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(data, 256)).alias("digest"), data.alias("data"))
    signed = materialise(rows.mapInArrow(sign_batches, "doc_id long, digest binary, runs long, signature binary"), "signed")
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("signature").alias("signature"))
    # a number for each text, fixed once the table is written
    texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    banded = materialise(texts.filter("runs > 0").select("key", "signature").mapInArrow(band_batches, "bucket long, key long"), "bands")
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("n_chunks"))
    members = blocks(banded.join(full, "bucket").join(texts.select("key", "signature"), "key")).select(*BLOCK)
    need = least_matches(threshold, tolerance)
    groups = components(members.mapInArrow(candidate_batches(need), "a long, b long"))
    groups = materialise(groups.toDF("key", "bucket").join(texts.select("key", "runs", "signature"), "key"), "groups")
    chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum("runs") * 8 / chunk_bytes)).cast("int").alias("n_chunks")
    members = blocks(groups.join(groups.groupBy("bucket").agg(chunks), "bucket")).select(*BLOCK)
    kept = materialise(members.mapInArrow(paired_batches(need), members.schema), "paired")
    wanted = texts.join(kept.select("key").distinct(), "key").select("key", "digest", F.col("first_id").alias("doc_id"))
    # one row holds each wanted text: that of its least id, or any of those without an id
    bodies = rows.join(wanted, (rows["digest"] == wanted["digest"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("key", "data").dropDuplicates(["key"])
    sets = bodies.mapInArrow(set_batches, "key long, members binary")
    checked = together(kept.join(sets, "key")).select(*BLOCK, "members")
    checked = materialise(checked.mapInArrow(verify_batches(need, threshold), "key long, links long, root long"), "links")
    linked = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    of = texts.select("key", "digest", "first_id", "copies").join(linked.toDF("key", "component"), "key", "left").join(links, "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = materialise(of, "classes")
    least = of.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("digest", F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("named"))
    of = of.join(least, "component").withColumn("first", F.col("digest") == F.col("named"))
    of = materialise(of.select("digest", "class_id", "first", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies")), "of")
    rows = join_one(signed.select("doc_id", "digest"), of, "digest", "n_copies")
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.select("doc_id", "class_id", "n_links", "n_copies", kept.alias("kept"), F.col("digest").alias("text_sha256"))
