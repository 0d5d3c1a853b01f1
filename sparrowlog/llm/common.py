"""Helpers that several operators of this folder share: written intermediates, the hold-out rule and hashing kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one in local mode; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparrowlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_one(rows: DataFrame, table: DataFrame, key: str, weight: str, parts: int = 1024) -> DataFrame:
    """``rows`` joined to their one row in ``table``, which says in ``weight`` how many of ``rows`` have its key.

    Keys of more than one part in ``parts`` of all rows are fewer than ``parts`` at every size and are broadcast, so that no
    task gets all rows of a hot key; all others meet by a shuffle. Both tables should be written ones, as each is read twice."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) > max(total // parts, 1))
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(weight) <= max(total // parts, 1)), key))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``most``; an item above that stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def canonical(text: bytes) -> bytes:
    """A-Z in lower case, words split at ASCII white space and joined by one space."""
    return b" ".join(text.lower().split())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of canonical texts, in order, and the number of words of each text."""
    counts = np.fromiter((d.count(b" ") + 1 if d else 0 for d in docs), np.int64, len(docs))
    blob = b" ".join(d for d in docs if d)
    if not blob:
        return np.zeros(0, np.uint64), counts
    a = np.frombuffer(blob + b" ", np.uint8)
    ends = np.flatnonzero(a == 32)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    lengths = ends - starts + 1  # with the space
    power = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inside = np.arange(len(a), dtype=np.int64) - np.repeat(starts, lengths)
    return mix(np.add.reduceat((a.astype(np.uint64) + U64(1)) * power[inside], starts) + lengths.astype(np.uint64)), counts


def shingle_hashes(docs: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of canonical texts and their number in each; a shorter text that has words is one run."""
    words, counts = word_hashes(docs)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(words):
        return words, runs
    begins = np.cumsum(counts) - counts
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begins, runs)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    short = np.repeat(np.where(counts < width, counts, width), runs)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        part = mix(padded[at + k] + U64(k + 1))
        total += part if k == 0 else np.where(short > k, part, U64(0))
        total *= U64(0xD6E8FEB86659FD93)
    return mix(total), runs


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``keys``: which of ``wanted`` are there, and where (0 if not)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, at


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, of the given lengths (0 for an empty run)."""
    out, full = np.zeros(len(counts)), counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out
