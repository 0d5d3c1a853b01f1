"""Best-fit packing of tokenised documents into sequences, as a hierarchy of partitions.

Each partition packs its pieces best-fit, longest first, and emits bins that are nearly full. Bins that are not become items
of the next round, in which ``fan_in`` partitions at most meet in one, and no more than leaves a task about ``items_per_task``
items. A round in a single task emits all. Where more is left than one task takes, and a round left more than nine tenths of
its items open, they are emitted as they are, by all its tasks. That costs one sequence a task at most: best-fit leaves no two
bins of a task that fit together, so one bin of a task at most is half empty, and bins over half full never fit one another,
however they are dealt again; merging on could save the half empty ones and no more. Rounds are written, so bins never change
when an executor is lost.

Nulls count as the empty text, which is the end id alone; repeated rows are packed each; extra columns are ignored; empty
tables give no pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "closed boolean, sequence_id long, fill int, members binary"
PACKED = PIECES + ", sequence_id long, offset long"
MEMBER = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
_CODERS: dict[tuple[str, str], object] = {}


class Coder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer's library gives them.

    The byte-level pattern never matches across the border between a character that is no white space and a single space
    before another such character, so texts are cut there and each cut's ids are remembered. Cuts are encoded with the same
    vocabulary as ranks (``ranks_path``), which costs a fifth of a call of the library for so short a text; a text with a
    special token's string, or with white space next to a space, goes to the library whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, most: int = 400_000):
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = tiktoken.Encoding("cuts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s ", r" \s", r"\s\Z", *special]))
        self.known, self.most = Cuts(self.cut), most

    def ids(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.most:
            self.known.clear()
        first, *rest = text.split(" ")
        return np.array(self.cut(first), "<u4").tobytes() + b"".join(map(self.known.__getitem__, rest))


class Cuts(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, cut: str) -> bytes:
        ids = np.array(self.encode(" " + cut), "<u4").tobytes()
        if len(cut) <= 40:
            self[cut] = ids
        return ids


def coder(path: str, ranks_path: str, pattern: str) -> Coder:
    if (path, ranks_path) not in _CODERS:
        _CODERS[path, ranks_path] = Coder(path, ranks_path, pattern)
    return _CODERS[path, ranks_path]


def cut_pieces(path: str, ranks_path: str, pattern: str, most: int, end_id: int):
    """A map over (doc_id, text) giving pieces; only longer documents are cut, and then the first piece takes what is over."""

    def run(batches):
        encode, end = coder(path, ranks_path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.ids(text) + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % most + 1
                for piece in range(-(-n // most)):
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + most
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: a bin with room r is there
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        if n > capacity:
            raise ValueError("an item is longer than a bin")
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                open_ ^= 1 << room
            bins[at].append(item)
        else:
            at, room = len(bins), capacity
            bins.append([item])
        by_room[room - n].append(at)
        open_ |= 1 << (room - n)
    return bins


def pack_round(number: int, capacity: int, full: int):
    """A map over (fill, members): bins of this partition's items, closed if they hold ``full`` tokens."""

    def run(batches):
        from pyspark import TaskContext

        items: list[tuple[int, bytes]] = []
        for batch in batches:
            items += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        items.sort()  # so that the result doesn't hang on the order of arrival
        own = (number << 54) | (TaskContext.get().partitionId() << 32)
        out = []
        for k, members in enumerate(best_fit([n for n, _ in items], capacity)):
            fill = sum(items[i][0] for i in members)
            out.append((fill >= full, own + k, fill, b"".join(items[i][1] for i in members)))
        for i in range(0, len(out), 5000):
            closed, ids, fills, data = (list(c) for c in zip(*out[i : i + 5000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(closed), pa.array(ids, pa.int64()), pa.array(fills, pa.int32()), pa.array(data, pa.binary())], ["closed", "sequence_id", "fill", "members"])

    return run


def as_items(batches):
    for batch in batches:
        doc_id = batch.column(0)
        rows = np.zeros(len(doc_id), MEMBER)
        rows["doc_id"], rows["null"] = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
        for name, k in (("piece", 1), ("start", 2), ("length", 3), ("crc", 4)):
            rows[name] = batch.column(k).to_numpy()
        data, n = rows.tobytes(), MEMBER.itemsize
        yield pa.RecordBatch.from_arrays([pa.array(rows["length"]), pa.array([data[i : i + n] for i in range(0, len(data), n)], pa.binary())], ["fill", "members"])


def as_rows(batches):
    for batch in batches:
        data = batch.column(1).to_pylist()
        rows = np.frombuffer(b"".join(data), MEMBER)
        counts = np.array([len(x) // MEMBER.itemsize for x in data], np.int64)
        before = np.cumsum(rows["length"], dtype=np.int64) - rows["length"]
        first = np.cumsum(counts) - counts
        offset = before - np.repeat(before[first], counts) if len(rows) else before
        ids = np.repeat(batch.column(0).to_numpy(), counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], mask=rows["null"] > 0), pa.array(rows["piece"]), pa.array(rows["start"]), pa.array(rows["length"].astype(np.int64)), pa.array(rows["crc"].astype(np.int64)), pa.array(ids), pa.array(offset)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_pieces(pieces: DataFrame, capacity: int = 2048, items_per_task: int = 20_000, fan_in: int = 8, nearly_full: float = 0.98) -> DataFrame:
    """``pieces`` with sequence_id and offset; no piece may be longer than ``capacity``."""
    items = pieces.count()
    tasks = max(1, -(-items // items_per_task))
    open_ = pieces.repartition(tasks).mapInArrow(as_items, "fill int, members binary")
    closed, number = None, 0
    while True:
        last = tasks == 1
        bins = materialise(open_.mapInArrow(pack_round(number, capacity, 0 if last else int(nearly_full * capacity)), BINS), "bins")
        done = bins.filter("closed").select("sequence_id", "members")
        closed = done if closed is None else closed.unionByName(done)
        if last:
            return closed.mapInArrow(as_rows, PACKED)
        rest = bins.filter("not closed")
        left = rest.count()
        if left > items_per_task and left > 0.9 * items:
            return closed.unionByName(rest.select("sequence_id", "members")).mapInArrow(as_rows, PACKED)
        items, tasks, number = left, max(-(-left // items_per_task), -(-tasks // fan_in)), number + 1
        open_ = rest.select("fill", "members").repartition(tasks) if tasks > 1 else rest.select("fill", "members").coalesce(1)


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = materialise(rows.mapInArrow(cut_pieces(tokenizer_path, ranks_path, pattern, capacity, end_id), PIECES), "pieces")
    return pack_pieces(pieces, capacity, **options)
