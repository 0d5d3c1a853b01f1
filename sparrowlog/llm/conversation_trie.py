"""Prefix trie of conversations by preorder intervals.

A conversation's turns are in the order of turn (nulls first), role and text. Each conversation is rebuilt first: it takes the
opening turns of the conversation at the head of its block of ids. A node is a distinct sequence of first turns; its code is the
SHA-256 of its depth and of sums of the digests of its turns and their places, which are running sums over one global sort.

Distinct sequences are ranked lexicographically: turns' digests are gathered in runs of ``RUN``, distinct runs are sorted and
named by their rank, and names are gathered likewise until a conversation is one name, so rounds grow as the logarithm of its
length and no array is longer than a run. A node's place in preorder is then (first sequence that holds it, depth), its subtree
ends where the last sequence that holds it ends, and leaves and savings of the subtree are differences of running sums over
preorder.

Conversations of any length and nodes of any number of members are split: orders are ranges of a global sort, all else joins on
keys of which hot ones are broadcast (``join_one``). The member ids of an end node are joined in pieces of ``PIECE`` ids; its
SHA-256, which is sequential, then streams over the pieces.

A null role or text is empty. Rows without a conv_id belong to no conversation and are left out. Rows that repeat are turns of
their own. An empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.llm.common import join_one, materialise
from sparrowlog.llm.quotes import BLOCK_ROWS, ranked

RUN, PIECE, SUMS = 32, 4096, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def sum_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``rows`` as running sums up to and with each rank: inside blocks of ranks, and between blocks from a table
    with a row for each."""
    rows = rows.withColumn("_block", F.floor(F.col("rank") / BLOCK_ROWS))
    inside = Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns])
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_" + c) for c in columns])
    sums = {c: F.sum(c).over(inside) + F.col("_" + c) for c in columns}
    return rows.join(blocks, "_block").withColumns(sums).drop("_block", *["_" + c for c in columns])


def heads(conv_id: Column) -> Column:
    """Turns that a conversation takes from the head of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, role, text) of rebuilt conversations, depth from 1, and (conv_id, n_turns), 0 for turnless ones."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    own = own.filter("conv_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())  # parts rows that are alike
    own = ranked(own, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")], "turns").drop("row")
    sizes = materialise(own.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "sizes")
    sizes = sizes.withColumn("h", heads(F.col("conv_id"))).withColumn("head_id", F.col("conv_id") - F.col("conv_id") % block)
    taken = sizes.select(F.col("conv_id").alias("head_id"), F.col("n").alias("head_n"))
    sizes = sizes.join(taken, "head_id", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0))))
    sizes = materialise(sizes.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "sizes")
    placed = materialise(join_one(own, sizes.select("conv_id", "first", "n", "h", "taken"), "conv_id", "n").withColumn("at", F.col("rank") - F.col("first")), "placed")
    kept = placed.filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text")
    # a head has three rows at most here, and a block as many conversations as it has ids
    first = placed.filter("at < 3").select(F.col("conv_id").alias("head_id"), "at", "role", "text")
    lent = first.join(sizes.select("conv_id", "head_id", "taken"), "head_id").filter("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "role", "text")
    return kept.unionByName(lent), sizes.select("conv_id", "n_turns")


def named_sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, path): the rank of each conversation among the distinct sequences of ``symbol`` by depth."""
    rows = turns.select("conv_id", (F.col("depth") - 1).alias("at"), "symbol")
    while True:
        runs = rows.groupBy("conv_id", F.floor(F.col("at") / RUN).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("run"))
        runs = materialise(runs.select("conv_id", "at", F.col("run.symbol").alias("run")), "runs")
        done = runs.filter("at > 0").isEmpty()
        if done:  # a conversation without turns is the empty run, which sorts before all
            runs = convs.select("conv_id").join(runs.drop("at"), "conv_id", "left").withColumn("run", F.coalesce("run", F.array().cast(runs.schema["run"].dataType)))
        named = ranked(runs.groupBy("run").agg(F.count("*").alias("n")), [F.asc("run")], "names")
        rows = join_one(runs, materialise(named, "names"), "run", "n").drop("run", "n").withColumnRenamed("rank", "symbol")
        if done:
            return rows.select("conv_id", F.col("symbol").alias("path"))
        rows = materialise(rows, "named")


def digest_batches(batches):
    """(path, place, ids), pieces of a path one after another, to (path, ends_sha256)."""
    path, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own == path:
                state.update(b"," + ids.encode())
            else:
                if path is not None:
                    out.append((path, state.hexdigest()))
                path, state = own, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out])], ["end_path", "ends_sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.int64()), pa.array([state.hexdigest()])], ["end_path", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(end_path, ends_sha256) of the conversations of each sequence."""
    rows = ranked(paths.select("path", "conv_id"), [F.asc("path"), F.asc("conv_id")], "ends")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    pieces = rows.groupBy("path", F.floor(F.col("rank") / PIECE).alias("place")).agg(ids)
    return pieces.repartition("path").sortWithinPartitions("path", "place").mapInArrow(digest_batches, "end_path long, ends_sha256 string")


def build_trie(conversations: DataFrame, block: int = 20) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie of
    (conv_id, turn, role, text)."""
    turns, convs = rebuilt(conversations, block)
    sha = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    turns = turns.select("conv_id", "depth", sha.alias("sha"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    pieces = [F.conv(F.substring("sha", 5 * k + 1, 5), 16, 10).cast("long").alias(f"s{k}") for k in range(SUMS)]
    turns = materialise(turns.select("conv_id", "depth", F.unhex(F.substring("sha", 33, 32)).alias("symbol"), "words", *pieces), "rebuilt")
    sums = [f"s{k}" for k in range(SUMS)]
    paths = materialise(named_sequences(turns, convs).join(convs, "conv_id"), "paths")
    # the root's row of each conversation adds nothing and says what the sums were before it
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(c) for c in sums])
    steps = ranked(turns.drop("symbol").unionByName(roots), [F.asc("conv_id"), F.asc("depth")], "steps")
    steps = materialise(sum_before(steps.withColumns({"own_" + c: F.col(c) for c in sums}), sums), "summed")
    start = steps.filter("depth = 0").select("conv_id", *[F.col(c).alias("start_" + c) for c in sums])
    of = materialise(paths.join(start, "conv_id").withColumn("rows", F.col("n_turns") + 1), "of")
    steps = join_one(steps, of, "conv_id", "rows")

    def code(depth: Column, values: list[Column]) -> Column:
        return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), *[v.cast("string") for v in values]).cast("binary"), 256), 1, 32))

    own = [F.col(c) - F.col("start_" + c) for c in sums]
    above = [F.col(c) - F.col("start_" + c) - F.col("own_" + c) for c in sums]
    end = F.when(F.col("depth") == F.col("n_turns"), F.col("path"))
    steps = steps.select("conv_id", "depth", "words", "path", code(F.col("depth"), own).alias("code"), F.when(F.col("depth") > 0, code(F.col("depth") - 1, above)).alias("parent"), end.alias("end_path"))
    nodes = steps.groupBy("code").agg(
        F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("parent").alias("parent"), F.min("end_path").alias("end_path"),
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("path").alias("first_path"), F.max("path").alias("last_path"),
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "code", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = ranked(nodes, [F.asc("first_path"), F.asc("depth")], "preorder")
    nodes = materialise(sum_before(nodes.withColumns({"own_leaf": F.col("leaf"), "own_saved": F.col("saved")}), ["leaf", "saved"]), "intervals")
    # a subtree ends with the last node that its last sequence is the first to hold
    last = nodes.groupBy(F.col("first_path").alias("last_path")).agg(F.max(F.struct("rank", "leaf", "saved")).alias("e"))
    asked = nodes.groupBy("last_path").agg(F.count("*").alias("asked"))
    last = materialise(last.join(asked, "last_path").select("last_path", "asked", F.col("e.leaf").alias("end_leaf"), F.col("e.saved").alias("end_saved")), "subtree-ends")
    nodes = join_one(nodes, last, "last_path", "asked")
    nodes = nodes.withColumn("n_leaves", F.col("end_leaf") - F.col("leaf") + F.col("own_leaf")).withColumn("saved_tokens", F.col("end_saved") - F.col("saved") + F.col("own_saved"))
    nodes = nodes.select("code", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_path")
    nodes = nodes.withColumn("end_path", F.coalesce("end_path", -1 - F.xxhash64("code").bitwiseAND(F.lit((1 << 62) - 1)))).join(ends(paths), "end_path", "left")
    nodes = materialise(nodes.drop("end_path").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie")
    parents = materialise(nodes.filter("n_children > 0").select(F.col("code").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    below = join_one(nodes.filter("parent IS NOT NULL"), parents.withColumnRenamed("n_children", "weight"), "parent", "weight")
    top = nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*out).unionByName(top.select(*out)).select(*out[:4], F.col("n_children").cast("long").alias("n_children"), *out[5:])
