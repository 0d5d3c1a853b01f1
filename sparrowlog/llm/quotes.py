"""Chat formatting by quotation linking.

A message's lines are split by their quote level (the number of leading ``>`` marks). Lines of level 0 without attribution
lines are its own text; consecutive lines of one deeper level are a quoted passage. Own texts and passages are cut into units:
the whole, its paragraphs and its lines (these two with three words or more), so a quote that leaves lines or paragraphs out
still finds its original. Units are normalised (lower case, white space as one space) and hashed with SHA-256, and a passage's
units join to the first message of their conversation that holds them, if it is an earlier one. Of the units found, that of the
shallowest level counts, then that with most words, then the first.

A message answers the message so linked, else the one before. An answer to another than the one before opens a branch. Messages
get the number of branches above them, and their position in reply order: a message, what follows it in its branch, then the
branches that hang on the branch's messages, the latest first. ``message`` is the chat message as JSON, without quotes.

Messages of a conversation are in the order of turn (nulls last), role and text; repeats are messages of their own. A message
without conv_id is a conversation by itself. Null texts are empty and have no passage. Extra columns are ignored; an empty table
gives none. No step sorts or gathers a whole conversation in one task: orders are ranges of a global sort, and all else joins on
ranks, which are unique. Reply order comes from list ranking around the tree of branches, with a fixed size for each branch.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.llm.common import join_one, materialise

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{0,100}\b(?:wrote|said|schrieb|escribió|a écrit))\s*:\s*$", re.I)
UNITS = "units array<string>, passages array<struct<level:int,place:int,words:int,unit:string>>"
PARSED = "conv_id long, turn long, role string, body string, text_md5 string, n_passages long, " + UNITS
BLOCK_ROWS = 100_000


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text) in order."""
    own, passages, level = [], [], 0
    for line in text.split("\n"):
        marks = MARKS.match(line)
        if not marks:
            level = 0
            own.append(line)
            continue
        depth, rest = marks[1].count(">"), line[marks.end() :]
        if ATTRIBUTION.match(rest):
            level = 0
        elif depth == level:
            passages[-1] = (depth, passages[-1][1] + "\n" + rest)
        else:
            passages.append((depth, rest))
            level = depth
    if passages:
        own = [x for x in own if not ATTRIBUTION.match(x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), passages


def units(text: str, least: int = 3) -> dict[str, int]:
    """Digests of the normalised whole, paragraphs and lines of a text, with their words."""
    out = {}
    for k, part in enumerate([text, *re.split(r"\n\s*\n", text), *text.split("\n")]):
        words = part.lower().split()
        if len(words) >= (least if k else 1):
            out.setdefault(hashlib.sha256(" ".join(words).encode()).hexdigest(), len(words))
    return out


def parse_batches(batches):
    kind = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int32()), ("words", pa.int32()), ("unit", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(3).to_pylist():
            body, passages = parse(text)
            found = [{"level": level, "place": i, "words": n, "unit": d} for i, (level, x) in enumerate(passages) for d, n in units(x).items()]
            rows.append((body, hashlib.md5(text.encode()).hexdigest(), len(passages), list(units(body)), found))
        bodies, digests, n, own, quoted = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        columns = [pa.array(bodies, pa.string()), pa.array(digests, pa.string()), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array(quoted, kind)]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *columns], ["conv_id", "turn", "role", "body", "text_md5", "n_passages", "units", "passages"])


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``rank``, the number of rows before each in the whole order; written, so that ties keep theirs."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    # the broadcast has a row for each partition
    return placed.join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the greatest value up to each rank: over blocks of ranks, and between blocks from a table with a row for each."""
    rows = rows.withColumn("_block", F.floor(F.col("rank") / BLOCK_ROWS)).withColumn("_value", value)
    inside = Window.partitionBy("_block").orderBy("rank")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.max("_value").alias("m")).select("_block", F.max("m").over(before).alias("_carried"))
    return rows.join(blocks, "_block").withColumn(name, F.coalesce(F.max("_value").over(inside), "_carried")).drop("_block", "_value", "_carried")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_passages, n_linked (units found), parent_turn, parent_position, depth, position and message of
    every row of (conv_id, turn, role, text)."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parsed = rows.mapInArrow(parse_batches, PARSED).withColumn("row", F.monotonically_increasing_id())  # parts rows that are alike
    parsed = ranked(parsed, [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text_md5"), F.asc("row")], "messages").drop("row")
    # a conversation is named by the rank of its first message
    conv = parsed.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n_rows"))
    conv = materialise(conv, "conversations")
    placed = join_one(parsed.filter("conv_id IS NOT NULL"), conv, "conv_id", "n_rows").drop("n_rows").unionByName(parsed.filter("conv_id IS NULL").withColumn("first", F.col("rank")))
    placed = materialise(placed, "placed")
    answers = placed.select("rank", "first", "turn").join(linked(placed), "rank", "left")
    heads = answers.withColumn("parent", F.coalesce("to_rank", F.when(F.col("rank") > F.col("first"), F.col("rank") - 1)))
    opens = F.when(F.col("parent").isNull() | (F.col("parent") < F.col("rank") - 1), F.col("rank"))
    heads = materialise(running(heads, opens, "branch").select("rank", "first", "parent", "branch", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")), "answers")
    places = heads.join(branch_places(heads), "branch")
    places = places.select("rank", "parent", "n_linked", "depth", (F.col("offset") + F.col("rank") - F.col("branch") + 1).alias("position"))
    # a first message has no parent: a key of its own, which none has, keeps them from meeting in one task
    places = places.withColumn("parent", F.coalesce("parent", -1 - F.col("rank")))
    parents = places.select(F.col("rank").alias("parent"), F.col("position").alias("parent_position")).join(placed.select(F.col("rank").alias("parent"), F.col("turn").alias("parent_turn")), "parent")
    out = placed.drop("units", "passages", "first").join(places, "rank").join(parents, "parent", "left")
    return out.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), "n_passages", "n_linked", "parent_turn", "parent_position", "depth", "position", F.to_json(F.struct("role", F.col("body").alias("content"))).alias("message"),
    )


def linked(placed: DataFrame) -> DataFrame:
    """(rank, to_rank, n_linked) of the messages of which a passage has its original."""
    quoted = placed.select("rank", "first", F.explode("passages").alias("p")).select("rank", "first", "p.*")
    own = placed.select("rank", "first", F.explode("units").alias("unit")).join(quoted.select("first", "unit").distinct(), ["first", "unit"], "left_semi")
    origin = own.groupBy("first", "unit").agg(F.min("rank").alias("to_rank"))
    found = quoted.join(origin, ["first", "unit"]).filter("to_rank < rank")
    return found.groupBy("rank").agg(F.min_by("to_rank", F.struct("level", -F.col("words"), "place")).alias("to_rank"), F.count("*").alias("n_linked"))


def branch_places(answers: DataFrame) -> DataFrame:
    """(branch, offset, depth): for each branch the messages of its conversation before it in reply order, and the branches above it.

    Branches are a tree; a walk around it enters a branch, goes through the branches that hang on it and leaves it. Each of
    these two steps knows the next, so the sums from each step to the walk's end follow by list ranking: every round doubles how
    far a step sees, and a step keeps its two sums only."""
    heads = answers.filter("rank = branch").select("branch", "parent")
    sizes = answers.groupBy("branch").agg(F.count("*").alias("n"))
    above = heads.withColumn("key", F.coalesce("parent", -1 - F.col("branch"))).join(answers.select(F.col("rank").alias("key"), F.col("branch").alias("up")), "key", "left")
    tree = materialise(above.select("branch", "parent", "up").join(sizes, "branch"), "branches")
    children = ranked(tree.filter("up IS NOT NULL"), [F.asc("up"), F.desc("parent"), F.asc("branch")], "children").select("branch", "up", "rank")
    after = children.select((F.col("rank") - 1).alias("rank"), F.col("branch").alias("next_branch"), F.col("up").alias("next_up"))
    siblings = children.join(after, "rank", "left").select("branch", F.when(F.col("next_up") == F.col("up"), F.col("next_branch")).alias("sibling"))
    firsts = children.groupBy("up").agg(F.min_by("branch", "rank").alias("child")).withColumnRenamed("up", "branch")
    tree = tree.join(siblings, "branch", "left").join(firsts, "branch", "left")
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    steps = F.array(
        F.struct(enter("branch").alias("step"), F.coalesce(enter("child"), leave("branch")).alias("next"), F.col("n").alias("messages"), F.lit(1).cast("long").alias("levels")),
        F.struct(leave("branch").alias("step"), F.coalesce(enter("sibling"), leave("up")).alias("next"), F.lit(0).cast("long").alias("messages"), F.lit(-1).cast("long").alias("levels")),
    )
    state = materialise(tree.select(F.inline(steps)), "steps")
    while not state.filter("next IS NOT NULL").isEmpty():
        far = state.select(F.col("step").alias("next"), F.col("next").alias("far"), F.col("messages").alias("far_messages"), F.col("levels").alias("far_levels"))
        moved = state.filter("next IS NOT NULL").join(far, "next").select("step", F.col("far").alias("next"), (F.col("messages") + F.col("far_messages")).alias("messages"), (F.col("levels") + F.col("far_levels")).alias("levels"))
        state = materialise(moved.unionByName(state.filter("next IS NULL")), "steps")
    ends = state.filter("step % 2 = 0").select(F.shiftright("step", 1).alias("branch"), "messages", "levels")
    # what a conversation's walk has in all is at the entry of its first branch, which is named by the first message
    whole = answers.filter("rank = branch").select("branch", "first").join(ends, "branch")
    total = whole.filter("branch = first").select("first", F.col("messages").alias("total"))
    return join_one(whole, materialise(total.join(whole.groupBy("first").agg(F.count("*").alias("branches")), "first"), "walks"), "first", "branches").select("branch", (F.col("total") - F.col("messages")).alias("offset"), (-F.col("levels")).cast("int").alias("depth"))
