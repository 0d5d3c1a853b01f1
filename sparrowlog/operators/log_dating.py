"""Full times for the lines of logs of any size, in two passes over byte ranges.

The text source cuts a file into ranges. A first pass goes through each range once, where it is read, without a shuffle: it
numbers lines, drops repeats, counts the days that begin, and sums the range up in one row. Sums before each range then come from
a window over these rows (a file has few), and give every line its number and day in the file. The result is that of
``combat.dated_lines``, which sees whole files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowlog.operators import combat
from sparrowlog.sources.export import shared

LINES = "file string, modified_at timestamp, block long, no long, text string, clock int, marker date, day long, doubt boolean"
SCANNED = LINES + ", lines long, first_clock int, last_clock int, last_text string"
NAMES = [x.split()[0] for x in SCANNED.split(", ")]


def log_ranges(spark: SparkSession, path: str, names: str = "*", part: str = "") -> DataFrame:
    """(file, modified_at, block, text): lines as they lie in the byte ranges (``block`` is a range's first byte) of log files.
    With ``part``, a pattern whose group is a number, the files of a folder are one log in the order of that number; its
    ``file`` is the folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("lineSep", "\n").text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("_metadata.file_block_start").alias("block")]
    rows = rows.select(*meta, F.col("value").alias("text"))
    if not part:
        return rows
    place = F.shiftleft(F.regexp_extract(F.element_at(F.split("file", "/"), -1), part, 1).cast("long"), 44)
    return rows.select(F.regexp_extract("file", "^(.*)/", 1).alias("file"), "modified_at", (place + F.col("block")).alias("block"), "text")


class Range:
    """What one range has shown so far."""

    def __init__(self, file: str, modified_at, block: int):
        self.file, self.modified_at, self.block = file, modified_at, block
        self.lines = self.day = 0
        self.first_clock = self.last_clock = self.last_text = None

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The range's next lines (file, modified_at, block, text, clock, marker): those that are kept, with number and day."""
        text = batch.column(3)
        filled = np.flatnonzero(pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        own = text.take(pa.array(filled))
        fresh = np.ones(len(filled), bool)
        if len(filled):
            fresh[0] = self.last_text is None or own[0].as_py() != self.last_text
            fresh[1:] = pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)
        doubtful = self.last_text is None  # the first line with text may repeat the last one of the range before
        clocks = batch.column(4).take(pa.array(filled))
        kept = fresh & clocks.is_valid().to_numpy(zero_copy_only=False)
        rows = filled[kept]
        clock = clocks.filter(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[clock[0] if self.last_clock is None else self.last_clock], clock[:-1]]) if len(clock) else clock
        day = self.day + np.cumsum(clock < before - 3600)
        out = self.rows(batch.take(pa.array(rows)), self.lines + rows + 1, clock, day, np.isin(rows, filled[:1]) & doubtful)
        self.lines += batch.num_rows
        if len(filled):
            self.last_text = own[len(own) - 1].as_py()
        if len(clock):
            self.first_clock = int(clock[0]) if self.first_clock is None else self.first_clock
            self.last_clock, self.day = int(clock[-1]), int(day[-1])
        return out

    @staticmethod
    def rows(batch: pa.RecordBatch, no, clock, day, doubt) -> pa.RecordBatch:
        n = batch.num_rows
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string())]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(no, pa.int64()), batch.column(3), pa.array(clock, pa.int32()), batch.column(5), pa.array(day, pa.int64()), pa.array(doubt), *none]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def summary(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        """One row for the range: its lines, days that begin in it, clocks at its ends and its last text."""
        given = {"file": self.file, "modified_at": self.modified_at, "block": self.block, "day": self.day, "lines": self.lines, "first_clock": self.first_clock, "last_clock": self.last_clock, "last_text": self.last_text}
        return pa.RecordBatch.from_arrays([pa.array([given.get(n)], k) for n, k in zip(NAMES, kinds, strict=True)], NAMES)


def scan_batches(batches):
    """Lines in the order of their ranges to kept lines, and a row for each range with ``lines`` set."""
    current, kinds = None, None
    for batch in batches:
        file, block = batch.column(0), batch.column(2).to_numpy()
        change = np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)) + 1 if len(block) > 1 else []
        for a, b in zip([0, *change], [*change, len(block)], strict=True):
            if a == b:
                continue
            name, start = file[a].as_py(), int(block[a])
            if current is None or (current.file, current.block) != (name, start):
                if current:
                    yield current.summary(kinds)
                current = Range(name, batch.column(1)[a].as_py(), start)
            out = current.take(batch.slice(a, b - a))
            kinds = [c.type for c in out.columns]
            yield out
    if current:
        yield current.summary(kinds)


def dated_ranges(lines: DataFrame) -> DataFrame:
    """(file, line_no, text, clock, at) of the combat lines of (file, modified_at, block, text)."""
    spark = lines.sparkSession
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), r"[\r\n]+$", "")
    marker = combat.login_marker(F.col("text"))
    clock = sum((F.regexp_extract("text", combat.STAMP, i).try_cast("int") * s for i, s in ((1, 3600), (2, 60), (3, 1))), F.lit(0))
    own = F.when(F.col("_m").isNotNull(), F.hour("_m") * 3600 + F.minute("_m") * 60 + F.second("_m")).when(combat.is_suspect(F.col("text")), clock)
    rows = lines.select("file", F.col("modified_at").cast("timestamp").alias("modified_at"), "block", text.alias("text")).withColumn("_m", marker)
    rows = rows.select("file", "modified_at", "block", "text", own.cast("int").alias("clock"), F.to_date("_m").alias("marker"))
    path = shared(spark, "log-ranges")
    rows.mapInArrow(scan_batches, SCANNED).write.parquet(path)
    scanned = spark.read.schema(SCANNED).parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = scanned.filter("lines IS NOT NULL").select("file", "block", zero(F.sum("lines").over(before)).alias("lines_before"), F.last("last_text", True).over(before).alias("text_before"), zero(F.sum("day").over(before)).alias("days_before"), F.coalesce(F.col("first_clock") < F.last("last_clock", True).over(before) - 3600, F.lit(False)).cast("long").alias("_cross"))
    ranges = ranges.withColumn("days_before", F.col("days_before") + F.sum("_cross").over(upto)).drop("_cross")
    kept = scanned.filter("lines IS NULL").drop("lines", "first_clock", "last_clock", "last_text").join(ranges, ["file", "block"])
    kept = kept.filter(~(F.col("doubt") & F.col("text").eqNullSafe(F.col("text_before"))))
    kept = kept.select("file", "modified_at", (F.col("no") + F.col("lines_before")).alias("line_no"), "text", "clock", "marker", (F.col("day") + F.col("days_before")).alias("day"))
    return kept.filter("marker IS NULL").join(dates_of_days(kept), ["file", "day"]).select("file", "line_no", "text", "clock", F.timestamp_add("SECOND", F.col("clock"), F.col("date").cast("timestamp_ntz")).alias("at"))


def dates_of_days(kept: DataFrame) -> DataFrame:
    """(file, day, date): the date of each day number of each file, from markers or from when the file was modified."""
    days = kept.groupBy("file", "day").agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("own"), F.min_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("head"), F.max("modified_at").alias("modified_at"), F.bool_or(F.col("marker").isNull()).alias("has_lines"))
    by, whole = Window.partitionBy("file").orderBy("day"), Window.partitionBy("file")
    anchor = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("date"), "day"))
    near = F.last(anchor("own"), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(anchor("head"), True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.struct(F.to_date(F.max("modified_at").over(whole)).alias("date"), F.max(F.when(F.col("has_lines"), F.col("day"))).over(whole).alias("day"))
    a = F.coalesce(near, first, last)
    return days.withColumn("_a", a).select("file", "day", F.date_add(F.col("_a.date"), (F.col("day") - F.col("_a.day")).cast("int")).alias("date"))
