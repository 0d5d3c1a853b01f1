"""File sources: payload landings, mail folders, chat logs; and the list of requests of a poll.

Landings and mail folders may hold millions of small files, which Spark's readers would list in the driver's memory. They are
listed by tasks, a folder in one task and a level of folders in one job, and read by tasks. Paths are those of folders that
PyArrow's file systems open from executors. Logs are few and large and come through Spark's reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlog.functions.files import shared
from sparrowlog.operators.ingest import content_hash, text_hash

#: The words that mark a combat log by name, the names of mails, and sizes of what is read.
LOG_NAMES = r"(?i)(chat|combat).*\.(txt|log)$|chatlog"
SNIFF, MAILS, MAIL_BYTES = 8 * 1024, "*.mail", 64_000
#: Rows and bytes of a batch that a task hands on.
ROWS, PIECE = 10_000, 4 << 20


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def scheme_of(path: str) -> str:
    return path.split("://")[0] + "://" if "://" in path else "file://"


def listing(glob: str, top: str):
    """Of folders (path), what lies in them: (path, length), length null for folders; files only where the name meets ``glob``."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(top)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(folder)) if not hidden(x.base_name) and (x.type == fs.FileType.Directory or fnmatchcase(x.base_name, glob))]
                for at in range(0, len(found), ROWS):
                    some = found[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([x.size if x.is_file else None for x in some], pa.int64())], ["path", "length"])

    return rows_of


def reading(top: str):
    """Of (path), the files' (file, content)."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(top)[0]
        paths, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([scheme_of(top) + x for x in paths], pa.string()), pa.array(texts, pa.binary())], ["file", "content"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    texts.append(f.read())
                paths.append(path)
                held += len(texts[-1])
                if held >= PIECE or len(paths) >= ROWS:
                    yield out()
                    paths, texts, held = [], [], 0
        if paths:
            yield out()

    return rows_of


def small_files(spark: SparkSession, path: str, glob: str, most: int | None = None) -> DataFrame:
    """(file, content) of the files of 1 to ``most`` bytes below a folder whose names meet ``glob`` (of ``fnmatch``)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(fs.FileSystem.from_uri(path)[1],)], "path string")
    found = None
    while True:  # as often as folders are deep
        at = shared(spark, "listing")
        level.mapInArrow(listing(glob, path), "path string, length long").write.parquet(at)
        here = spark.read.schema("path string, length long").parquet(at)
        found = here if found is None else found.unionByName(here)
        folders = here.filter("length IS NULL").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition(parts, "path")
    fit = F.col("length") >= 1 if most is None else F.col("length").between(1, most)
    return found.filter(fit).select("path").repartition(parts, "path").mapInArrow(reading(path), "file string, content binary")


def walked(top: str, glob: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """(file, content) as of ``small_files``, of a folder that one task lists and reads as a whole."""
    batch = lambda paths: iter([pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])])
    folders, fit = [fs.FileSystem.from_uri(top)[1]], []
    while folders:
        found = [x for some in listing(glob, top)(batch(folders)) for x in zip(*(c.to_pylist() for c in some.columns), strict=True)]
        folders = [path for path, length in found if length is None]
        fit += [path for path, length in found if length and (most is None or length <= most)]
    yield from reading(top)(batch(fit))


def payloads(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, payload, payload_hash) of a folder of JSON responses; hash of the canonical text, null where it is no JSON."""
    rows = small_files(spark, path, glob).select("file", F.col("content").cast("string").alias("payload"))
    ok = F.try_parse_json("payload").isNotNull()
    return rows.select("file", "payload", F.when(ok, content_hash(F.col("payload"))).alias("payload_hash"))


def character_name(file: Column) -> Column:
    """The owner of a mail folder: its name without ``mail_``, underscores as spaces."""
    return F.replace(F.regexp_replace(F.element_at(F.split(file, "/"), -2), "^mail_", ""), F.lit("_"), F.lit(" "))


def mails(spark: SparkSession, path: str, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(file, character, raw, fingerprint) of ``.mail`` files of 1 to 64,000 bytes that ``known`` (fingerprint) lacks."""
    return mails_of(small_files(spark, path, MAILS, MAIL_BYTES), known, limit)


def mails_of(files: DataFrame, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The same of files (file, content) that have been read."""
    rows = files.select("file", character_name(F.col("file")).alias("character"), F.col("content").cast("string").alias("raw")).withColumn("fingerprint", text_hash(F.col("raw")))
    if known is not None:
        rows = rows.join(known.select("fingerprint"), "fingerprint", "left_anti")
    rows = rows.dropDuplicates(["fingerprint"])
    return rows if limit is None else rows.orderBy("file").limit(limit)


def chat_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified_at) of logs found by their name or by combat lines in their last 8 KiB."""
    from sparrowlog.operators.combat import is_suspect

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    tail = F.expr(f"decode(substring(content, greatest(1, length(content) - {SNIFF - 1})), 'UTF-8')")
    named = F.element_at(F.split("path", "/"), -1).rlike(LOG_NAMES)
    sniffed = F.exists(F.split(tail, r"\r?\n"), is_suspect)
    return files.filter(named | sniffed).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified_at"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified_at, line_no, text) of whole logs; each file is read by one task."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified_at"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def work_list(spark: SparkSession, boards: list[str], periods: list[str], subjects: list[str], factions: list[str]) -> DataFrame:
    """Requests of one poll: activity, each board by period and subject, each board's wins, each faction's officers."""
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    none = lambda c: F.lit(None).cast("string").alias(c)
    b = frame("board", boards)
    pages = b.crossJoin(frame("period", periods)).crossJoin(frame("subject", subjects)).select(F.lit("leaderboard").alias("processor"), "board", "period", "subject")
    wins = b.select(F.lit("wins").alias("processor"), "board", none("period"), none("subject"))
    officers = frame("board", factions).select(F.lit("officers").alias("processor"), "board", none("period"), none("subject"))
    activity = spark.range(1).select(F.lit("bounty").alias("processor"), none("board"), none("period"), none("subject"))
    return activity.unionByName(pages).unionByName(wins).unionByName(officers)
