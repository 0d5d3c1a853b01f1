"""Structured Streaming: idempotent landing, incremental combat lines, windowed monitors and fight state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sparrowlog.functions.latest import latest_per_key
from sparrowlog.operators.combat import parse


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as e:  # a table that no batch has written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, keys: list[str], batch_id: int) -> None:
    """Append the first row of each key that the table lacks, in a folder of the batch: a batch that runs again replaces it.

    Only keys are read of the table, and of files only those whose range of the first key meets the batch's."""
    spark, rows = rows.sparkSession, rows.persist()  # read for its range, and written
    own = f"batch={batch_id}"
    low, high = rows.agg(F.min(keys[0]), F.max(keys[0])).first()
    old = read_table(spark, path, StructType([*rows.schema.fields, StructField("batch", LongType())])).filter(F.col("batch") != batch_id).drop("batch")
    if low is not None:
        old = old.filter(F.col(keys[0]).between(F.lit(low), F.lit(high)))
    fresh = latest_per_key(rows, keys, [F.asc(c) for c in rows.columns]).join(old.select(*keys), keys, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/{own}")
    rows.unpersist()


def land(stream: DataFrame, table: str, keys: list[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Exactly-once effect by natural keys without a horizon: late rows are taken whenever they come."""
    writer = stream.writeStream.foreachBatch(lambda rows, i: append_new(rows, table, keys, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def combat_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of log files as they appear: (file, raw, clock, kind, source, target, ability, amount, flag)."""
    lines = spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    return lines.select("*", F.explode(F.array(parse(F.col("raw")))).alias("c")).filter("c IS NOT NULL AND c.kind <> 'utility'").select("file", "raw", "c.*")


def error_monitor(stream: DataFrame, at: str, failed, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Failures in windows of some minutes, with a watermark that bounds the state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, f"{minutes} minutes")).agg(F.count_if(failed).alias("failures"), F.count("*").alias("requests"))


FIGHT_STATE = "anchor long, start long, last long, damage long, events long"
FIGHTS = "user_id string, start timestamp, end timestamp, total_damage long, events long"


def fight_groups(gap_us: int):
    """State function: the fight of a user goes on while its last damage (or first event) is recent; finished ones come out."""
    import pandas as pd

    def run(key, frames, state):
        s = state.get if state.exists else None
        out = []

        def close():
            if s and s[3] > 0:
                out.append((key[0], pd.Timestamp(s[1], unit="us"), pd.Timestamp(s[2], unit="us"), s[3], s[4]))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["occurred_at", "id"])
            for at, kind, amount in zip(rows["occurred_at"].astype("datetime64[us]").astype("int64"), rows["kind"], rows["amount"], strict=True):
                hit = kind == "damage"
                if s and at - s[0] > gap_us:
                    close()
                    s = None
                s = (at, at, at, amount if hit else 0, 1) if s is None else (max(s[0], at) if hit else s[0], min(s[1], at), max(s[2], at), s[3] + (amount if hit else 0), s[4] + 1)
            state.update(tuple(int(x) for x in s))
            state.setTimeoutTimestamp(int(s[0] // 1000) + gap_us // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "start", "end", "total_damage", "events"])

    return run


def fight_stream(events: DataFrame, gap_seconds: int = 20, late: str = "1 minute") -> DataFrame:
    """Fights of each user as they end: equal in the end to the batch clusters of events that come in order. One that comes in a
    later batch than its followers, but before the watermark, is counted in the fight that is open then and never moves its
    anchor back."""
    return events.withWatermark("occurred_at", late).groupBy("user_id").applyInPandasWithState(fight_groups(gap_seconds * 1_000_000), FIGHTS, FIGHT_STATE, "append", "EventTimeTimeout")


DECISIONS = "id long, client string, at timestamp, reset timestamp, remaining int, allowed boolean"


def decide(width: int, limit: int):
    """State function: the window of a client and its requests so far; a request at or after the window's end begins the next."""
    import pandas as pd

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for i, at in zip(rows["id"], rows["at"].astype("datetime64[us]").astype("int64"), strict=True):
            if start is None or at >= start + width:
                start, n = at, 0
            n += 1
            out.append((i, key[0], pd.Timestamp(at, unit="us"), pd.Timestamp(start + width, unit="us"), max(0, limit - n), n <= limit))
        state.update((int(start), n))
        state.setTimeoutTimestamp(int(start + width) // 1000 + 1)
        yield pd.DataFrame(out, columns=["id", "client", "at", "reset", "remaining", "allowed"])

    return run


def rate_stream(requests: DataFrame, limit: int = 120, seconds: int = 60, least: int = 10, late: str = "1 minute") -> DataFrame:
    """Decisions on requests (id, client, at) as they come; those of one batch in the order of their time. A client's state goes
    once the watermark has passed its window. Requests that come in order get the decisions of ``limits.rate_windows``."""
    rows = requests.select("id", "client", "at").withWatermark("at", late)
    return rows.groupBy("client").applyInPandasWithState(decide(seconds * 1_000_000, max(least, limit)), DECISIONS, "start long, n int", "append", "EventTimeTimeout")
