"""Exports of several tables at one version with a manifest, their check, schema reports, and resumable backfills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlog.functions.files import shared  # noqa: F401
from sparrowlog.functions.latest import latest_per_key
from sparrowlog.operators import ingest, merge
from sparrowlog.sources import landing

CHECKPOINT = "job_key string, status string, last_error string, updated_at timestamp"


def digests(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    out = None
    for name, (rows, order) in tables.items():
        part = merge.table_digest(rows, rows.columns).select(F.lit(name).alias("table"), "rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Write tables (rows, key columns) under one folder, then the manifest: a folder without one is no whole export."""
    for name, (rows, _) in tables.items():
        rows.write.parquet(f"{path}/{name}")
    digests(tables).coalesce(1).write.parquet(f"{path}/_manifest")


def verify(spark: SparkSession, path: str, keys: dict[str, list[str]]) -> DataFrame:
    """(table, rows, ok): whether what lies in the folder has the manifest's rows and digest. A table that is missing is not ok."""
    found = {}
    for name, order in keys.items():
        try:
            found[name] = (spark.read.parquet(f"{path}/{name}"), order)
        except AnalysisException:  # not there: the left join below reports it
            continue
    want = spark.read.parquet(f"{path}/_manifest")
    if not found:
        return want.select("table", "rows", F.lit(False).alias("ok"))
    got = digests(found).toDF("table", "got_rows", "got")
    return want.join(F.broadcast(got), "table", "left").select("table", "rows", F.coalesce((F.col("rows") == F.col("got_rows")) & (F.col("digest") == F.col("got")), F.lit(False)).alias("ok"))


def schema_report(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, types, files) over all JSON responses of a folder."""
    rows = ingest.schema_paths(landing.payloads(spark, path, glob), "file", "payload")
    return rows.groupBy("path").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.count("*").alias("files"))


def checkpoints(spark: SparkSession, path: str) -> dict[str, str]:
    """The newest status of each job; jobs are few, one for each period."""
    try:
        rows = spark.read.schema(CHECKPOINT).parquet(path)
    except AnalysisException:  # no job has begun
        return {}
    return {r["job_key"]: r["status"] for r in latest_per_key(rows, ["job_key"], [F.desc("updated_at")]).collect()}


def backfill(spark: SparkSession, path: str, periods: list[str], run: Callable[[str], None]) -> list[str]:
    """Run a job for each period that has not succeeded; a failure is noted and raised, and the next call goes on there."""

    def note(key: str, status: str, error: str | None = None) -> None:
        spark.createDataFrame([(key, status, error)], "job_key string, status string, last_error string").withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)

    done, before = [], checkpoints(spark, path)
    for period in periods:
        if before.get(period) == "SUCCEEDED":
            continue
        note(period, "RUNNING")
        try:
            run(period)
        except Exception as e:
            note(period, "FAILED", str(e)[:2000])
            raise
        note(period, "SUCCEEDED")
        done.append(period)
    return done
