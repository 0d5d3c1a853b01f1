"""Newest row per key, as-of lookups, calendars and time zones."""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key under a total order; the window keeps one row a key before the shuffle (group limit)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def players_by_name(participants: DataFrame, kind: str = "player") -> DataFrame:
    """Newest participant of each lower-case name: name_key, participant_id, guild_abbreviation."""
    rows = participants.filter(F.col("participant_type") == kind).withColumn("name_key", F.lower("current_name"))
    rows = latest_per_key(rows, ["name_key"], [F.desc_nulls_last("last_seen_at"), F.asc("id")])
    return rows.select("name_key", F.col("id").alias("participant_id"), F.nullif("guild_abbreviation", F.lit("")).alias("guild_abbreviation"))


def with_player(df: DataFrame, name: str, participants: DataFrame, out: str, keep_guild: bool = False) -> DataFrame:
    """Left lookup of the newest player with the lower-case name in column ``name``."""
    found = players_by_name(participants).select(F.col("name_key").alias("_key"), F.col("participant_id").alias(out), *([F.col("guild_abbreviation")] if keep_guild else []))
    return df.join(found, F.lower(df[name]) == found["_key"], "left").drop("_key")


def previous_observation(observed: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Backward as-of join of each row with the row strictly before it in the same key (absent observations are skipped)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return observed.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])


def days(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """One row a day from first to last; none where last is before first (``sequence`` alone would fail)."""
    none = F.array().cast("array<date>")
    return spark.range(1).select(F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(none)).alias("day"))


def known_zone(zone: str | None) -> str:
    """The zone if it is a known one, else UTC."""
    return zone if zone and zone in zoneinfo.available_timezones() else "UTC"


def local_day(at: Column, zone: str) -> Column:
    """The calendar day in ``zone`` of a UTC time without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at))


def day_start(day: str, zone: str) -> Column:
    """UTC time without zone of local midnight."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(dt.datetime.fromisoformat(day)).cast("timestamp_ntz"))


def epoch_clock(value: Column) -> Column:
    """Unix seconds or milliseconds (over 1e12) as a timestamp; not positive is null."""
    return F.when(value <= 0, None).when(value > F.lit(10**12), F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))
