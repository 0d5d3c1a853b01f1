"""Sales and purchases of one account: windows, items, customers, days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.functions.latest import days, known_zone, local_day


def of_account(rows: DataFrame, user: str, character: str | None = None) -> DataFrame:
    rows = rows.filter(F.col("user_id") == user)
    return rows if character is None else rows.filter(F.col("character_name") == character)


def since(as_of: dt.datetime, n_days: int) -> Column:
    return F.col("occurred_at") >= F.lit(as_of - dt.timedelta(days=n_days)).cast("timestamp_ntz")


def total(where: Column | None = None) -> Column:
    return F.coalesce(F.sum("credits" if where is None else F.when(where, F.col("credits"))), F.lit(0)).cast("double")


def local_today(as_of: dt.datetime, zone: str) -> Column:
    return local_day(F.lit(as_of).cast("timestamp_ntz"), zone)


def windows(rows: DataFrame, as_of: dt.datetime, zone: str | None = None) -> DataFrame:
    zone = known_zone(zone)
    today, week, month = local_day(F.col("occurred_at"), zone) == local_today(as_of, zone), since(as_of, 7), since(as_of, 30)
    return rows.agg(
        F.count_if(today).alias("today_sales"), total(today).alias("today_credits"),
        F.count_if(week).alias("week_sales"), total(week).alias("week_credits"),
        F.count_if(month).alias("month_sales"), total(month).alias("month_credits"),
        F.count("*").alias("total_sales"), total().alias("total_credits"),
        F.coalesce(F.avg("credits"), F.lit(0.0)).alias("average_credits"),
        F.coalesce(F.max("credits"), F.lit(0)).cast("double").alias("best_credits"),
    )


def top_items(rows: DataFrame, as_of: dt.datetime, n: int = 10) -> DataFrame:
    return rows.filter(since(as_of, 30)).groupBy("item_name").agg(F.count("*").alias("sales"), F.sum("credits").cast("double").alias("credits")).orderBy(F.desc("credits"), "item_name").limit(n)


def daily(rows: DataFrame, as_of: dt.datetime, zone: str | None = None, n_days: int = 14) -> DataFrame:
    """The last days in the zone, zero where quiet."""
    zone = known_zone(zone)
    last = local_today(as_of, zone)
    found = rows.groupBy(local_day(F.col("occurred_at"), zone).alias("day")).agg(F.count("*").alias("sales"), F.sum("credits").cast("double").alias("credits"))
    calendar = days(rows.sparkSession, F.date_sub(last, n_days - 1), last)
    return calendar.join(found, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("sales", F.lit(0)).alias("sales"), F.coalesce("credits", F.lit(0.0)).alias("credits"))


def purchases(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    month = since(as_of, 30)
    return rows.agg(F.count_if(month).alias("month_purchases"), total(month).alias("month_spent"), F.count("*").alias("total_purchases"), total().alias("total_spent"))


def customers(rows: DataFrame, n: int = 200) -> DataFrame:
    """Ledger of buyers with the item of their dearest purchase (the last in the alphabet of equal ones)."""
    return (
        rows.filter("buyer <> ''")
        .groupBy("buyer")
        .agg(F.count("*").alias("purchases"), F.sum("credits").cast("double").alias("credits"), F.max("credits").cast("double").alias("best"), F.min("occurred_at").alias("first_purchase"), F.max("occurred_at").alias("last_purchase"), F.max(F.struct("credits", "item_name"))["item_name"].alias("top_item"))
        .orderBy(F.desc("credits"), "buyer")
        .limit(n)
    )


def characters(rows: DataFrame) -> DataFrame:
    return rows.filter("character_name <> ''").select("character_name").distinct()


def recent(rows: DataFrame, buyer: str | None = None, n: int = 50) -> DataFrame:
    if buyer is not None:
        rows = rows.filter(F.col("buyer") == buyer)
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(min(200, max(1, n)))
