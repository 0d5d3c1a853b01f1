"""Head-to-head pairs: wins of each side, claims, spans and revenge kills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.functions.latest import with_player
from sparrowlog.functions.text import contains_ci
from sparrowlog.operators.encounters import failed, kill, paid


def hunter() -> Column:
    return F.lower("hunter_name")


def target() -> Column:
    return F.lower("target_name")


def pairs(encounters: DataFrame) -> DataFrame:
    """One row for each unordered pair of different names. A revenge kill follows, among the pair's kills, a kill of this
    killer by this victim."""
    first = hunter() <= target()
    tagged = encounters.filter(hunter() != target()).select(
        "*",
        F.least(hunter(), target()).alias("side_a_key"),
        F.greatest(hunter(), target()).alias("side_b_key"),
        F.when(first, F.col("hunter_name")).otherwise(F.col("target_name")).alias("side_a_name"),
        F.when(first, F.col("target_name")).otherwise(F.col("hunter_name")).alias("side_b_name"),
    )
    # the kill before, among kills only, over the one shuffle that the totals need too
    kills = Window.partitionBy("side_a_key", "side_b_key").orderBy("event_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("previous_killer", F.last(F.when(kill(), hunter()), True).over(kills))
    won_by = lambda side: (kill() & (hunter() == F.col(side))) | (failed() & (target() == F.col(side)))
    return tagged.groupBy("side_a_key", "side_b_key").agg(
        F.min("side_a_name").alias("side_a_name"),
        F.min("side_b_name").alias("side_b_name"),
        F.count("*").alias("encounters"),
        F.count_if(won_by("side_a_key")).alias("side_a_wins"),
        F.count_if(won_by("side_b_key")).alias("side_b_wins"),
        F.count_if(kill()).alias("claims"),
        paid().alias("credits"),
        F.min("event_at").alias("first_event_at"),
        F.max("event_at").alias("last_event_at"),
        F.count_if(kill() & (F.col("previous_killer") == target())).alias("revenge_kills"),
    )


def span_seconds():
    return F.timestamp_diff("SECOND", F.col("first_event_at"), F.col("last_event_at"))


ORDERS = {
    "encounters": lambda: [F.desc("encounters"), F.desc("last_event_at")],
    "closest": lambda: [F.asc(F.abs(F.col("side_a_wins") - F.col("side_b_wins"))), F.desc("encounters")],
    "revenge": lambda: [F.desc("revenge_kills"), F.desc("encounters")],
    "longest": lambda: [F.desc(span_seconds()), F.desc("encounters")],
    "recent": lambda: [F.desc("last_event_at"), F.desc("encounters")],
}


def listing(encounters: DataFrame, participants: DataFrame, q: str | None = None, sort: str = "encounters", page: int = 1, page_size: int = 25) -> DataFrame:
    """A page of pairs that met twice or more, with the newest player of each side."""
    rows = pairs(encounters).filter("encounters >= 2")
    if q and q.strip():
        rows = rows.filter(contains_ci(F.col("side_a_name"), q.strip()) | contains_ci(F.col("side_b_name"), q.strip()))
    size = min(100, max(10, page_size))
    rows = rows.orderBy(*ORDERS[sort](), "side_a_key", "side_b_key").offset((max(1, page) - 1) * size).limit(size)
    return with_player(with_player(rows, "side_a_key", participants, "side_a_participant_id"), "side_b_key", participants, "side_b_participant_id")


def summary(encounters: DataFrame) -> DataFrame:
    """Pairs of two or more meetings and their longest span; the other figures are over all pairs."""
    twice = F.col("encounters") >= 2
    return pairs(encounters).agg(
        F.count_if(twice).alias("rivalries"),
        F.coalesce(F.max("encounters"), F.lit(0)).alias("most_encounters"),
        F.coalesce(F.sum("revenge_kills"), F.lit(0)).alias("revenge_kills"),
        F.coalesce(F.max(F.when(twice, span_seconds())), F.lit(0)).cast("double").alias("longest_span_seconds"),
    )


def of_hunter(encounters: DataFrame, name: str, participants: DataFrame) -> DataFrame:
    """One player's opponents (itself included, if it hunted itself); revenge counts the player's own kills only."""
    me = F.lit(name.lower())
    rows = encounters.filter((hunter() == me) | (target() == me)).withColumn("opponent", F.when(hunter() == me, F.col("target_name")).otherwise(F.col("hunter_name"))).withColumn("opponent_key", F.lower("opponent"))
    kills = Window.partitionBy("opponent_key").orderBy("event_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous_killer", F.last(F.when(kill(), hunter()), True).over(kills))
    claim, survival = kill() & (hunter() == me), failed() & (target() == me)
    out = rows.groupBy("opponent_key").agg(
        F.min("opponent").alias("opponent"),
        F.count("*").alias("encounters"),
        F.count_if(claim | survival).alias("wins"),
        (F.count("*") - F.count_if(claim | survival)).alias("losses"),
        F.count_if(claim).alias("claims"),
        F.count_if(survival).alias("survivals"),
        F.coalesce(F.sum(F.when(claim, F.col("credits"))), F.lit(0)).cast("double").alias("credits"),
        F.min("event_at").alias("first_event_at"),
        F.max("event_at").alias("last_event_at"),
        (F.count_if(claim | survival).cast("double") / F.count("*")).alias("win_rate"),
        F.count_if(claim & (F.col("previous_killer") == target())).alias("revenge_kills"),
    )
    return with_player(out, "opponent_key", participants, "participant_id")


def revenge_counts(kills: DataFrame) -> DataFrame:
    """Of one hunter's kills and deaths (opponent_key, mine, event_at, id): kills right after a death by the same opponent, in
    order. The window's twin as a fold over each opponent's ordered events."""
    ordered = F.sort_array(F.collect_list(F.struct("event_at", "id", "mine")))
    start = F.struct(F.lit(True).alias("before"), F.lit(0).cast("long").alias("n"))
    step = lambda s, e: F.struct(e["mine"].alias("before"), (s["n"] + (e["mine"] & ~s["before"]).cast("long")).alias("n"))
    return kills.groupBy("opponent_key").agg(F.aggregate(ordered, start, step)["n"].alias("revenge_kills"))
