"""Versioned leaderboards: newest snapshots, movement, standings, history and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.functions.latest import latest_per_key, previous_observation
from sparrowlog.functions.numbers import safe_ratio


def newest_snapshots(observations: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """All entries of the newest snapshot of each key."""
    rows = observations if where is None else observations.filter(where)
    heads = rows.select(*keys, "snapshot_id", "observed_at").distinct()
    heads = latest_per_key(heads, keys, [F.desc("observed_at"), F.asc("snapshot_id")]).select("snapshot_id")
    return rows.join(heads, "snapshot_id", "left_semi")


def cycles(observations: DataFrame) -> DataFrame:
    """Cycles of the boards with their period keys and the last time one was observed."""
    return observations.groupBy("starts_at", "ends_at").agg(F.sort_array(F.collect_set("source_period_key")).alias("source_period_keys"), F.max("observed_at").alias("verified_at"))


def select_cycle(rows: list, period: str, start=None):
    """Of cycles, newest first: the one that starts at ``start``, else the first whose keys have ``period``; None if none has."""
    exact = next((r for r in rows if start is not None and r["starts_at"] == start), None)
    return exact or next((r for r in rows if period in r["source_period_keys"]), None)


def current_cycle(observations: DataFrame) -> DataFrame:
    """The cycle of the newest snapshot flagged CURRENT: one row or none."""
    rows = observations.filter("source_period_key = 'CURRENT'").select("starts_at", "ends_at", "observed_at", "snapshot_id")
    return rows.orderBy(F.desc("observed_at"), F.desc("snapshot_id")).limit(1).select("starts_at", "ends_at")


def current_standings(observations: DataFrame) -> DataFrame:
    """The newest current observation of each participant on each board."""
    rows = observations.filter("source_period_key = 'CURRENT'")
    return latest_per_key(rows, ["leaderboard_id", "participant_id"], [F.desc("observed_at"), F.asc("snapshot_id")])


def board_values(observations: DataFrame, total: str, unique: str) -> DataFrame:
    """Newest rank and score on two boards, a row for each participant."""
    of = lambda board, c: F.max(F.when(F.col("leaderboard_id") == board, F.col(c)))
    return current_standings(observations).groupBy("participant_id").agg(of(total, "rank").alias("total_kills_rank"), of(total, "score").alias("total_kills_score"), of(unique, "rank").alias("unique_kills_rank"), of(unique, "score").alias("unique_kills_score"))


def movement(observations: DataFrame) -> DataFrame:
    """Every observation beside the one before it of the same participant in the same period of the board."""
    return previous_observation(observations, ["leaderboard_id", "starts_at", "participant_id"], "observed_at", ["rank", "score"])


def leaderboard(observations: DataFrame, participants: DataFrame, board: str, period: str) -> DataFrame:
    """Entries of the newest snapshot with their former rank and score. Only one board's period is moved."""
    rows = observations.filter((F.col("leaderboard_id") == board) & (F.col("source_period_key") == period))
    rows = movement(rows)
    heads = rows.orderBy(F.desc("observed_at"), F.desc("snapshot_id")).limit(1).select("snapshot_id")
    p = participants.select(F.col("id").alias("participant_id"), "current_name", "guild_abbreviation", "city_name")
    return rows.join(F.broadcast(heads), "snapshot_id", "left_semi").join(p, "participant_id").select("rank", "score", "participant_id", "current_name", "guild_abbreviation", "city_name", "previous_rank", "previous_score")


def standings(observations: DataFrame, participant: str, n: int = 24) -> DataFrame:
    """Newest observation of one participant in each board and period, its share of the total and its best rank ever."""
    mine = observations.filter(F.col("participant_id") == participant)
    mine = mine.withColumn("best_rank", F.min("rank").over(Window.partitionBy("leaderboard_id")))
    rows = latest_per_key(mine, ["leaderboard_id", "starts_at"], [F.desc("observed_at"), F.asc("snapshot_id")])
    share = safe_ratio(F.col("score"), F.nullif(F.greatest("total_score", F.lit(0.0)), F.lit(0.0)))
    return rows.select("leaderboard_id", "starts_at", "ends_at", "source_period_key", "rank", "score", "total_score", share.alias("share"), "best_rank").orderBy("leaderboard_id", F.desc("starts_at")).limit(n)


def trends(standing_rows: DataFrame) -> DataFrame:
    """Rank change against the period before (positive: better)."""
    before = F.lead("rank").over(Window.partitionBy("leaderboard_id").orderBy(F.desc("starts_at")))
    return standing_rows.withColumn("previous_rank", before).withColumn("delta", F.col("previous_rank") - F.col("rank")).withColumn("trend", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "same"))


def contemporaneous(observations: DataFrame) -> DataFrame:
    """Observations made while their own period ran; a period without end is open."""
    return observations.filter((F.col("observed_at") >= F.col("starts_at")) & (F.col("ends_at").isNull() | (F.col("observed_at") < F.col("ends_at"))))


def rank_history(observations: DataFrame, participant: str, boards: list[str]) -> DataFrame:
    """Day by board: the last rank of the day; the pivot's columns are given, so it needs no job of its own."""
    rows = contemporaneous(observations).filter(F.col("participant_id") == participant).withColumn("day", F.to_date("observed_at").cast("string"))
    return rows.groupBy("day").pivot("leaderboard_id", boards).agg(F.max_by("rank", "observed_at"))


def newest_period(observations: DataFrame, participant: str) -> DataFrame:
    """Of each board the newest period, and in it the newest observation."""
    mine = observations.filter(F.col("participant_id") == participant)
    return latest_per_key(mine, ["leaderboard_id"], [F.desc("starts_at"), F.desc("observed_at"), F.asc("snapshot_id")]).select("leaderboard_id", "starts_at", "observed_at", "rank", "score")


def members_of_boards(observations: DataFrame, participants: DataFrame, boards: list[str]) -> DataFrame:
    """Entries on the given boards with the identity of their participant (those without one have no row)."""
    p = participants.select(F.col("id").alias("participant_id"), "current_name", "guild_abbreviation")
    return observations.filter(F.col("leaderboard_id").isin(boards)).join(p, "participant_id")
