"""Guild roll-ups, rosters and rivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.functions.latest import players_by_name
from sparrowlog.operators.encounters import failed, kill, hunter_metrics, paid


def tag_of() -> Column:
    return F.nullif("guild_abbreviation", F.lit(""))


def activity(encounters: DataFrame, participants: DataFrame) -> DataFrame:
    """Members (newest identity of each name) with or without encounters, rolled up by tag."""
    members = players_by_name(participants).filter("guild_abbreviation IS NOT NULL").join(hunter_metrics(encounters), F.col("name_key") == F.col("hunter_key"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return members.groupBy(F.lower("guild_abbreviation").alias("guild_key")).agg(
        F.count("*").alias("roster_size"),
        F.count_if(F.col("encounters") > 0).alias("active_hunters"),
        zero("encounters").alias("encounters"),
        zero("wins").alias("wins"),
        zero("losses").alias("losses"),
        zero("credits_claimed").cast("double").alias("credits"),
        zero("unique_targets").alias("target_observations"),
        F.max("last_active_at").alias("last_active_at"),
    )


def directory(encounters: DataFrame, participants: DataFrame) -> DataFrame:
    g, a = participants.filter("participant_type = 'guild'").select("id", "current_name", "guild_abbreviation"), activity(encounters, participants)
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    rate = F.when(F.col("encounters") > 0, F.col("wins").cast("double") / F.col("encounters")).alias("win_rate")
    return g.join(a, F.lower("guild_abbreviation") == F.col("guild_key"), "left").select("id", "current_name", "guild_abbreviation", zero("roster_size"), zero("active_hunters"), zero("encounters"), zero("wins"), zero("losses"), rate, zero("credits", 0.0), "last_active_at")


def summary(encounters: DataFrame, participants: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return activity(encounters, participants).agg(F.count("*").alias("guilds"), zero("roster_size").alias("rostered_hunters"), zero("active_hunters").alias("active_hunters"), zero("wins").alias("claims"), zero("credits").cast("double").alias("credits"))


def roster(encounters: DataFrame, participants: DataFrame, tag: str) -> DataFrame:
    """All players of the tag, repeated names too, each with the encounters of its name."""
    p = participants.filter((F.col("participant_type") == "player") & (F.lower(tag_of()) == tag.lower()))
    m = hunter_metrics(encounters).select("hunter_key", "encounters", "wins", "losses", "credits_claimed", "last_active_at")
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    return p.join(m, F.lower("current_name") == F.col("hunter_key"), "left").select("id", "current_name", "city_name", zero("encounters").alias("encounters"), zero("wins").alias("wins"), zero("losses").alias("losses"), zero("credits_claimed", 0.0).alias("credits"), "last_active_at")


def daily(encounters: DataFrame, participants: DataFrame, tag: str) -> DataFrame:
    """Days of a guild. Players are not made distinct by name, so a name that two players share counts twice."""
    p = participants.filter((F.col("participant_type") == "player") & (F.lower(tag_of()) == tag.lower())).select(F.lower("current_name").alias("name_key"))
    rows = encounters.join(p, F.lower("hunter_name") == F.col("name_key"))
    return rows.groupBy(F.to_date("event_at").cast("string").alias("day")).agg(F.count("*").alias("encounters"), F.count_if(kill()).alias("wins"), F.count_if(failed()).alias("losses"), paid().alias("credits"))


def rivals(encounters: DataFrame, participants: DataFrame, tag: str) -> DataFrame:
    """Meetings with other guilds, turned so that wins are this guild's; guilds that share a tag give a row each."""
    names, me = players_by_name(participants), F.lit(tag.lower())
    h = names.select(F.col("name_key").alias("h_key"), F.col("guild_abbreviation").alias("hunter_guild"))
    t = names.select(F.col("name_key").alias("t_key"), F.col("guild_abbreviation").alias("target_guild"))
    rows = encounters.join(h, F.lower("hunter_name") == F.col("h_key")).join(t, F.lower("target_name") == F.col("t_key"))
    ours, theirs = F.lower("hunter_guild") == me, F.lower("target_guild") == me
    rows = rows.filter((F.lower("hunter_guild") != F.lower("target_guild")) & (ours | theirs))
    rows = rows.withColumn("opponent_guild", F.when(ours, F.col("target_guild")).otherwise(F.col("hunter_guild"))).withColumn("won", (kill() & ours) | (failed() & theirs))
    g = participants.filter("participant_type = 'guild'").select(F.lower("guild_abbreviation").alias("g_key"), F.col("id").alias("guild_id"))
    rows = rows.withColumn("opponent_key", F.lower("opponent_guild")).join(g, F.col("opponent_key") == F.col("g_key"), "left")
    return rows.groupBy("opponent_key", "guild_id").agg(F.min("opponent_guild").alias("opponent_guild"), F.count("*").alias("encounters"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.min("event_at").alias("first_event_at"), F.max("event_at").alias("last_event_at")).drop("opponent_key")
