"""Encounter read layer: filters, pages, activity, hunter and target roll-ups."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.functions.latest import day_start, days, known_zone, with_player
from sparrowlog.functions.text import contains_ci, trim_all

OUTCOMES = ("KILL", "FAILED")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def kill() -> Column:
    return F.col("outcome") == "KILL"


def failed() -> Column:
    return F.col("outcome") == "FAILED"


def paid(credits: str = "credits") -> Column:
    """Sum of the credits of kills, 0 where there is none."""
    return F.coalesce(F.sum(F.when(kill(), F.col(credits))), F.lit(0)).cast("double")


def iso_date(value: str | None) -> str | None:
    """The value if it is a real ISO date, else nothing."""
    if not value or not DATE.fullmatch(value):
        return None
    try:
        dt.date.fromisoformat(value)
    except ValueError:
        return None
    return value


@dataclass(frozen=True)
class EncounterFilter:
    q: str | None = None
    outcome: str | None = None
    min_credits: int | None = None
    max_credits: int | None = None
    from_day: str | None = None
    to_day: str | None = None
    zone: str | None = None
    page: int = 1
    page_size: int = 25

    def column(self) -> Column:
        """All given conditions; what is not given adds none."""
        out = F.lit(True)
        if self.q and self.q.strip():
            q = self.q.strip()
            out = out & (contains_ci(F.col("hunter_name"), q) | contains_ci(F.col("target_name"), q))
        if self.outcome is not None:
            if self.outcome not in OUTCOMES:
                raise ValueError(f"outcome must be one of {OUTCOMES}")
            out = out & (F.col("outcome") == self.outcome)
        if self.min_credits is not None:
            out = out & (F.col("credits") >= self.min_credits)
        if self.max_credits is not None:
            out = out & (F.col("credits") <= self.max_credits)
        zone = known_zone(self.zone)
        if iso_date(self.from_day):
            out = out & (F.col("event_at") >= day_start(self.from_day, zone))
        if iso_date(self.to_day):
            after = (dt.date.fromisoformat(self.to_day) + dt.timedelta(days=1)).isoformat()
            out = out & (F.col("event_at") < day_start(after, zone))
        return out

    @property
    def size(self) -> int:
        return min(100, max(10, self.page_size))


def search(encounters: DataFrame, f: EncounterFilter) -> DataFrame:
    """One page, newest first, with the number of all rows that match."""
    found = encounters.filter(f.column())
    page = found.orderBy(F.desc("event_at"), F.desc("id")).offset((max(1, f.page) - 1) * f.size).limit(f.size)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def within(encounters: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    return encounters.filter((F.col("event_at") >= ntz(start)) & (F.col("event_at") < ntz(end)))


def actor_events(encounters: DataFrame) -> DataFrame:
    """Both roles of each encounter: a hunter's own contract, and a target's death if it was killed."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    killed, lost = kill().cast("long"), failed().cast("long")
    hunter = encounters.select(F.lower("hunter_name").alias("hunter_key"), F.col("hunter_name").alias("display_name"), "event_at", one.alias("encounter"), killed.alias("kill"), lost.alias("failure"), lost.alias("death"), F.when(kill(), F.col("credits")).otherwise(0).alias("credits"))
    target = encounters.select(F.lower("target_name").alias("hunter_key"), F.col("target_name").alias("display_name"), "event_at", none.alias("encounter"), none.alias("kill"), none.alias("failure"), killed.alias("death"), none.alias("credits"))
    return hunter.unionByName(target)


def hunter_stats(encounters: DataFrame, cycle: DataFrame) -> DataFrame:
    """Roll-up of both roles in the current cycle (a frame of at most one row of starts_at, ends_at) and overall."""
    rows = actor_events(encounters).join(F.broadcast(cycle), F.lit(True), "left")
    inside = F.col("starts_at").isNotNull() & (F.col("event_at") >= F.col("starts_at")) & (F.col("ends_at").isNull() | (F.col("event_at") < F.col("ends_at")))
    names = {"encounters": "encounter", "kills": "kill", "deaths": "death", "failures": "failure", "credits": "credits"}
    in_cycle = [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("double" if c == "credits" else "long").alias(f"cycle_{n}") for n, c in names.items()]
    overall = [F.coalesce(F.sum(c), F.lit(0)).cast("double" if c == "credits" else "long").alias(f"overall_{n}") for n, c in names.items()]
    return rows.groupBy("hunter_key", F.col("starts_at").alias("cycle_starts_at"), F.col("ends_at").alias("cycle_ends_at")).agg(*in_cycle, *overall)


def daily(encounters: DataFrame, since: dt.datetime) -> DataFrame:
    """Days with encounters from a moment on; quiet days are not there."""
    rows = encounters.filter(F.col("event_at") >= F.lit(since).cast("timestamp_ntz"))
    return rows.groupBy(F.to_date("event_at").cast("string").alias("day")).agg(F.count("*").alias("encounters"), F.count_if(kill()).alias("kills"), paid().alias("credits"))


def cycle_summary(encounters: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return within(encounters, start, end).agg(
        F.count("*").alias("encounters"),
        F.count_if(kill()).alias("claims"),
        F.count_if(failed()).alias("failures"),
        paid().alias("credits"),
        F.coalesce(F.avg(F.when(kill(), F.col("credits"))), F.lit(0.0)).alias("average_bounty"),
        F.count_distinct(F.lower("hunter_name")).alias("active_hunters"),
        F.count_distinct(F.lower("target_name")).alias("unique_targets"),
        F.count_distinct(F.to_date("event_at")).alias("active_days"),
    )


def top_hunters(encounters: DataFrame, participants: DataFrame, start: dt.datetime, end: dt.datetime, n: int = 10) -> DataFrame:
    totals = (
        actor_events(within(encounters, start, end))
        .groupBy("hunter_key")
        .agg(F.min("display_name").alias("hunter_name"), F.sum("encounter").alias("encounters"), F.sum("kill").alias("kills"), F.sum("failure").alias("failures"), F.sum("death").alias("deaths"), F.sum("credits").cast("double").alias("credits"))
        .filter("encounters > 0")
    )
    best = totals.orderBy(F.desc("kills"), F.desc("credits"), F.desc("encounters"), "hunter_name").limit(n)
    return with_player(best, "hunter_key", participants, "participant_id", True)


def targets(encounters: DataFrame, participants: DataFrame) -> DataFrame:
    """Roll-up by target name with its newest player."""
    rows = encounters.groupBy(F.lower("target_name").alias("target_key")).agg(F.min("target_name").alias("target_name"), F.count("*").alias("targeted"), F.count_if(kill()).alias("killed"), F.count_if(failed()).alias("survived"))
    return with_player(rows, "target_key", participants, "participant_id").drop("target_key")


def top_targets(encounters: DataFrame, participants: DataFrame, start: dt.datetime, end: dt.datetime, n: int = 8) -> DataFrame:
    return targets(within(encounters, start, end), participants).orderBy(F.desc("targeted"), F.desc("killed"), "target_name").limit(n)


def hunters(encounters: DataFrame, participants: DataFrame) -> DataFrame:
    rows = encounters.groupBy(F.lower("hunter_name").alias("hunter_key")).agg(F.min("hunter_name").alias("hunter_name"), F.count("*").alias("encounters"), F.count_if(kill()).alias("wins"), F.count_if(failed()).alias("losses"), paid().alias("credits"))
    return with_player(rows, "hunter_key", participants, "participant_id").drop("hunter_key")


def cycle_daily(encounters: DataFrame, start: dt.datetime, end: dt.datetime, as_of: dt.datetime) -> DataFrame:
    """Every elapsed day of the cycle, zero where quiet; days after ``as_of`` are left out."""
    last = min(end - dt.timedelta(seconds=1), as_of).date()
    calendar = days(encounters.sparkSession, F.lit(start.date()), F.lit(last))
    rows = within(encounters, start, end).groupBy(F.to_date("event_at").alias("day")).agg(F.count("*").alias("encounters"), F.count_if(kill()).alias("claims"), F.count_if(failed()).alias("failures"), paid().alias("credits"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return calendar.join(rows, "day", "left").select(F.col("day").cast("string").alias("day"), zero("encounters", 0), zero("claims", 0), zero("failures", 0), zero("credits", 0.0))


def hunter_metrics(encounters: DataFrame) -> DataFrame:
    """Nine measures of each lower-case hunter name."""
    return encounters.groupBy(F.lower("hunter_name").alias("hunter_key")).agg(
        F.count("*").alias("encounters"),
        F.count_if(kill()).alias("wins"),
        F.count_if(failed()).alias("losses"),
        (F.count_if(kill()).cast("double") / F.count("*")).alias("win_rate"),
        paid().alias("credits_claimed"),
        F.max(F.when(kill(), F.col("credits"))).cast("double").alias("highest_bounty"),
        F.count_distinct(F.to_date("event_at")).alias("active_days"),
        F.count_distinct(F.lower("target_name")).alias("unique_targets"),
        F.max("event_at").alias("last_active_at"),
    )


def hunter_order(sort: str) -> list[Column]:
    return {
        "name": [F.asc("current_name")],
        "winRate": [F.desc_nulls_last("win_rate"), F.desc("encounters"), F.asc("current_name")],
        "encounters": [F.desc_nulls_last("encounters"), F.asc("current_name")],
        "credits": [F.desc_nulls_last("credits_claimed"), F.asc("current_name")],
        "lastActive": [F.desc_nulls_last("last_active_at"), F.asc("current_name")],
    }[sort]


def hunter_directory(encounters: DataFrame, participants: DataFrame, board_values: DataFrame, q: str | None = None, activity: str | None = None, sort: str = "encounters", page: int = 1, page_size: int = 25) -> DataFrame:
    """A page of players that a board or an encounter knows, with metrics, board values and their guild's newest identity."""
    from sparrowlog.functions.latest import latest_per_key

    p = participants.filter("participant_type = 'player'")
    guild = participants.filter("participant_type = 'guild'").withColumn("guild_key", F.lower("guild_abbreviation"))
    guild = latest_per_key(guild, ["guild_key"], [F.desc_nulls_last("last_seen_at"), F.asc("id")]).select("guild_key", F.col("id").alias("guild_id"))
    rows = p.join(hunter_metrics(encounters), F.lower("current_name") == F.col("hunter_key"), "left").join(board_values, p["id"] == board_values["participant_id"], "left")
    rows = rows.filter(F.col("hunter_key").isNotNull() | F.col("participant_id").isNotNull())
    if q and q.strip():
        rows = rows.filter(contains_ci(F.col("current_name"), q.strip()) | contains_ci(F.col("guild_abbreviation"), q.strip()))
    if activity == "seen":
        rows = rows.filter("encounters > 0")
    elif activity == "unseen":
        rows = rows.filter("encounters IS NULL")
    size = min(100, max(10, page_size))
    rows = rows.join(guild, F.lower(F.nullif("guild_abbreviation", F.lit(""))) == F.col("guild_key"), "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    out = rows.select("id", "current_name", "guild_abbreviation", "city_name", "guild_id", "total_kills_rank", "total_kills_score", "unique_kills_rank", "unique_kills_score", zero("encounters", 0), zero("wins", 0), zero("losses", 0), "win_rate", zero("credits_claimed", 0.0), "highest_bounty", zero("active_days", 0), zero("unique_targets", 0), "last_active_at")
    return out.orderBy(*hunter_order(sort), F.asc("id")).offset((max(1, page) - 1) * size).limit(size)


def opponents(encounters: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Whom a player hunted most."""
    return encounters.filter(F.lower("hunter_name") == name.lower()).groupBy(F.lower("target_name").alias("opponent_key")).agg(F.min("target_name").alias("opponent"), F.count("*").alias("encounters"), F.count_if(kill()).alias("kills"), paid().alias("credits")).orderBy(F.desc("encounters"), F.desc("kills"), "opponent").limit(n)


def outcome_totals(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy("outcome").agg(F.count("*").alias("encounters"), F.sum("credits").cast("double").alias("credits"))


def archive_totals(encounters: DataFrame, as_of: dt.datetime) -> DataFrame:
    today = F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
    week = F.lit(as_of - dt.timedelta(days=7)).cast("timestamp_ntz")
    names = encounters.select(F.lower("hunter_name").alias("actor")).union(encounters.select(F.lower("target_name"))).distinct().agg(F.count("*").alias("unique_names"))
    return encounters.agg(
        F.count("*").alias("encounters"),
        F.count_if(F.col("event_at") >= today).alias("encounters_today"),
        F.count_if(F.col("event_at") >= week).alias("encounters_week"),
        F.count_distinct(F.lower("hunter_name")).alias("encounter_hunters"),
        F.count_distinct(F.lower("target_name")).alias("encounter_targets"),
        F.min("event_at").alias("history_start"),
        F.max("event_at").alias("history_end"),
    ).crossJoin(F.broadcast(names))


def bounty_presence(participants: DataFrame, observations: DataFrame, encounters: DataFrame) -> DataFrame:
    """Participants on a board or, for players, with a hunter's name: counts by type."""
    boards = observations.select("participant_id").distinct()
    names = encounters.select(F.lower("hunter_name").alias("name_key")).distinct()
    p = participants.join(boards.withColumn("on_board", F.lit(True)), participants["id"] == boards["participant_id"], "left")
    p = p.join(names.withColumn("hunted", F.lit(True)), (F.lower("current_name") == F.col("name_key")) & (F.col("participant_type") == "player"), "left")
    return p.groupBy("participant_type").agg(F.count_if(F.coalesce("on_board", F.lit(False)) | F.coalesce("hunted", F.lit(False))).alias("tracked"))


def per_cycle(encounters: DataFrame, cycles: DataFrame) -> DataFrame:
    """Totals of each cycle (starts_at, ends_at) by interval membership: cycles are spread over the days they touch, so that
    events meet them by day and the exact bounds are checked on these pairs only."""
    days_of = F.explode(F.sequence(F.to_date("starts_at"), F.to_date(F.col("ends_at") - F.expr("INTERVAL 1 MICROSECOND")))).alias("day")
    spread = cycles.filter("ends_at > starts_at").select("starts_at", "ends_at", days_of)
    found = encounters.withColumn("day", F.to_date("event_at")).join(spread, "day").filter("event_at >= starts_at AND event_at < ends_at")
    totals = found.groupBy("starts_at", "ends_at").agg(F.count("*").alias("encounters"), F.count_if(kill()).alias("claims"), paid().alias("credits"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return cycles.join(totals, ["starts_at", "ends_at"], "left").select("starts_at", "ends_at", zero("encounters", 0), zero("claims", 0), zero("credits", 0.0))


def of_names(encounters: DataFrame, names: DataFrame) -> DataFrame:
    """Metrics of the hunters asked for (name), matched without case and outer white space; the unknown ones stay, with nulls."""
    wanted = names.select("name", F.lower(trim_all(F.col("name"))).alias("hunter_key"))
    return wanted.join(hunter_metrics(encounters).select("hunter_key", "encounters", "wins"), "hunter_key", "left").select("name", "encounters", "wins")
