"""Processors of valid payloads, one for each kind of feed, the outcome of requests, and repairs by a newer parser.

Each takes what the archive has and valid payloads (``contracts.validate`` without issues), and gives rows to append or replace;
nothing here loops over payloads, so a batch of any number of them is one job.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.functions.latest import latest_per_key
from sparrowlog.functions.text import redact
from sparrowlog.operators import combat, contracts, ingest, mail, merge

BOARD_FIELDS = ["name", "tracker_oid", "category", "value_type"]
STATE = ["leaderboard_id", "starts_at", "ends_at", "subject"]
COMMISSIONED = 7  # fixed value: the least commissioned rank


def catalog(known: DataFrame, valid: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Boards (id, name, tracker_oid, category, value_type) after valid catalogues, and (id, field, old_value, new_value) of what changed."""
    rows = valid.select(F.col("p.fetchedAt").alias("at"), F.explode("p.boards").alias("b")).filter(F.col("b.category").isin(categories))
    rows = rows.select("at", "b.id", "b.name", F.col("b.trackerOid").alias("tracker_oid"), "b.category", F.col("b.valueType").alias("value_type"))
    rows = latest_per_key(rows, ["id"], [F.desc("at"), *[F.asc(c) for c in BOARD_FIELDS]]).drop("at")
    return merge.upsert(known, rows, ["id"]), merge.revisions(known, rows, ["id"], BOARD_FIELDS)


def fresh_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of entry rows (``is_new``: not archived yet) the archived ones, and those of the snapshots to append: the first observation
    of each state (keys, state_hash, none of them null) that the archive lacks. Both come in one frame, whose source is thus
    worked out once."""
    state = Window.partitionBy("state_hash", *keys)  # what tells rows apart comes first, as sorting looks at it first
    rows = rows.select("*", F.min("is_new").over(state).alias("_lacks"), F.min("observed_at").over(state).alias("_first"))
    whole = [F.col(c).isNotNull() for c in (*keys, "state_hash")]
    return rows.filter(~F.col("is_new") | reduce(and_, whole, F.col("_lacks") & (F.col("observed_at") == F.col("_first")))).drop("_lacks", "_first")


def entry_revisions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """What differs between an entry of a new snapshot of a past period and the same participant's in the snapshot just
    before it, of archived and fresh rows (``fresh_states``): (leaderboard_id, starts_at, ends_at, subject, participant_id,
    observed_at, field, old_value, new_value)."""
    rows = rows.select(*STATE, "observed_at", "source_period_key", "participant_id", *fields, "is_new").filter("source_period_key <> 'CURRENT'")
    rows = rows.withColumn("n", F.dense_rank().over(Window.partitionBy(*STATE).orderBy("observed_at")))
    before = Window.partitionBy("participant_id", *STATE).orderBy("n")  # here, too, what tells rows apart comes first
    rows = rows.select("*", F.lag("n").over(before).alias("n_before"), *[F.lag(c).over(before).cast("string").alias(f"_{c}") for c in fields]).filter("is_new AND n_before = n - 1 AND participant_id IS NOT NULL")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("old_value"), F.col(c).cast("string").alias("new_value")) for c in fields]))
    rows = rows.select(*STATE, "participant_id", "observed_at", each.alias("r"))
    return rows.select(*STATE, "participant_id", "observed_at", "r.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def bounty(known: DataFrame, valid: DataFrame, source: str) -> DataFrame:
    """Encounters to append: one of each fingerprint that ``known`` (fingerprint) lacks."""
    return merge.insert_if_absent(known, ingest.encounters_of(valid, source), ["fingerprint"], [F.asc("event_at")])


BOUNTY_STATE = ["windowDays", "summary", "hunters", "targets", "survivors"]


def bounty_aggregates(known: DataFrame, valid: DataFrame) -> DataFrame:
    """(state_hash, window_days, summary, hunters, targets, survivors, first_fetched_at) of states that ``known`` (state_hash) lacks."""
    state = ingest.state_hash(F.col("payload"), BOUNTY_STATE).alias("state_hash")
    rows = valid.select(state, F.col("p.windowDays").alias("window_days"), *[F.col(f"p.{c}") for c in BOUNTY_STATE[1:]], F.to_timestamp("p.fetchedAt").alias("at"))
    rows = rows.groupBy("state_hash").agg(*[F.first(c).alias(c) for c in ("window_days", *BOUNTY_STATE[1:])], F.min("at").alias("first_fetched_at"))
    return rows.join(known.select("state_hash"), "state_hash", "left_anti")


def wins(known: DataFrame, valid: DataFrame) -> DataFrame:
    """Win rows to append: each (board, subject, participant, wins, rank) once."""
    keys = ["leaderboard_id", "subject", "source_participant_id", "wins", "rank"]
    return ingest.wins_of(valid).select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def officers(known: DataFrame, valid: DataFrame) -> DataFrame:
    """Registry rows of states (faction, state_hash) to append."""
    rows = ingest.officers_of(valid).dropDuplicates(["faction", "state_hash", "source_participant_id"])
    return rows.join(known.select("faction", "state_hash").distinct(), ["faction", "state_hash"], "left_anti")


def officer_corps(rows: DataFrame, top: int = 5) -> DataFrame:
    """The commissioned officers of each guild in the newest registry of each faction, ``top`` a guild, with the guild's
    numbers; a guild without any has one row with null in their place. Rows: (faction, observed_at, participant_id,
    rank_index, points, guild)."""
    newest = rows.groupBy("faction").agg(F.max("observed_at").alias("observed_at"))
    rows = rows.join(newest, ["faction", "observed_at"], "left_semi").withColumn("guild", F.lower("guild")).filter("guild <> ''")
    high = F.col("rank_index") >= COMMISSIONED
    counts = rows.groupBy("guild").agg(F.count_if(high).alias("commissioned"), F.count_if(~high).alias("enlisted"))
    place = F.row_number().over(Window.partitionBy("guild").orderBy(F.desc("rank_index"), F.desc("points"), "participant_id"))
    best = rows.filter(high).withColumn("place", place).filter(F.col("place") <= top).select("guild", "place", "participant_id", "rank_index", "points")
    return counts.join(best, "guild", "left")


def archived(raw: DataFrame, kind: str) -> DataFrame:
    """Rows of (source, payload, observed_at) as they are archived, valid or not: their hash, status and issues. The archive is
    written before any processor sees a payload, so what fails stays to be read again."""
    rows = contracts.validate(raw, kind)
    status = F.when(F.try_parse_json("payload").isNull(), "INVALID_JSON").when(F.size("issues") > 0, "REJECTED").otherwise("PROCESSED")
    return rows.select("source", "payload", "observed_at", F.sha2(F.coalesce(F.to_json(F.try_parse_json("payload")), "payload"), 256).alias("payload_hash"), status.alias("status"), "issues")


def resolve_errors(errors: DataFrame, successes: DataFrame) -> DataFrame:
    """Errors (id, source, at) with ``resolved_at``: the first success (source, at) of their source after them, else null."""
    rows = errors.select("id", "source", "at", F.lit(None).cast("timestamp_ntz").alias("ok")).unionByName(successes.select(F.lit(None).cast("long").alias("id"), "source", "at", F.col("at").alias("ok")))
    # newest first; of one moment the error comes first, so only strictly later successes precede it
    later = Window.partitionBy("source").orderBy(F.desc("at"), F.col("id").isNull(), "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("resolved_at", F.last("ok", True).over(later)).filter("id IS NOT NULL").drop("ok")


def reparse_mails(archive: DataFrame, version: str) -> DataFrame:
    """The archive (id, raw, sender, subject, sent_at, parser_version) with the headers of the present parser, ``changed``,
    and the trades; a mail changes if a header differs or another parser read it, and keeps its time if none is found now."""
    old = archive.select("id", "raw", *[F.col(c).alias(f"_{c}") for c in ("sender", "subject", "sent_at", "parser_version")])
    rows = mail.with_trades(mail.parse_mails(old))
    same = F.col("_sender").eqNullSafe(F.col("sender")) & F.col("_subject").eqNullSafe(F.col("subject")) & F.col("_parser_version").eqNullSafe(F.lit(version))
    sent = F.when(same, F.col("_sent_at")).otherwise(F.coalesce("sent_at", "_sent_at"))
    return rows.select("id", "sender", "subject", sent.alias("sent_at"), F.col("sent_at").alias("parsed_at"), (~same).alias("changed"), "sale", "purchase")


def repair_dates(trades: DataFrame, mails: DataFrame) -> DataFrame:
    """Trades (mail_id, occurred_at, ...) at the time of their mail (id, parsed_at; ids are unique) where that is known, with ``repaired``."""
    rows = trades.join(mails.select(F.col("id").alias("mail_id"), "parsed_at"), "mail_id", "left")
    differs = F.col("parsed_at").isNotNull() & ~F.col("occurred_at").eqNullSafe(F.col("parsed_at"))
    return rows.withColumn("repaired", differs).withColumn("occurred_at", F.coalesce("parsed_at", "occurred_at")).drop("parsed_at")


def reparse_combat(unparsed: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append of unparsed lines (user_id, fingerprint, raw, occurred_at, uploaded_at) that the grammar knows now and
    ``events`` (user_id, fingerprint) lacks, and the lines that stay unparsed; known utility lines go without an event."""
    found, stay, _ = combat.split_upload(unparsed)
    found = found.withColumn("occurred_at", F.coalesce("occurred_at", "uploaded_at")).drop("uploaded_at")
    return merge.insert_if_absent(events, found, ["user_id", "fingerprint"], [F.asc("occurred_at")]), stay


def log_records(rows: DataFrame, level: Column, event: Column, context: Column, at: Column, environment: str = "development", service: str = "sparrowlog") -> DataFrame:
    """Adds ``record``, a structured log line as JSON: the fields of the context (a JSON object) without its secrets, then
    timestamp, level, event, environment and service, which no field of the context can replace. A context that is no object is
    the field ``context``."""
    own = F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), level.alias("level"), event.alias("event"), F.lit(environment).alias("environment"), F.lit(service).alias("service"))
    # a column of its own, as lambdas take no Python function
    rows = rows.withColumn("_own", F.to_json(own)).withColumn("_plain", redact(context))
    is_object = F.try_variant_get(F.try_parse_json("_plain"), "$", contracts.MAP).isNotNull()
    fields = F.when(is_object, F.col("_plain")).otherwise(F.to_json(F.struct(F.col("_plain").alias("context"))))
    rows = rows.withColumn("_fields", contracts.canonical_state(fields, drop=["timestamp", "level", "event", "environment", "service"]))
    inner = F.nullif(F.substring("_fields", F.lit(2), F.length("_fields") - 2), F.lit(""))
    return rows.withColumn("record", F.concat(F.lit("{"), F.concat_ws(",", inner, F.substring("_own", F.lit(2), F.length("_own") - 2)), F.lit("}"))).drop("_own", "_plain", "_fields")


def amount(value: Column) -> Column:
    """A number with commas, rounded to whole."""
    return F.format_number(value.cast("double"), 0)


def report_hunters(rows: DataFrame) -> DataFrame:
    """Labels of a report's hunters (hunter_name, guild_abbreviation, kills, deaths, failures, credits)."""
    guild = F.coalesce(F.nullif("guild_abbreviation", F.lit("")), F.lit("Unaligned"))
    return rows.select(F.col("hunter_name").alias("name"), guild.alias("guild"), F.concat("kills", F.lit("K")).alias("kills"), F.concat("deaths", F.lit("D · "), "failures", F.lit(" failed")).alias("record"), amount(F.col("credits")).alias("credits"))


def report_leaders(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Labels of a report's leaders (leaderboard_id, current_name, guild_abbreviation, score, value_type)."""
    board = F.lit(None).cast("string")
    for key, label in labels.items():
        board = F.when(F.col("leaderboard_id") == key, label).otherwise(board)
    guild = F.coalesce(F.nullif("guild_abbreviation", F.lit("")), F.lit("Unaligned"))
    score = F.concat(amount(F.col("score")), F.when(F.col("value_type") == "CREDITS", " cr").otherwise(""))
    return rows.select(F.coalesce(board, "leaderboard_id").alias("board"), F.col("current_name").alias("name"), guild.alias("guild"), score.alias("score"))
