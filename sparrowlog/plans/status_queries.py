"""Queries of the newest board rows, the payload archive and the status pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowlog.functions.latest import latest_per_key
from sparrowlog.operators import ingest
from sparrowlog.plans import lens
from sparrowlog.plans.register import query

O = lens.with_("observations")
HASH = "sha256(CAST(json(props) AS VARCHAR))"


@query("lst6_guild_board", f"""{O} SELECT participant_id, rank, score FROM observations WHERE leaderboard_id='{lens.BOARDS[0]}' AND source_period_key='CURRENT'
QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY observed_at DESC, snapshot_id)=1""")
def guild_board(spark, d):
    rows = lens.observations(spark, d).filter((F.col("leaderboard_id") == lens.BOARDS[0]) & (F.col("source_period_key") == "CURRENT"))
    return latest_per_key(rows, ["participant_id"], [F.desc("observed_at"), F.asc("snapshot_id")]).select("participant_id", "rank", "score")


@query("lst7_board_wins", f"""{O} SELECT participant_id, leaderboard_id, score AS wins, rank, observed_at FROM observations
QUALIFY row_number() OVER (PARTITION BY participant_id, leaderboard_id ORDER BY observed_at DESC, snapshot_id)=1""")
def board_wins(spark, d):
    rows = latest_per_key(lens.observations(spark, d), ["participant_id", "leaderboard_id"], [F.desc("observed_at"), F.asc("snapshot_id")])
    return rows.select("participant_id", "leaderboard_id", F.col("score").alias("wins"), "rank", "observed_at")


@query("lst8_registry_row", f"""{O}, newest AS (SELECT leaderboard_id, max(observed_at) AS observed_at FROM observations GROUP BY 1)
SELECT o.participant_id, o.leaderboard_id AS faction, o.observed_at, o.rank FROM observations o JOIN newest n ON n.leaderboard_id=o.leaderboard_id AND n.observed_at=o.observed_at
QUALIFY row_number() OVER (PARTITION BY o.participant_id ORDER BY o.observed_at DESC, o.leaderboard_id)=1""")
def registry_row(spark, d):
    """The newest snapshot of each faction, then each participant's newest row in these."""
    rows = lens.observations(spark, d)
    newest = rows.groupBy("leaderboard_id").agg(F.max("observed_at").alias("observed_at"))
    rows = rows.join(newest, ["leaderboard_id", "observed_at"], "left_semi")
    rows = latest_per_key(rows, ["participant_id"], [F.desc("observed_at"), F.asc("leaderboard_id")])
    return rows.select("participant_id", F.col("leaderboard_id").alias("faction"), "observed_at", "rank")


@query("lst10_payload_blobs", f"""SELECT {HASH} AS payload_hash, props AS payload, ts AS first_seen_at FROM events QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY ts, event_id)=1""")
def payload_blobs(spark, d):
    """The earliest payload of each content hash, null payloads apart; a minimum, so repeats meet before the shuffle."""
    e = lens.table(spark, d, "events").filter("props IS NOT NULL").select(ingest.content_hash(F.col("props")).alias("payload_hash"), F.struct(F.col("ts").alias("first_seen_at"), "event_id", F.col("props").alias("payload")).alias("row"))
    return e.groupBy("payload_hash").agg(F.min("row").alias("row")).select("payload_hash", "row.payload", "row.first_seen_at")


@query("agg4_agg25_admin_summary", """SELECT max(ts) FILTER (event_type='view') AS last_success, count(*) FILTER (event_type='error') AS historical_errors, count(*) FILTER (event_type='error' AND value>=20) AS open_errors, count(*) AS raw_responses,
 (SELECT count(*) FROM customer) AS participants, (SELECT count(*) FROM orders) AS snapshots, (SELECT count(*) FROM lineitem) AS entries FROM events""")
def admin_summary(spark, d):
    failed = F.col("event_type") == "error"
    row = lens.table(spark, d, "events").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_success"), F.count_if(failed).alias("historical_errors"), F.count_if(failed & (F.col("value") >= 20)).alias("open_errors"), F.count("*").alias("raw_responses"))
    for name, of in (("participants", "customer"), ("snapshots", "orders"), ("entries", "lineitem")):
        row = row.crossJoin(F.broadcast(lens.table(spark, d, of).agg(F.count("*").alias(name))))  # one row each
    return row


@query("ops2_open_errors", "SELECT event_id, user_id, ts AS created_at FROM events WHERE event_type='error' AND value>=20 ORDER BY ts DESC, event_id DESC LIMIT 50")
def open_errors(spark, d):
    rows = lens.table(spark, d, "events").filter("event_type = 'error' AND value >= 20")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", F.col("ts").alias("created_at"))


@query("lst2_group_leaders", f"""{lens.with_("observations", "participants")}, newest AS (SELECT leaderboard_id, max(observed_at) AS observed_at FROM observations WHERE source_period_key='CURRENT' GROUP BY 1)
SELECT o.leaderboard_id, o.participant_id, p.current_name, o.rank, o.score FROM observations o JOIN newest n ON n.leaderboard_id=o.leaderboard_id AND n.observed_at=o.observed_at JOIN participants p ON p.id=o.participant_id
WHERE o.source_period_key='CURRENT' AND o.rank<=5""")
def group_leaders(spark, d):
    """The first five ranks of the newest current snapshot of each board."""
    rows = lens.observations(spark, d).filter("source_period_key = 'CURRENT'")
    newest = rows.groupBy("leaderboard_id").agg(F.max("observed_at").alias("observed_at"))
    rows = rows.filter("rank <= 5").join(newest, ["leaderboard_id", "observed_at"], "left_semi")
    people = lens.participants(spark, d).select(F.col("id").alias("participant_id"), "current_name")
    return rows.join(people, "participant_id").select("leaderboard_id", "participant_id", "current_name", "rank", "score")
