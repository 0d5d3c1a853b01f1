"""Queries of the read layer: encounters, hunters, guilds, rivalries, boards and sales."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparrowlog.functions import text as tx
from sparrowlog.operators import boards, encounters, guilds, rivalries, sales, text_index
from sparrowlog.plans import lens
from sparrowlog.plans.register import query
from sparrowlog.sources import export

AS_OF = dt.datetime(2024, 1, 20, 12)
START, END = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15)
SALES_AS_OF = dt.datetime(2001, 7, 15, 9, 30)
ZONE, GUILD, HUNTER, PLAYER, USER = "America/New_York", "NATION_3", "actor 7", "p7", "u3"
E, P, N, O, S = "encounters", "participants", "player_by_name", "observations", "sales"
W = lens.with_
IN_CYCLE = "event_at>=TIMESTAMP '2024-01-08' AND event_at<TIMESTAMP '2024-01-15'"
KILLS = "count(*) FILTER (outcome='KILL')"
FAILS = "count(*) FILTER (outcome='FAILED')"
PAID = "CAST(coalesce(sum(credits) FILTER (outcome='KILL'),0) AS DOUBLE)"


def enc(spark, d):
    return lens.encounters(spark, d)


def par(spark, d):
    return lens.participants(spark, d)


def obs(spark, d):
    return lens.observations(spark, d)


def account(spark, d):
    return sales.of_account(lens.sales(spark, d), USER)


@query("flt_encounter_search", f"""{W(E)}, f AS (SELECT * FROM encounters WHERE (hunter_name ILIKE '%actor 1%' OR target_name ILIKE '%actor 1%') AND outcome='KILL'
 AND credits>=1000 AND credits<=90000 AND event_at>=TIMESTAMP '2024-01-03 05:00:00' AND event_at<TIMESTAMP '2024-01-26 05:00:00')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY event_at DESC, id DESC LIMIT 50 OFFSET 50""")
def encounter_search(spark, d):
    f = encounters.EncounterFilter(q=" actor 1", outcome="KILL", min_credits=1000, max_credits=90000, from_day="2024-01-03", to_day="2024-01-25", zone=ZONE, page=2, page_size=50)
    return encounters.search(enc(spark, d), f)


@query("agg1_hunter_stats", f"""{W(E)}, a AS (SELECT lower(hunter_name) AS hunter_key, event_at, 1 AS e, (outcome='KILL')::INT AS k, (outcome='FAILED')::INT AS f, (outcome='FAILED')::INT AS x, CASE WHEN outcome='KILL' THEN credits ELSE 0 END AS c FROM encounters
 UNION ALL SELECT lower(target_name), event_at, 0, 0, 0, (outcome='KILL')::INT, 0 FROM encounters), b AS (SELECT *, {IN_CYCLE} AS i FROM a)
SELECT hunter_key, TIMESTAMP '2024-01-08' AS cycle_starts_at, TIMESTAMP '2024-01-15' AS cycle_ends_at,
 CAST(coalesce(sum(e) FILTER (i),0) AS BIGINT) AS cycle_encounters, CAST(coalesce(sum(k) FILTER (i),0) AS BIGINT) AS cycle_kills, CAST(coalesce(sum(x) FILTER (i),0) AS BIGINT) AS cycle_deaths,
 CAST(coalesce(sum(f) FILTER (i),0) AS BIGINT) AS cycle_failures, CAST(coalesce(sum(c) FILTER (i),0) AS DOUBLE) AS cycle_credits,
 CAST(sum(e) AS BIGINT) AS overall_encounters, CAST(sum(k) AS BIGINT) AS overall_kills, CAST(sum(x) AS BIGINT) AS overall_deaths, CAST(sum(f) AS BIGINT) AS overall_failures, CAST(sum(c) AS DOUBLE) AS overall_credits
FROM b GROUP BY 1""")
def hunter_stats(spark, d):
    cycle = spark.createDataFrame([(START, END)], "starts_at timestamp_ntz, ends_at timestamp_ntz")
    return encounters.hunter_stats(enc(spark, d), cycle)


@query("agg2_agg13_archive_totals", f"""{W(E)} SELECT count(*) AS encounters, count(*) FILTER (event_at>=TIMESTAMP '2024-01-20') AS encounters_today, count(*) FILTER (event_at>=TIMESTAMP '2024-01-13 12:00:00') AS encounters_week,
 count(DISTINCT lower(hunter_name)) AS encounter_hunters, count(DISTINCT lower(target_name)) AS encounter_targets, min(event_at) AS history_start, max(event_at) AS history_end,
 (SELECT count(*) FROM (SELECT lower(hunter_name) FROM encounters UNION SELECT lower(target_name) FROM encounters)) AS unique_names FROM encounters""")
def archive_totals(spark, d):
    return encounters.archive_totals(enc(spark, d), AS_OF)


@query("agg2_jon9_tracked_participants", f"""{W(E, P, O)} SELECT participant_type, count(*) FILTER (id IN (SELECT participant_id FROM observations) OR (participant_type='player' AND lower(current_name) IN (SELECT lower(hunter_name) FROM encounters))) AS tracked
FROM participants GROUP BY 1""")
def tracked(spark, d):
    return encounters.bounty_presence(par(spark, d), obs(spark, d), enc(spark, d))


@query("agg3_daily_activity", f"""{W(E)} SELECT CAST(event_at::DATE AS VARCHAR) AS day, count(*) AS encounters, {KILLS} AS kills, {PAID} AS credits FROM encounters WHERE event_at>=TIMESTAMP '2023-12-21 12:00:00' GROUP BY 1""")
def daily_activity(spark, d):
    return encounters.daily(enc(spark, d), AS_OF - dt.timedelta(days=30))


@query("agg6_cycle_summary", f"""{W(E)} SELECT count(*) AS encounters, {KILLS} AS claims, {FAILS} AS failures, {PAID} AS credits, coalesce(avg(credits) FILTER (outcome='KILL'),0) AS average_bounty,
 count(DISTINCT lower(hunter_name)) AS active_hunters, count(DISTINCT lower(target_name)) AS unique_targets, count(DISTINCT event_at::DATE) AS active_days FROM encounters WHERE {IN_CYCLE}""")
def cycle_summary(spark, d):
    return encounters.cycle_summary(enc(spark, d), START, END)


@query("agg7_cycle_top_hunters", f"""{W(E, P, N)}, c AS (SELECT * FROM encounters WHERE {IN_CYCLE}),
a AS (SELECT lower(hunter_name) AS hunter_key, hunter_name AS n, 1 AS e, (outcome='KILL')::INT AS k, (outcome='FAILED')::INT AS f, (outcome='FAILED')::INT AS x, CASE WHEN outcome='KILL' THEN credits ELSE 0 END AS cr FROM c
 UNION ALL SELECT lower(target_name), target_name, 0, 0, 0, (outcome='KILL')::INT, 0 FROM c)
SELECT t.*, participant_id, guild_abbreviation FROM (SELECT hunter_key, min(n) AS hunter_name, CAST(sum(e) AS BIGINT) AS encounters, CAST(sum(k) AS BIGINT) AS kills, CAST(sum(f) AS BIGINT) AS failures, CAST(sum(x) AS BIGINT) AS deaths, CAST(sum(cr) AS DOUBLE) AS credits
 FROM a GROUP BY 1 HAVING sum(e)>0 ORDER BY kills DESC, credits DESC, encounters DESC, hunter_name LIMIT 10) t LEFT JOIN player_by_name ON name_key=hunter_key""")
def top_hunters(spark, d):
    return encounters.top_hunters(enc(spark, d), par(spark, d), START, END)


TARGETS = f"SELECT min(target_name) AS target_name, count(*) AS targeted, {KILLS} AS killed, {FAILS} AS survived, any_value(participant_id) AS participant_id"


@query("agg8_cycle_top_targets", f"{W(E, P, N)} {TARGETS} FROM encounters LEFT JOIN player_by_name ON name_key=lower(target_name) WHERE {IN_CYCLE} GROUP BY lower(target_name) ORDER BY targeted DESC, killed DESC, target_name LIMIT 8")
def top_targets(spark, d):
    return encounters.top_targets(enc(spark, d), par(spark, d), START, END)


@query("agg9_cycle_calendar", f"""{W(E)} SELECT CAST(g.day::DATE AS VARCHAR) AS day, count(id) AS encounters, count(id) FILTER (outcome='KILL') AS claims, count(id) FILTER (outcome='FAILED') AS failures, {PAID} AS credits
FROM (SELECT unnest(generate_series(DATE '2024-01-08', DATE '2024-01-14', INTERVAL 1 DAY)) AS day) g LEFT JOIN encounters ON event_at::DATE=g.day::DATE GROUP BY 1""")
def cycle_calendar(spark, d):
    return encounters.cycle_daily(enc(spark, d), START, END, AS_OF)


METRICS = f"""m AS (SELECT lower(hunter_name) AS hunter_key, count(*) AS encounters, {KILLS} AS wins, {FAILS} AS losses, CAST({KILLS} AS DOUBLE)/count(*) AS win_rate, {PAID} AS credits_claimed,
 CAST(max(credits) FILTER (outcome='KILL') AS DOUBLE) AS highest_bounty, count(DISTINCT event_at::DATE) AS active_days, count(DISTINCT lower(target_name)) AS unique_targets, max(event_at) AS last_active_at FROM encounters GROUP BY 1)"""


@query("agg10_hunter_metrics", f"{W(E)}, {METRICS} SELECT * FROM m")
def hunter_metrics(spark, d):
    return encounters.hunter_metrics(enc(spark, d))


CURRENT = """cur AS (SELECT * FROM observations WHERE source_period_key='CURRENT' QUALIFY row_number() OVER (PARTITION BY leaderboard_id, participant_id ORDER BY observed_at DESC, snapshot_id)=1)"""
VALUES = """v AS (SELECT participant_id, max(rank) FILTER (leaderboard_id='1-URGENT') AS total_kills_rank, max(score) FILTER (leaderboard_id='1-URGENT') AS total_kills_score,
 max(rank) FILTER (leaderboard_id='2-HIGH') AS unique_kills_rank, max(score) FILTER (leaderboard_id='2-HIGH') AS unique_kills_score FROM cur GROUP BY 1)"""


@query("agg11_board_values", f"{W(O)}, {CURRENT}, {VALUES} SELECT * FROM v")
def board_values(spark, d):
    return boards.board_values(obs(spark, d), *lens.BOARDS)


@query("srt2_hunter_directory", f"""{W(E, P, O)}, {METRICS}, {CURRENT}, {VALUES},
gk AS (SELECT lower(guild_abbreviation) AS gkey, id AS guild_id FROM participants WHERE participant_type='guild')
SELECT p.id, p.current_name, p.guild_abbreviation, p.city_name, guild_id, total_kills_rank, total_kills_score, unique_kills_rank, unique_kills_score, coalesce(encounters,0) AS encounters, coalesce(wins,0) AS wins,
 coalesce(losses,0) AS losses, win_rate, coalesce(credits_claimed,0) AS credits_claimed, highest_bounty, coalesce(active_days,0) AS active_days, coalesce(unique_targets,0) AS unique_targets, last_active_at
FROM participants p LEFT JOIN m ON hunter_key=lower(p.current_name) LEFT JOIN v ON v.participant_id=p.id LEFT JOIN gk ON gkey=lower(nullif(p.guild_abbreviation,''))
WHERE p.participant_type='player' AND (hunter_key IS NOT NULL OR v.participant_id IS NOT NULL) ORDER BY win_rate DESC NULLS LAST, m.encounters DESC NULLS LAST, p.current_name, p.id LIMIT 40""")
def hunter_directory(spark, d):
    o = obs(spark, d)
    return encounters.hunter_directory(enc(spark, d), par(spark, d), boards.board_values(o, *lens.BOARDS), sort="winRate", page_size=40)


@query("agg12_directory_summary", f"""{W(E, P)} SELECT (SELECT count(DISTINCT lower(hunter_name)) FROM encounters) AS encounter_hunters, (SELECT count(*) FROM participants WHERE participant_type='player' AND lower(current_name) IN (SELECT lower(hunter_name) FROM encounters)) AS matched_hunters""")
def directory_summary(spark, d):
    e = enc(spark, d)
    names = e.select(F.lower("hunter_name").alias("name_key")).distinct()
    p = par(spark, d).filter("participant_type = 'player'").withColumn("name_key", F.lower("current_name"))
    return names.agg(F.count("*").alias("encounter_hunters")).crossJoin(p.join(names, "name_key", "left_semi").agg(F.count("*").alias("matched_hunters")))


@query("agg14_all_time_hunters", f"""{W(E, P, N)} SELECT min(hunter_name) AS hunter_name, count(*) AS encounters, {KILLS} AS wins, {FAILS} AS losses, {PAID} AS credits, any_value(participant_id) AS participant_id
FROM encounters LEFT JOIN player_by_name ON name_key=lower(hunter_name) GROUP BY lower(hunter_name) ORDER BY encounters DESC, wins DESC, hunter_name LIMIT 15""")
def all_time_hunters(spark, d):
    return encounters.hunters(enc(spark, d), par(spark, d)).orderBy(F.desc("encounters"), F.desc("wins"), "hunter_name").limit(15)


@query("agg14_all_time_targets", f"{W(E, P, N)} {TARGETS} FROM encounters LEFT JOIN player_by_name ON name_key=lower(target_name) GROUP BY lower(target_name) ORDER BY targeted DESC, survived DESC, target_name LIMIT 15")
def all_time_targets(spark, d):
    return encounters.targets(enc(spark, d), par(spark, d)).orderBy(F.desc("targeted"), F.desc("survived"), "target_name").limit(15)


@query("agg15_outcome_totals", f"{W(E)} SELECT outcome, count(*) AS encounters, CAST(sum(credits) AS DOUBLE) AS credits FROM encounters GROUP BY 1")
def outcome_totals(spark, d):
    return encounters.outcome_totals(enc(spark, d))


@query("agg24_opponents", f"{W(E)} SELECT lower(target_name) AS opponent_key, min(target_name) AS opponent, count(*) AS encounters, {KILLS} AS kills, {PAID} AS credits FROM encounters WHERE lower(hunter_name)='actor 7' GROUP BY 1 ORDER BY encounters DESC, kills DESC, opponent LIMIT 10")
def opponents(spark, d):
    return encounters.opponents(enc(spark, d), HUNTER)


PAIRS = f"""t AS (SELECT *, least(lower(hunter_name),lower(target_name)) AS side_a_key, greatest(lower(hunter_name),lower(target_name)) AS side_b_key FROM encounters WHERE lower(hunter_name)<>lower(target_name)),
ks AS (SELECT side_a_key, side_b_key, lower(target_name) AS victim, lag(lower(hunter_name)) OVER (PARTITION BY side_a_key, side_b_key ORDER BY event_at, id) AS prev FROM t WHERE outcome='KILL'),
rv AS (SELECT side_a_key, side_b_key, count(*) FILTER (prev=victim) AS revenge_kills FROM ks GROUP BY 1,2),
rr AS (SELECT t.side_a_key, t.side_b_key, min(CASE WHEN lower(hunter_name)=t.side_a_key THEN hunter_name ELSE target_name END) AS side_a_name, min(CASE WHEN lower(hunter_name)=t.side_a_key THEN target_name ELSE hunter_name END) AS side_b_name,
 count(*) AS encounters, count(*) FILTER ((outcome='KILL')=(lower(hunter_name)=t.side_a_key)) AS side_a_wins, count(*) FILTER ((outcome='KILL')=(lower(hunter_name)=t.side_b_key)) AS side_b_wins, {KILLS} AS claims, {PAID} AS credits,
 min(event_at) AS first_event_at, max(event_at) AS last_event_at, coalesce(max(revenge_kills),0) AS revenge_kills FROM t LEFT JOIN rv USING (side_a_key, side_b_key) GROUP BY 1,2)"""


@query("agg17_win1_rivalries", f"{W(E)}, {PAIRS} SELECT * FROM rr")
def rivalry_pairs(spark, d):
    return rivalries.pairs(enc(spark, d))


@query("srt1_rivalry_listing", f"""{W(E, P, N)}, {PAIRS}, pg AS (SELECT * FROM rr WHERE encounters>=2 AND (side_a_name ILIKE '%r 1%' OR side_b_name ILIKE '%r 1%') ORDER BY abs(side_a_wins-side_b_wins), encounters DESC, side_a_key, side_b_key LIMIT 25 OFFSET 25)
SELECT pg.*, a.participant_id AS side_a_participant_id, b.participant_id AS side_b_participant_id FROM pg LEFT JOIN player_by_name a ON a.name_key=side_a_key LEFT JOIN player_by_name b ON b.name_key=side_b_key""")
def rivalry_listing(spark, d):
    return rivalries.listing(enc(spark, d), par(spark, d), q="r 1", sort="closest", page=2)


@query("agg18_rivalry_summary", f"""{W(E)}, {PAIRS} SELECT count(*) FILTER (encounters>=2) AS rivalries, max(encounters) AS most_encounters, CAST(sum(revenge_kills) AS BIGINT) AS revenge_kills,
 CAST(coalesce(max(trunc(epoch(last_event_at)-epoch(first_event_at))) FILTER (encounters>=2),0) AS DOUBLE) AS longest_span_seconds FROM rr""")
def rivalry_summary(spark, d):
    return rivalries.summary(enc(spark, d))


@query("agg23_win2_hunter_rivalries", f"""{W(E, P, N)}, mt AS (SELECT *, CASE WHEN lower(hunter_name)='actor 7' THEN target_name ELSE hunter_name END AS opp, (outcome='KILL' AND lower(hunter_name)='actor 7') AS claim, (outcome='FAILED' AND lower(target_name)='actor 7') AS surv
 FROM encounters WHERE lower(hunter_name)='actor 7' OR lower(target_name)='actor 7'),
ks AS (SELECT lower(opp) AS ok, lower(hunter_name) AS killer, lower(target_name) AS victim, lag(lower(hunter_name)) OVER (PARTITION BY lower(opp) ORDER BY event_at, id) AS prev FROM mt WHERE outcome='KILL'),
rv AS (SELECT ok, count(*) FILTER (killer='actor 7' AND prev=victim) AS revenge_kills FROM ks GROUP BY 1)
SELECT a.*, coalesce(revenge_kills,0) AS revenge_kills, participant_id FROM (SELECT lower(opp) AS opponent_key, min(opp) AS opponent, count(*) AS encounters, count(*) FILTER (claim OR surv) AS wins, count(*) FILTER (NOT (claim OR surv)) AS losses,
 count(*) FILTER (claim) AS claims, count(*) FILTER (surv) AS survivals, CAST(coalesce(sum(credits) FILTER (claim),0) AS DOUBLE) AS credits, min(event_at) AS first_event_at, max(event_at) AS last_event_at, CAST(count(*) FILTER (claim OR surv) AS DOUBLE)/count(*) AS win_rate FROM mt GROUP BY 1) a
LEFT JOIN rv ON ok=opponent_key LEFT JOIN player_by_name ON name_key=opponent_key""")
def hunter_rivalries(spark, d):
    return rivalries.of_hunter(enc(spark, d), HUNTER, par(spark, d))


@query("his4_repeated_rivalries", f"""{W(E)}, mt AS (SELECT CASE WHEN lower(hunter_name)='actor 7' THEN lower(target_name) ELSE lower(hunter_name) END AS opponent_key FROM encounters WHERE lower(hunter_name)='actor 7' OR lower(target_name)='actor 7')
SELECT opponent_key, count(*) AS encounters FROM mt GROUP BY 1 HAVING count(*)>=2 ORDER BY encounters DESC, opponent_key LIMIT 10""")
def repeated_rivalries(spark, d):
    return rivalries.of_hunter(enc(spark, d), HUNTER, par(spark, d)).filter("encounters >= 2").select("opponent_key", "encounters").orderBy(F.desc("encounters"), "opponent_key").limit(10)


ACTIVITY = f"""ga AS (SELECT lower(guild_abbreviation) AS guild_key, count(*) AS roster_size, count(*) FILTER (encounters>0) AS active_hunters, CAST(coalesce(sum(encounters),0) AS BIGINT) AS encounters, CAST(coalesce(sum(wins),0) AS BIGINT) AS wins, CAST(coalesce(sum(losses),0) AS BIGINT) AS losses,
 CAST(coalesce(sum(credits_claimed),0) AS DOUBLE) AS credits, CAST(coalesce(sum(unique_targets),0) AS BIGINT) AS target_observations, max(last_active_at) AS last_active_at FROM player_by_name LEFT JOIN m ON hunter_key=name_key WHERE guild_abbreviation IS NOT NULL GROUP BY 1)"""


@query("agg19_guild_activity", f"{W(E, P, N)}, {METRICS}, {ACTIVITY} SELECT * FROM ga")
def guild_activity(spark, d):
    return guilds.activity(enc(spark, d), par(spark, d))


@query("agg19_guild_directory", f"""{W(E, P, N)}, {METRICS}, {ACTIVITY} SELECT id, current_name, guild_abbreviation, coalesce(roster_size,0) AS roster_size, coalesce(active_hunters,0) AS active_hunters, coalesce(encounters,0) AS encounters, coalesce(wins,0) AS wins, coalesce(losses,0) AS losses,
 CASE WHEN encounters>0 THEN CAST(wins AS DOUBLE)/encounters END AS win_rate, coalesce(credits,0) AS credits, last_active_at FROM participants LEFT JOIN ga ON guild_key=lower(guild_abbreviation) WHERE participant_type='guild'""")
def guild_directory(spark, d):
    return guilds.directory(enc(spark, d), par(spark, d))


@query("agg20_guild_summary", f"{W(E, P, N)}, {METRICS}, {ACTIVITY} SELECT count(*) AS guilds, CAST(sum(roster_size) AS BIGINT) AS rostered_hunters, CAST(sum(active_hunters) AS BIGINT) AS active_hunters, CAST(sum(wins) AS BIGINT) AS claims, sum(credits) AS credits FROM ga")
def guild_summary(spark, d):
    return guilds.summary(enc(spark, d), par(spark, d))


@query("agg21_guild_roster", f"""{W(E, P)}, {METRICS} SELECT id, current_name, city_name, coalesce(encounters,0) AS encounters, coalesce(wins,0) AS wins, coalesce(losses,0) AS losses, coalesce(credits_claimed,0) AS credits, last_active_at
FROM participants LEFT JOIN m ON hunter_key=lower(current_name) WHERE participant_type='player' AND lower(nullif(guild_abbreviation,''))='nation_3'""")
def guild_roster(spark, d):
    return guilds.roster(enc(spark, d), par(spark, d), GUILD)


@query("agg21_guild_daily", f"""{W(E, P)} SELECT CAST(event_at::DATE AS VARCHAR) AS day, count(*) AS encounters, {KILLS} AS wins, {FAILS} AS losses, {PAID} AS credits
FROM encounters JOIN participants ON participant_type='player' AND lower(current_name)=lower(hunter_name) WHERE lower(nullif(guild_abbreviation,''))='nation_3' GROUP BY 1""")
def guild_daily(spark, d):
    return guilds.daily(enc(spark, d), par(spark, d), GUILD)


@query("agg22_jon8_guild_rivals", f"""{W(E, P, N)}, mt AS (SELECT e.*, h.guild_abbreviation AS hg, t.guild_abbreviation AS tg FROM encounters e JOIN player_by_name h ON h.name_key=lower(hunter_name) JOIN player_by_name t ON t.name_key=lower(target_name)
 WHERE lower(h.guild_abbreviation)<>lower(t.guild_abbreviation) AND (lower(h.guild_abbreviation)='nation_3' OR lower(t.guild_abbreviation)='nation_3')),
rs AS (SELECT CASE WHEN lower(hg)='nation_3' THEN tg ELSE hg END AS og, ((outcome='KILL' AND lower(hg)='nation_3') OR (outcome='FAILED' AND lower(tg)='nation_3')) AS won, event_at FROM mt)
SELECT g.id AS guild_id, min(og) AS opponent_guild, count(*) AS encounters, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, min(event_at) AS first_event_at, max(event_at) AS last_event_at
FROM rs LEFT JOIN participants g ON g.participant_type='guild' AND lower(g.guild_abbreviation)=lower(og) GROUP BY lower(og), g.id""")
def guild_rivals(spark, d):
    return guilds.rivals(enc(spark, d), par(spark, d), GUILD)


HEADS = """heads AS (SELECT leaderboard_id, snapshot_id FROM (SELECT DISTINCT leaderboard_id, snapshot_id, observed_at, source_period_key, starts_at FROM observations) WHERE {0} QUALIFY row_number() OVER (PARTITION BY leaderboard_id ORDER BY observed_at DESC, snapshot_id)=1)"""


@query("lst1_latest_top5", f"{W(O)}, {HEADS.format(chr(39).join(['source_period_key=', 'CURRENT', '']))} SELECT leaderboard_id, rank, score, participant_id FROM observations WHERE snapshot_id IN (SELECT snapshot_id FROM heads) AND rank<=5")
def latest_top5(spark, d):
    return boards.newest_snapshots(obs(spark, d), ["leaderboard_id"], F.col("source_period_key") == "CURRENT").filter("rank <= 5").select("leaderboard_id", "rank", "score", "participant_id")


@query("lst3_cycle_leaders", f"{W(O, P)}, {HEADS.format(chr(39).join(['starts_at=TIMESTAMP ', '2000-03-01', '']))} SELECT leaderboard_id, observed_at, score, id AS participant_id, current_name FROM observations JOIN participants ON id=participant_id WHERE snapshot_id IN (SELECT snapshot_id FROM heads) AND rank=1")
def cycle_leaders(spark, d):
    start = F.lit(dt.datetime(2000, 3, 1)).cast("timestamp_ntz")
    rows = boards.newest_snapshots(obs(spark, d), ["leaderboard_id"], F.col("starts_at") == start).filter("rank = 1")
    return rows.join(par(spark, d), F.col("participant_id") == F.col("id")).select("leaderboard_id", "observed_at", "score", "participant_id", "current_name")


@query("lst4_current_standings", f"{W(O)}, {CURRENT} SELECT leaderboard_id, participant_id, rank, score FROM cur")
def current_standings(spark, d):
    return boards.current_standings(obs(spark, d)).select("leaderboard_id", "participant_id", "rank", "score")


@query("lst5_jon3_newest_identity", f"{W(P, N)} SELECT name_key, participant_id, guild_abbreviation FROM player_by_name")
def newest_identity(spark, d):
    from sparrowlog.functions.latest import players_by_name

    return players_by_name(par(spark, d))


@query("lst11_current_snapshots", f"{W(O)} SELECT leaderboard_id, starts_at, snapshot_id, observed_at FROM (SELECT DISTINCT leaderboard_id, starts_at, snapshot_id, observed_at FROM observations) QUALIFY row_number() OVER (PARTITION BY leaderboard_id, starts_at ORDER BY observed_at DESC, snapshot_id)=1")
def current_snapshots(spark, d):
    return boards.newest_snapshots(obs(spark, d), ["leaderboard_id", "starts_at"]).select("leaderboard_id", "starts_at", "snapshot_id", "observed_at").distinct()


@query("lst13_newest_period", f"{W(O)} SELECT leaderboard_id, starts_at, observed_at, rank, score FROM observations WHERE participant_id='p7' QUALIFY row_number() OVER (PARTITION BY leaderboard_id ORDER BY starts_at DESC, observed_at DESC, snapshot_id)=1")
def newest_period(spark, d):
    return boards.newest_period(obs(spark, d), PLAYER)


@query("lst14_current_cycle", f"{W(O)} SELECT starts_at, ends_at FROM observations WHERE source_period_key='CURRENT' ORDER BY observed_at DESC, snapshot_id DESC LIMIT 1")
def current_cycle(spark, d):
    return boards.current_cycle(obs(spark, d))


@query("jon4_asof_movement", f"""{W(O)} SELECT a.snapshot_id, a.participant_id, a.rank, a.score, b.rank AS previous_rank, b.score AS previous_score FROM observations a
ASOF LEFT JOIN observations b ON a.leaderboard_id=b.leaderboard_id AND a.starts_at=b.starts_at AND a.participant_id=b.participant_id AND a.observed_at>b.observed_at""")
def movement(spark, d):
    return boards.movement(obs(spark, d)).select("snapshot_id", "participant_id", "rank", "score", "previous_rank", "previous_score")


@query("lst12_leaderboard", f"""{W(O, P)}, h AS (SELECT snapshot_id, observed_at FROM observations WHERE leaderboard_id='2-HIGH' AND source_period_key='ARCHIVE' ORDER BY observed_at DESC, snapshot_id DESC LIMIT 1)
SELECT a.rank, a.score, a.participant_id, current_name, guild_abbreviation, city_name, b.rank AS previous_rank, b.score AS previous_score FROM observations a JOIN h USING (snapshot_id) JOIN participants ON id=a.participant_id
ASOF LEFT JOIN observations b ON a.leaderboard_id=b.leaderboard_id AND a.starts_at=b.starts_at AND a.participant_id=b.participant_id AND a.observed_at>b.observed_at""")
def leaderboard(spark, d):
    return boards.leaderboard(obs(spark, d), par(spark, d), "2-HIGH", "ARCHIVE")


@query("agg5_cycle_catalogue", f"{W(O)} SELECT starts_at, ends_at, string_agg(DISTINCT source_period_key, ',' ORDER BY source_period_key) AS source_period_keys, max(observed_at) AS verified_at FROM observations GROUP BY 1,2")
def cycle_catalogue(spark, d):
    return boards.cycles(obs(spark, d)).withColumn("source_period_keys", F.array_join("source_period_keys", ","))


STANDINGS = """st AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY leaderboard_id) AS best_rank, row_number() OVER (PARTITION BY leaderboard_id, starts_at ORDER BY observed_at DESC, snapshot_id) AS rn FROM observations WHERE participant_id='p7') WHERE rn=1 ORDER BY leaderboard_id, starts_at DESC LIMIT 24)"""


@query("win3_win4_standings", f"{W(O)}, {STANDINGS} SELECT leaderboard_id, starts_at, ends_at, source_period_key, rank, score, total_score, CASE WHEN total_score>0 THEN score/total_score END AS share, best_rank FROM st")
def standings(spark, d):
    return boards.standings(obs(spark, d), PLAYER)


@query("win9_trends", f"""{W(O)}, {STANDINGS}, tr AS (SELECT leaderboard_id, starts_at, rank, lead(rank) OVER (PARTITION BY leaderboard_id ORDER BY starts_at DESC) AS previous_rank FROM st)
SELECT *, previous_rank-rank AS delta, CASE WHEN previous_rank>rank THEN 'up' WHEN previous_rank<rank THEN 'down' WHEN previous_rank=rank THEN 'same' END AS trend FROM tr""")
def trends(spark, d):
    return boards.trends(boards.standings(obs(spark, d), PLAYER)).select("leaderboard_id", "starts_at", "rank", "previous_rank", "delta", "trend")


@query("his1_contemporaneous", f"{W(O)} SELECT leaderboard_id, count(*) AS n, count(DISTINCT participant_id) AS players FROM observations WHERE observed_at>=starts_at AND observed_at<ends_at GROUP BY 1")
def contemporaneous(spark, d):
    return boards.contemporaneous(obs(spark, d)).groupBy("leaderboard_id").agg(F.count("*").alias("n"), F.count_distinct("participant_id").alias("players"))


@query("his2_rank_history", f"""{W(O)} SELECT CAST(observed_at::DATE AS VARCHAR) AS day, max(rank) FILTER (leaderboard_id='1-URGENT') AS "1-URGENT", max(rank) FILTER (leaderboard_id='2-HIGH') AS "2-HIGH" FROM observations
WHERE participant_id='p7' AND observed_at>=starts_at AND observed_at<ends_at GROUP BY 1""")
def rank_history(spark, d):
    return boards.rank_history(obs(spark, d), PLAYER, list(lens.BOARDS))


@query("his3_compare_players", f"{W(E)}, {METRICS} SELECT hunter_key, encounters, wins, losses, credits_claimed, unique_targets FROM m WHERE hunter_key IN ('actor 1','actor 2','actor 3','actor 4','actor 5')")
def compare_players(spark, d):
    names = [f"actor {i}" for i in range(1, 6)]
    e = enc(spark, d).filter(F.lower("hunter_name").isin(names))
    return encounters.hunter_metrics(e).select("hunter_key", "encounters", "wins", "losses", "credits_claimed", "unique_targets")


MINE = "mine AS (SELECT * FROM sales WHERE user_id='u3')"
LOCAL = "CAST(timezone('America/New_York', timezone('UTC', occurred_at)) AS DATE)"


@query("agg26_sales_windows", f"""{W(S)}, {MINE} SELECT count(*) FILTER (occurred_at>=TIMESTAMP '2001-07-15' AND occurred_at<TIMESTAMP '2001-07-16') AS today_sales, CAST(coalesce(sum(credits) FILTER (occurred_at>=TIMESTAMP '2001-07-15' AND occurred_at<TIMESTAMP '2001-07-16'),0) AS DOUBLE) AS today_credits,
 count(*) FILTER (occurred_at>=TIMESTAMP '2001-07-08 09:30:00') AS week_sales, CAST(coalesce(sum(credits) FILTER (occurred_at>=TIMESTAMP '2001-07-08 09:30:00'),0) AS DOUBLE) AS week_credits,
 count(*) FILTER (occurred_at>=TIMESTAMP '2001-06-15 09:30:00') AS month_sales, CAST(coalesce(sum(credits) FILTER (occurred_at>=TIMESTAMP '2001-06-15 09:30:00'),0) AS DOUBLE) AS month_credits,
 count(*) AS total_sales, CAST(coalesce(sum(credits),0) AS DOUBLE) AS total_credits, coalesce(avg(credits),0) AS average_credits, CAST(coalesce(max(credits),0) AS DOUBLE) AS best_credits FROM mine""")
def sales_windows(spark, d):
    return sales.windows(account(spark, d), SALES_AS_OF)


@query("agg27_top_items", f"{W(S)}, {MINE} SELECT item_name, count(*) AS sales, CAST(sum(credits) AS DOUBLE) AS credits FROM mine WHERE occurred_at>=TIMESTAMP '2001-06-15 09:30:00' GROUP BY 1 ORDER BY credits DESC, item_name LIMIT 10")
def top_items(spark, d):
    return sales.top_items(account(spark, d), SALES_AS_OF)


@query("agg28_sales_calendar", f"""{W(S)}, {MINE} SELECT CAST(g.day::DATE AS VARCHAR) AS day, count(id) AS sales, CAST(coalesce(sum(credits),0) AS DOUBLE) AS credits
FROM (SELECT unnest(generate_series(DATE '2001-07-02', DATE '2001-07-15', INTERVAL 1 DAY)) AS day) g LEFT JOIN mine ON (occurred_at - INTERVAL 4 HOUR)::DATE=g.day::DATE GROUP BY 1""")
def sales_calendar(spark, d):
    return sales.daily(account(spark, d), SALES_AS_OF, ZONE)


@query("agg29_purchase_windows", f"""{W(S)}, {MINE} SELECT count(*) FILTER (occurred_at>=TIMESTAMP '2001-06-15 09:30:00') AS month_purchases, CAST(coalesce(sum(credits) FILTER (occurred_at>=TIMESTAMP '2001-06-15 09:30:00'),0) AS DOUBLE) AS month_spent,
 count(*) AS total_purchases, CAST(coalesce(sum(credits),0) AS DOUBLE) AS total_spent FROM mine""")
def purchase_windows(spark, d):
    return sales.purchases(account(spark, d), SALES_AS_OF)


@query("agg30_top_customers", f"{W(S)}, {MINE} SELECT buyer, count(*) AS purchases, CAST(sum(credits) AS DOUBLE) AS credits, max(occurred_at) AS last_purchase FROM mine WHERE buyer<>'' GROUP BY 1 ORDER BY credits DESC, buyer LIMIT 10")
def top_customers(spark, d):
    return sales.customers(account(spark, d), 10).select("buyer", "purchases", "credits", "last_purchase")


@query("agg30_characters", f"{W(S)} SELECT DISTINCT character_name FROM sales WHERE user_id='u3' AND character_name<>''")
def characters(spark, d):
    return sales.characters(account(spark, d))


@query("agg31_customer_ledger", f"""{W(S)}, {MINE} SELECT buyer, count(*) AS purchases, CAST(sum(credits) AS DOUBLE) AS credits, CAST(max(credits) AS DOUBLE) AS best, min(occurred_at) AS first_purchase, max(occurred_at) AS last_purchase,
 first(item_name ORDER BY mine.credits DESC, item_name DESC) AS top_item FROM mine WHERE buyer<>'' GROUP BY 1 ORDER BY credits DESC, buyer LIMIT 200""")
def customer_ledger(spark, d):
    return sales.customers(account(spark, d))


@query("txt10_recent_sales", f"{W(S)} SELECT * FROM sales WHERE user_id='u3' AND character_name='Trader 3' ORDER BY occurred_at DESC, id DESC LIMIT 50")
def recent_sales(spark, d):
    return sales.recent(sales.of_account(lens.sales(spark, d), USER, "Trader 3"))


ENTITIES = f"""{W(P)}, c AS (SELECT * FROM participants WHERE current_name ILIKE '%or 1%' OR guild_abbreviation ILIKE '%or 1%' OR city_name ILIKE '%or 1%'),
tg AS (SELECT id, (SELECT list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(current_name),'[^a-z0-9]+'), lambda w: w<>''), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ', i, 3)))))) AS g FROM c),
q AS (SELECT ['  a',' ac','act','cto','tor','or ','  1',' 12','12 '] AS g)
SELECT c.id, c.participant_type, c.current_name, CAST(len(list_intersect(tg.g, q.g)) AS DOUBLE)/len(list_distinct(list_concat(tg.g, q.g))) AS relevance FROM c JOIN tg USING (id), q ORDER BY relevance DESC, current_name, c.id LIMIT 50"""


@query("str6_entity_search", ENTITIES)
def entity_search(spark, d):
    p = par(spark, d).filter(tx.contains_ci(F.col("current_name"), "or 1") | tx.contains_ci(F.col("guild_abbreviation"), "or 1") | tx.contains_ci(F.col("city_name"), "or 1"))
    rows = p.select("id", "participant_type", "current_name", tx.similarity(F.col("current_name"), F.lit("Actor 12")).alias("relevance"))
    return rows.orderBy(F.desc("relevance"), "current_name", "id").limit(50)


MATCHES = """WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w<>'') AS w FROM conversations)
SELECT conv_id, turn FROM t WHERE (list_contains(w,'the') AND NOT list_contains(w,'of') AND contains(' '||array_to_string(w,' ')||' ', ' in the ')) OR (list_contains(w,'que'))"""


@query("str7_full_text", MATCHES)
def full_text(spark, d):
    c = lens.table(spark, d, "conversations")
    return c.filter(tx.matches(tx.tokens(F.col("text")), 'the -of "in the" or que')).select("conv_id", "turn")


@query("str6_indexed_search", ENTITIES)
def indexed_search(spark, d):
    """The same by trigram postings, which two calls wrote."""
    fields, path, p = ["current_name", "guild_abbreviation", "city_name"], export.shared(spark, "trigrams"), par(spark, d)
    for part in (p.filter(F.crc32("id") % 2 == 0), p):
        text_index.extend_trigrams(path, part, "id", fields)
    found = text_index.search_part(spark, path, p.schema, "id", fields, "or 1")
    near = text_index.similar_to(spark, path, p.schema, "id", "current_name", "Actor 12", 1e-9)
    rows = found.join(near, "id", "left").select("id", "participant_type", "current_name", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    return rows.orderBy(F.desc("relevance"), "current_name", "id").limit(50)


@query("str7_indexed_text", MATCHES)
def indexed_text(spark, d):
    """The same by postings of words with their places, which two calls wrote."""
    c = lens.table(spark, d, "conversations").select(F.concat_ws("|", "conv_id", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.md5(F.col("text").cast("binary"))).alias("key"), "conv_id", "turn", "text")
    path = export.shared(spark, "words")
    for part in (c.filter("conv_id % 2 = 0"), c):
        text_index.extend_words(path, part, "key", "text")
    found = text_index.search_words(spark, path, c.schema, "key", 'the -of "in the" or que')
    # rows that are alike in all three are one in the index and as many in the result
    return c.join(found.select("key"), "key", "left_semi").select("conv_id", "turn")
