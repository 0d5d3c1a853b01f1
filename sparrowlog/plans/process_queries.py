"""Queries of the payload processors, the outcome of requests, repairs, exports and report labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparrowlog.operators import contracts, ingest, mail, process
from sparrowlog.plans import lens
from sparrowlog.plans.ingest_queries import NTZ, E, S, W, combat_lines, events, mails
from sparrowlog.plans.register import query
from sparrowlog.sources import export

O = "observations"
CUT = dt.datetime(2024, 1, 20)


def as_json(*columns):
    """An object of the columns that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def nothing(*names):
    return [F.lit(None).cast("string").alias(n) for n in names]


def fetched():
    return F.lit("2024-01-20T12:00:00Z").alias("fetchedAt")


def valid(rows, kind):
    """Rows of (payload, ...) whose payload breaks no rule."""
    return contracts.validate(rows, kind).filter(F.size("issues") == 0)


def catalogs(spark, d):
    """Boards from parts and a catalogue for each: one in three renamed, one in five new, some of a category not tracked."""
    p = lens.spread(lens.table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("t"), "p_partkey").alias("tracker_oid"), F.col("p_type").alias("category"), F.lit("RAW").alias("value_type"), "p_partkey")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))
    board = F.struct("id", F.col("tracker_oid").alias("trackerOid"), name.alias("name"), "category", F.col("value_type").alias("valueType"), F.lit(1).alias("periodStartTime"), F.lit(2).alias("periodEndTime"))
    return p.filter("p_partkey % 5 <> 0").drop("p_partkey"), p.select(F.to_json(F.struct(F.array(board).alias("boards"), fetched())).alias("payload"))


TRACKED = ["ECONOMY", "STANDARD", "PROMO"]
IS_TRACKED = f"p_type IN ({', '.join(map(repr, TRACKED))})"


@query("prc1_catalog", f"""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey%3=0 AND {IS_TRACKED} THEN 'new '||p_name ELSE p_name END AS name, 't'||p_partkey AS tracker_oid, p_type AS category, 'RAW' AS value_type FROM part WHERE p_partkey%5<>0 OR {IS_TRACKED}""")
def catalog(spark, d):
    known, payloads = catalogs(spark, d)
    return process.catalog(known, valid(payloads, "catalog"), TRACKED)[0]


@query("prc1_catalog_revisions", f"SELECT CAST(p_partkey AS VARCHAR) AS id, 'name' AS field, p_name AS old_value, 'new '||p_name AS new_value FROM part WHERE p_partkey%5<>0 AND p_partkey%3=0 AND {IS_TRACKED}")
def catalog_revisions(spark, d):
    known, payloads = catalogs(spark, d)
    return process.catalog(known, valid(payloads, "catalog"), TRACKED)[1]


def board_states(spark, d):
    """Archived entries (first two weeks), and later ones that come twice, the second time an hour later with the same state."""
    rows = lens.observations(spark, d).withColumn("subject", F.lit("player")).withColumn("state_hash", F.sha2("snapshot_id", 256)).withColumn("score_raw", F.col("score").cast("decimal(18,2)").cast("string"))
    rows = rows.withColumn("is_new", F.substring_index("snapshot_id", "|", -1).cast("int") > 2)
    again = F.when(F.col("is_new"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("again", F.explode(again)).withColumn("observed_at", F.when(F.col("again") == 1, F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("observed_at"))).drop("again")


@query("prc2_snapshots", f"{W(O)} SELECT leaderboard_id, starts_at, observed_at, participant_id, rank FROM observations WHERE CAST(split_part(snapshot_id,'|',3) AS INT)>2")
def board_snapshots(spark, d):
    return process.fresh_states(board_states(spark, d), process.STATE).filter("is_new").select("leaderboard_id", "starts_at", "observed_at", "participant_id", "rank")


@query("prc2_entry_revisions", f"""{W(O)}, s AS (SELECT *, CAST(CAST(score AS DECIMAL(18,2)) AS VARCHAR) AS score_raw, dense_rank() OVER (PARTITION BY leaderboard_id, starts_at ORDER BY observed_at) AS n FROM observations WHERE source_period_key<>'CURRENT'),
 b AS (SELECT y.leaderboard_id, y.starts_at, y.participant_id, y.observed_at, x.rank AS r0, y.rank AS r1, x.score_raw AS s0, y.score_raw AS s1 FROM s x JOIN s y ON x.leaderboard_id=y.leaderboard_id AND x.starts_at=y.starts_at AND x.participant_id=y.participant_id AND y.n=x.n+1 WHERE CAST(split_part(y.snapshot_id,'|',3) AS INT)>2)
SELECT leaderboard_id, starts_at, participant_id, observed_at, 'rank' AS field, CAST(r0 AS VARCHAR) AS old_value, CAST(r1 AS VARCHAR) AS new_value FROM b WHERE r0<>r1 UNION ALL SELECT leaderboard_id, starts_at, participant_id, observed_at, 'score_raw', s0, s1 FROM b WHERE s0<>s1""")
def entry_revisions(spark, d):
    return process.entry_revisions(process.fresh_states(board_states(spark, d), process.STATE), ["rank", "score_raw"]).drop("subject", "ends_at")


def bounties(spark, d):
    """A payload for each encounter, with its hunter and target."""
    e, won = lens.spread(lens.encounters(spark, d), "id"), (F.col("outcome") == "KILL").cast("long")
    one = F.struct(F.date_format("event_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "outcome", F.col("hunter_name").alias("hunterName"), F.col("target_name").alias("targetName"), "credits")
    count = lambda n: F.lit(n).cast("long")
    summary = F.struct(won.alias("kills"), (1 - won).alias("failures"), count(1).alias("encounters"), won.cast("double").alias("successRate"), F.col("credits").alias("creditsPaid"), F.col("credits").cast("double").alias("averageBounty"), count(1).alias("distinctHunters"), count(1).alias("distinctTargets"), F.when(won == 1, one).alias("largestBounty"))
    hunter = F.struct(F.lit(1).alias("rank"), F.col("hunter_name").alias("name"), won.alias("kills"), (1 - won).alias("failures"), count(1).alias("encounters"), won.cast("double").alias("successRate"), F.col("credits").alias("creditsEarned"))
    target = F.struct(F.lit(1).alias("rank"), F.col("target_name").alias("name"), won.alias("timesKilled"), (1 - won).alias("timesSurvived"), count(1).alias("encounters"), (1 - won).cast("double").alias("survivalRate"))
    parts = [summary.alias("summary"), F.array(hunter).alias("hunters"), F.array(target).alias("targets"), F.filter(F.array(target), lambda _: won == 0).alias("survivors"), F.array(one).alias("recent")]
    return e.select("event_at", as_json(F.lit(14).alias("windowDays"), fetched(), *parts).alias("payload"))


@query("prc3_bounty_encounters", f"{W(E)} SELECT DISTINCT date_trunc('millisecond', event_at) AS event_at, outcome, hunter_name, target_name, credits FROM encounters WHERE event_at>=TIMESTAMP '2024-01-20'")
def bounty_encounters(spark, d):
    rows = bounties(spark, d)
    known = ingest.encounters_of(valid(rows.filter(F.col("event_at") < F.lit(CUT).cast(NTZ)), "bounty"), "archive")
    return process.bounty(known, valid(rows, "bounty"), "archive").select(F.col("event_at").cast(NTZ).alias("event_at"), "outcome", "hunter_name", "target_name", "credits")


@query("prc3_bounty_aggregates", f"""{W(E)}, s AS (SELECT DISTINCT credits, outcome, hunter_name, target_name, CASE WHEN outcome='KILL' THEN date_trunc('millisecond', event_at) END AS at FROM encounters)
SELECT credits AS credits_paid, (outcome='KILL')::BIGINT AS kills, hunter_name AS hunter, target_name AS target, CASE WHEN outcome='KILL' THEN 0 ELSE 1 END AS survivors, count(*) AS states FROM s GROUP BY 1,2,3,4,5""")
def bounty_aggregates(spark, d):
    """States differ if only a hunter or a target does; the events of failures, which the state doesn't name, make none."""
    none = spark.createDataFrame([], "state_hash string")
    rows = process.bounty_aggregates(none, valid(bounties(spark, d), "bounty"))
    return rows.groupBy(F.col("summary.creditsPaid").alias("credits_paid"), "summary.kills", F.col("hunters")[0]["name"].alias("hunter"), F.col("targets")[0]["name"].alias("target"), F.size("survivors").alias("survivors")).agg(F.count("*").alias("states"))


@query("prc4_wins", """WITH w AS (SELECT 'guild' AS subject, 'g'||(s_suppkey%40) AS source_participant_id, CAST(s_suppkey%9 AS INT) AS wins, CAST(s_suppkey%7+1 AS INT) AS rank FROM supplier UNION SELECT 'city', 'c'||s_nationkey, CAST(s_suppkey%9 AS INT), CAST(s_suppkey%7+1 AS INT) FROM supplier)
SELECT DISTINCT 'board' AS leaderboard_id, w.* FROM w EXCEPT SELECT 'board', 'guild', 'g'||(s_suppkey%40), CAST(s_suppkey%9 AS INT), CAST(s_suppkey%7+1 AS INT) FROM supplier WHERE s_suppkey%2=0""")
def board_wins(spark, d):
    s = lens.table(spark, d, "supplier")
    entry = lambda who: F.array(F.struct((F.col("s_suppkey") % 7 + 1).cast("int").alias("rank"), who.alias("participantId"), F.lit("n").alias("name"), (F.col("s_suppkey") % 9).cast("int").alias("wins"), *nothing("guildAbbreviation", "faction", "planet")))
    guilds, cities = entry(F.concat(F.lit("g"), F.col("s_suppkey") % 40)).alias("guildWins"), entry(F.concat(F.lit("c"), "s_nationkey")).alias("cityWins")
    none = F.array().cast("array<struct<rank:int,participantId:string,name:string,wins:int>>").alias("cityWins")
    payload = lambda rows, city: valid(rows.select(as_json(F.lit("board").alias("id"), city, guilds, fetched()).alias("payload")), "wins")
    return process.wins(ingest.wins_of(payload(s.filter("s_suppkey % 2 = 0"), none)), payload(s, cities))


@query("prc5_officers", "SELECT CASE WHEN c_custkey%2=0 THEN 'IMPERIAL' ELSE 'REBEL' END AS faction, CAST(c_custkey AS VARCHAR) AS source_participant_id, c_name AS name, CAST(c_custkey%12+1 AS INT) AS rank_index, CAST(floor(abs(c_acctbal)) AS BIGINT) AS points FROM customer WHERE c_custkey%5<>0")
def officers(spark, d):
    c = lens.spread(lens.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    points = F.floor(F.abs("c_acctbal"))
    one = F.struct(F.col("c_custkey").cast("string").alias("oid"), F.col("c_name").alias("name"), F.lit("f").alias("factionName"), (F.col("c_custkey") % 12 + 1).cast("int").alias("rankIndex"), F.lit("r").alias("rankName"), points.alias("currentGcwPoints"), F.lit(0).alias("currentPvpKills"), points.alias("lifetimeGcwPoints"), F.lit(0).alias("lifetimePvpKills"), *nothing("profession", "guildName", "guildAbbreviation", "residentPlanet", "residentCityName"))
    rows = c.select("c_custkey", as_json(F.when(F.col("c_custkey") % 2 == 0, "IMPERIAL").otherwise("REBEL").alias("faction"), F.array(one).alias("officers"), F.lit(1).alias("totalResults"), fetched()).alias("payload"))
    known = ingest.officers_of(valid(rows.filter("c_custkey % 5 = 0"), "officers"))
    return process.officers(known, valid(rows.unionByName(rows), "officers")).select("faction", "source_participant_id", "name", "rank_index", F.col("current_gcw_points").alias("points"))


@query("prc6_archived", "SELECT event_id, CASE event_id%4 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'REJECTED' ELSE 'PROCESSED' END AS status FROM events")
def archived(spark, d):
    """Every response is archived with its status, whatever became of it."""
    e = lens.spread(events(spark, d).select("event_id", "ts"), "event_id")
    good = F.to_json(F.struct(F.lit("b").alias("id"), F.array().cast("array<int>").alias("cityWins"), F.array().cast("array<int>").alias("guildWins"), fetched()))
    bad = F.to_json(F.struct(F.lit("").alias("id"), fetched()))
    payload = F.when(F.col("event_id") % 4 == 0, "{no json").when(F.col("event_id") % 4 == 1, bad).otherwise(good)
    rows = process.archived(e.select(F.col("event_id").cast("string").alias("source"), payload.alias("payload"), F.col("ts").alias("observed_at")), "wins")
    return rows.select(F.col("source").cast("long").alias("event_id"), "status")


@query("prc6_resolved_errors", """SELECT e.event_id AS id, e.user_id AS source, e.ts AS at, min(s.ts) AS resolved_at FROM events e LEFT JOIN events s ON s.event_type='view' AND s.user_id=e.user_id AND s.ts>e.ts WHERE e.event_type='error' GROUP BY 1,2,3""")
def resolved_errors(spark, d):
    of = lambda kind: events(spark, d).filter(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("ts").alias("at"))
    return process.resolve_errors(of("error"), of("view").drop("id"))


CORPS = """o AS (SELECT 'f'||(c_custkey%2) AS faction, k AS day, c_custkey, lower(n_name) AS guild, CAST((c_custkey+k)%12+1 AS INT) AS rank_index, floor(abs(c_acctbal)) AS points FROM customer JOIN nation ON c_nationkey=n_nationkey, (SELECT unnest([0,1,2]) AS k) WHERE k<2 OR c_custkey%2=0),
 l AS (SELECT o.* FROM o JOIN (SELECT faction, max(day) AS day FROM o GROUP BY 1) USING (faction, day))"""


@query("lst9_officer_corps", f"""WITH {CORPS}, c AS (SELECT guild, count(*) FILTER (rank_index>=7) AS commissioned, count(*) FILTER (rank_index<7) AS enlisted FROM l GROUP BY 1),
 t AS (SELECT guild, CAST(row_number() OVER (PARTITION BY guild ORDER BY rank_index DESC, points DESC, c_custkey) AS INT) AS place, c_custkey AS participant_id, rank_index, CAST(points AS BIGINT) AS points FROM l WHERE rank_index>=7)
SELECT c.guild, commissioned, enlisted, place, participant_id, rank_index, points FROM c LEFT JOIN t ON t.guild=c.guild AND place<=5""")
def officer_corps(spark, d):
    c = lens.table(spark, d, "customer").join(lens.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("k < 2 OR c_custkey % 2 = 0")
    rows = rows.select(F.concat(F.lit("f"), F.col("c_custkey") % 2).alias("faction"), F.col("k").alias("observed_at"), F.col("c_custkey").alias("participant_id"), ((F.col("c_custkey") + F.col("k")) % 12 + 1).cast("int").alias("rank_index"), F.floor(F.abs("c_acctbal")).alias("points"), F.col("n_name").alias("guild"))
    return process.officer_corps(rows)


def mail_archive(spark, d):
    """Mails as an older parser left them: one in three without subject, one in four without time, half of another version."""
    at = F.col("occurred_at").cast("timestamp")
    rows = mails(spark, d, "occurred_at").withColumn("sender", F.lit("Galaxy.auctioner"))
    rows = rows.withColumns({"subject": F.when(F.col("id") % 3 == 0, "").otherwise("Trade"), "sent_at": F.when(F.col("id") % 4 != 0, at), "parser_version": F.when(F.col("id") % 2 == 0, "1").otherwise("2")})
    return rows.drop("occurred_at")


@query("rpr1_reparsed_mails", f"{W(S)} SELECT id, 'Trade' AS subject, occurred_at AS sent_at, id%3=0 OR id%2=0 AS changed FROM sales")
def reparsed_mails(spark, d):
    return process.reparse_mails(mail_archive(spark, d), "2").select("id", "subject", F.col("sent_at").cast(NTZ).alias("sent_at"), "changed")


@query("snk7_rpr1_repaired_dates", f"{W(S)} SELECT id AS mail_id, occurred_at, id%7=0 AS repaired FROM sales WHERE id%2=0")
def repaired_dates(spark, d):
    trades = lens.sales(spark, d).filter("id % 2 = 0").select(F.col("id").alias("mail_id"), F.when(F.col("id") % 7 == 0, F.lit(CUT).cast("timestamp")).otherwise(F.col("occurred_at").cast("timestamp")).alias("occurred_at"))
    rows = process.repair_dates(trades, process.reparse_mails(mail_archive(spark, d).dropDuplicates(["id"]), "2"))
    return rows.select("mail_id", F.col("occurred_at").cast(NTZ).alias("occurred_at"), "repaired")


@query("rpr2_promoted_lines", """SELECT event_id, CASE WHEN event_id%2=0 THEN ts ELSE ts+INTERVAL 1 HOUR END AS occurred_at FROM events WHERE CAST(json_extract_string(props,'$.k') AS INT)%5<4 AND event_id%3<>0""")
def promoted_lines(spark, d):
    """Lines that an older grammar rejected; one in three is among the events already."""
    at = events(spark, d).select("event_id", F.col("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("occurred_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("uploaded_at"))
    rows = combat_lines(spark, d).join(at, "event_id").withColumn("fingerprint", F.sha2(F.col("event_id").cast("string"), 256))
    return process.reparse_combat(rows, rows.filter("event_id % 3 = 0"))[0].select("event_id", "occurred_at")


@query("txt8_mail_upload", f"{W(S)} SELECT CAST(id AS VARCHAR) AS mail_id, id%2=0 AS is_sale, id%2=1 AS is_purchase, occurred_at FROM sales WHERE id%5<>0")
def mail_upload(spark, d):
    """Mails that come twice are archived once; what the archive has gives no trade again."""
    rows = mails(spark, d).withColumn("user_id", F.lit("u1"))
    old = rows.filter("id % 5 = 0").withColumn("fingerprint", ingest.text_hash(F.col("raw")))
    # the two copies of a mail stay in one task, which drops the second before the shuffle
    new = mail.upload(old, rows.select("user_id", "raw", F.explode(F.array(F.lit(0), F.lit(1)))).drop("col"), CUT)
    return new.select("mail_id", F.col("sale").isNotNull().alias("is_sale"), F.col("purchase").isNotNull().alias("is_purchase"), F.col("occurred_at").cast(NTZ).alias("occurred_at"))


@query("his5_report_hunters", f"""{W(E)}, a AS (SELECT lower(hunter_name) AS k, hunter_name AS n, (outcome='KILL')::INT AS k1, (outcome='FAILED')::INT AS f1, 0 AS x1, CASE WHEN outcome='KILL' THEN credits ELSE 0 END AS c1 FROM encounters UNION ALL SELECT lower(target_name), target_name, 0, 0, (outcome='KILL')::INT, 0 FROM encounters)
SELECT min(n) AS name, 'Unaligned' AS guild, CAST(sum(k1) AS BIGINT)||'K' AS kills, CAST(sum(x1) AS BIGINT)||'D · '||CAST(sum(f1) AS BIGINT)||' failed' AS record, format('{{:,}}', CAST(sum(c1) AS BIGINT)) AS credits FROM a GROUP BY k""")
def hunter_labels(spark, d):
    e, won = lens.encounters(spark, d), F.col("outcome") == "KILL"
    zero = F.lit(0)
    own = e.select(F.col("hunter_name"), won.cast("int").alias("k"), (~won).cast("int").alias("f"), zero.alias("x"), F.when(won, F.col("credits")).otherwise(0).alias("c"))
    other = e.select(F.col("target_name").alias("hunter_name"), zero.alias("k"), zero.alias("f"), won.cast("int").alias("x"), zero.cast("long").alias("c"))
    rows = own.unionByName(other).groupBy(F.lower("hunter_name")).agg(F.min("hunter_name").alias("hunter_name"), F.sum("k").alias("kills"), F.sum("f").alias("failures"), F.sum("x").alias("deaths"), F.sum("c").alias("credits"))
    return process.report_hunters(rows.withColumn("guild_abbreviation", F.lit("")))


@query("src14_snk11_export", "SELECT 'orders' AS \"table\", (SELECT count(*) FROM orders) AS rows, true AS ok UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), true")
def exported(spark, d):
    """Two tables exported with a manifest, then read back and held against it."""
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    path = export.shared(spark, "export")
    export.export({t: (lens.table(spark, d, t), k) for t, k in keys.items()}, path)
    return export.verify(spark, path, keys)


@query("snk12_log_records", """SELECT event_id, '{"message":"token=[REDACTED] n='||user_id||'","request":{"body":"[REDACTED]","tries":'||user_id||'},"request_headers":"[REDACTED]","timestamp":"'||strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z","level":"'||CASE WHEN event_type='error' THEN 'error' ELSE 'info' END||'","event":"'||event_type||'","environment":"development","service":"archive"}' AS record FROM events""")
def log_records(spark, d):
    """Contexts with nested secrets, a payload, and a level of their own, which doesn't count."""
    context = F.concat(F.lit('{"request":{"tries":'), "user_id", F.lit(',"body":{"a":1}},"level":"fatal","request_headers":{"Set-Cookie":"a"},"message":"token=abc'), "event_id", F.lit(" n="), "user_id", F.lit('"}'))
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return process.log_records(events(spark, d), level, F.col("event_type"), context, F.col("ts"), service="archive").select("event_id", "record")
