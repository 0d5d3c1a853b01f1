"""Queries of the combat layer: normalised names, fights, actors, sessions and the dating of logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowlog.operators import combat, log_dating
from sparrowlog.plans import lens
from sparrowlog.plans.ingest_queries import NTZ, events
from sparrowlog.plans.register import query
from sparrowlog.sources import export
from sparrowlog.streaming import fights as fight_streams

BEFORE = "ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
TICK = "(flag='periodic' AND source IN (ability, 'Periodic'))"
COMBAT = f"""WITH RECURSIVE k AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events), c AS (SELECT event_id AS id, 'u'||(user_id%20) AS user_id,
 CASE event_type WHEN 'click' THEN 'damage' WHEN 'purchase' THEN 'damage' WHEN 'view' THEN 'heal' WHEN 'error' THEN 'death' ELSE 'avoid' END AS kind,
 CASE WHEN event_type='purchase' AND k%2=0 THEN 'ability'||(k%5) ELSE 'Hero'||(user_id%7) END AS source, CASE WHEN k%3=0 THEN 'A Beast '||(k%9) ELSE 'Foe'||(k%9) END AS target, 'ability'||(k%5) AS ability,
 CAST(round(value*10) AS BIGINT) AS amount, CASE WHEN event_type='purchase' AND k%2=0 THEN 'periodic' WHEN k%10=1 THEN 'crit' ELSE 'hit' END AS flag, ts AS occurred_at FROM k),
n AS (SELECT id, user_id, kind, CASE WHEN kind='damage' AND {TICK} THEN coalesce(
  last_value(CASE WHEN kind='damage' AND NOT {TICK} THEN source END IGNORE NULLS) OVER (PARTITION BY user_id, lower(ability), target {BEFORE}),
  last_value(CASE WHEN kind='damage' AND NOT {TICK} AND flag<>'periodic' THEN source END IGNORE NULLS) OVER (PARTITION BY user_id, target {BEFORE}), '') ELSE source END AS source, target, ability, amount, flag, occurred_at FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS rn FROM n),
w(user_id, rn, anchor, cluster) AS (SELECT user_id, rn, occurred_at, 1 FROM o WHERE rn=1 UNION ALL SELECT o.user_id, o.rn, CASE WHEN o.kind='damage' OR o.occurred_at-w.anchor>INTERVAL 600 SECOND THEN o.occurred_at ELSE w.anchor END, w.cluster+(o.occurred_at-w.anchor>INTERVAL 600 SECOND)::INT FROM w JOIN o ON o.user_id=w.user_id AND o.rn=w.rn+1),
x AS (SELECT o.*, CAST(w.cluster AS BIGINT) AS cluster FROM o JOIN w USING (user_id, rn)),
b AS (SELECT user_id, cluster, target AS boss FROM x WHERE kind='damage' AND target<>'' GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY user_id, cluster ORDER BY target LIKE 'A Beast%' DESC, sum(amount) DESC, min(occurred_at), min(id))=1),
f AS (SELECT user_id, cluster, min(occurred_at) AS start, max(occurred_at) AS "end", coalesce(sum(amount) FILTER (kind='damage'),0)::BIGINT AS total_damage, coalesce(list_sort(list(DISTINCT target) FILTER (kind='death' AND target<>'')), []) AS d, list(target ORDER BY occurred_at, id) FILTER (kind='death' AND target<>'') AS dead FROM x GROUP BY 1,2 HAVING count(*) FILTER (kind='damage')>0),
g AS (SELECT f.*, coalesce(boss,'Unknown') AS title, greatest(1, CAST(round(epoch("end"-start)) AS BIGINT)) AS duration_seconds FROM f LEFT JOIN b USING (user_id, cluster)),
a AS (SELECT user_id, cluster, source AS name, coalesce(sum(amount) FILTER (kind='damage'),0)::BIGINT AS damage, coalesce(max(amount) FILTER (kind='damage'),0) AS max_hit, coalesce(sum(amount) FILTER (kind='heal'),0)::BIGINT AS healing, count(*) FILTER (kind='damage') AS hits, count(*) FILTER (kind='damage' AND flag='crit') AS crits FROM x WHERE source<>'' AND kind IN ('damage','heal') GROUP BY 1,2,3)"""


def clustered(spark, d):
    return combat.clusters(combat.normalise(lens.combat(spark, d)), gap=600)


@query("stm7_win7_normalised_combat", COMBAT + " SELECT * FROM n")
def normalised(spark, d):
    return combat.normalise(lens.combat(spark, d))


@query("stm5_clusters", COMBAT + " SELECT id, user_id, cluster FROM x")
def cluster_numbers(spark, d):
    return clustered(spark, d).select("id", "user_id", "cluster")


@query("stm5_agg35_fights", COMBAT + " SELECT user_id, cluster, start, \"end\", total_damage, coalesce(array_to_string(dead, '|'), '') AS deaths, title, duration_seconds, list_contains(d, title) AS defeated, total_damage/duration_seconds AS group_dps FROM g")
def fights(spark, d):
    return combat.fights(clustered(spark, d)).withColumn("deaths", F.array_join("deaths", "|"))


@query("agg35_actors", COMBAT + " SELECT a.*, CASE WHEN total_damage>0 THEN damage/total_damage ELSE 0.0 END AS share, damage/duration_seconds AS dps FROM a JOIN g USING (user_id, cluster)")
def actors(spark, d):
    rows = clustered(spark, d)
    return combat.with_shares(combat.actors(rows), combat.fights(rows))


SESSIONS = """, s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY cluster) AS session FROM (SELECT *, CASE WHEN start-lag("end") OVER (PARTITION BY user_id ORDER BY cluster)<=INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM g)),
p AS (SELECT s.user_id, s.session, a.name, sum(a.damage) AS damage FROM a JOIN s USING (user_id, cluster) GROUP BY 1,2,3), t AS (SELECT user_id, session, name FROM p QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY damage DESC, name)=1)"""


@query("stm6_agg36_sessions", COMBAT + SESSIONS + """ SELECT s.user_id, CAST(s.session AS BIGINT) AS session, min(start) AS start, max("end") AS "end", sum(total_damage)::BIGINT AS total_damage, count(*) AS encounters, coalesce(any_value(t.name),'') AS top_player FROM s LEFT JOIN t ON t.user_id=s.user_id AND t.session=s.session GROUP BY 1,2""")
def sessions(spark, d):
    rows = clustered(spark, d)
    return combat.sessions(combat.fights(rows), combat.actors(rows), gap=3600)


def streamed(spark, d):
    """Fights and sessions of one stream, to which events come in three parts, out of order by up to two hours; the watermark
    passes the last of them by two events of each user that are no damage."""
    rows = lens.combat(spark, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    key = F.unix_seconds("occurred_at") + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(7200))
    ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    part = F.floor((key - ends.a) * 3 / (ends.b - ends.a + 1)).cast("int")
    last = rows.groupBy("user_id").agg(F.lit(-1).cast("long").alias("id"), F.lit("heal").alias("kind"), *[F.lit("").alias(c) for c in ("source", "target", "ability")], F.lit(0).cast("long").alias("amount"), F.lit("").alias("flag"))
    late = [last.withColumn("occurred_at", F.timestamp_seconds(F.lit(ends.b + n * 10_000_000))) for n in (1, 2)]
    source, table, mark = (export.shared(spark, x) for x in ("fight-events", "fights", "checkpoint"))
    for more in (*[rows.filter(part == i) for i in range(3)], *[x.select(rows.columns) for x in late]):
        more.write.mode("append").parquet(source)
        stream = fight_streams.session_stream(spark.readStream.schema(rows.schema).parquet(source), 600, 3600, "2 hours")
        stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).outputMode("append").start(table, "parquet").awaitTermination()
    return spark.read.schema(fight_streams.OUT).parquet(table).withColumns({c: F.col(c).cast(NTZ) for c in ("start", "end")})


@query("stm5_stm7_streamed_fights", COMBAT + """, q AS (SELECT user_id, cluster, array_to_string(list(target ORDER BY occurred_at, id) FILTER (kind='death' AND target<>''), '|') AS deaths FROM x GROUP BY 1,2), r AS (SELECT user_id, cluster, array_to_string(list(name||':'||damage||':'||max_hit||':'||healing||':'||hits||':'||crits ORDER BY damage DESC, name), '|') AS actors FROM a GROUP BY 1,2)
SELECT g.user_id, start, "end", total_damage, coalesce(q.deaths, '') AS deaths, title, duration_seconds, list_contains(d, title) AS defeated, coalesce(r.actors, '') AS actors FROM g LEFT JOIN q USING (user_id, cluster) LEFT JOIN r USING (user_id, cluster)""")
def streamed_fights(spark, d):
    actors = F.array_join(F.transform("actors", lambda a: F.concat_ws(":", a["name"], *[a[c].cast("string") for c in ("damage", "max_hit", "healing", "hits", "crits")])), "|")
    rows = streamed(spark, d).filter("what = 'fight'")
    return rows.select("user_id", "start", "end", "total_damage", F.array_join("deaths", "|").alias("deaths"), "title", "duration_seconds", "defeated", actors.alias("actors"))


@query("stm6_streamed_sessions", COMBAT + SESSIONS + """ SELECT s.user_id, min(start) AS start, max("end") AS "end", sum(total_damage)::BIGINT AS total_damage, count(*) AS encounters, coalesce(any_value(t.name),'') AS top_player FROM s LEFT JOIN t ON t.user_id=s.user_id AND t.session=s.session GROUP BY s.user_id, s.session""")
def streamed_sessions(spark, d):
    return streamed(spark, d).filter("what = 'session'").select("user_id", "start", "end", "total_damage", "encounters", "top_player")


MODIFIED = dt.datetime(2024, 2, 2, 3)
CLOCK = "CAST(hour(ts)*3600+minute(ts)*60+trunc(second(ts)) AS INTEGER)"
DATED = f"""WITH l AS (SELECT 'f'||(user_id%5) AS file, ts, event_id, {CLOCK} AS clock FROM events), m AS (SELECT file, min(ts)::DATE AS first FROM l GROUP BY 1),
i AS (SELECT *, sum(CASE WHEN clock<before-3600 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ts, event_id) AS day FROM (SELECT *, lag(clock, 1, CASE WHEN file IN ('f0','f1','f2') THEN 0 END) OVER (PARTITION BY file ORDER BY ts, event_id) AS before FROM l)),
d AS (SELECT i.*, CASE WHEN file IN ('f0','f1','f2') THEN first+CAST(day AS INTEGER) ELSE DATE '2024-02-02'-CAST(max(day) OVER (PARTITION BY file)-day AS INTEGER) END AS date FROM i JOIN m USING (file))"""


def log_of_events(spark, d):
    """Logs of five files, each line twice in a row; three of them begin with a login marker at midnight of their first day."""
    by = Window.partitionBy("file").orderBy("ts", "event_id")
    e = events(spark, d).select(F.concat(F.lit("f"), F.col("user_id") % 5).alias("file"), "ts", "event_id").withColumn("n", F.row_number().over(by))
    line = F.concat(F.lit("[Combat]  "), F.date_format("ts", "HH:mm:ss"), F.lit(" X heals Y for "), "event_id", F.lit(" points\r"))
    lines = e.select("file", F.explode(F.array(F.col("n") * 4, F.col("n") * 4 + 2)).alias("line_no"), line.alias("text"))
    first = e.filter(F.col("file").isin("f0", "f1", "f2") & (F.col("n") == 1))
    marker = F.concat(F.lit("Logging In ["), F.date_format("ts", "EEE MMM dd"), F.lit(" 00:00:00 "), F.date_format("ts", "yyyy"), F.lit("]"))
    other = e.select("file", (F.col("n") * 4 + 3).alias("line_no"), F.lit("someone says hello").alias("text"))
    rows = lines.unionByName(first.select("file", F.lit(1).alias("line_no"), marker.alias("text"))).unionByName(other.filter("line_no % 20 = 3"))
    return rows.withColumn("modified_at", F.lit(MODIFIED).cast(NTZ))


@query("stm8_win8_win10_jon17_dat7_dated_lines", DATED + " SELECT file, event_id, clock, date+to_seconds(clock) AS at FROM d")
def dated(spark, d):
    rows = combat.dated_lines(log_of_events(spark, d))
    return rows.select("file", F.regexp_extract("text", r"for (\d+) points", 1).cast("long").alias("event_id"), "clock", F.col("at").cast(NTZ).alias("at"))


@query("stm8_win8_win10_split_logs", DATED + " SELECT file, event_id, clock, date+to_seconds(clock) AS at FROM d")
def split_logs(spark, d):
    """Such logs in parts, each written by one task in the order of its lines and read in byte ranges."""
    top = export.shared(spark, "logs")
    # a file that can't be null: for others the writer sorts once more, by file alone, and lines lose their order
    e = events(spark, d).select(F.coalesce(F.concat(F.lit("f"), F.col("user_id") % 5), F.lit("")).alias("file"), "ts", "event_id")
    line = F.concat(F.lit("[Combat]  "), F.date_format("ts", "HH:mm:ss"), F.lit(" X heals Y for "), "event_id", F.lit(" points\r"))
    texts = F.array(line, line, F.when(F.col("event_id") % 5 == 0, "someone says hello"))
    rows = e.select("*", F.posexplode(texts).alias("i", "text")).filter("text IS NOT NULL")
    first = e.filter("file IN ('f0', 'f1', 'f2')").groupBy("file").agg(F.min(F.struct("ts", "event_id")).alias("e")).select("file", "e.*")
    marker = F.concat(F.lit("Logging In ["), F.date_format("ts", "EEE MMM dd"), F.lit(" 00:00:00 "), F.date_format("ts", "yyyy"), F.lit("]"))
    rows = rows.unionByName(first.select("*", F.lit(-1).alias("i"), marker.alias("text")))
    rows = rows.repartitionByRange("file", "ts", "event_id").sortWithinPartitions("file", "ts", "event_id", "i")
    rows.select("file", "text").write.partitionBy("file").text(top)
    lines = log_dating.log_ranges(spark, top, "*.txt", r"^part-(\d+)").withColumn("modified_at", F.lit(MODIFIED).cast(NTZ))
    out = log_dating.dated_ranges(lines)
    return out.select(F.regexp_extract("file", "file=([^/]+)$", 1).alias("file"), F.regexp_extract("text", r"for (\d+) points", 1).cast("long").alias("event_id"), "clock", F.col("at").cast(NTZ).alias("at"))


@query("win10_repeated_lines", "SELECT user_id, count(*) AS runs FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type GROUP BY 1")
def repeated_lines(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("line_no"), F.col("event_type").alias("text"))
    return combat.without_repeats(rows).groupBy(F.col("file").alias("user_id")).agg(F.count("*").alias("runs"))


@query("win8_day_index", DATED + " SELECT event_id, CAST(day AS BIGINT) AS day FROM d")
def day_index(spark, d):
    e = events(spark, d).select((F.col("user_id") % 5).alias("file"), F.struct("ts", "event_id").alias("line_no"), "event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("clock"))
    return combat.with_day_index(e).select("event_id", F.col("_day").cast("long").alias("day"))


@query("dat6_live_stamps", f"SELECT event_id, TIMESTAMP '2024-01-20 12:00:00'::DATE+to_seconds({CLOCK})-CASE WHEN {CLOCK}>43500 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS at FROM events")
def live_stamps(spark, d):
    line = F.concat(F.lit("[Combat]  "), F.date_format("ts", "HH:mm:ss"), F.lit(" X heals Y for 5 points"))
    return events(spark, d).select("event_id", combat.live_stamp(line, F.lit(dt.datetime(2024, 1, 20, 12)).cast(NTZ)).cast(NTZ).alias("at"))


@query("dat7_login_markers", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def login_markers(spark, d):
    text = F.concat(F.lit("  Logging In ["), F.date_format("ts", "EEE MMM dd  HH:mm:ss yyyy"), F.lit("] done"))
    return events(spark, d).select("event_id", combat.login_marker(text).cast(NTZ).alias("at"))
