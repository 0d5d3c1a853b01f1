"""Queries of the ingest, merge, text, session and operations layers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparrowlog.functions.latest import latest_per_key
from sparrowlog.operators import combat, ingest, limits, mail, merge
from sparrowlog.plans import lens
from sparrowlog.plans.register import query
from sparrowlog.streaming import live

W, E, P, S = lens.with_, "encounters", "participants", "sales"
AS_OF = dt.datetime(2024, 1, 20, 12)
NTZ = "timestamp_ntz"


def events(spark, d):
    return lens.table(spark, d, "events")


@query("hsh2_content_hash", """SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS content_hash FROM events""")
def content_hash(spark, d):
    return events(spark, d).select("event_id", ingest.content_hash(F.col("props")).alias("content_hash"))


@query("hsh3_encounter_fingerprint", f"""{W(E)} SELECT id, sha256('["archive","'||strftime(event_at,'%Y-%m-%dT%H:%M:%S.%g')||'Z","'||outcome||'","'||hunter_name||'","'||target_name||'",'||credits||']') AS fingerprint FROM encounters""")
def fingerprints(spark, d):
    e = lens.encounters(spark, d)
    return e.select("id", ingest.encounter_fingerprint("archive", F.col("event_at"), F.col("outcome"), F.col("hunter_name"), F.col("target_name"), F.col("credits")).alias("fingerprint"))


@query("hsh5_text_hash", "SELECT doc_id, sha256(replace(text, chr(13)||chr(10), chr(10))) AS fingerprint FROM documents")
def text_hashes(spark, d):
    return lens.table(spark, d, "documents").select("doc_id", ingest.text_hash(F.col("text")).alias("fingerprint"))


def payloads(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    tags = F.when(k == 0, "[]").when(k == 1, '["a",1]').otherwise('[{"x":null}]')
    return events(spark, d).select(F.col("event_id").alias("id"), F.concat(F.lit('{"user":'), "user_id", F.lit(',"tags":'), tags, F.lit("}")).alias("payload"))


CASE = "CASE CAST(json_extract_string(props,'$.k') AS INT)%3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"


@query("sch1_schema_paths", """WITH k AS (SELECT CAST(json_extract_string(props,'$.k') AS INT)%3 AS k FROM events), t(k, path, types) AS (VALUES (0,'$','object'),(0,'$.user','number'),(0,'$.tags','array'),(1,'$','object'),(1,'$.user','number'),(1,'$.tags','array'),(1,'$.tags[]','number|string'),
 (2,'$','object'),(2,'$.user','number'),(2,'$.tags','array'),(2,'$.tags[]','object'),(2,'$.tags[].x','null')) SELECT path, types, count(*) AS payloads FROM k JOIN t USING (k) GROUP BY 1,2""")
def schema_paths(spark, d):
    return ingest.schema_paths(payloads(spark, d), "id", "payload").groupBy("path", F.array_join("types", "|").alias("types")).agg(F.count("*").alias("payloads"))


SHAPES = ["$.tags:array;$.user:number;$:object", "$.tags:array;$.tags[]:number|string;$.user:number;$:object", "$.tags:array;$.tags[].x:null;$.tags[]:object;$.user:number;$:object"]


@query("sch2_sch3_signatures", f"""WITH s AS (SELECT {CASE.format(*[repr(x) for x in SHAPES])} AS shape FROM events) SELECT shape, sha256('["'||replace(shape,';','","')||'"]') AS signature, NOT shape='{SHAPES[0]}' AS comparable, count(*) AS payloads FROM s GROUP BY 1,2,3""")
def signatures(spark, d):
    rows = ingest.payload_signatures(payloads(spark, d), "id", "payload")
    return rows.groupBy(F.array_join("paths", ";").alias("shape"), "signature", "comparable").agg(F.count("*").alias("payloads"))


@query("snk1_insert_if_absent", f"{W(E)} SELECT id, event_at, credits FROM encounters WHERE event_at>=TIMESTAMP '2024-01-20'")
def insert_if_absent(spark, d):
    e = lens.encounters(spark, d)
    old, new = e.filter(F.col("event_at") < F.lit(dt.datetime(2024, 1, 20)).cast(NTZ)), e.unionByName(e.filter("outcome = 'KILL'"))
    return merge.insert_if_absent(old, new, ["id"], [F.asc("event_at")]).select("id", "event_at", "credits")


@query("snk2_upsert", "SELECT c_custkey, CASE WHEN c_custkey%4=0 THEN 'new '||c_name ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey+1000000, s_name, NULL FROM supplier")
def upsert(spark, d):
    c = lens.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    more = lens.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return merge.upsert(c, new.unionByName(more), ["c_custkey"])


@query("snk3_count_upsert", "SELECT event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS occurrences, min(ts)>=TIMESTAMP '2024-01-10' AS is_new FROM events GROUP BY 1")
def count_upsert(spark, d):
    e = events(spark, d)
    cut = F.lit(dt.datetime(2024, 1, 10)).cast(NTZ)
    old = e.filter(F.col("ts") < cut).groupBy("event_type").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("occurrences"))
    return merge.count_upsert(old, e.filter(F.col("ts") >= cut).select("event_type", F.col("ts").alias("at")), ["event_type"])


def sync_items(spark, d):
    return events(spark, d).select(F.col("event_type").alias("store"), (F.col("user_id") % 30).alias("item_id"), F.col("props").alias("payload"), F.col("ts").alias("updated_at"), (F.col("value") < 5).alias("deleted"))


@query("snk4_last_write_wins", """SELECT event_type AS store, user_id%30 AS item_id, props AS payload, ts AS updated_at, value<5 AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id%30 ORDER BY ts DESC)=1""")
def last_write_wins(spark, d):
    rows = sync_items(spark, d)
    old = latest_per_key(rows.filter(F.col("updated_at") < F.lit(AS_OF).cast(NTZ)), ["store", "item_id"], [F.desc("updated_at")])
    return merge.newest_write(old, rows.filter(F.col("updated_at") >= F.lit(AS_OF).cast(NTZ)), ["store", "item_id"])


@query("stm4_changed_since", """WITH l AS (SELECT event_type AS store, user_id%30 AS item_id, props AS payload, ts AS updated_at, value<5 AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id%30 ORDER BY ts DESC)=1)
SELECT * FROM l WHERE updated_at>TIMESTAMP '2024-01-20 12:00:00' ORDER BY updated_at, store, item_id LIMIT 2000""")
def changed_since(spark, d):
    rows = latest_per_key(sync_items(spark, d), ["store", "item_id"], [F.desc("updated_at")])
    return merge.changed_since(rows, AS_OF).select("store", "item_id", "payload", "updated_at", "deleted")


@query("snk5_win5_open_events", """SELECT event_type, user_id AS entity_key, event_id AS id, ts AS detected_at FROM events WHERE value>=20 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC)=1""")
def open_events(spark, d):
    rows = events(spark, d).select("event_type", F.col("user_id").alias("entity_key"), F.col("event_id").alias("id"), F.col("ts").alias("detected_at"), F.when(F.col("value") < 20, F.col("ts")).alias("resolved_at"))
    return merge.open_events(rows).drop("resolved_at")


@query("rev1_revisions", """SELECT c_custkey, 'c_name' AS field, c_name AS old_value, 'x'||c_name AS new_value FROM customer WHERE c_custkey%5=0 UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer WHERE c_custkey%7=0""")
def revisions(spark, d):
    c = lens.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), "c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return merge.revisions(c, new, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("snk9_widen_intervals", """WITH h AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE event_type='view' GROUP BY 1), o AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE event_type='click' GROUP BY 1)
SELECT user_id, least(h.f, o.f) AS first_seen_at, greatest(h.l, o.l) AS last_seen_at FROM h LEFT JOIN o USING (user_id)""")
def widen(spark, d):
    seen = lambda kind: events(spark, d).filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    return merge.widen(seen("view"), seen("click"), ["user_id"], "first_seen_at", "last_seen_at")


@query("snk10_merge_metadata", """SELECT event_id, '{"k":"'||CASE WHEN event_id%2=0 THEN 'new' ELSE json_extract_string(props,'$.k') END||'"'||CASE WHEN event_id%2=0 THEN ',"seen":null' ELSE '' END||CASE WHEN event_id%3=0 THEN ',"status":"idle"' ELSE '' END||'}' AS metadata FROM events""")
def merge_metadata(spark, d):
    e = events(spark, d).select("event_id", F.from_json("props", "map<string,string>").alias("old"))
    k = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("seen"), F.lit(None).cast("string"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    new = F.map_concat(k, F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("status"), F.lit("idle"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")))
    merged = merge.shallow_merge(F.map_filter("old", lambda key, _: key == "k"), new)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    return e.select("event_id", F.to_json(ordered, {"ignoreNullFields": "false"}).alias("metadata"))


@query("jon14_id_map", "SELECT 's'||c_custkey AS source_id, CASE WHEN c_custkey%2=0 THEN 't'||c_custkey ELSE 's'||c_custkey END AS target_id FROM customer")
def id_map(spark, d):
    c = lens.table(spark, d, "customer")
    source = c.select(F.concat(F.lit("s"), "c_custkey").alias("id"), "c_name")
    target = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("t"), "c_custkey").alias("id"), "c_name")
    return merge.id_map(source, target, ["c_name"])


@query("mrg1_merge_archive", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def merge_archive(spark, d):
    o = lens.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target, source = o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <= 1")
    once = merge.merge_archive(target, source, ["o_orderkey", "o_custkey"])
    return merge.merge_archive(once, source, ["o_orderkey", "o_custkey"])


@query("mrg2_dangling", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%10<>0) GROUP BY 1")
def dangling(spark, d):
    parents = lens.table(spark, d, "customer").filter("c_custkey % 10 <> 0")
    return merge.dangling(lens.table(spark, d, "orders"), "o_custkey", parents, "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("flt14_duplicates", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2 HAVING count(*)>1")
def duplicates(spark, d):
    return merge.duplicates(lens.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


FRAME = "CASE WHEN {0} IS NULL THEN '-' ELSE length({0}::VARCHAR)||':'||{0}::VARCHAR END"


@query("agg33_man1_manifest", "WITH h AS (SELECT sha256(" + "||".join(FRAME.format(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")) + """) AS h FROM orders), p AS (SELECT CAST('0x'||substr(h,1,15) AS BIGINT) AS a, CAST('0x'||substr(h,16,15) AS BIGINT) AS b, CAST('0x'||substr(h,31,15) AS BIGINT) AS c, CAST('0x'||substr(h,46,15) AS BIGINT) AS d FROM h)
SELECT count(*) AS rows, concat_ws('-', sum(a), sum(b), sum(c), sum(d)) AS digest FROM p""")
def manifest(spark, d):
    return merge.table_digest(lens.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("agg34_rec1_integrity", f"""{W(E)} SELECT count(*) FILTER (outcome='FAILED' AND credits<>0) AS paid_failures, count(*) FILTER (credits<0) AS negative, (SELECT count(*) FROM (SELECT id FROM encounters GROUP BY 1 HAVING count(*)>1)) AS repeated,
 (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM encounters""")
def integrity(spark, d):
    e = lens.encounters(spark, d)
    row = e.agg(F.count_if((F.col("outcome") == "FAILED") & (F.col("credits") != 0)).alias("paid_failures"), F.count_if(F.col("credits") < 0).alias("negative"))
    orphans = merge.dangling(lens.table(spark, d, "orders"), "o_custkey", lens.table(spark, d, "customer"), "c_custkey").agg(F.count("*").alias("orphans"))
    return row.crossJoin(F.broadcast(merge.duplicates(e, ["id"]).agg(F.count("*").alias("repeated")))).crossJoin(F.broadcast(orphans))


TABLES = "region nation customer supplier part orders lineitem events".split()


@query("agg32_src5_validation", f"{W(E)} SELECT 'encounters' AS name, count(*) AS n FROM encounters UNION ALL SELECT 'ids', count(DISTINCT id) FROM encounters UNION ALL SELECT 'instants', count(DISTINCT event_at) FROM encounters UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) " + "".join(f"UNION ALL SELECT '{t}', count(*) FROM {t} " for t in TABLES))
def validation(spark, d):
    return merge.validation(lens.encounters(spark, d), {t: lens.table(spark, d, t) for t in TABLES}, merge.dangling(lens.table(spark, d, "orders"), "o_custkey", lens.table(spark, d, "customer"), "c_custkey"))


@query("agg16_responses_by_source", "SELECT event_type, count(*) FILTER (value>50) AS responses, max(ts) FILTER (value>50) AS last_response FROM events GROUP BY 1")
def responses(spark, d):
    big = F.col("value") > 50
    return events(spark, d).groupBy("event_type").agg(F.count_if(big).alias("responses"), F.max(F.when(big, F.col("ts"))).alias("last_response"))


@query("jon5_latest_per_source", "SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id)=1")
def latest_per_source(spark, d):
    e = events(spark, d)
    newest = latest_per_key(e, ["event_type"], [F.desc("ts"), F.asc("event_id")]).select("event_type", "event_id", "ts")
    return e.select("event_type").distinct().join(newest, "event_type", "left")


@query("int2_run_status", """WITH r AS (SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, count(*) AS requests, count(*) FILTER (event_type='error') AS failed, count(*) FILTER (value>95) AS partial FROM events GROUP BY 1,2)
SELECT *, CASE WHEN failed>=requests THEN 'FAILED' WHEN failed>0 OR partial>0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM r""")
def run_status(spark, d):
    r = events(spark, d).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 95).alias("partial"))
    return r.withColumn("status", ingest.run_status(F.col("requests"), F.col("failed"), F.col("partial")))


@query("prj4_payload_preview", "SELECT conv_id, turn, left(text,280) AS preview, CAST(strlen(text) AS INTEGER) AS bytes FROM conversations")
def preview(spark, d):
    return lens.table(spark, d, "conversations").select("conv_id", "turn", F.left("text", F.lit(280)).alias("preview"), F.octet_length("text").alias("bytes"))


@query("stm3_incremental", f"""{W(E)} SELECT 'after' AS kind, * FROM (SELECT id, event_at FROM encounters WHERE id>50 ORDER BY id LIMIT 600) UNION ALL SELECT 'seed', id, event_at FROM (SELECT id, event_at FROM encounters WHERE event_at>=TIMESTAMP '2024-01-20 12:00:00'-INTERVAL 86400 SECOND ORDER BY id LIMIT 600)""")
def incremental(spark, d):
    e = lens.encounters(spark, d).select("id", "event_at")
    after, seed = merge.incremental(e, 50, AS_OF), merge.incremental(e, None, AS_OF, seed_seconds=86_400)
    return after.select(F.lit("after").alias("kind"), "*").unionByName(seed.select(F.lit("seed").alias("kind"), "*"))


@query("srt5_capped_tail", f"{W(E)} SELECT * FROM (SELECT id, event_at, credits FROM encounters ORDER BY event_at DESC, id DESC LIMIT 200000) ORDER BY event_at, id")
def capped_tail(spark, d):
    return lens.encounters(spark, d).select("id", "event_at", "credits").orderBy(F.desc("event_at"), F.desc("id")).limit(200_000).orderBy("event_at", "id")


@query("snk8_stm11_retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts>=TIMESTAMP '2024-01-06 12:00:00' GROUP BY 1")
def retention(spark, d):
    return merge.retained(events(spark, d), "ts", AS_OF).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("stm13_rate_limit", """WITH r AS (SELECT 'c'||(user_id%3) AS client, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, CAST(sum(CAST(json_extract_string(props,'$.k') AS INT)) AS BIGINT) AS requests FROM events GROUP BY 1,2) SELECT * FROM r WHERE requests>12""")
def rate_limit(spark, d):
    # each event stands for k requests in its minute, spread over its seconds
    k = F.get_json_object("props", "$.k").cast("int")
    e = events(spark, d).filter(k > 0).select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("client"), F.date_trunc("minute", F.col("ts")).alias("minute"), F.explode(F.sequence(F.lit(1), k)).alias("i"))
    rows = e.select("client", F.timestamp_add("SECOND", F.col("i") % 60, F.col("minute")).cast(NTZ).alias("at"))
    return merge.over_limit(rows, 12).select("client", F.col("minute").cast(NTZ).alias("minute"), "requests")


@query("stm13_anchored_windows", """WITH RECURSIVE o AS (SELECT event_id AS id, 'c'||(user_id%3) AS client, ts, row_number() OVER (PARTITION BY user_id%3 ORDER BY ts, event_id) AS rn FROM events),
w(client, rn, start, n) AS (SELECT client, rn, ts, 1 FROM o WHERE rn=1 UNION ALL SELECT o.client, o.rn, CASE WHEN o.ts>=w.start+INTERVAL 6 HOUR THEN o.ts ELSE w.start END, CASE WHEN o.ts>=w.start+INTERVAL 6 HOUR THEN 1 ELSE w.n+1 END FROM w JOIN o ON o.client=w.client AND o.rn=w.rn+1)
SELECT id, client, start+INTERVAL 6 HOUR AS reset, greatest(0, 12-n)::INT AS remaining, n<=12 AS allowed FROM w JOIN o USING (client, rn)""")
def anchored_windows(spark, d):
    forwarded = F.concat(F.lit("1.2.3.4, c"), F.col("user_id") % 3)
    rows = events(spark, d).select(F.col("event_id").alias("id"), limits.client_of(forwarded, F.lit(None).cast("string")).alias("client"), F.col("ts").alias("at"))
    return limits.rate_windows(rows, 12, 6 * 3600).select("id", "client", F.col("reset").cast(NTZ).alias("reset"), "remaining", "allowed")


@query("stm14_monitor", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) FILTER (event_type='error') AS failures, count(*) AS requests FROM events GROUP BY 1 HAVING count(*) FILTER (event_type='error')>=1")
def monitor(spark, d):
    rows = live.error_monitor(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "error")
    return rows.filter("failures >= 1").select(F.col("window.start").cast(NTZ).alias("start"), "failures", "requests")


@query("ops1_health", """WITH h AS (SELECT user_id, max(ts) AS heartbeat_at, max(ts) FILTER (event_type='view') AS last_completed_at, arg_max(CASE WHEN event_type='error' THEN 'FAILED' WHEN event_type='click' THEN 'PARTIAL' ELSE 'SUCCEEDED' END, ts) AS last_status, user_id%11=0 AS disabled FROM events WHERE ts<=TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id)
SELECT user_id, CASE WHEN disabled THEN 'disabled' WHEN coalesce(last_completed_at, heartbeat_at)<TIMESTAMP '2024-01-19 12:00:00' THEN 'stale' WHEN last_status='FAILED' THEN 'failed' WHEN last_status='PARTIAL' THEN 'degraded' WHEN last_completed_at IS NOT NULL THEN 'healthy' ELSE 'starting' END AS state FROM h""")
def health(spark, d):
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "PARTIAL").otherwise("SUCCEEDED")
    rows = events(spark, d).filter(F.col("ts") <= F.lit(AS_OF).cast(NTZ)).groupBy("user_id").agg(F.max("ts").alias("heartbeat_at"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_completed_at"), F.max_by(status, "ts").alias("last_status"))
    return merge.health(rows.withColumn("disabled", F.col("user_id") % 11 == 0), AS_OF, 86_400).select("user_id", "state")


LINES = """WITH c AS (SELECT event_id, ts, CAST(json_extract_string(props,'$.k') AS INT) AS k, 'Hero'||(user_id%7) AS hero, CAST(round(value*10) AS BIGINT) AS n FROM events)"""


def combat_lines(spark, d):
    k, n = F.get_json_object("props", "$.k").cast("int"), F.round(F.col("value") * 10).cast("long")
    hero, foe = F.concat(F.lit("Hero"), F.col("user_id") % 7), F.concat(F.lit("a Beast "), k % 9)
    stamp = F.concat(F.lit("[Combat]  "), F.date_format("ts", "HH:mm:ss"), F.lit(" "))
    kinds = [F.concat(hero, F.lit(" attacks "), foe, F.lit(" with Power Shot and crits (25% evaded) for "), n, F.lit(" points.")), F.concat(foe, F.lit(" suffers "), n, F.lit(" points of damage from Fire Blanket over time.")), F.concat(hero, F.lit(" heals Hero0 for "), n, F.lit(" points with Bacta")), F.concat(foe, F.lit(" is no more.")), F.concat(hero, F.lit(" says hello there"))]
    text = kinds[4]
    for i in range(3, -1, -1):
        text = F.when(k % 5 == i, kinds[i]).otherwise(text)
    return events(spark, d).select("event_id", F.concat(stamp, text).alias("raw"))


@query("txt1_combat_grammar", LINES + """ SELECT event_id, CAST(hour(ts)*3600+minute(ts)*60+trunc(second(ts)) AS INTEGER) AS clock, CASE k%5 WHEN 2 THEN 'heal' WHEN 3 THEN 'death' ELSE 'damage' END AS kind, CASE k%5 WHEN 0 THEN hero WHEN 1 THEN 'Fire Blanket' WHEN 2 THEN hero ELSE '' END AS source,
 CASE k%5 WHEN 2 THEN 'Hero0' ELSE 'a Beast '||(k%9) END AS target, CASE k%5 WHEN 0 THEN 'Power Shot' WHEN 1 THEN 'Fire Blanket' WHEN 2 THEN 'Bacta' ELSE '' END AS ability, CASE WHEN k%5=3 THEN 0 ELSE n END AS amount, CASE k%5 WHEN 0 THEN 'crit' WHEN 1 THEN 'periodic' ELSE '' END AS flag FROM c WHERE k%5<4""")
def combat_grammar(spark, d):
    return combat.split_upload(combat_lines(spark, d))[0].drop("raw")


@query("txt9_combat_rejects", LINES + " SELECT event_id, '[Combat]  '||strftime(ts,'%H:%M:%S')||' '||hero||' says hello there' AS raw FROM c WHERE k%5=4")
def combat_rejects(spark, d):
    return combat.split_upload(combat_lines(spark, d))[1]


def mails(spark, d, *more):
    s = lens.sales(spark, d)
    item = F.concat(F.lit("["), "item_name", F.lit("]"))
    amount = F.format_number("credits", 0)
    buyer = F.when(F.col("buyer") == "", "Nobody").otherwise(F.col("buyer"))
    sold = F.concat(F.lit("Vendor: "), "vendor", F.lit(" has sold "), item, F.lit(" to "), buyer, F.lit(" for "), amount, F.lit(" credits."))
    bought = F.concat(F.lit("You have won the auction of "), item, F.lit(" from "), buyer, F.lit(" for "), amount, F.lit(" credits."))
    head = F.concat(F.col("id").cast("string"), F.lit("\r\nGalaxy.auctioner\r\nTrade\r\nTIMESTAMP: "), F.unix_timestamp(F.col("occurred_at").cast("timestamp")).cast("string"), F.lit("\r\n\r\n"))
    return s.select("id", F.concat(head, F.when(F.col("id") % 2 == 0, sold).otherwise(bought)).alias("raw"), *more)


@query("txt5_txt6_mail_sales", f"{W(S)} SELECT CAST(id AS VARCHAR) AS mail_id, 'Galaxy.auctioner' AS sender, 'Trade' AS subject, occurred_at, item_name, CASE WHEN buyer='' THEN 'Nobody' ELSE buyer END AS buyer, credits, vendor, 'vendor' AS sale_type FROM sales WHERE id%2=0")
def mail_sales(spark, d):
    rows = mail.trades(mails(spark, d), "sale")
    return rows.select("mail_id", "sender", "subject", F.col("sent_at").cast(NTZ).alias("occurred_at"), "sale.*")


@query("txt7_mail_purchases", f"{W(S)} SELECT CAST(id AS VARCHAR) AS mail_id, item_name, CASE WHEN buyer='' THEN 'Nobody' ELSE buyer END AS seller, credits, 'bazaar' AS purchase_type FROM sales WHERE id%2=1")
def mail_purchases(spark, d):
    return mail.trades(mails(spark, d), "purchase").select("mail_id", "purchase.*")
