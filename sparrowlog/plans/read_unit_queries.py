"""Queries of single predicates, projections, joins, sorts and set operations of the read layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparrowlog.functions import latest, numbers
from sparrowlog.functions import text as tx
from sparrowlog.operators import boards, encounters, merge, rivalries, sales
from sparrowlog.plans import lens
from sparrowlog.plans.ingest_queries import NTZ, sync_items
from sparrowlog.plans.read_queries import AS_OF, END, HUNTER, PLAYER, START, USER, ZONE, E, N, O, P, S, W, account, enc, obs, par
from sparrowlog.plans.register import query

Filter = encounters.EncounterFilter
SALES_AS_OF = dt.datetime(2001, 7, 15, 9, 30)


def union(frames):
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


FILTERS = {
    "none": (Filter(), "true"), "q": (Filter(q=" ACTOR 1 "), "(hunter_name ILIKE '%actor 1%' OR target_name ILIKE '%actor 1%')"), "outcome": (Filter(outcome="FAILED"), "outcome='FAILED'"),
    "least": (Filter(min_credits=5000), "credits>=5000"), "most": (Filter(max_credits=5000), "credits<=5000"), "from": (Filter(from_day="2024-01-10"), "event_at>=TIMESTAMP '2024-01-10'"),
    "both": (Filter(q="%7", min_credits=1, to_day="2024-01-20"), "(hunter_name ILIKE '%%7%' OR target_name ILIKE '%%7%') AND credits>=1 AND event_at<TIMESTAMP '2024-01-21'"),
}


@query("flt1_filter_builder", f"{W(E)} " + " UNION ALL ".join(f"SELECT '{k}' AS given, count(*) AS n FROM encounters WHERE {sql}" for k, (_, sql) in FILTERS.items()))
def filter_builder(spark, d):
    return union([enc(spark, d).filter(f.column()).agg(F.count("*").alias("n")).select(F.lit(k).alias("given"), "n") for k, (f, _) in FILTERS.items()])


@query("flt2_substring", r"SELECT c_custkey FROM customer WHERE c_name ILIKE '%ER#00_%7%' OR c_mktsegment ILIKE '%mach%' OR c_name ILIKE '%\\%'")
def substring(spark, d):
    c = lens.table(spark, d, "customer")
    return c.filter(tx.contains_ci(F.col("c_name"), "er#00_%7") | tx.contains_ci(F.col("c_mktsegment"), "MACH") | tx.contains_ci(F.col("c_name"), "\\")).select("c_custkey")


@query("flt3_str1_name_equality", f"{W(P)} SELECT id, lower(current_name) AS name_key FROM participants WHERE lower(current_name)='actor 7'")
def name_equality(spark, d):
    return par(spark, d).filter(tx.name_key(F.col("current_name")) == "ACTOR 7".lower()).select("id", tx.name_key(F.col("current_name")).alias("name_key"))


@query("flt4_half_open_range", f"{W(E)} SELECT id, event_at FROM encounters WHERE event_at>=TIMESTAMP '2024-01-08' AND event_at<TIMESTAMP '2024-01-15'")
def half_open(spark, d):
    return encounters.within(enc(spark, d), START, END).select("id", "event_at")


@query("flt5_zone_day_bounds", f"{W(E)} SELECT id FROM encounters WHERE event_at>=TIMESTAMP '2024-01-09 05:00:00' AND event_at<TIMESTAMP '2024-01-13 05:00:00'")
def day_bounds(spark, d):
    return enc(spark, d).filter(Filter(from_day="2024-01-09", to_day="2024-01-12", zone=ZONE).column()).select("id")


@query("flt6_flt11_unknown_zone_and_bad_dates", f"{W(E)} SELECT id FROM encounters WHERE event_at<TIMESTAMP '2024-01-13'")
def unknown_zone(spark, d):
    return enc(spark, d).filter(Filter(from_day="2024-13-40", to_day="2024-01-12", zone="Mars/Base").column()).select("id")


@query("flt7_rolling_windows", f"{W(E)} " + " UNION ALL ".join(f"SELECT {n} AS days, count(*) AS encounters FROM encounters WHERE event_at>=TIMESTAMP '2024-01-20 12:00:00'-INTERVAL {n} DAY" for n in (1, 7, 30)))
def rolling(spark, d):
    return union([merge.retained(enc(spark, d), "event_at", AS_OF, n).agg(F.count("*").alias("encounters")).select(F.lit(n).alias("days"), "encounters") for n in (1, 7, 30)])


@query("flt8_jon1_board_members", f"{W(O, P)} SELECT leaderboard_id, guild_abbreviation, count(*) AS entries, count(DISTINCT current_name) AS names FROM observations o JOIN participants p ON p.id=o.participant_id WHERE leaderboard_id IN ('1-URGENT','5-LOW') GROUP BY 1,2")
def board_members(spark, d):
    rows = boards.members_of_boards(obs(spark, d), par(spark, d), ["1-URGENT", "5-LOW"])
    return rows.groupBy("leaderboard_id", "guild_abbreviation").agg(F.count("*").alias("entries"), F.count_distinct("current_name").alias("names"))


@query("flt9_optional_since", """WITH l AS (SELECT event_type AS store, user_id%30 AS item_id, ts AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id%30 ORDER BY ts DESC)=1) SELECT * FROM l ORDER BY updated_at, store, item_id LIMIT 2000""")
def optional_since(spark, d):
    rows = latest.latest_per_key(sync_items(spark, d), ["store", "item_id"], [F.desc("updated_at")])
    return merge.changed_since(rows, None).select("store", "item_id", "updated_at")


@query("flt10_null_safe_compare", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey, 'other' FROM customer WHERE c_custkey%5=0")
def null_safe(spark, d):
    c = lens.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    other = c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("other").alias("segment"))
    return merge.merge_archive(c, c.unionByName(other), ["c_custkey", "segment"])


@query("flt11_uuid_guard", """SELECT event_id, event_id%4=0 AS ok FROM events""")
def uuid_guard(spark, d):
    x = F.lpad(F.hex("event_id"), 8, "0")
    k = F.col("event_id") % 4
    tail = F.when(k == 0, "-12aB-4000-8fff-0123456789ab").when(k == 1, "-12ab-9000-8fff-0123456789ab").when(k == 2, "-12ab-4000-8fff-0123456789ab ").otherwise("-12ab4000-8fff-0123456789ab")
    return lens.table(spark, d, "events").select("event_id", numbers.is_uuid(F.concat(x, tail)).alias("ok"))


@query("flt12_enum_guard", """WITH r AS (SELECT CASE event_id%4 WHEN 0 THEN 'KILL' WHEN 1 THEN 'FAILED' WHEN 2 THEN lower('KILL') ELSE event_type END AS outcome FROM events) SELECT outcome, outcome IN ('KILL','FAILED') AS allowed, count(*) AS requests FROM r GROUP BY 1,2""")
def enum_guard(spark, d):
    """Outcomes that requests ask for; the words asked for are few, and each is tried on the filter."""
    n = F.col("event_id") % 4
    asked = lens.table(spark, d, "events").select(F.when(n == 0, "KILL").when(n == 1, "FAILED").when(n == 2, "kill").otherwise(F.col("event_type")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("requests"))

    def allowed(x):
        try:
            Filter(outcome=x).column()
        except ValueError:
            return False
        return True

    good = [x.outcome for x in asked.select("outcome").collect() if allowed(x.outcome)]
    return asked.select("outcome", F.col("outcome").isin(*good).alias("allowed"), "requests")


@query("prj1_cnd1_conditional_values", f"{W(E)} SELECT id, outcome='KILL' AS killed, outcome='FAILED' AS failed, CASE WHEN outcome='KILL' THEN credits END AS claimed FROM encounters")
def conditional(spark, d):
    return enc(spark, d).select("id", encounters.kill().alias("killed"), encounters.failed().alias("failed"), F.when(encounters.kill(), F.col("credits")).alias("claimed"))


@query("prj2_mth1_ratios", "SELECT user_id, CASE WHEN count(*) FILTER (event_type='view')>0 THEN count(*) FILTER (event_type='click')::DOUBLE/count(*) FILTER (event_type='view') END AS ratio, greatest(1, CAST(ceil(count(*)/25.0) AS BIGINT)) AS pages, abs(count(*) FILTER (event_type='click')-count(*) FILTER (event_type='view')) AS gap, round(avg(value)) AS mean FROM events GROUP BY 1")
def ratios(spark, d):
    """The mean is that of doubles added in the table's order, as the SQL adds them; where no order shows after rounding, nothing is sorted."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    x, e = F.col("value"), lens.table(spark, d, "events")
    by_user = e.groupBy("user_id").agg(numbers.safe_ratio(n("click"), n("view")).alias("ratio"), numbers.pages(F.count("*"), 25).alias("pages"), F.abs(n("click") - n("view")).alias("gap"), numbers.exact_mean(x).alias("exact"))
    near = e.groupBy("user_id").agg(numbers.near_half(x).alias("near")).filter("near").select(F.col("user_id").alias("near_id"))
    rows = e.select("user_id", "value", "_metadata.file_path", "_metadata.row_index")
    added = numbers.means_in_order(rows.join(near, F.col("user_id").eqNullSafe(F.col("near_id")), "left_semi"), "user_id", "value", "file_path", "row_index")
    added = added.select(F.col("user_id").alias("near_id"), "mean")
    return by_user.join(added, F.col("user_id").eqNullSafe(F.col("near_id")), "left").select("user_id", "ratio", "pages", "gap", F.round(F.coalesce("mean", "exact")).alias("mean"))


@query("prj3_name_defaults", f"{W(P, N)} SELECT * EXCLUDE (current_name) FROM player_by_name")
def name_defaults(spark, d):
    return latest.players_by_name(par(spark, d))


@query("jon2_players_with_metrics", f"{W(E, P)} SELECT p.id, coalesce(m.n,0) AS encounters FROM participants p LEFT JOIN (SELECT lower(hunter_name) AS k, count(*) AS n FROM encounters GROUP BY 1) m ON m.k=lower(p.current_name) WHERE participant_type='player'")
def players_with_metrics(spark, d):
    p = par(spark, d).filter("participant_type = 'player'")
    return p.join(encounters.hunter_metrics(enc(spark, d)), F.lower("current_name") == F.col("hunter_key"), "left").select("id", F.coalesce("encounters", F.lit(0)).alias("encounters"))


@query("jon6_without_a_cycle", f"{W(E)}, a AS (SELECT lower(hunter_name) AS hunter_key, 1 AS e FROM encounters UNION ALL SELECT lower(target_name), 0 FROM encounters) SELECT hunter_key, NULL::TIMESTAMP AS cycle_starts_at, 0 AS cycle_encounters, CAST(sum(e) AS BIGINT) AS overall_encounters FROM a GROUP BY 1")
def without_cycle(spark, d):
    none = spark.createDataFrame([], "starts_at timestamp_ntz, ends_at timestamp_ntz")
    return encounters.hunter_stats(enc(spark, d), none).select("hunter_key", "cycle_starts_at", "cycle_encounters", "overall_encounters")


WEEKS = "(SELECT TIMESTAMP '2023-12-31 06:00:00'+to_days(CAST(7*i AS INTEGER)) AS starts_at, TIMESTAMP '2024-01-07 06:00:00'+to_days(CAST(7*i AS INTEGER)) AS ends_at FROM range(0,9) t(i))"


@query("jon7_interval_membership", f"{W(E)} SELECT w.starts_at, w.ends_at, count(e.id) AS encounters, count(*) FILTER (outcome='KILL') AS claims, CAST(coalesce(sum(credits) FILTER (outcome='KILL'),0) AS DOUBLE) AS credits FROM {WEEKS} w LEFT JOIN encounters e ON event_at>=starts_at AND event_at<ends_at GROUP BY 1,2")
def interval_membership(spark, d):
    first = dt.datetime(2023, 12, 31, 6)
    weeks = spark.createDataFrame([(first + dt.timedelta(7 * i), first + dt.timedelta(7 * i + 7)) for i in range(9)], "starts_at timestamp_ntz, ends_at timestamp_ntz")
    return encounters.per_cycle(enc(spark, d), weeks)


@query("jon10_without_parent", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')")
def without_parent(spark, d):
    return merge.dangling(lens.table(spark, d, "customer"), "c_custkey", lens.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), "o_custkey").select("c_custkey")


@query("jon11_missing_rows", "SELECT o.o_custkey, min(o.o_orderkey) AS first_order FROM orders o LEFT JOIN customer c ON c.c_custkey=o.o_custkey AND c_custkey%2=0 WHERE c.c_custkey IS NULL GROUP BY 1")
def missing_rows(spark, d):
    old = lens.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = merge.insert_if_absent(old, lens.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")])
    return rows.select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("jon12_two_keys", """WITH g AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1,2) SELECT user_id, event_type, CASE WHEN event_type='view' THEN n+1 ELSE n END AS n, CASE WHEN event_type='view' AND user_id%2=0 THEN 0 ELSE top END AS top FROM g""")
def two_keys(spark, d):
    g = lens.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    new = g.filter("event_type = 'view'").select("user_id", "event_type", (F.col("n") + 1).alias("n"), F.when(F.col("user_id") % 2 == 0, 0.0).alias("top"))
    return merge.upsert(g, new, ["user_id", "event_type"])


CALENDAR = "(SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-01-05', INTERVAL 1 DAY)) AS DATE) AS day)"


@query("jon13_src12_zero_filled_days", f"{W(E)} SELECT CAST(c.day AS VARCHAR) AS day, count(e.id) AS encounters FROM {CALENDAR} c LEFT JOIN encounters e ON e.event_at::DATE=c.day GROUP BY 1")
def zero_filled(spark, d):
    return encounters.cycle_daily(enc(spark, d), dt.datetime(2023, 12, 28), dt.datetime(2024, 1, 6), AS_OF).select("day", "encounters")


@query("src12_calendar", "SELECT event_type AS kind, CAST(unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY 1")
def calendar(spark, d):
    """The days between the first and the last event of each kind."""
    spans = lens.table(spark, d, "events").groupBy("event_type").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b")).collect()
    return union([latest.days(spark, F.lit(x.a), F.lit(x.b)).select(F.lit(x.event_type).alias("kind"), "day") for x in spans])


@query("src13_one_row_seed", "SELECT (SELECT max(ts) FROM events WHERE event_type='view') AS last_view, (SELECT max(ts) FROM events WHERE event_type='none') AS last_none, (SELECT count(*) FROM orders WHERE o_orderkey<0) AS orders")
def seed(spark, d):
    e = lens.table(spark, d, "events")
    newest = lambda t, name: e.filter(F.col("event_type") == t).orderBy(F.desc("ts")).limit(1).select(F.col("ts").alias(name))
    rows = spark.range(1).join(F.broadcast(newest("view", "last_view")), F.lit(True), "left").join(F.broadcast(newest("none", "last_none")), F.lit(True), "left")
    return rows.join(F.broadcast(lens.table(spark, d, "orders").filter("o_orderkey < 0").agg(F.count("*").alias("orders"))), F.lit(True), "left").drop("id")


@query("jon15_fan_out", f"{W(E, P)} SELECT p.id, count(*) AS encounters, count(*) FILTER (outcome='KILL') AS kills FROM encounters e JOIN participants p ON lower(p.current_name)=lower(e.hunter_name) WHERE p.guild_abbreviation<>'' GROUP BY 1")
def fan_out(spark, d):
    p = par(spark, d).filter("guild_abbreviation <> ''")
    return enc(spark, d).join(p, F.lower("hunter_name") == F.lower("current_name")).groupBy(p["id"]).agg(F.count("*").alias("encounters"), F.count_if(encounters.kill()).alias("kills"))


@query("jon16_names_asked_for", f"{W(E)}, n(name) AS (VALUES (' ACTOR 7 '), ('actor 12'), ('nobody'), ('')) SELECT n.name, m.n AS encounters, m.k AS wins FROM n LEFT JOIN (SELECT lower(hunter_name) AS h, count(*) AS n, count(*) FILTER (outcome='KILL') AS k FROM encounters GROUP BY 1) m ON m.h=lower(trim(n.name))")
def names_asked(spark, d):
    return encounters.of_names(enc(spark, d), spark.createDataFrame([(" ACTOR 7 ",), ("actor 12",), ("nobody",), ("",)], "name string"))


@query("win6_revenge_fold", f"""{W(E)}, m AS (SELECT *, CASE WHEN lower(hunter_name)='{HUNTER}' THEN lower(target_name) ELSE lower(hunter_name) END AS opponent FROM encounters WHERE outcome='KILL' AND (lower(hunter_name)='{HUNTER}')<>(lower(target_name)='{HUNTER}')),
l AS (SELECT *, lag(lower(hunter_name)) OVER (PARTITION BY opponent ORDER BY event_at, id) AS before FROM m) SELECT opponent AS opponent_key, count(*) FILTER (lower(hunter_name)='{HUNTER}' AND before=opponent) AS revenge_kills FROM l GROUP BY 1""")
def revenge_fold(spark, d):
    """The fold over a hunter's kills in order, by opponent, as an aggregate of ordered structs."""
    me = enc(spark, d).filter(encounters.kill()).select(F.lower("hunter_name").alias("h"), F.lower("target_name").alias("t"), "event_at", "id").filter((F.col("h") == HUNTER) != (F.col("t") == HUNTER))
    return rivalries.revenge_counts(me.select(F.when(F.col("h") == HUNTER, F.col("t")).otherwise(F.col("h")).alias("opponent_key"), (F.col("h") == HUNTER).alias("mine"), "event_at", "id"))


@query("srt3_top_k", f"{W(E)} SELECT lower(target_name) AS target_key, count(*) AS n FROM encounters GROUP BY 1 ORDER BY n DESC, target_key LIMIT 15")
def top_k(spark, d):
    return enc(spark, d).groupBy(F.lower("target_name").alias("target_key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_key").limit(15)


@query("srt4_top_of_each_board", f"""{W(O)}, h AS (SELECT leaderboard_id, arg_max(snapshot_id, observed_at) AS snapshot_id FROM observations GROUP BY 1)
SELECT o.leaderboard_id, o.rank, o.participant_id FROM observations o JOIN h USING (leaderboard_id, snapshot_id) WHERE o.rank<=3""")
def top_of_each(spark, d):
    return boards.newest_snapshots(obs(spark, d), ["leaderboard_id"]).filter("rank <= 3").select("leaderboard_id", "rank", "participant_id")


@query("srt6_caps", f"""{W(O, S)} SELECT 'standings' AS list, least(24, (SELECT count(*) FROM (SELECT DISTINCT leaderboard_id, starts_at FROM observations WHERE participant_id='{PLAYER}'))) AS n UNION ALL SELECT 'customers', least(200, (SELECT count(DISTINCT buyer) FROM sales WHERE user_id='{USER}' AND buyer<>'')) UNION ALL SELECT 'recent', least(50, (SELECT count(*) FROM sales WHERE user_id='{USER}')) UNION ALL SELECT 'recent 10', least(10, (SELECT count(*) FROM sales WHERE user_id='{USER}'))""")
def caps(spark, d):
    lists = {"standings": boards.standings(obs(spark, d), PLAYER), "customers": sales.customers(account(spark, d)), "recent": sales.recent(account(spark, d)), "recent 10": sales.recent(account(spark, d), n=10)}
    return union([x.agg(F.count("*").alias("n")).select(F.lit(k).alias("list"), "n") for k, x in lists.items()])


@query("srt7_by_expression", f"""{W(E)}, p AS (SELECT least(lower(hunter_name),lower(target_name)) AS side_a_key, greatest(lower(hunter_name),lower(target_name)) AS side_b_key, (outcome='KILL')=(lower(hunter_name)<=lower(target_name)) AS a FROM encounters WHERE lower(hunter_name)<>lower(target_name)),
g AS (SELECT side_a_key, side_b_key, count(*) AS encounters, count(*) FILTER (a) AS side_a_wins, count(*) FILTER (NOT a) AS side_b_wins FROM p GROUP BY 1,2) SELECT side_a_key, side_b_key, side_a_wins, side_b_wins FROM g ORDER BY abs(side_a_wins-side_b_wins), encounters DESC, side_a_key, side_b_key LIMIT 40""")
def by_expression(spark, d):
    rows = rivalries.pairs(enc(spark, d)).withColumn("gap", F.abs(F.col("side_a_wins") - F.col("side_b_wins")))
    return rows.orderBy("gap", F.desc("encounters"), "side_a_key", "side_b_key").limit(40).select("side_a_key", "side_b_key", "side_a_wins", "side_b_wins")


@query("set1_both_roles", f"{W(E)} SELECT lower(hunter_name) AS hunter_key, event_at, (outcome='FAILED')::INT AS death FROM encounters UNION ALL SELECT lower(target_name), event_at, (outcome='KILL')::INT FROM encounters")
def both_roles(spark, d):
    return encounters.actor_events(enc(spark, d)).select("hunter_key", "event_at", F.col("death").cast("int").alias("death"))


@query("set2_all_names", f"{W(E)} SELECT count(*) AS names FROM (SELECT lower(hunter_name) FROM encounters UNION SELECT lower(target_name) FROM encounters)")
def all_names(spark, d):
    return encounters.archive_totals(enc(spark, d), AS_OF).select(F.col("unique_names").alias("names"))


@query("set3_characters", f"{W(S)} SELECT DISTINCT character_name FROM sales WHERE user_id='{USER}'")
def characters(spark, d):
    return sales.characters(account(spark, d))


@query("arr1_jsn1_elements", """SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k, len(json_keys(props)) AS keys, event_type IN ('view','click') AS common FROM events""")
def elements(spark, d):
    kinds = F.array(F.lit("view"), F.lit("click"))
    k = F.element_at(F.from_json("props", "map<string,string>"), "k").cast("int")
    return lens.table(spark, d, "events").select("event_id", k.alias("k"), F.size(F.json_object_keys("props")).alias("keys"), F.array_contains(kinds, F.col("event_type")).alias("common"))


@query("dat1_days", "SELECT event_id, CAST(ts::DATE AS VARCHAR) AS day, date_trunc('day', ts) AS midnight FROM events")
def whole_days(spark, d):
    return lens.table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), F.date_trunc("day", F.col("ts")).cast(NTZ).alias("midnight"))


@query("dat2_zones", f"SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::DATE AS day, (TIMESTAMP '2024-03-11' AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS summer, (TIMESTAMP '2024-03-10' AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS winter FROM events")
def zones(spark, d):
    return lens.table(spark, d, "events").select("event_id", latest.local_day(F.col("ts"), ZONE).alias("day"), latest.day_start("2024-03-11", ZONE).alias("summer"), latest.day_start("2024-03-10", ZONE).alias("winter"))


@query("dat3_spans", "SELECT user_id, CAST(epoch(max(ts)-min(ts)) AS BIGINT) AS seconds, max(ts)-INTERVAL 14 DAY AS cut FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def spans(spark, d):
    e = lens.table(spark, d, "events").withColumn("ts", F.date_trunc("second", F.col("ts")).cast(NTZ))
    return e.groupBy("user_id").agg(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"), (F.max("ts") - F.expr("INTERVAL 14 DAY")).alias("cut"))


@query("dat4_clocks", "SELECT event_id, CASE WHEN event_id%3=2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def clocks(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    given = F.when(F.col("event_id") % 3 == 0, seconds).when(F.col("event_id") % 3 == 1, seconds * 1000).otherwise(-seconds)
    return lens.table(spark, d, "events").select("event_id", latest.epoch_clock(given).cast(NTZ).alias("at"))


@query("dat5_iso_instants", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def iso_instants(spark, d):
    from sparrowlog.operators.contracts import STAMP
    from sparrowlog.operators.ingest import instant

    east = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    text = F.when(F.col("event_id") % 2 == 0, east).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return lens.table(spark, d, "events").withColumn("text", text).filter(F.col("text").rlike(STAMP)).select("event_id", instant(F.col("text")).cast(NTZ).alias("at"))
