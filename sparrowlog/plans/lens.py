"""The driver's tables seen as the canonical frames. Times stay without zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOARDS = ("1-URGENT", "2-HIGH")  # the two boards that stand for total and unique kills


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks by their keys. A small file is read by one task, and what is made of its rows may be a thousand times
    as much; the number is given, as adaptive execution would join the small pieces again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    won = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("event_at"),
        F.when(won, "KILL").otherwise("FAILED").alias("outcome"),
        F.concat(F.lit("Actor "), F.col("user_id")).alias("hunter_name"),
        F.concat(F.lit("Actor "), F.get_json_object("props", "$.k")).alias("target_name"),
        F.when(won, F.round(F.col("value") * 100).cast("long")).otherwise(0).cast("long").alias("credits"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players from customers (names repeat in two cases), guilds from nations, cities from regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_seen_at"))
    name = F.concat(F.lit("Actor "), F.col("c_custkey") % 200)
    players = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.concat(F.lit("p"), "c_custkey").alias("id"),
            F.lit("player").alias("participant_type"),
            F.when(F.col("c_custkey") % 3 == 0, F.upper(name)).otherwise(name).alias("current_name"),
            F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("n_name")).alias("guild_abbreviation"),
            F.col("r_name").alias("city_name"),
            "first_seen_at",
            "last_seen_at",
        )
    )
    none = F.lit(None).cast("timestamp_ntz")
    guilds = nation.select(F.concat(F.lit("g"), "n_nationkey").alias("id"), F.lit("guild").alias("participant_type"), F.concat(F.lit("Guild "), "n_name").alias("current_name"), F.col("n_name").alias("guild_abbreviation"), F.lit(None).cast("string").alias("city_name"), none.alias("first_seen_at"), none.alias("last_seen_at"))
    return players.unionByName(guilds)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of weekly board snapshots with their snapshot and period: cumulative order totals of a customer in a month. Orders
    are dealt by board and period once, before they become several rows each; all that is ranked or compared lies within one."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderpriority").alias("leaderboard_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").cast("timestamp_ntz").alias("starts_at"),
        F.least(F.lit(4), F.floor((F.dayofmonth("o_orderdate") - 1) / 7).cast("int") + 1).alias("week"),
        F.col("o_custkey"),
        "o_totalprice",
    )
    rows = spread(rows, "leaderboard_id", "starts_at").withColumn("total", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("week", F.explode(F.sequence("week", F.lit(4))))
    rows = rows.groupBy("leaderboard_id", "starts_at", "week", "o_custkey").agg(F.sum("total").alias("score")).withColumn("starts_on", F.col("starts_at").cast("date"))
    newest = o.agg(F.add_months(F.trunc(F.max("o_orderdate").cast("date"), "MM"), -1).alias("newest"))  # the last whole month
    snapshot = Window.partitionBy("starts_at", "week", "leaderboard_id")
    # a double is soon compared and in the order of its decimal, which tells equal doubles apart
    place = F.rank().over(snapshot.orderBy(F.desc(F.col("score").cast("double")), F.desc("score")))
    total = F.sum("score").over(snapshot)
    return rows.crossJoin(F.broadcast(newest)).select(
        "leaderboard_id",
        F.when(F.col("starts_on") == F.col("newest"), "CURRENT").otherwise("ARCHIVE").alias("source_period_key"),
        "starts_at",
        F.add_months("starts_on", 1).cast("timestamp_ntz").alias("ends_at"),
        F.concat_ws("|", "leaderboard_id", "starts_on", "week").alias("snapshot_id"),
        F.date_add("starts_on", F.col("week") * 7).cast("timestamp_ntz").alias("observed_at"),
        F.concat(F.lit("p"), "o_custkey").alias("participant_id"),
        place.cast("int").alias("rank"),
        F.col("score").cast("double").alias("score"),
        total.cast("double").alias("total_score"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders. Orders meet their customers before the many lines do, and what a line brings is made before it is shuffled."""
    li, o, p, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "part", "customer"))
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice").cast("long").alias("credits"))
    items = p.select("p_partkey", F.concat_ws(" ", F.col("p_brand"), F.col("p_type")).alias("item_name"))
    buyers = c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_name")).alias("buyer"))
    bought = o.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "buyer", F.col("o_orderdate").alias("occurred_at"))
    return (
        lines.join(items, F.col("l_partkey") == F.col("p_partkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.concat(F.lit("u"), F.col("l_suppkey") % 10).alias("user_id"),
            F.concat(F.lit("Trader "), F.col("l_suppkey") % 40).alias("character_name"),
            "item_name",
            "buyer",
            "credits",
            F.concat(F.lit("Vendor "), "l_suppkey").alias("vendor"),
            "occurred_at",
        )
    )


def combat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combat events of each user; some damage ticks carry their ability as source."""
    kinds = {"click": "damage", "view": "heal", "error": "death", "signup": "avoid", "purchase": "damage"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    tick = (F.col("event_type") == "purchase") & (k % 2 == 0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("user_id"),
        kind.alias("kind"),
        F.when(tick, F.concat(F.lit("ability"), k % 5)).otherwise(F.concat(F.lit("Hero"), F.col("user_id") % 7)).alias("source"),
        F.when(k % 3 == 0, F.concat(F.lit("a Beast "), k % 9)).otherwise(F.concat(F.lit("Foe"), k % 9)).alias("target"),
        F.concat(F.lit("ability"), k % 5).alias("ability"),
        F.round(F.col("value") * 10).cast("long").alias("amount"),
        F.when(tick, "periodic").when(k % 10 == 1, "crit").otherwise("hit").alias("flag"),
        F.col("ts").alias("occurred_at"),
    )


#: The same frames for the SQL checks.
SQL = {
    "encounters": """encounters AS (SELECT event_id AS id, ts AS event_at, CASE WHEN event_type='purchase' THEN 'KILL' ELSE 'FAILED' END AS outcome,
 'Actor '||user_id AS hunter_name, 'Actor '||json_extract_string(props,'$.k') AS target_name,
 CASE WHEN event_type='purchase' THEN CAST(round(value*100) AS BIGINT) ELSE 0 END AS credits FROM events WHERE event_type IN ('purchase','error'))""",
    "participants": """participants AS (SELECT 'p'||c_custkey AS id, 'player' AS participant_type,
 CASE WHEN c_custkey%3=0 THEN upper('Actor '||(c_custkey%200)) ELSE 'Actor '||(c_custkey%200) END AS current_name,
 CASE WHEN c_custkey%7=0 THEN '' ELSE n_name END AS guild_abbreviation, r_name AS city_name, s.first_seen_at, s.last_seen_at
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_seen_at, max(o_orderdate) AS last_seen_at FROM orders GROUP BY 1) s ON s.o_custkey=c_custkey
 UNION ALL SELECT 'g'||n_nationkey,'guild','Guild '||n_name,n_name,NULL,NULL,NULL FROM nation)""",
    "player_by_name": """player_by_name AS (SELECT lower(current_name) AS name_key, id AS participant_id, nullif(guild_abbreviation,'') AS guild_abbreviation, current_name FROM participants
 WHERE participant_type='player' QUALIFY row_number() OVER (PARTITION BY lower(current_name) ORDER BY last_seen_at DESC NULLS LAST, id)=1)""",
    "observations": """weekly AS (SELECT o_orderpriority AS leaderboard_id, date_trunc('month',o_orderdate)::DATE AS starts_on, w.week, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS score
 FROM orders JOIN (SELECT unnest([1,2,3,4]) AS week) w ON w.week>=least(4,(day(o_orderdate)-1)//7+1) GROUP BY 1,2,3,4),
observations AS (SELECT leaderboard_id, CASE WHEN starts_on=(SELECT (date_trunc('month',max(o_orderdate))-INTERVAL 1 MONTH)::DATE FROM orders) THEN 'CURRENT' ELSE 'ARCHIVE' END AS source_period_key,
 starts_on::TIMESTAMP AS starts_at, (starts_on+INTERVAL 1 MONTH)::TIMESTAMP AS ends_at, leaderboard_id||'|'||starts_on||'|'||week AS snapshot_id,
 (starts_on+to_days(CAST(week*7 AS INTEGER)))::TIMESTAMP AS observed_at, 'p'||o_custkey AS participant_id,
 CAST(rank() OVER (PARTITION BY leaderboard_id,starts_on,week ORDER BY score DESC) AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score,
 CAST(sum(score) OVER (PARTITION BY leaderboard_id,starts_on,week) AS DOUBLE) AS total_score FROM weekly)""",
    "sales": """sales AS (SELECT l_orderkey*10+l_linenumber AS id, 'u'||(l_suppkey%10) AS user_id, 'Trader '||(l_suppkey%40) AS character_name, p_brand||' '||p_type AS item_name,
 CASE WHEN c_custkey%50=0 THEN '' ELSE c_name END AS buyer, CAST(round(l_extendedprice) AS BIGINT) AS credits, 'Vendor '||l_suppkey AS vendor, o_orderdate AS occurred_at
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey JOIN customer ON o_custkey=c_custkey)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
