"""Combat text to rows, encounters and sessions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sparrowlog.functions.arrays import as_structs
from sparrowlog.functions.text import SPACE, trim_all

# The log's line formats, tried in this order. Fields: kind, pattern, then group numbers (or constants) of
# source, target, ability, amount and flag; the last tells whether unlikely amounts are refused.
HITS = r"(hits|glances|crits|critically\s+hits|critical\s+hits|strikes\s+through|punishing\s+blows)"
EVADED = r"(?:\s*\((\d+)\s*%(?:\s*evaded)?\))?"
STAMP = r"(?iu)^(?:\[\s*Combat\s*\]\s*)?(\d{2}):(\d{2}):(\d{2})\s+"
RULES = [
    ("death", r"^(.+?)\s+is\s+no\s+more\.", "", 1, "", None, "", False),
    ("avoid", r"^(.+?)\s+attacks\s+(.+?)(?:\s+(?:with|using)\s+.+?)?\s+(?:and\s+)?misses\s*\((dodge|parry|parries)\)\.?$", 1, 2, "", None, 3, False),
    ("avoid", r"^(.+?)\s+attacks\s+(.+?)\s+(?:with|using)\s+.*?(?:,?\s+)?(?:but|and)\s+\2\s+(dodges|parries)\b", 1, 2, "", None, 3, False),
    ("avoid", r"^(.+?)\s+attacks\s+(.+?)(?:\s+(?:but|and))\s+\2\s+(dodges|parries)\b", 1, 2, "", None, 3, False),
    ("avoid", r"^(.+?)\s+(dodges|parries)\s+(.+?)'?s?\s+attack\b", 3, 1, "", None, 2, False),
    ("avoid", r"^(.+?)'?s?\s+attack\s+(?:is|was)\s+(dodged|parried)\s+by\s+(.+?)\b", 1, 3, "", None, 2, False),
    ("avoid", r"^(.+?)\s+attacks\s+(.+?)(?:\s+(?:with|using)\s+.+?)?\s+and\s+misses\.?\s*$", 1, 2, "", None, "miss", False),
    ("damage", rf"^(.+?)\s+attacks\s+(.+?)\s+(?:with|using)\s+(.+?)\s+(?:and\s+{HITS})?{EVADED}\s*for\s+(\d+)\s+points", 1, 2, 3, 6, 4, True),
    ("damage", rf"^(.+?)\s+attacks\s+(.+?)(?:\s+and\s+)?(?:{HITS})?{EVADED}\s*for\s+(\d+)\s+points", 1, 2, "attack", 5, 3, True),
    ("damage", r"^(.+?)\s+damages\s+(.+?)\s+for\s+(\d+)\s+points(?:\s+(?:with|using)\s+(.+?))?\.?$", 1, 2, (4, "attack"), 3, "", True),
    ("damage", r"^(.+?)\s+suffers\s+(\d+)\s+points\s+of\s+damage\s+from\s+(.+?)\s+over\s+time", 3, 1, 3, 2, "periodic", False),
    ("damage", r"^(.+?)\s+has\s+caused\s+(.+?)\s+to\s+take\s+(\d+)\s+points\s+of\s+(?:[a-z]+\s+)?damage", 1, 2, "Periodic", 3, "periodic", True),
    ("damage", r"^(.+?)\s+causes\s+(.+?)\s+to\s+take\s+(\d+)\s+points\s+of\s+damage", 1, 2, "Periodic", 3, "periodic", True),
    ("damage", r"^(.+?)\s+has\s+taken\s+(\d+)\s+points\s+of\s+(?:([a-z]+)\s+)?damage", (3, "Periodic"), 1, (3, "Periodic"), 2, "periodic", False),
    ("damage", r"^(.+?)\s+is\s+wracked\s+with\s+crippling\s+pain\s+for\s+(\d+)\s+points", "crippling pain", 1, "crippling pain", 2, "periodic", False),
    ("damage", r"^You\s+are\s+rent\s+by\s+agony\s+sharing\s+(\d+)\s+points", "agony sharing", "You", "agony sharing", 1, "periodic", False),
    ("heal", r"^You\s+have\s+healed\s+(.+?)\s+for\s+(\d+)\s+points", "You", 1, "", 2, "", False),
    ("heal", r"^(.+?)\s+heals\s+(.+?)\s+for\s+(\d+)\s+points(?:\s+with\s+(.+))?", 1, 2, 4, 3, "", False),
    ("utility", r"^(.+?)\s+performs\s+(.+?)\.?\s*$", 1, "", 2, None, "", False),
]
# The words of which a combat line has one, what flags are called, and limits in points and seconds.
WORDS = ("points", "attacks", "damages", "suffers", "heals", "is no more", "misses", "dodg", "parr", "performs", "caused")
FLAGS = {"crits": "crit", "critically hits": "crit", "critical hits": "crit", "hits": "hit", "glances": "glance", "strikes through": "strikethrough"}
LARGEST_HIT, FIGHT_GAP, SESSION_GAP = 60_000, 20, 30 * 60
#: No amount counts for more, so that sums stay in range.
MOST = 10**15


def is_npc(name: Column) -> Column:
    return trim_all(name).rlike(r"(?i)^(?:a|an|the)\s+")


def is_suspect(line: Column) -> Column:
    """Cheap test before the grammar: a stamp and one of the words."""
    low = F.lower(line)
    return line.rlike(STAMP) & F.exists(F.array(*[F.lit(w) for w in WORDS]), lambda w: low.contains(w))


def flag_of(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    out = F.when(low.startswith("dodg"), "dodge").when(low.startswith("parr"), "parry")
    for said, flag in FLAGS.items():
        out = out.when(low == said, flag)
    return out.otherwise("")


MARK = "\u0001"
#: A word without which a rule can't match, so that most rules cost no pattern.
NEEDED = ("more", "misses", "attacks", "attacks", "attack", "attack", "misses", "points", "points", "points", "suffers", "caused", "causes", "taken", "wracked", "agony", "healed", "heals", "performs")
LINE = StructType([StructField("clock", IntegerType()), StructField("kind", StringType()), StructField("source", StringType()), StructField("target", StringType()), StructField("ability", StringType()), StructField("amount", LongType()), StructField("flag", StringType())])
STAMP_OF, NPC = (re.compile(x.removeprefix("(?iu)^").replace(r"\d", "[0-9]"), re.I) for x in (STAMP, r"(?iu)^(?:a|an|the)\s+"))
COMPILED = [(word, kind, re.compile(pattern.replace(r"\d", "[0-9]"), re.I), *rest) for word, (kind, pattern, *rest) in zip(NEEDED, RULES, strict=True)]


def groups_of(text: Column, pattern: str) -> Column:
    """The groups of a pattern that begins a text, the first at place 1, by one evaluation; of size 1 if it does not match."""
    marks = "".join(f"{MARK}${i + 1}" for i in range(re.compile(pattern).groups))
    return F.split(F.regexp_replace(text, "(?iu)" + pattern + ("" if pattern.endswith("$") else r"[\s\S]*$"), marks), MARK)


def said(text: str) -> str:
    """``flag_of`` of one text."""
    low = re.sub(r"\s+", " ", text.lower())
    return "dodge" if low.startswith("dodg") else "parry" if low.startswith("parr") else FLAGS.get(low, "")


def read_line(raw: str | None) -> tuple | None:
    """(clock, kind, source, target, ability, amount, flag) of a line, nothing if it is none. The first rule that matches decides,
    even if it then refuses the line for its amount."""
    stamp = STAMP_OF.match(raw or "")
    if not stamp:
        return None
    clock = int(stamp[1]) * 3600 + int(stamp[2]) * 60 + int(stamp[3])
    rest = raw[stamp.end() :].strip(SPACE)
    low = rest.lower()
    for word, kind, pattern, source, target, ability, amount, flag, guarded in COMPILED:
        m = pattern.match(rest) if word in low else None
        if not m:
            continue

        def part(what, m=m):
            if isinstance(what, str):
                return what
            group, other = what if isinstance(what, tuple) else (what, "")
            return (m[group] or "").strip(SPACE) or other

        points = 0 if amount is None else min(int(m[amount][:18]) if len(m[amount]) <= 18 else MOST, MOST)
        by = part(source)
        if guarded and points > LARGEST_HIT and not NPC.match(by):
            return None
        return clock, kind, by, part(target), part(ability), points, flag if isinstance(flag, str) else said(m[flag] or "")
    return None


@F.arrow_udf(LINE)
def parse(raw: pa.Array) -> pa.Array:
    """struct(clock, kind, source, target, ability, amount, flag) of a line, null if it is none: a small function over Arrow
    batches, as nineteen patterns tried in turn are slower as native expressions, which no code is generated for."""
    return as_structs(list(map(read_line, raw.to_pylist())), LINE)


def split_upload(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (raw, ...) as (events, unparsed, ignored): utility lines are known but not kept."""
    # a generator keeps the filters from repeating the grammar below them
    rows = lines.select("*", F.explode(F.array(parse(F.col("raw")))).alias("c"))
    return rows.filter("c.kind <> 'utility'").select("*", "c.*").drop("c"), rows.filter("c IS NULL").drop("c"), rows.filter("c.kind = 'utility'").drop("c")


def canonical_npc(name: Column) -> Column:
    name = trim_all(name)
    article = F.initcap(F.lower(F.regexp_extract(name, r"(?i)^(a|an|the)\s+", 1)))
    return F.concat(article, F.lit(" "), F.regexp_replace(name, r"(?i)^(a|an|the)\s+", ""))


def normalise(events: DataFrame) -> DataFrame:
    """Names made one (articles, effects and long forms of a known single name), ticks credited to who applied them."""
    order = F.struct("occurred_at", "id")
    ends = events.select("user_id", order.alias("o"), F.posexplode(F.array("source", "target")).alias("place", "name"))
    ends = ends.filter((F.col("name") != "") & ~is_npc(F.col("name")) & ~F.col("name").contains(" "))
    singles = ends.groupBy("user_id", F.lower("name").alias("single")).agg(F.min_by("name", F.struct("o", "place")).alias("known"))
    out = events
    for c in ("source", "target"):
        s = singles.select(F.col("user_id").alias("_u"), F.col("single").alias("_s"), F.col("known").alias("_k"))
        parts = F.split(F.col(c), r"\s+")
        out = out.join(s, (F.col("user_id") == F.col("_u")) & (F.lower(parts[0]) == F.col("_s")), "left")
        effect = (F.size(parts) == 2) & parts[1].startswith("Effect")
        mapped = F.when(F.col(c) == "", F.col(c)).when(is_npc(F.col(c)), canonical_npc(F.col(c))).when(effect, F.coalesce("_k", parts[0])).when(F.size(parts) > 1, F.coalesce("_k", F.col(c))).otherwise(F.col(c))
        out = out.withColumn(f"_{c}", mapped).drop("_u", "_s", "_k")
    damage, tick = F.col("kind") == "damage", (F.col("flag") == "periodic") & ((F.col("source") == F.col("ability")) | (F.col("source") == "Periodic"))
    before = lambda *keys: Window.partitionBy("user_id", *keys).orderBy("occurred_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_spell", F.lower("ability"))
    out = out.withColumn("_caster", F.last(F.when(damage & ~tick, F.col("_source")), True).over(before("_spell", "_target")))
    out = out.withColumn("_hitter", F.last(F.when(damage & ~tick & (F.col("flag") != "periodic"), F.col("_source")), True).over(before("_target")))
    source = F.when(damage & tick, F.coalesce("_caster", "_hitter", F.lit(""))).otherwise(F.col("_source"))
    return out.withColumn("source", source).withColumn("target", F.col("_target")).drop("_source", "_target", "_spell", "_caster", "_hitter")


def clusters(events: DataFrame, gap: int = FIGHT_GAP) -> DataFrame:
    """Adds ``cluster``: a new one begins when the last damage of the cluster, or its first event, is over ``gap`` seconds old.

    An event with damage less than the gap before it never begins one. The others lie in stretches without damage, in which
    the anchor is the stretch's last beginning: only these are folded, one stretch at a time."""
    w = Window.partitionBy("user_id").orderBy("occurred_at", "id")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    damage = F.col("kind") == "damage"
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.withColumn("_at", us("occurred_at")).withColumn("_hit", F.last(F.when(damage, F.col("_at")), True).over(earlier)).withColumn("_stretch", F.coalesce(F.count_if(damage).over(earlier), F.lit(0)))
    loose = rows.filter(F.col("_hit").isNull() | (F.col("_at") - F.col("_hit") > gap * 1_000_000))
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.array().cast("array<bigint>").alias("ids"))
    fold = lambda s, e: F.when(s["anchor"].isNull() | (e["_at"] - s["anchor"] > gap * 1_000_000), F.struct(e["_at"].alias("anchor"), F.concat(s["ids"], F.array(e["id"])).alias("ids"))).otherwise(s)
    first = loose.groupBy("user_id", "_stretch").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("_at", "id"))), start, fold)["ids"].alias("ids"))
    first = first.select(F.col("user_id").alias("_u"), F.explode("ids").alias("_first"))
    rows = rows.join(first, (rows["user_id"] == first["_u"]) & (rows["id"] == first["_first"]), "left")
    return rows.withColumn("cluster", F.count_if(F.col("_first").isNotNull()).over(w)).drop("_at", "_hit", "_stretch", "_u", "_first")


def actors(clustered: DataFrame) -> DataFrame:
    """Roll-up of each source in a cluster."""
    damage, heal = F.col("kind") == "damage", F.col("kind") == "heal"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return clustered.filter((F.col("source") != "") & (damage | heal)).groupBy("user_id", "cluster", F.col("source").alias("name")).agg(
        zero(F.sum(F.when(damage, F.col("amount")))).alias("damage"), zero(F.max(F.when(damage, F.col("amount")))).alias("max_hit"), zero(F.sum(F.when(heal, F.col("amount")))).alias("healing"), F.count_if(damage).alias("hits"), F.count_if(damage & (F.col("flag") == "crit")).alias("crits"),
    )


def with_shares(actor_rows: DataFrame, fight_rows: DataFrame) -> DataFrame:
    """Actors of fights with their share of the fight's damage and their damage a second."""
    f = fight_rows.select("user_id", "cluster", "total_damage", "duration_seconds")
    rows = actor_rows.join(f, ["user_id", "cluster"])
    share = F.when(F.col("total_damage") > 0, F.col("damage").cast("double") / F.col("total_damage")).otherwise(F.lit(0.0))
    return rows.withColumn("share", share).withColumn("dps", F.col("damage").cast("double") / F.col("duration_seconds")).drop("total_damage", "duration_seconds")


def fights(clustered: DataFrame) -> DataFrame:
    """Clusters with damage: span, total, boss (the most damaged NPC, else the most damaged of all) and whether it died."""
    damage = F.col("kind") == "damage"
    total = clustered.groupBy("user_id", "cluster").agg(F.min("occurred_at").alias("start"), F.max("occurred_at").alias("end"), F.coalesce(F.sum(F.when(damage, F.col("amount"))), F.lit(0)).alias("total_damage"), F.count_if(damage).alias("n"), F.array_sort(F.collect_list(F.when((F.col("kind") == "death") & (F.col("target") != ""), F.struct("occurred_at", "id", "target")))).alias("deaths")).filter("n > 0")
    taken = clustered.filter(damage & (F.col("target") != "")).groupBy("user_id", "cluster", "target").agg(F.sum("amount").alias("amount"), F.min(F.struct("occurred_at", "id")).alias("o"))
    key = F.struct(is_npc(F.col("target")), "amount", -F.unix_micros(F.col("o.occurred_at").cast("timestamp")), -F.col("o.id"))
    boss = taken.groupBy("user_id", "cluster").agg(F.max_by("target", key).alias("boss"))
    seconds = F.greatest(F.lit(1), F.round((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6).cast("long"))
    total = total.withColumn("deaths", F.col("deaths.target"))  # each death, in order
    out = total.join(boss, ["user_id", "cluster"], "left").withColumn("title", F.coalesce("boss", F.lit("Unknown"))).withColumn("duration_seconds", seconds)
    return out.withColumn("defeated", F.array_contains("deaths", F.col("title"))).withColumn("group_dps", F.col("total_damage") / F.col("duration_seconds")).drop("n", "boss")


def sessions(fight_rows: DataFrame, actor_rows: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Fights with pauses of no more than ``gap`` seconds between them, with the player who did most damage."""
    w = Window.partitionBy("user_id").orderBy("cluster")
    pause = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.lag("end").over(w).cast("timestamp"))) > gap * 1_000_000
    f = fight_rows.withColumn("_new", F.when(F.coalesce(pause, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    players = actor_rows.filter(~is_npc(F.col("name"))).join(f.select("user_id", "cluster", "session", "start"), ["user_id", "cluster"])
    best = players.groupBy("user_id", "session", "name").agg(F.sum("damage").alias("damage")).groupBy("user_id", "session").agg(F.min_by("name", F.struct(-F.col("damage"), F.col("name"))).alias("top_player"))
    out = f.groupBy("user_id", "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total_damage").alias("total_damage"), F.count("*").alias("encounters"))
    return out.join(best, ["user_id", "session"], "left").withColumn("top_player", F.coalesce("top_player", F.lit("")))


def without_repeats(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, text) that differ from the one before them; empty ones are no lines."""
    by = Window.partitionBy("file").orderBy("line_no")
    return lines.filter("text <> ''").withColumn("_before", F.lag("text").over(by)).filter("_before IS NULL OR _before <> text").drop("_before")


def login_marker(text: Column) -> Column:
    """The time of a login marker's line, null if it is none."""
    stamp = F.regexp_replace(F.trim(F.regexp_extract(F.trim(text), r"^Logging In \[([^\]]*)\]", 1)), r"^\w{3}\s+", "")
    return F.when(F.trim(text).startswith("Logging In ["), F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy")))


def with_day_index(lines: DataFrame) -> DataFrame:
    """Adds ``_day``: how often the clock of (file, line_no, clock) has fallen by more than an hour up to a line."""
    by = Window.partitionBy("file").orderBy("line_no")
    return lines.withColumn("_day", F.sum(F.when(F.col("clock") < F.lag("clock").over(by) - 3600, 1).otherwise(0)).over(by))


def dated_lines(lines: DataFrame) -> DataFrame:
    """Combat lines (file, modified_at, line_no, text) with their full time.

    A clock that falls by more than an hour begins a day. Login markers anchor day numbers to dates: the last one at or before
    a line's day counts, else the first; a file without markers ends on the day it was modified."""
    line = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"[\r\n]+$", "")
    rows = without_repeats(lines.withColumn("text", line)).withColumn("_marker", login_marker(F.col("text")))
    clock = sum((F.regexp_extract("text", STAMP, i).try_cast("int") * s for i, s in ((1, 3600), (2, 60), (3, 1))), F.lit(0))
    own = F.when(F.col("_marker").isNotNull(), F.hour("_marker") * 3600 + F.minute("_marker") * 60 + F.second("_marker")).when(is_suspect(F.col("text")), clock)
    rows = with_day_index(rows.withColumn("clock", own).filter("clock IS NOT NULL"))
    upto = Window.partitionBy("file").orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("file")
    anchor = F.when(F.col("_marker").isNotNull(), F.struct(F.to_date("_marker").alias("date"), F.col("_day").alias("day")))
    spot = F.struct("_day", "line_no")
    rows = rows.withColumn("_near", F.max_by(anchor, F.when(anchor.isNotNull(), spot)).over(upto)).withColumn("_first", F.min_by(anchor, F.when(anchor.isNotNull(), spot)).over(whole))
    rows = rows.withColumn("_last", F.max(F.when(F.col("_marker").isNull(), F.col("_day"))).over(whole))
    a = F.coalesce("_near", "_first", F.struct(F.to_date("modified_at").alias("date"), F.col("_last").alias("day")))
    day = F.date_add(a["date"], (F.col("_day") - a["day"]).cast("int"))
    at = F.timestamp_add("SECOND", F.col("clock"), day.cast("timestamp_ntz"))
    return rows.filter("_marker IS NULL").select("file", "line_no", "text", "clock", at.alias("at"))


def live_stamp(line: Column, as_of: Column) -> Column:
    """Time of a line read just now: today's clock, a day back where that is over five minutes ahead."""
    seconds = sum((F.regexp_extract(line, r"(\d{2}):(\d{2}):(\d{2})", i).try_cast("int") * s for i, s in ((1, 3600), (2, 60), (3, 1))), F.lit(0))
    at = F.timestamp_add("SECOND", seconds, F.date_trunc("day", as_of).cast("timestamp_ntz"))
    return F.coalesce(F.when(at > as_of + F.expr("INTERVAL 5 MINUTES"), at - F.expr("INTERVAL 1 DAY")).otherwise(at), as_of)
