"""Writes as set operations: insert if absent, upserts, change capture, newest write wins, cross-archive merge and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlog.functions.latest import latest_per_key


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``old`` lacks."""
    return latest_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` with the fields that ``new`` gives; a null in ``new`` keeps the old value. Of writes with one key the first by
    ``order`` counts (without one: the greatest row), so a key has one row."""
    values = [c for c in old.columns if c not in keys]
    new = latest_per_key(new, keys, order or [F.desc_nulls_last(c) for c in values])
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def count_upsert(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Registry of (keys, first_seen_at, last_seen_at, occurrences) after the sightings (keys, at); ``is_new`` tells new keys."""
    rows = old.select(*keys, "first_seen_at", "last_seen_at", "occurrences", F.lit(0).alias("_new"))
    rows = rows.unionByName(seen.select(*keys, F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.lit(1).cast("long").alias("occurrences"), F.lit(1).alias("_new")))
    return rows.groupBy(*keys).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("occurrences").alias("occurrences"), (F.min("_new") == 1).alias("is_new"))


def newest_write(old: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """Last write wins with tombstones kept; a write that is not strictly newer changes nothing."""
    rows = old.withColumn("_prefer", F.lit(1)).unionByName(new.withColumn("_prefer", F.lit(0)))
    rest = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, "_prefer", *[c for c in rest if c != at])).alias("w"))
    return best.select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest])


def changed_since(items: DataFrame, since: dt.datetime | None, n: int = 2000) -> DataFrame:
    """Writes after a moment, tombstones included, oldest first."""
    rows = items if since is None else items.filter(F.col("updated_at") > F.lit(since).cast("timestamp_ntz"))
    return rows.orderBy("updated_at", "store", "item_id").limit(n)


def revisions(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, old_value, new_value) of fields that differ between rows of the same key, values as text."""
    o = old.select(*keys, *[F.col(c).cast("string").alias(f"_o_{c}") for c in fields])
    n = new.select(*keys, *[F.col(c).cast("string").alias(f"_n_{c}") for c in fields])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old_value"), F.col(f"_n_{c}").alias("new_value")) for c in fields]))
    return o.join(n, keys).select(*keys, each.alias("r")).select(*keys, "r.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def open_events(events: DataFrame) -> DataFrame:
    """The newest open event of each kind and entity."""
    return latest_per_key(events.filter("resolved_at IS NULL"), ["event_type", "entity_key"], [F.desc("detected_at"), F.desc("id")])


def widen(old: DataFrame, other: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Seen intervals of both archives together; rows of ``other`` with one key count as one interval."""
    o = other.groupBy(*keys).agg(F.min(first).alias("_f"), F.max(last).alias("_l"))
    return old.join(o, keys, "left").withColumns({first: F.least(first, "_f"), last: F.greatest(last, "_l")}).drop("_f", "_l")


def id_map(source: DataFrame, target: DataFrame, natural: list[str]) -> DataFrame:
    """(source_id, target_id) by natural key, the least id where several have it; what the target lacks keeps its own id."""
    target = target.groupBy(*natural).agg(F.min("id").alias("id"))
    s = source.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"_{c}") for c in natural])
    on = [F.col(f"_{c}").eqNullSafe(target[c]) for c in natural]
    return s.join(target.select("id", *natural), on, "left").select("source_id", F.coalesce("id", "source_id").alias("target_id"))


def remap(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("source_id").alias(column), F.col("target_id")), column, "left").withColumn(column, F.coalesce("target_id", column)).drop("target_id")


def merge_archive(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the source's rows whose key (nulls equal) it lacks; running it again adds nothing."""
    s = source.dropDuplicates(keys).alias("s")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    return target.unionByName(s.join(target.select(*keys).alias("t"), on, "left_anti"))


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent: str = "id") -> DataFrame:
    """Rows that point to no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def framed(columns: list[str]) -> Column:
    """A text of a row that no other row has: each value after its length, nulls as a dash."""
    return F.concat(*[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string"))) for c in columns])


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and content digest of a table: sums of four parts of each row's hash, which need no order, repeated rows
    included, and no task gets more than a few numbers."""
    line = F.sha2(framed(columns), 256)
    parts = [F.sum(F.conv(F.substring(line, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]).alias("digest"))


def retained(rows: DataFrame, at: str, as_of: dt.datetime, n_days: int = 14) -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.filter(F.col(at) >= F.lit(as_of - dt.timedelta(days=n_days)).cast("timestamp_ntz"))


def health(rows: DataFrame, as_of: dt.datetime, stale_seconds: int = 900) -> DataFrame:
    """Worker state of rows (heartbeat_at, last_completed_at, disabled, last_status): the first rule that holds."""
    now, seen = F.lit(as_of).cast("timestamp_ntz"), F.coalesce("last_completed_at", "heartbeat_at")
    stale = seen.isNull() | (F.timestamp_diff("SECOND", seen, now) > max(120, stale_seconds))
    state = F.when(F.coalesce("disabled", F.lit(False)), "disabled").when(stale, "stale").when(F.col("last_status") == "FAILED", "failed").when(F.col("last_status") == "PARTIAL", "degraded").when(F.col("last_completed_at").isNotNull(), "healthy").otherwise("starting")
    return rows.withColumn("state", state)


def weekly_post(cycles: list[tuple[dt.datetime, dt.datetime]], posted: set[dt.datetime], now: dt.datetime, settle_minutes: int = 30) -> tuple[bool, str]:
    """Whether to publish the last whole cycle (cycles newest first), and why or why not."""
    if len(cycles) < 2:
        return False, "not_enough_cycles"
    (current, _), (start, end) = cycles[:2]
    if now - current < dt.timedelta(minutes=settle_minutes):
        return False, "reset_settling"
    if now - end > dt.timedelta(days=8):
        return False, "cycle_too_old"
    return (False, "already_posted") if start in posted else (True, "due")


def weekly_posts(cycles: DataFrame, posted: DataFrame, now: dt.datetime, settle_minutes: int = 30) -> DataFrame:
    """The same for many boards at once: (board, starts_at, publish, reason) of cycles (board, starts_at, ends_at), of which the
    newest two of a board count, and what is posted (board, starts_at). ``starts_at`` is that of the last whole cycle."""
    at, newest = F.lit(now).cast("timestamp_ntz"), Window.partitionBy("board").orderBy(F.desc("starts_at"))
    last = cycles.withColumn("_current", F.lag("starts_at").over(newest)).withColumn("_n", F.row_number().over(newest)).withColumn("_of", F.count("*").over(Window.partitionBy("board")))
    last = last.filter("_n = 2 OR _of = 1").join(posted.select("board", "starts_at", F.lit(True).alias("_posted")).distinct(), ["board", "starts_at"], "left")
    reason = F.when(F.col("_of") == 1, "not_enough_cycles").when(F.timestamp_diff("SECOND", "_current", at) < settle_minutes * 60, "reset_settling").when(F.timestamp_diff("SECOND", "ends_at", at) > 8 * 86_400, "cycle_too_old").when(F.col("_posted"), "already_posted").otherwise("due")
    return last.select("board", F.when(F.col("_of") > 1, F.col("starts_at")).alias("starts_at"), (reason == "due").alias("publish"), reason.alias("reason"))


def over_limit(requests: DataFrame, most: int = 120) -> DataFrame:
    """Clients over ``most`` requests in a minute window of (client, at)."""
    return requests.groupBy("client", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("requests")).filter(F.col("requests") > max(10, most)).select("client", F.col("w.start").alias("minute"), "requests")


def shallow_merge(a: Column, b: Column) -> Column:
    """Both maps in one; where both have a key, the value of ``b``, null or not."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def incremental(rows: DataFrame, after: int | None, as_of: dt.datetime, at: str = "event_at", seed_seconds: int = 180, n: int = 600) -> DataFrame:
    """What a consumer has not seen: rows after an id, or without one those of the last moments; oldest first."""
    fresh = F.col("id") > after if after is not None else F.col(at) >= F.lit(as_of - dt.timedelta(seconds=seed_seconds)).cast("timestamp_ntz")
    return rows.filter(fresh).orderBy("id").limit(n)


def validation(encounters: DataFrame, tables: dict[str, DataFrame], orphans: DataFrame) -> DataFrame:
    """(name, n): rows, distinct ids and instants of the encounters, rows without a parent, and rows of each table."""
    counts = encounters.agg(F.count("*").alias("encounters"), F.count_distinct("id").alias("ids"), F.count_distinct("event_at").alias("instants"))
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counts.columns])).alias("r")).select("r.*")
    for name, rows in [("orphans", orphans), *tables.items()]:
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out
