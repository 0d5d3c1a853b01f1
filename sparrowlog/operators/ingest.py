"""Ingest algebra: canonical JSON, content hashes, schema inference and diff, rows of valid payloads."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.operators.contracts import state_hash

#: JSON types in their order within a path.
TYPE_ORDER = ("array", "boolean", "null", "number", "object", "string")
KINDS = {list: "array", bool: "boolean", type(None): "null", dict: "object", str: "string"}


def instant(text: Column) -> Column:
    """The instant of an ISO text with its offset, null where it is none."""
    return F.try_to_timestamp(text)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every depth and no white space; arrays keep their order."""
    return F.to_json(F.parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def text_hash(raw: Column) -> Column:
    """Hash of a text with unified line ends."""
    return F.sha2(F.replace(raw, F.lit("\r\n"), F.lit("\n")), 256)


def line_fingerprint(file: Column, line_no: Column, index: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.element_at(F.split(file, "/"), -1), line_no, index, line), 256)


def encounter_fingerprint(source: str, at: Column, outcome: Column, hunter: Column, target: Column, credits: Column) -> Column:
    """Identity of an encounter: its own facts and its instant in UTC, not when it was collected."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = [F.to_json(F.array(c)) for c in (F.lit(source), stamp, outcome, hunter, target)]
    inner = [F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *inner, credits.cast("string")), F.lit("]")), 256)


def shape(json: Column) -> Column:
    """A text that only payloads of equal paths and types share: canonical JSON with a mark for each string (~), number (#) and
    truth value (!), and with each run of equal marks, or of equal objects of these, in an array once. Each pattern takes a quoted
    key whole before it looks for anything else, so keys stay; they are followed by a mark of each kind, which says nothing."""
    key = r'("[^"\\]*+(?:\\.[^"\\]*+)*+":)'
    out = F.regexp_replace(F.to_json(F.try_parse_json(json)), rf"{key}|{key[1:-2]}", "$1~")
    out = F.regexp_replace(F.regexp_replace(out, rf"{key}|-?\d[\d.eE+-]*+", "$1#"), rf"{key}|true|false", "$1!")
    out = F.regexp_replace(out, key[:-1] + r"!#~)|([~#!]|null)(?:,\2)+", "$1$2")
    flat = rf'\{{(?:[^{{}}\[\]"]++|{key[1:-1]}|\[[^{{}}\[\]"]*+\])*+\}}'
    return F.regexp_replace(out, key[:-1] + rf"!#~)|({flat})(?:,\2)+", "$1$2")


def walk_batches(batches):
    """(key, canonical JSON) to (key, path, types), by an explicit stack, so at any depth."""
    for batch in batches:
        keys, paths, types = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            seen: dict[str, set[str]] = {}
            stack = [("$", json.loads(text))]
            while stack:
                path, value = stack.pop()
                kind = KINDS.get(type(value), "number")
                seen.setdefault(path, set()).add(kind)
                if kind == "object":
                    stack += [(f"{path}.{k}", v) for k, v in value.items()]
                elif kind == "array":
                    stack += [(path + "[]", v) for v in value]
            keys += [row] * len(seen)
            paths += seen
            types += [sorted(x) for x in seen.values()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(paths, pa.string()), pa.array(types, pa.list_(pa.string()))], ["k", "path", "types"])


def walked_paths(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, types) by walking every value of every payload."""
    rows = payloads.select(F.col(key).alias("k"), F.to_json(F.try_parse_json(text)).alias("json")).filter("json IS NOT NULL")
    kind = rows.schema["k"].dataType.simpleString()
    walked = rows.mapInArrow(walk_batches, f"k {kind}, path string, types array<string>")
    return walked.groupBy(F.col("k").alias(key), "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))


def shaped(payloads: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, shape) of each payload that is JSON, and (shape, path, types), for which one payload of each shape is walked."""
    rows = payloads.select(F.col(key), F.col(text).alias("_json"), shape(F.col(text)).alias("shape")).filter("shape IS NOT NULL")
    return rows.select(key, "shape"), walked_paths(rows.groupBy("shape").agg(F.min("_json").alias("_json")), "shape", "_json")


def schema_paths(payloads: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, types): the JSON types seen at each path of each payload, arrays as ``[]``. A payload that is no JSON has no path."""
    rows, paths = shaped(payloads, key, json)
    return rows.join(paths, "shape").select(key, "path", "types")


def payload_signatures(payloads: DataFrame, key: str, json: str) -> DataFrame:
    """(key, paths, signature, comparable) of each payload that is JSON, worked out once for each shape."""
    rows, paths = shaped(payloads, key, json)
    return rows.join(signatures(paths, "shape"), "shape").drop("shape")


def signatures(paths: DataFrame, key: str) -> DataFrame:
    """(key, paths, signature, comparable): one row a payload; not comparable if an array had no member."""
    line = F.concat("path", F.lit(":"), F.array_join("types", "|"))
    rows = paths.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("paths"), F.collect_set("path").alias("names"), F.collect_set(F.when(F.array_contains("types", "array"), F.col("path"))).alias("arrays"))
    open_ = F.exists("arrays", lambda a: ~F.exists("names", lambda n: n.startswith(F.concat(a, F.lit("[]")))))
    return rows.select(key, "paths", F.sha2(F.to_json("paths"), 256).alias("signature"), (~open_).alias("comparable"))


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path, from_types, to_types) between two tables of (path, types); children of empty arrays say nothing."""

    def empty(t: DataFrame) -> DataFrame:
        a = t.filter(F.array_contains("types", "array")).select(F.concat("path", F.lit("[]")).alias("prefix"))
        return a.join(t.select("path"), F.col("path").startswith(F.col("prefix")), "left_anti")

    b, a = before.select("path", F.col("types").alias("from_types")), after.select("path", F.col("types").alias("to_types"))
    both = b.join(a, "path", "full_outer")
    added = both.filter("from_types IS NULL").join(empty(before), F.col("path").startswith(F.col("prefix")), "left_anti").withColumn("change", F.lit("added"))
    removed = both.filter("to_types IS NULL").join(empty(after), F.col("path").startswith(F.col("prefix")), "left_anti").withColumn("change", F.lit("removed"))
    changed = both.filter("from_types <> to_types").withColumn("change", F.lit("changed"))
    return added.unionByName(removed).unionByName(changed).select("change", "path", "from_types", "to_types")


def novel_paths(known: DataFrame, new: DataFrame, nullable: list[str]) -> DataFrame:
    """(path, novelty) against all known variants (variant, path, types): a path or a type never seen (null is excused on
    ``nullable`` paths), or a path gone that every variant had."""
    variants = known.agg(F.count_distinct("variant").alias("variants"))
    seen = known.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("seen"), F.count_distinct("variant").alias("held"))
    rows = new.select("path", "types").join(seen, "path", "full_outer").crossJoin(F.broadcast(variants))
    excused = F.when(F.col("path").isin(nullable), F.array(F.lit("null"))).otherwise(F.array().cast("array<string>"))
    fresh = F.size(F.array_except(F.array_except("types", "seen"), excused)) > 0
    what = F.when(F.col("seen").isNull(), "path").when(F.col("types").isNull() & (F.col("held") == F.col("variants")), "removed").when(F.col("types").isNotNull() & fresh, "type")
    return rows.select("path", what.alias("novelty")).filter("novelty IS NOT NULL")


def run_status(requests: Column, failed: Column, partial: Column) -> Column:
    return F.when((requests > 0) & (failed >= requests), "FAILED").when((failed > 0) | (partial > 0), "PARTIAL").otherwise("SUCCEEDED")


def encounters_of(valid: DataFrame, source: str) -> DataFrame:
    """Encounter rows of valid bounty payloads with their fingerprint."""
    rows = valid.select(F.explode("p.recent").alias("e"))
    rows = rows.select(instant(F.col("e.timestamp")).alias("event_at"), "e.outcome", F.col("e.hunterName").alias("hunter_name"), F.col("e.targetName").alias("target_name"), "e.credits")
    return rows.withColumn("fingerprint", encounter_fingerprint(source, F.col("event_at"), F.col("outcome"), F.col("hunter_name"), F.col("target_name"), F.col("credits")))


def snapshots_of(valid: DataFrame) -> DataFrame:
    """Entry rows of valid leaderboard payloads with the snapshot's state hash."""
    rows = valid.select(state_hash(F.col("payload")).alias("state_hash"), F.col("p.id").alias("leaderboard_id"), F.col("p.subject").alias("subject"), F.col("p.period").alias("source_period_key"), F.timestamp_seconds("p.periodStartTime").alias("starts_at"), F.timestamp_seconds("p.periodEndTime").alias("ends_at"), instant(F.col("p.fetchedAt")).alias("source_fetched_at"), F.explode("p.entries").alias("e"))
    return rows.select("state_hash", "leaderboard_id", "subject", "source_period_key", "starts_at", "ends_at", "source_fetched_at", F.col("e.rank").alias("rank"), F.col("e.participantId").alias("source_participant_id"), F.col("e.name").alias("name"), F.col("e.score").cast("decimal(30,6)").alias("score"), F.col("e.scoreRaw").alias("score_raw"), F.nullif(F.col("e.guildAbbreviation"), F.lit("")).alias("guild_abbreviation"))


def wins_of(valid: DataFrame) -> DataFrame:
    part = lambda c, subject: valid.select(F.col("p.id").alias("leaderboard_id"), F.lit(subject).alias("subject"), F.explode(f"p.{c}").alias("e")).select("leaderboard_id", "subject", F.col("e.participantId").alias("source_participant_id"), "e.wins", "e.rank")
    return part("cityWins", "city").unionByName(part("guildWins", "guild"))


def officers_of(valid: DataFrame) -> DataFrame:
    state = state_hash(F.col("payload"), ["faction", "totalResults", "officers"])
    return valid.select(state.alias("state_hash"), "p.faction", F.explode("p.officers").alias("e")).select("state_hash", "faction", F.col("e.oid").alias("source_participant_id"), "e.name", F.col("e.rankIndex").alias("rank_index"), F.col("e.rankName").alias("rank_name"), F.col("e.currentGcwPoints").alias("current_gcw_points"))
