"""Contracts of the feeds' payloads over variants: issues by path, fields that no contract knows, and completeness.

A contract is a tree of rules. Whether a field is absent, null or of a type is read from the parsed payload itself, as a struct
schema would make absent and null one case. Spark says what is JSON; the rules are then a walk of one payload over Arrow batches,
as no code is generated for native functions over its arrays. A payload stays one row.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed words of the contracts.
VALUE_TYPES, PERIODS, SUBJECTS, FACTIONS, OUTCOMES = ("RAW", "CREDITS", "PERCENT", "METERS"), ("CURRENT", "PREVIOUS_1", "PREVIOUS_2"), ("player", "guild", "city"), ("IMPERIAL", "REBEL"), ("KILL", "FAILED")
#: Formats of the contracts, and what the feeds expose at most.
STAMP = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
SCORE = r"^-?\d+(?:\.\d+)?%?$"
RECENT_CAP, OFFICER_CAP = 12, 250
SAFE = 2.0**53 - 1
MAP, LIST = "map<string,variant>", "array<variant>"
ISSUES = "struct<issues:array<string>,affected:array<string>>"


@dataclass(frozen=True)
class Rule:
    """What a field must be: ``text``, ``number``, ``whole``, ``object`` or ``objects`` (an array of them). A null passes where
    the rule is nullable. ``checks`` (path, message, test of the object) are made where the object has no issue of type."""

    kind: str
    least: float | None = None
    most: float | None = None
    words: tuple[str, ...] = ()
    pattern: str = ""
    nullable: bool = False
    fields: dict[str, Rule] = field(default_factory=dict)
    checks: tuple[tuple[str, str, Callable[[dict], bool]], ...] = ()


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def distinct_ids(items: str, key: str) -> Callable[[dict], bool]:
    return lambda v: len({x[key] for x in v[items]}) == len(v[items])


TEXT, SOME, NULLABLE, COUNT, PLACE = Rule("text"), Rule("text", least=1), Rule("text", nullable=True), Rule("whole", least=0), Rule("whole", least=1)
NUMBER, RATE, AT = Rule("number"), Rule("number", least=0, most=1), Rule("text", pattern=STAMP)
VALUE = Rule("text", words=VALUE_TYPES)
# The feeds' fields with their types and ranges, and the texts of the checks over several fields.
BOARD = {"id": SOME, "trackerOid": SOME, "name": SOME, "category": SOME, "valueType": VALUE, "periodStartTime": COUNT, "periodEndTime": PLACE}
ENTRY = {"rank": PLACE, "participantId": SOME, "name": TEXT, "score": NUMBER, "scoreRaw": Rule("text", pattern=SCORE), "guildAbbreviation": NULLABLE, "faction": NULLABLE, "planet": NULLABLE, "cityName": NULLABLE}
WIN = {"rank": PLACE, "participantId": SOME, "name": TEXT, "wins": COUNT, "guildAbbreviation": NULLABLE, "faction": NULLABLE, "planet": NULLABLE}
OFFICER = {
    "oid": SOME, "name": TEXT, "factionName": SOME, "rankIndex": PLACE, "rankName": SOME, "currentGcwPoints": COUNT, "currentPvpKills": COUNT, "lifetimeGcwPoints": COUNT, "lifetimePvpKills": COUNT,
    "profession": NULLABLE, "guildName": NULLABLE, "guildAbbreviation": NULLABLE, "residentPlanet": NULLABLE, "residentCityName": NULLABLE,
}
ENCOUNTER = {"timestamp": AT, "outcome": Rule("text", words=OUTCOMES), "hunterName": SOME, "targetName": SOME, "credits": COUNT}
FREE_FAILURE = ("credits", "A failed encounter must have zero source credits", lambda v: v["outcome"] != "FAILED" or v["credits"] == 0)
HUNTER = {"rank": PLACE, "name": SOME, "kills": COUNT, "failures": COUNT, "encounters": COUNT, "successRate": RATE, "creditsEarned": COUNT}
TARGET = {"rank": PLACE, "name": SOME, "timesKilled": COUNT, "timesSurvived": COUNT, "encounters": COUNT, "survivalRate": RATE}
SUMMARY = {
    "kills": COUNT, "failures": COUNT, "encounters": COUNT, "successRate": RATE, "creditsPaid": COUNT, "averageBounty": Rule("number", least=0), "distinctHunters": COUNT, "distinctTargets": COUNT,
    "largestBounty": Rule("object", nullable=True, fields=ENCOUNTER, checks=(FREE_FAILURE,)),
}


def objects(fields: dict[str, Rule], *checks) -> Rule:
    return Rule("objects", fields=fields, checks=checks)


CONTRACTS = {
    "catalog": Rule("object", fields={"boards": objects(BOARD), "fetchedAt": AT}),
    "leaderboard": Rule(
        "object",
        fields={"id": SOME, "period": Rule("text", words=PERIODS), "subject": Rule("text", words=SUBJECTS), "valueType": VALUE, "totalScore": NUMBER, "periodStartTime": COUNT, "periodEndTime": PLACE, "entries": objects(ENTRY), "fetchedAt": AT},
        checks=(
            ("periodEndTime", "Period must end after it starts", lambda v: v["periodEndTime"] > v["periodStartTime"]),
            ("entries", "Duplicate participant in source response", distinct_ids("entries", "participantId")),
        ),
    ),
    "wins": Rule("object", fields={"id": SOME, "cityWins": objects(WIN), "guildWins": objects(WIN), "fetchedAt": AT}),
    "officers": Rule(
        "object",
        fields={"faction": Rule("text", words=FACTIONS), "officers": objects(OFFICER), "totalResults": COUNT, "fetchedAt": AT},
        checks=(("officers", "Duplicate officer identity in source response", distinct_ids("officers", "oid")),),
    ),
    "bounty": Rule(
        "object",
        fields={"windowDays": PLACE, "summary": Rule("object", fields=SUMMARY), "hunters": objects(HUNTER), "targets": objects(TARGET), "survivors": objects(TARGET), "recent": objects(ENCOUNTER, FREE_FAILURE), "fetchedAt": AT},
        checks=(("summary", "Kills plus failures does not equal encounters", lambda v: v["summary"]["kills"] + v["summary"]["failures"] == v["summary"]["encounters"]),),
    ),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def is_day(text: str) -> bool:
    try:
        return bool(dt.date.fromisoformat(text))
    except ValueError:
        return False


@cache
def matches(pattern: str) -> Callable[[str], re.Match | None]:
    return re.compile(pattern.replace("$", r"\Z"), re.ASCII).search


def scalar_issue(v: dict, name: str, rule: Rule) -> tuple[str, bool] | None:
    """(message, whether it is one of presence or type) of a field; numbers are floats, whatever their form."""
    if name not in v:
        return "missing", True
    x = v[name]
    if x is None:
        return None if rule.nullable else ("null", True)
    if rule.kind == "text":
        if not isinstance(x, str):
            return "not a text", True
        if rule.words and x not in rule.words:
            return "not allowed", True
        if rule.least and len(x) < rule.least:
            return "empty", False
        if rule.pattern and not (matches(rule.pattern)(x) and (rule.pattern != STAMP or is_day(x[:10]))):
            return "wrong format", False
        return None
    if not isinstance(x, float) or not math.isfinite(x):
        return "not a number", True
    if rule.kind == "whole" and x != math.floor(x):
        return "not a whole number", True
    if rule.kind == "whole" and abs(x) > SAFE:
        return "too large", False
    if rule.least is not None and x < rule.least:
        return "too small", False
    return ("too large", False) if rule.most is not None and x > rule.most else None


def object_issues(x, path: str, rule: Rule, out: list) -> bool:
    """Adds (path, message) of an object and of all below it, in the order of the contract's fields; whether one is fatal."""
    if not isinstance(x, dict):
        if x is not None or not rule.nullable:
            out.append((path, "null" if x is None else "not an object"))
        return x is not None or not rule.nullable
    fatal = False
    for name, r in rule.fields.items():
        at = f"{path}.{name}"
        if r.kind not in ("object", "objects"):
            if issue := scalar_issue(x, name, r):
                out.append((at, issue[0]))
                fatal |= issue[1]
        elif name not in x:
            out.append((at, "missing"))
            fatal = True
        elif r.kind == "object":
            fatal |= object_issues(x[name], at, r, out)
        elif not isinstance(x[name], list):
            out.append((at, "null" if x[name] is None else "not an array"))
            fatal = True
        else:
            for i, y in enumerate(x[name]):
                fatal |= object_issues(y, f"{at}.{i}", r, out)
    if not fatal:
        out += [(f"{path}.{at}", message) for at, message, test in rule.checks if not test(x)]
    return fatal


ENTRIES = "struct<rank:int,participantId:string,name:string,score:double,scoreRaw:string,guildAbbreviation:string,faction:string,planet:string,cityName:string>"
ENCOUNTERS = "struct<timestamp:string,outcome:string,hunterName:string,targetName:string,credits:bigint>"
OFFICERS = "struct<oid:string,name:string,factionName:string,rankIndex:int,rankName:string,currentGcwPoints:bigint,currentPvpKills:bigint,lifetimeGcwPoints:bigint,lifetimePvpKills:bigint,profession:string,guildName:string,guildAbbreviation:string,residentPlanet:string,residentCityName:string>"
WINS = "struct<rank:int,participantId:string,name:string,wins:int,guildAbbreviation:string,faction:string,planet:string>"
HUNTERS = "struct<rank:int,name:string,kills:bigint,failures:bigint,encounters:bigint,successRate:double,creditsEarned:bigint>"
TARGETS = "struct<rank:int,name:string,timesKilled:bigint,timesSurvived:bigint,encounters:bigint,survivalRate:double>"
#: Payloads as structs, for what is valid.
PAYLOADS = {
    "catalog": "boards array<struct<id:string,trackerOid:string,name:string,category:string,valueType:string,periodStartTime:bigint,periodEndTime:bigint>>, fetchedAt string",
    "leaderboard": f"id string, period string, subject string, valueType string, totalScore double, periodStartTime bigint, periodEndTime bigint, entries array<{ENTRIES}>, fetchedAt string",
    "wins": f"id string, cityWins array<{WINS}>, guildWins array<{WINS}>, fetchedAt string",
    "officers": f"faction string, officers array<{OFFICERS}>, totalResults int, fetchedAt string",
    "bounty": f"windowDays int, fetchedAt string, summary struct<kills:bigint,failures:bigint,encounters:bigint,successRate:double,creditsPaid:bigint,averageBounty:double,distinctHunters:bigint,distinctTargets:bigint,largestBounty:{ENCOUNTERS}>, hunters array<{HUNTERS}>, targets array<{TARGETS}>, survivors array<{TARGETS}>, recent array<{ENCOUNTERS}>",
}


#: Of JSON only its first value counts, as in Spark's parser; its numbers are floats of any size.
DECODER = json.JSONDecoder(parse_int=float)


def payload_issues(payload: str | None, is_json: bool, rule: Rule) -> list[tuple[str, str]]:
    if not is_json:
        return [("$", "not JSON")]
    out: list[tuple[str, str]] = []
    object_issues(DECODER.raw_decode(payload.lstrip(" \t\r\n\ufeff"))[0], "$", rule, out)
    return out


@cache
def issues(kind: str, most: int):
    """A function of (payload, is it JSON) to its issues and affected paths."""

    def run(payload: pa.Array, is_json: pa.Array) -> pa.Array:
        found = [payload_issues(p, ok, CONTRACTS[kind]) for p, ok in zip(payload.to_pylist(), is_json.to_pylist(), strict=True)]
        texts = pa.array([[f"{at}: {message}" for at, message in x[:most]] for x in found], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([texts, pa.array([sorted({at for at, _ in x}) for x in found], pa.list_(pa.string()))], ["issues", "affected"])

    run.__annotations__ = {"payload": pa.Array, "is_json": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ISSUES)


def validate(payloads: DataFrame, kind: str, most: int = 8) -> DataFrame:
    """Adds to rows of (payload): ``p`` (the payload as a struct; unknown keys are allowed), ``issues`` ("path: message", the
    first ``most``; empty: valid) and ``affected`` (every path with an issue, sorted)."""
    rows = payloads.withColumn("_found", issues(kind, most)("payload", F.try_parse_json("payload").isNotNull()))
    return rows.select(*payloads.columns, F.from_json("payload", PAYLOADS[kind]).alias("p"), "_found.issues", "_found.affected")


def unknown_keys(x: Column, path: str, rule: Rule) -> Column:
    """Paths of keys that the rule doesn't know, of an object and of the known objects below it."""
    keys = F.map_keys(F.try_variant_get(x, "$", MAP))
    own = F.transform(F.filter(keys, lambda k: ~k.isin(*rule.fields)), lambda k: F.concat(F.lit(path + "."), k))
    parts = [F.coalesce(own, F.array().cast("array<string>"))]
    for name, r in rule.fields.items():
        if r.kind == "object":
            parts.append(unknown_keys(get(x, name), f"{path}.{name}", r))
        elif r.kind == "objects":
            below = F.flatten(F.transform(get(x, name, LIST), below_of(f"{path}.{name}[]", r)))
            parts.append(F.coalesce(below, F.array().cast("array<string>")))
    return F.concat(*parts)


def below_of(path: str, rule: Rule) -> Callable[[Column], Column]:
    return lambda y: unknown_keys(y, path, rule)


def unknown_fields(payload: Column, kind: str) -> Column:
    """Sorted paths of a payload's fields that its feed's contract doesn't name, arrays as ``[]``; only the topmost unknown key of
    a branch is told. What is no object gives ``$:non-object``."""
    v = F.try_parse_json(payload)
    paths = F.array_sort(F.array_distinct(let(v, lambda x: unknown_keys(x, "$", CONTRACTS[kind]))))
    return F.when(F.try_variant_get(v, "$", MAP).isNull(), F.array(F.lit("$:non-object"))).otherwise(paths)


def as_number(x: Column) -> Column:
    """A value as a number, loosely: null and empty text are 0, true is 1, texts are read; null where it is none or not finite."""
    return let(x, read_number)


def read_number(x: Column) -> Column:
    kind, text = F.schema_of_variant(x), F.trim(F.try_variant_get(x, "$", "string"))
    number = F.when(F.is_variant_null(x), 0.0).when(kind == "STRING", F.when(text == "", 0.0).otherwise(text.try_cast("double"))).when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(x, "$", "double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def first_set(v: Column, *names: str) -> Column:
    """The first of the fields that is there and not null; else the last as it is."""
    return F.coalesce(*[F.when(~F.is_variant_null(get(v, n)), get(v, n)) for n in names[:-1]], get(v, names[-1]))


PROBLEM = "array<struct<event:string,reason:string,expected:double,received:double,missing:array<string>>>"


def problem(when: Column, event: str, reason: Column, expected: Column, received: Column, missing: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    one = F.array(F.struct(F.lit(event).alias("event"), reason.alias("reason"), expected.cast("double").alias("expected"), received.cast("double").alias("received"), (none if missing is None else missing).alias("missing")))
    return F.when(when, one.cast(PROBLEM)).otherwise(F.array().cast(PROBLEM))


def pagination(v: Column) -> Column:
    """A payload that says itself that pages are missing, in its pagination object or at its top."""
    m = F.when(F.try_variant_get(v, "$.pagination", MAP).isNotNull(), get(v, "pagination")).otherwise(v)
    pages = as_number(first_set(m, "totalPages", "total_pages"))
    got = as_number(first_set(m, "pagesReceived", "pages_received", "currentPage", "current_page"))
    said = F.lit(False)
    for name in ("complete", "isComplete", "is_complete"):
        said = said | F.coalesce((F.schema_of_variant(get(m, name)) == "BOOLEAN") & ~get(m, name, "boolean"), F.lit(False))
    return problem(said | F.coalesce(got < pages, F.lit(False)), "pagination_incomplete", F.lit("pagination_incomplete"), pages, got)


def completeness(payloads: DataFrame, kind: str, boards: list[str] = ()) -> DataFrame:
    """Adds to rows of (payload) ``expected`` and ``received`` records and ``problems`` (event, reason, expected, received,
    missing), several at once where there are several; none: the payload is whole."""
    rows = payloads.withColumn("_variant", F.try_parse_json("payload"))
    return rows.withColumn("_whole", let(F.col("_variant"), lambda v: wholeness(v, kind, boards))).select(*payloads.columns, "_whole.*")


def wholeness(v: Column, kind: str, boards: list[str]) -> Column:
    is_object = F.try_variant_get(v, "$", MAP).isNotNull()
    n = lambda name: F.coalesce(F.size(get(v, name, LIST)), F.lit(0)).cast("double")
    failed = "source_integrity_failed"
    if kind == "catalog":
        ids = F.transform(get(v, "boards", LIST), lambda x: F.when(F.schema_of_variant(get(x, "id")) == "STRING", get(x, "id", "string")))
        missing = F.array_except(F.array(*[F.lit(b) for b in boards]).cast("array<string>"), F.coalesce(ids, F.array().cast("array<string>")))
        none = F.lit(None).cast("double")
        expected, received, more = F.greatest(n("boards"), F.lit(float(len(boards)))), n("boards"), problem(F.size(missing) > 0, failed, F.lit("tracked_boards_missing"), none, none, missing)
    elif kind in ("bounty", "officers"):
        said, got, cap, partial = (as_number(get(v, "summary.encounters")), n("recent"), RECENT_CAP, "recent_encounters_incomplete") if kind == "bounty" else (as_number(get(v, "totalResults")), n("officers"), OFFICER_CAP, "officer_registry_incomplete")
        want, one = F.least(F.coalesce(said, F.lit(0.0)), F.lit(float(cap))), 1 if kind == "bounty" else 0
        reason = F.when(got == 0, "unexpected_empty_response").otherwise(partial)
        expected, received, more = want + one, got + one, problem(got < want, failed, reason, want, got)
    else:
        received = n("entries") if kind == "leaderboard" else n("cityWins") + n("guildWins")
        expected, more = received, F.array().cast(PROBLEM)
    lost = problem(F.lit(True), failed, F.lit("non_object_response"), F.lit(1.0), F.lit(0.0))
    return F.struct(F.when(is_object, expected).otherwise(1.0).alias("expected"), F.when(is_object, received).otherwise(0.0).alias("received"), F.when(is_object, F.concat(pagination(v), more)).otherwise(lost).alias("problems"))


def canonical_state(payload: Column, keep: list[str] | None = None, drop: list[str] = ()) -> Column:
    """A payload object as canonical JSON (keys sorted at every depth, types kept) of its named top fields, or of all but those
    to drop. Named fields that are absent stay absent."""
    fields = F.from_json(payload, MAP)
    kept = F.map_filter(fields, lambda k, _: k.isin(*keep) if keep is not None else ~k.isin(*drop))
    parts = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1), F.lit(":"), F.to_json(F.element_at(kept, k))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def state_hash(payload: Column, keep: list[str] | None = None, drop: list[str] = ("fetchedAt",)) -> Column:
    """Hash of a payload's state: equal whenever its values are, whatever the order of keys; the fetch time is no state."""
    return F.sha2(canonical_state(payload, keep, drop), 256)
