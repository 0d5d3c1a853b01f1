"""Fights and sessions as a stream: the batch algebra of ``operators.combat`` one user at a time, with state.

Events wait until the watermark has passed them and are then taken in the order of (occurred_at, id), so in whatever order they
come within the delay, fights and sessions are those of the batch. State of a user: waiting events, names first seen, the last
caster of each ability on a target and the last hitter of each target, the open fight and the open session.
A name that is first seen alone maps the long forms after it; the batch, which sees all events, maps those before it too.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparrowlog.operators.combat import FIGHT_GAP, SESSION_GAP

EVENT = ["at", "id", "kind", "source", "target", "ability", "amount", "flag"]
WAITING = "at long, id long, kind string, source string, target string, ability string, amount long, flag string"
ACTOR = "struct<name:string,damage:bigint,max_hit:bigint,healing:bigint,hits:bigint,crits:bigint,share:double,dps:double>"
FIGHT = f"start timestamp, end timestamp, total_damage long, duration_seconds long, title string, defeated boolean, deaths array<string>, actors array<{ACTOR}>"
OUT = f"what string, user_id string, {FIGHT}, encounters long, top_player string"
COLUMNS = ["what", "user_id", "start", "end", "total_damage", "duration_seconds", "title", "defeated", "deaths", "actors", "encounters", "top_player"]
NPC = re.compile(r"^(?:a|an|the)\s+", re.I)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def canonical_npc(name: str) -> str:
    article, rest = name.strip().split(None, 1)
    return f"{article.capitalize()} {rest}"


class Held:
    """A map state as it is during one call: each key is read once, and what is new is written at the end."""

    def __init__(self, state):
        self.state, self.values, self.fresh = state, {}, set()

    def get(self, key: tuple) -> tuple | None:
        if key not in self.values:
            self.values[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.values[key]

    def put(self, key: tuple, value: tuple) -> None:
        self.values[key] = value
        self.fresh.add(key)

    def write(self) -> None:
        for key in self.fresh:
            self.state.updateValue(key, self.values[key])


class Fights(StatefulProcessor):
    """Rows of a user to finished fights and sessions."""

    def __init__(self, gap_seconds: int, session_seconds: int, keep_seconds: int | None):
        self.gap, self.session_gap, self.keep = gap_seconds * 1_000_000, session_seconds * 1_000_000, keep_seconds and keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.names = handle.getMapState("names", "single string", "known string")
        self.casters = handle.getMapState("casters", "spell string, target string", "source string, at long")
        self.hitters = handle.getMapState("hitters", "target string", "source string, at long")
        self.fight = handle.getValueState("fight", "state string")
        self.session = handle.getValueState("session", "state string")

    def close(self) -> None:
        pass

    # --- input and time

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows))
        at = frame["occurred_at"].astype("datetime64[us]").astype("int64")
        fresh = [(int(a), *(None if pd.isna(x) else x for x in row)) for a, *row in zip(at, *(frame[c] for c in EVENT[1:]), strict=True)]
        self.waiting.appendList([(a, int(i), *rest[:4], int(rest[4] or 0), rest[5]) for a, i, *rest in fresh])
        self.wake(min(x[0] for x in fresh) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [x for x in events if x[0] < passed], [x for x in events if x[0] >= passed]
        self.out, self.user = [], key[0]
        fight = json.loads(self.fight.get()[0]) if self.fight.exists() else None
        session = json.loads(self.session.get()[0]) if self.session.exists() else None
        self.open = session
        for event in self.named(ready):
            if fight and event[0] - fight["anchor"] > self.gap:
                self.end_fight(fight)
                fight = None
            fight = self.take(fight, event)
        if fight and passed - fight["anchor"] > self.gap and not (later and later[0][0] - fight["anchor"] <= self.gap):
            self.end_fight(fight)
            fight = None
        if self.open and passed - self.open["end"] > self.session_gap and not (fight and fight["start"] - self.open["end"] <= self.session_gap):
            self.end_session()
            self.forget(passed)
        self.put(self.fight, fight)
        self.put(self.session, self.open)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        times = [x[0] for x in later[:1]] + ([fight["anchor"] + self.gap] if fight else []) + ([self.open["end"] + self.session_gap] if self.open else [])
        if times:
            self.wake(max(min(times), passed) // 1000 + 1)
        yield pd.DataFrame(self.out, columns=COLUMNS)

    def forget(self, now: int) -> None:
        """Casters and hitters of long ago go when a session ends."""
        for state in (self.casters, self.hitters) if self.keep else ():
            for key in [k for k, (_, at) in state.iterator() if at < now - self.keep]:
                state.removeKey(key)

    def wake(self, ms: int) -> None:
        if ms not in [x if isinstance(x, int) else x[0] for x in self.handle.listTimers()]:
            self.handle.registerTimer(ms)

    @staticmethod
    def put(state, value) -> None:
        if value is None:
            state.clear()
        else:
            state.update((json.dumps(value),))

    # --- names and ticks

    def mapped(self, name: str) -> str:
        if not name:
            return name
        if NPC.match(name.strip()):
            return canonical_npc(name)
        parts = re.split(r"\s+", name)
        if len(parts) == 1:
            return name
        known = self.known_as(parts[0].lower())
        if known is not None:
            return known
        return parts[0] if len(parts) == 2 and parts[1].startswith("Effect") else name

    def known_as(self, single: str) -> str | None:
        """The name first seen alone; looked up in the state once a call."""
        if single not in self.seen:
            self.seen[single] = self.names.getValue((single,))[0] if self.names.containsKey((single,)) else None
        return self.seen[single]

    def named(self, events):
        """Events with names made one, and ticks credited to who applied them."""
        self.seen: dict[str, str | None] = {}
        casters, hitters = Held(self.casters), Held(self.hitters)
        for event in events:
            for name in (event[3], event[4]):
                if name and " " not in name and not NPC.match(name.strip()) and self.known_as(name.lower()) is None:
                    self.names.updateValue((name.lower(),), (name,))
                    self.seen[name.lower()] = name
        for at, i, kind, source, target, ability, amount, flag in events:
            tick = flag == "periodic" and source in (ability, "Periodic")
            source, target = self.mapped(source or ""), self.mapped(target or "")
            if kind == "damage":
                spell = ((ability or "").lower(), target)
                if tick:
                    last = casters.get(spell) or hitters.get((target,))
                    source = last[0] if last else ""
                else:
                    casters.put(spell, (source, at))
                    if flag != "periodic":
                        hitters.put((target,), (source, at))
            yield at, i, kind, source, target, amount, flag
        casters.write()
        hitters.write()

    # --- fights and sessions

    @staticmethod
    def take(fight, event):
        at, _, kind, source, target, amount, flag = event
        fight = fight or {"start": at, "end": at, "anchor": at, "total": 0, "hits": 0, "taken": {}, "actors": {}, "deaths": []}
        fight["end"] = at
        if kind == "damage":
            fight["anchor"], fight["total"], fight["hits"] = at, fight["total"] + amount, fight["hits"] + 1
            if target:
                fight["taken"][target] = fight["taken"].get(target, 0) + amount
        if source and kind in ("damage", "heal"):
            actor = fight["actors"].setdefault(source, {"damage": 0, "max_hit": 0, "healing": 0, "hits": 0, "crits": 0})
            if kind == "heal":
                actor["healing"] += amount
            else:
                actor["damage"], actor["max_hit"], actor["hits"] = actor["damage"] + amount, max(actor["max_hit"], amount), actor["hits"] + 1
                actor["crits"] += flag == "crit"
        if kind == "death" and target:
            fight["deaths"].append(target)
        return fight

    def end_fight(self, fight) -> None:
        if not fight["hits"]:
            return
        # of equal ones the first that was hit, as a dictionary keeps its order
        boss = max(fight["taken"], key=lambda x: (bool(NPC.match(x)), fight["taken"][x]), default="Unknown")
        seconds = max(1, int((fight["end"] - fight["start"]) / 1e6 + 0.5))
        actors = [{"name": n, **a, "share": a["damage"] / fight["total"] if fight["total"] > 0 else 0.0, "dps": a["damage"] / seconds} for n, a in sorted(fight["actors"].items(), key=lambda x: (-x[1]["damage"], x[0]))]
        self.emit("fight", fight, fight["total"], seconds, boss, boss in fight["deaths"], fight["deaths"], actors, None, None)
        if self.open and fight["start"] - self.open["end"] > self.session_gap:
            self.end_session()
        s = self.open = self.open or {"start": fight["start"], "end": 0, "total": 0, "encounters": 0, "players": {}}
        s["end"], s["total"], s["encounters"] = fight["end"], s["total"] + fight["total"], s["encounters"] + 1
        for a in actors:
            if not NPC.match(a["name"]):
                s["players"][a["name"]] = s["players"].get(a["name"], 0) + a["damage"]

    def end_session(self) -> None:
        s, self.open = self.open, None
        top = min(s["players"], key=lambda x: (-s["players"][x], x), default="")
        self.emit("session", s, s["total"], None, None, None, None, None, s["encounters"], top)

    def emit(self, what, span, total, *rest) -> None:
        import pandas as pd

        self.out.append((what, self.user, pd.Timestamp(span["start"], unit="us"), pd.Timestamp(span["end"], unit="us"), total, *rest))


def use_state_store(spark: SparkSession) -> None:
    """Named state lives in RocksDB, so it may outgrow an executor's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def session_stream(events: DataFrame, gap_seconds: int = FIGHT_GAP, session_seconds: int = SESSION_GAP, late: str = "1 minute", keep_seconds: int | None = None) -> DataFrame:
    """Rows ``what`` = fight (span, total, boss, deaths in order, actors) and session (span, total, encounters, top player) as
    they end, of events (id, user_id, kind, source, target, ability, amount, flag, occurred_at). With ``keep_seconds``, who cast
    or hit last longer ago than that is forgotten when a session ends; the batch never forgets."""
    use_state_store(events.sparkSession)
    rows = events.select("user_id", "id", "kind", "source", "target", "ability", "amount", "flag", "occurred_at").withWatermark("occurred_at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Fights(gap_seconds, session_seconds, keep_seconds), OUT, "Append", "EventTime")
