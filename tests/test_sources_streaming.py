import datetime as dt
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparrowlog.operators import combat, limits, log_dating
from sparrowlog.plans import lens
from sparrowlog.sources import export, landing, web
from sparrowlog.streaming import fights, live

T = dt.datetime(2024, 1, 1)


def test_fetch_retries():
    answers = [(429, {"retry-after": "3"}, "busy"), (503, {}, "busy"), (200, {}, '{"a":1}')]
    waits = []
    row = web.fetch_json("u", call=lambda u, t: answers.pop(0), sleep=waits.append)
    assert row == ("u", 200, 3, '{"a":1}', None) and waits == [3.0, 1.0]
    row = web.fetch_json("u", retries=1, call=lambda u, t: (200, {}, "<html>" + "x" * 30_000), sleep=waits.append)
    assert len(json.loads(row[3])["nonJsonBody"]) == 20_000

    def broken(u, t):
        raise OSError("down")

    assert web.fetch_json("u", retries=2, call=broken, sleep=waits.append)[1:] == (None, 3, None, "down")


def test_web_source_registers(spark):
    spark.dataSource.register(web.JsonWebSource)
    assert spark.read.format("json_web").option("urls", "").load().columns == ["url", "status", "attempts", "payload", "error"]


def test_landing(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"b": 1, "a": 2}')
    (tmp_path / "p/b.json").write_text("no json")
    rows = landing.payloads(spark, str(tmp_path / "p")).orderBy("file").collect()
    assert rows[0].payload_hash and rows[1].payload_hash is None
    box = tmp_path / "m/mail_Some_One"
    box.mkdir(parents=True)
    (box / "1.mail").write_text("a\r\nb")
    (box / "2.mail").write_text("a\nb")
    (box / "3.mail").write_text("")
    (box / "4.mail").write_text("x" * 64_001)
    rows = landing.mails(spark, str(tmp_path / "m")).collect()
    assert [r.character for r in rows] == ["Some One"]
    assert landing.mails(spark, str(tmp_path / "m"), spark.createDataFrame([(rows[0].fingerprint,)], "fingerprint string")).count() == 0
    logs = tmp_path / "l"
    logs.mkdir()
    (logs / "my_chat.log").write_text("hello")
    (logs / "other.dat").write_text("12:00:00 A attacks B and hits for 5 points\n")
    (logs / "notes.txt").write_text("nothing")
    assert sorted(r.file.rsplit("/", 1)[1] for r in landing.chat_logs(spark, str(logs)).collect()) == ["my_chat.log", "other.dat"]
    assert landing.log_lines(spark, str(logs)).count() == 4


def test_work_list(spark):
    assert landing.work_list(spark, list("abcdef"), ["x", "y", "z"], ["p", "g", "c"], ["i", "r"]).count() == 1 + 54 + 6 + 2


def test_landing_stream_is_idempotent(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.createDataFrame([(k % 5, "v") for k in range(20)], "k int, v string")
    rows.write.parquet(source)
    for n in range(2):
        q = live.land(spark.readStream.schema("k int, v string").parquet(source), table, ["k"], str(tmp_path / f"cp{n}"))
        q.awaitTermination()
    rows.withColumn("k", F.col("k") + 3).write.mode("append").parquet(source)
    live.land(spark.readStream.schema("k int, v string").parquet(source), table, ["k"], str(tmp_path / "cp1")).awaitTermination()
    got = sorted(r.k for r in spark.read.parquet(table).collect())
    assert got == list(range(8))


IN_ORDER = [(0, "damage", 5), (15, "heal", 0), (19, "damage", 6), (60, "damage", 7), (4000, "heal", 0), (9000, "heal", 0)]
LATE = [(0, "damage", 5), (19, "damage", 6), (10, "damage", 1), (35, "damage", 7), (4000, "heal", 0), (9000, "heal", 0)]


@pytest.mark.parametrize("given, fights", [(IN_ORDER, [(7, 1), (11, 3)]), (LATE, [(19, 4)])])
def test_fight_stream(spark, tmp_path, given, fights):
    """An event that comes a batch late never moves the anchor back, which would split the fight."""
    t = dt.datetime(2024, 1, 1)
    events = [(i, "u", kind, n, t + dt.timedelta(seconds=s)) for i, (s, kind, n) in enumerate(given)]
    rows = spark.createDataFrame(events, "id long, user_id string, kind string, amount long, occurred_at timestamp")
    for i in range(len(events)):
        rows.filter(F.col("id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.fight_stream(stream).writeStream.format("memory").queryName("fights").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.total_damage, r.events) for r in spark.table("fights").collect()) == fights


def test_export_backfill_and_schema_report(spark, tmp_path):
    top = f"file://{tmp_path}"
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string"), spark.createDataFrame([], "id long")
    export.export({"a": (a, ["id"]), "b": (b, ["id"])}, f"{top}/one")
    keys = {"a": ["id"], "b": ["id"]}
    assert {r["table"]: (r["rows"], r["ok"]) for r in export.verify(spark, f"{top}/one", keys).collect()} == {"a": (2, True), "b": (0, True)}
    spark.createDataFrame([(3, "y")], "id long, v string").write.mode("append").parquet(f"{top}/one/a")
    assert {r["table"]: r["ok"] for r in export.verify(spark, f"{top}/one", keys).collect()} == {"a": False, "b": True}
    assert not any(r["ok"] for r in export.verify(spark, f"{top}/one", {}).collect())

    ran = []

    def run(period):
        ran.append(period)
        if ran == ["p1", "p2"]:
            raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        export.backfill(spark, f"{top}/jobs", ["p1", "p2", "p3"], run)
    assert export.checkpoints(spark, f"{top}/jobs") == {"p1": "SUCCEEDED", "p2": "FAILED"}
    assert export.backfill(spark, f"{top}/jobs", ["p1", "p2", "p3"], run) == ["p2", "p3"]
    assert ran == ["p1", "p2", "p2", "p3"]

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"n": 1}')
    (tmp_path / "in/b.json").write_text('{"n": "x", "m": []}')
    assert {(r["path"], *r["types"], r["files"]) for r in export.schema_report(spark, f"{top}/in").collect()} == {("$", "object", 2), ("$.n", "number", "string", 2), ("$.m", "array", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_streamed_fights_equal_the_batch_in_any_order_within_the_delay(spark, tmp_path, seed):
    events = lens.combat(spark, "/root/testdata/sf0.001").filter("id < 400").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    rows = sorted(events.collect(), key=lambda x: x.occurred_at.timestamp() + zlib.crc32(f"{x.id} {seed}".encode()) % 7200)
    users = sorted({x.user_id for x in rows})
    last = [[(-1, u, "heal", "", "", "", 0, "", dt.datetime(2030 + k, 1, 1)) for u in users] for k in range(2)]
    for part in (rows[:150], rows[150:300], rows[300:], *last):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = fights.session_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 3600, 7200, "2 hours")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start(str(tmp_path / "out"), "parquet").awaitTermination()
    got = spark.read.schema(fights.OUT).parquet(str(tmp_path / "out")).collect()
    clustered = combat.clusters(combat.normalise(events), 3600)
    f, a = combat.fights(clustered), combat.actors(clustered)
    shape = lambda x: (x.user_id, x.start, x.end, x.total_damage, x.duration_seconds, x.title, x.defeated, tuple(x.deaths))
    assert sorted(shape(x) for x in got if x.what == "fight") == sorted(map(shape, f.collect()))
    whole = lambda x: (x.user_id, x.start, x.end, x.total_damage, x.encounters, x.top_player)
    assert sorted(whole(x) for x in got if x.what == "session") == sorted(map(whole, combat.sessions(f, a, 7200).collect()))
    assert sum(len(x.actors) for x in got if x.what == "fight") == combat.with_shares(a, f).count()


def walked(times, width, limit):
    """Greedy walk of one client's requests."""
    start, n, out = None, 0, []
    for at in times:
        if start is None or at >= start + width:
            start, n = at, 0
        n += 1
        out.append((start + width, max(0, limit - n), n <= limit))
    return out


def test_rate_windows_equal_the_greedy_walk(spark, tmp_path):
    r, rows, want = random.Random(3), [], {}
    for c in range(12):
        at, times = 0, []
        for _ in range(r.choice([1, 2, 300])):
            at += r.choice([0, 1, 2, 7, 29, 30, 31, 59, 60, 61, 119, 120, 200] if c % 3 else [0, 1, 1, 2])
            times.append(at)
        for t, w in zip(times, walked(times, 60, 10), strict=True):
            want[len(rows)] = w
            rows.append((len(rows), f"c{c}", T + dt.timedelta(seconds=t)))
    d = spark.createDataFrame(rows, "id long, client string, at timestamp")
    key = lambda x: (round((x.reset - T).total_seconds()), x.remaining, x.allowed)
    assert {x.id: key(x) for x in limits.rate_windows(d.repartition(5), 1).collect()} == want, "a limit under 10 counts as 10"
    assert limits.rate_windows(d.filter("false")).count() == 0
    order = sorted(rows, key=lambda x: x[2])
    for part in (order[:200], order[200:900], order[900:]):
        spark.createDataFrame(part, d.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.rate_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 10)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start(str(tmp_path / "out"), "parquet").awaitTermination()
    assert {x.id: key(x) for x in spark.read.schema(live.DECISIONS).parquet(str(tmp_path / "out")).collect()} == want
    client = lambda a, b: spark.sql("SELECT CAST(? AS STRING) AS a, CAST(? AS STRING) AS b", args=[a, b]).select(limits.client_of(F.col("a"), F.col("b")).alias("c")).first().c
    assert [client("1, 2 ,", "r"), client(" , ", "r"), client(None, None)] == ["2", "r", "local"]


@pytest.mark.parametrize("seed", range(2))
def test_split_logs_are_dated_like_whole_files(spark, tmp_path, seed):
    r = random.Random(seed)
    (tmp_path / "logs").mkdir()
    for f in range(5):
        at, lines = T + dt.timedelta(days=f, hours=20), []
        for i in range(r.choice([0, 3, 200])):
            at += dt.timedelta(seconds=r.choice([0, 1, 600, 5000, 40_000]))
            what = r.random()
            line = f"[Combat]  {at:%H:%M:%S} Ann heals Bo for {r.choice([5, i])} points" if what < 0.6 else "" if what < 0.7 else f"Logging In [{at:%a %b %d %H:%M:%S %Y}]" if what < 0.78 and f % 2 else "someone says hello"
            lines += [line] * r.choice([1, 1, 2, 9])
        (tmp_path / "logs" / f"chatlog{f}.txt").write_bytes((b"\xef\xbb\xbf" if f == 1 else b"") + "\r\n".join(lines).encode())
    key = lambda x: (x.file.rsplit("/", 1)[-1], x.line_no, x.text, x.clock, x.at)
    want = sorted(map(key, combat.dated_lines(landing.log_lines(spark, str(tmp_path / "logs"))).collect()))
    assert len(want) > 50
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("1000", "333", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            ranges = log_dating.log_ranges(spark, str(tmp_path / "logs"))
            assert most == size or ranges.select("file", "block").distinct().count() > 10
            assert sorted(map(key, log_dating.dated_ranges(ranges).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
