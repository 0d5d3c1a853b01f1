"""What only shows on larger tables, on small rows made for it."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparrowlog.functions import numbers
from sparrowlog.llm import lsh_forest
from sparrowlog.operators import combat, contracts, ingest, limits, log_dating, mail, process
from sparrowlog.plans import ingest_queries, ingest_unit_queries, lens, process_queries
from sparrowlog.plans.registry import ORACLES, QUERIES
from sparrowlog.sources import landing, tail


def test_large_sizes_have_no_commas(spark):
    rows = spark.createDataFrame([(1023,), (1280,), (5_000_000,)], "n long").select(numbers.size_label(F.col("n")).alias("s"))
    assert [r.s for r in rows.collect()] == ["1023 B", "1.2 KB", "4882.8 KB"]


def test_mean_of_decimals_is_exact(spark):
    """As doubles these sum to less than 2.5 in this order."""
    values = [0.3, 0.2, 0.2, 1.4, 0.4]
    rows = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    assert rows.agg(F.round(numbers.exact_mean(F.col("x"))).alias("m")).first().m == 1.0
    wide = spark.createDataFrame([(1e300,), (3e300,), (None,)], "x double")
    assert wide.agg(numbers.exact_mean(F.col("x")).alias("m")).first().m == 2e300


def test_a_log_in_parts_is_dated_as_one(spark, tmp_path):
    """Parts by number, not by name; repeats, a line of one file with the next, and a midnight between parts."""
    line = "[Combat]  {} X heals Y for {} points"
    texts = ["Logging In [Mon Jan 01 23:00:00 2024]", *[x for i in range(40) for x in [line.format(f"{(23 + i // 10) % 24:02d}:{i % 10:02d}:00", i)] * 2]]
    folder = tmp_path / "file=f0"
    folder.mkdir()
    for at in range(0, len(texts), 8):
        (folder / f"part-{at // 8}-x.txt").write_text("".join(x + "\n" for x in texts[at : at + 8]))
    rows = log_dating.dated_ranges(log_dating.log_ranges(spark, f"file://{tmp_path}", "*.txt", r"^part-(\d+)"))
    whole = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(texts)], "file string, line_no long, text string").withColumn("modified_at", F.lit(dt.datetime(2024, 2, 2)).cast("timestamp_ntz"))
    want = sorted((r.text, r["at"]) for r in combat.dated_lines(whole).collect())
    assert sorted((r.text, r["at"]) for r in rows.collect()) == want
    assert len(want) == 40


def test_a_tail_has_no_more_tasks_than_parts(spark, tmp_path):
    """A batch of any size, cut into few tasks whose lines are those of the file."""
    text = b"".join(b"%d\r\n" % i * (i % 3) for i in range(3000)) + b"\xff\n\nno end"
    (tmp_path / "a.log").write_bytes(text)
    reader = tail.TailReader({"path": f"file://{tmp_path}", "part_bytes": "10", "parts": "7"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) == 7 and max(end.values()) == len(text) - len(b"no end")
    got = [(at, line) for p in parts for batch in reader.read(p) for _, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line.rstrip(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    assert got == want


def test_payloads_of_a_small_file_are_made_by_many_tasks(spark):
    d = "/root/testdata/sf0.001"
    for rows in (process_queries.bounties(spark, d), process_queries.catalogs(spark, d)[1], lens.spread(lens.table(spark, d, "customer"), "c_custkey")):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_contract_formats_end_with_the_text(spark):
    """A line feed after a number or a time is a wrong format, and a number that no double holds is none."""
    from sparrowlog.plans.ingest_unit_queries import BOARD

    cases = [BOARD.replace('"-2"', '"-2\\n"'), BOARD.replace('12:00:00Z"', '12:00:00Z\\n"'), BOARD.replace('"totalScore":3', '"totalScore":' + "9" * 900), BOARD.replace('"id":"b"', '"id":"b","id":"c"')]
    rows = contracts.validate(spark.createDataFrame(list(enumerate(cases)), "i int, payload string"), "leaderboard").orderBy("i").collect()
    assert [r.issues for r in rows] == [["$.entries.1.scoreRaw: wrong format"], ["$.fetchedAt: wrong format"], ["$.totalScore: not a number"], ["$: not JSON"]]


def test_a_pair_of_texts_comes_out_in_the_first_order_that_shows_it():
    """Rows alike in all orders, dealt in one block for each region: only the first order gives the pair, at any depth."""
    same = np.full(128, 7, np.uint8).tobytes()
    label = lambda t: (t << 48) | int.from_bytes(bytes([7] * 6))
    bucket = lambda t, depth: (label(t) >> 8 * (6 - depth)) | depth << lsh_forest.DEPTH_AT
    for depth in (4, 5, 6):
        rows = [(bucket(t, depth), 0, 0, 0, key, key, same) for t in range(32) for key in (1, 2)]
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(["bucket", "lo", "hi", "chunk", "key", "class", "signature"])})
        block = lsh_forest.Block(table)
        left, right = block.survivors(lsh_forest.least_equal(0.85))
        fresh = block.unseen(left, right)
        assert len(left) == 32 and list(lsh_forest.order_of(block.bucket[left[fresh]])) == [0]
        out = pa.Table.from_batches(list(lsh_forest.span_batches(lsh_forest.least_equal(0.85))(table.to_batches())))
        assert sorted(out.column("key").to_pylist()) == [1, 2]


def test_pointers_of_windows_are_few(spark, monkeypatch):
    """Chains without pause: one request in sixteen, not each, is joined in rounds, and the windows are those of a walk."""
    import random

    at = {c: sorted(random.Random(c).sample(range(0, 90 * 60_000), 3000)) for c in range(2)}
    at[2] = [0, 17 * 60_000, 17 * 60_000 + 5, 33 * 60_000 - 1, 33 * 60_000 + 59_000, 34 * 60_000 - 2, 80 * 60_000]
    want = {}
    for c, times in at.items():
        start = None
        for i, t in enumerate(times):
            start = t if start is None or t >= start + 60_000 else start
            want[c, i] = start
    sizes, write = {}, limits.written
    monkeypatch.setattr(limits, "written", lambda df, name: (out := write(df, name), sizes.setdefault(name, out.count()))[0])
    rows = [(c * 10_000 + i, f"c{c}", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t)) for c, times in at.items() for i, t in enumerate(times)]
    got = limits.rate_windows(spark.createDataFrame(rows, "id long, client string, at timestamp_ntz"), 120, 60).collect()
    origin = dt.datetime(2024, 1, 1, 0, 1)
    assert {(r.id // 10_000, r.id % 10_000): round((r.reset - origin).total_seconds() * 1000) for r in got} == want
    assert max(n for name, n in sizes.items() if name != "limit-nodes") < len(rows) / 8


def test_small_files_are_listed_by_tasks(spark, tmp_path):
    """No reader of Spark knows the files' names, so that none are in the driver; folders, hidden names and sizes count as in one."""
    for folder in ("a", "a/b", "a/b/c_d", "_x", "a/.y"):
        (tmp_path / folder).mkdir()
        for name in ("1.mail", "2.mail", ".3.mail", "_4.mail", "5.txt", "6.mail"):
            (tmp_path / folder / name).write_bytes(b"" if name == "6.mail" else f"{folder} {name}".encode() + b"\xff" * (name == "2.mail"))
    rows = landing.mails(spark, f"file://{tmp_path}")
    assert not rows.inputFiles() or not any(x.endswith(".mail") for x in rows.inputFiles())
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mail").load(str(tmp_path)).filter("length > 0")
    names = lambda df, c: sorted("/".join(r[0].split("/")[-2:]) for r in df.select(c).collect())
    assert names(rows, "file") == names(want, "path") and rows.count() == 6
    assert sorted(r[0] for r in rows.select(F.col("raw").cast("binary")).collect()) == sorted(r[0] for r in want.select("content").collect())
    assert sorted(r[0] for r in rows.select("character").distinct().collect()) == ["a", "b", "c d"]


def test_mails_are_read_by_one_worker_a_task(spark):
    """Each Python step of a stage is a worker of its own in each task, and a filter on a trade is no second reading."""
    d = "/root/testdata/sf0.001"
    for rows in (ingest_queries.mail_sales(spark, d), ingest_queries.mail_purchases(spark, d), process_queries.mail_upload(spark, d)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("+- ArrowEvalPython") == 1


def test_trades_are_those_of_all_mails(spark):
    """What is not walked has no trade: any case of letters, in subject or body, and letters that only look alike."""
    texts = [None, "", "1\r\na\r\nVENDOR: V HAS SOLD x TO y FOR 3 CREDITS", "1\na\nb\n\nYou Won The AUCTION of x from y for 1 credit", "1\na\nb\n\nyou PURCHASED x from y for 1,0 credits", "Vendor: v has \u017fold x to y for 3 credits", "so\r\nld to", "You have purchased sold x to y for 9 credits", "auct\u0130on of x from y for 1 credit"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    for kind in ("sale", "purchase"):
        every = mail.with_trades(mail.parse_mails(rows)).filter(F.col(kind).isNotNull()).select("i", "subject", kind)
        assert sorted(mail.trades(rows, kind).select("i", "subject", kind).collect()) == sorted(every.collect())
        assert every.count() > 0


def test_board_states_are_worked_out_once(spark):
    """each snapshot's entries come from one read and one deal of the orders, however often they are compared."""
    for query in (process_queries.entry_revisions, process_queries.board_snapshots):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == 1
        assert plan.count("Exchange") == 3  # the deal, and the newest month's maximum and its broadcast
        assert plan.count("FileScan") == 2


def test_entry_revisions_of_known_and_new_snapshots(spark):
    """A known state and a repeated one give nothing; a participant who missed a snapshot, the current period and null keys neither."""
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [  # board, state, observed, period, participant, rank, new
        ("b", "s1", day(1), "ARCHIVE", "p1", 1, False),
        ("b", "s1", day(1), "ARCHIVE", "p2", 2, False),
        ("b", "s1", day(2), "ARCHIVE", "p1", 9, True),
        ("b", "s2", day(3), "ARCHIVE", "p1", 3, True),
        ("b", "s2", day(4), "ARCHIVE", "p1", 8, True),
        ("b", "s3", day(5), "ARCHIVE", "p1", 3, True),
        ("b", "s3", day(5), "ARCHIVE", "p2", 1, True),
        ("b", "s4", day(6), "ARCHIVE", "p2", 2, True),
        ("b", "s1", day(1), "ARCHIVE", None, 5, False),
        ("b", "s2", day(3), "ARCHIVE", None, 6, True),
        ("c", "s1", day(1), "CURRENT", "p1", 1, False),
        ("c", "s2", day(2), "CURRENT", "p1", 2, True),
        (None, "s1", day(1), "ARCHIVE", "p1", 1, False),
        (None, "s2", day(2), "ARCHIVE", "p1", 2, True),
    ]
    kind = "leaderboard_id string, state_hash string, observed_at timestamp_ntz, source_period_key string, participant_id string, rank int, is_new boolean"
    frame = spark.createDataFrame(rows, kind).selectExpr("*", "TIMESTAMP_NTZ '2024-01-01' AS starts_at", "TIMESTAMP_NTZ '2024-02-01' AS ends_at", "'player' AS subject")
    fresh = process.fresh_states(frame, process.STATE)
    assert sorted((r.leaderboard_id, r.state_hash, r.observed_at.day) for r in fresh.filter("is_new").select("leaderboard_id", "state_hash", "observed_at").distinct().collect()) == [("b", "s2", 3), ("b", "s3", 5), ("b", "s4", 6), ("c", "s2", 2)]
    got = sorted((r.participant_id, r.observed_at.day, r.field, r.old_value, r.new_value) for r in process.entry_revisions(fresh, ["rank"]).collect())
    assert got == [("p1", 3, "rank", "1", "3"), ("p2", 6, "rank", "1", "2")]


def test_ranks_of_equal_doubles_are_those_of_their_decimals(spark, tmp_path):
    """Two totals that are one double and differ by a cent, and two that are equal."""
    big = 9_007_199_254_740_992.0  # doubles lie two apart from here on, so only a sum of decimals can hold a cent more
    orders = [(1, big, "1-URGENT"), (2, big, "1-URGENT"), (2, 0.01, "1-URGENT"), (3, big, "1-URGENT")]
    rows = spark.createDataFrame(orders, "o_custkey long, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.lit(dt.datetime(2024, 1, 30)).cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted((r.participant_id, r["rank"]) for r in lens.observations(spark, str(tmp_path)).collect()) == [("p1", 2), ("p2", 1), ("p3", 2)]


def test_means_on_a_half_are_those_of_the_tables_order(spark, tmp_path):
    """doubles that sum to a half or just below it, by their order; the SQL on one thread adds them as they lie in the file."""
    low = [0.3, 0.2, 0.2, 1.4, 0.4]
    users = {1: low, 2: sorted(low), None: low, 3: [1.0, 2.0], 4: [0.1, 0.2], 5: [None], 6: [0.1] * 35 + [1.4], 7: [2.5e15, 0.5, None]}
    rows = [(i, u, "click", x) for i in range(36) for u, values in users.items() for x in values[i : i + 1]]
    names = ["event_id", "user_id", "event_type", "value"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names), tmp_path / "events.parquet", row_group_size=7)
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = dict(db.execute(f"SELECT user_id, mean FROM ({ORACLES['prj2_mth1_ratios']})").fetchall())
    assert {r.user_id: r["mean"] for r in QUERIES["prj2_mth1_ratios"](spark, str(tmp_path)).collect()} == want
    assert want[1] == want[None] == 0.0 and want[2] == 1.0


def test_uploaded_mails_are_shuffled_once(spark):
    """one deal of mails and archive. A user's known mail is left out whatever its line ends; another user's, one without a user, and
    one whose archived hash is no hash stay, each once."""
    head = "{}\r\nGalaxy.auctioner\r\nTrade\r\nTIMESTAMP: 1700000000\r\n\r\nVendor: v has sold [x] to y for 3 credits"
    text = {n: head.format(n) for n in (1, 2, 3, 4)}
    rows = [("a", text[1], 0), ("a", text[1].replace("\r\n", "\n"), 0), ("a", text[2], 0), ("b", text[2], 0), (None, text[2], 0), (None, text[2], 0), ("a", text[3], 0), ("a", None, 0), ("a", None, 0), ("a", text[4], 5)]
    mails = spark.createDataFrame(rows, "user_id string, raw string, place int").repartition(3)
    hashed = spark.createDataFrame([("a", text[2].replace("\r\n", "\n")), (None, text[2]), ("c", text[4])], "user_id string, raw string").select("user_id", ingest.text_hash(F.col("raw")).alias("fingerprint"))
    archive = hashed.unionByName(spark.createDataFrame([("a", None), ("a", ""), ("a", "zz")], "user_id string, fingerprint string"))
    archive = archive.unionByName(spark.createDataFrame([("a", text[3])], "user_id string, raw string").select("user_id", F.upper(ingest.text_hash(F.col("raw"))).alias("fingerprint")))
    new = mail.upload(archive, mails, dt.datetime(2024, 1, 1))
    got = sorted((r.user_id or "", r.mail_id, r.place, r.sale is not None) for r in new.select("user_id", "mail_id", "place", "sale").collect())
    assert got == [("", "2", 0, True), ("a", "", 0, False), ("a", "1", 0, True), ("a", "3", 0, True), ("a", "4", 5, True), ("b", "2", 0, True)]
    plan = mail.upload(archive, mails.coalesce(1), dt.datetime(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_lines_of_orders_are_shuffled_twice(spark):
    """by part and by order, and not again by customer; the names of customers meet the orders."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lens.sales(spark, "/root/testdata/sf0.001").select("id", "item_name", "buyer", "occurred_at")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan[: plan.index("lineitem.parquet")].splitlines()
    above = [x for i, x in enumerate(lines) if all(len(y) - len(y.lstrip(" :+-")) > len(x) - len(x.lstrip(" :+-")) for y in lines[i + 1 :])]
    assert sum("Exchange hashpartitioning(" in x for x in above) == 2


def test_a_walked_folder_is_that_of_small_files(spark, tmp_path):
    """one task's walk lists and reads what the jobs over folders do."""
    for folder in ("", "a", "a/b", "a/b/c_d", "_x", "a/.y", "e"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for name, size in (("1.mail", 5), ("2.mail", 10), (".3.mail", 5), ("_4.mail", 5), ("5.txt", 5), ("6.mail", 0), ("7.mail", 11)):
            (tmp_path / folder / name).write_bytes((folder + name).encode().ljust(size, b"\xff")[:size])
    for most in (10, None):
        walked = [x for batch in landing.walked(f"file://{tmp_path}", "*.mail", most) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        want = [(r.file, bytes(r.content)) for r in landing.small_files(spark, f"file://{tmp_path}", "*.mail", most).collect()]
        assert sorted(walked) == sorted(want) and len(want) == (10 if most else 15)
    (tmp_path / "none").mkdir()
    assert list(landing.walked(f"file://{tmp_path}/none", "*.mail")) == []


def test_files_of_a_batch_are_dropped_when_read(spark):
    """the disk holds a batch's files, not all, and none when the query has run; the folders of several batches in a task are apart."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {x for x in glob.glob(f"{top}/mails-*/**", recursive=True) if os.path.isfile(x)}
    before, size = files(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        rows = QUERIES["src8_src9_src10_mails"](spark, "/root/testdata/sf0.001").collect()
        paths = spark.range(40).selectExpr("concat('a/b', id % 3, '/', id, '.mail') AS path", "repeat('x', id) AS text")
        read = ingest_unit_queries.passing_files(paths.coalesce(1), "mails", landing.MAILS, 30).collect()
    finally:
        spark.conf.set(size, old)
    assert sorted(r.raw for r in rows) == [f"mail to {x}" for x in sorted(spark.read.parquet("/root/testdata/sf0.001/customer.parquet").filter("c_custkey % 10 NOT IN (3, 4)").toPandas()["c_name"])]
    assert sorted(len(r.content) for r in read) == list(range(1, 31))
    assert files() == before
