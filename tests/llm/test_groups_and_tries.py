"""Operators 11 to 13 against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowlog.llm import conversation_trie, lsh_forest, queries, spelling

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)
DOC = "doc_id long, text string, word string, key string, n long, class string"
TURN = "conv_id long, turn long, role string, text string, rank string, depth string"


def docs(spark, rows):
    # extra columns with names that the operators use themselves
    return spark.createDataFrame([(i, t, "w", "k", 1, "c") for i, t in rows], DOC)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    cur = c.execute(queries.ORACLES[name])
    assert [x[0] for x in cur.description] == got.columns
    assert sorted(cur.fetchall(), key=str) == plain(got)


# --- spelling


def variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    n = {w: k for w, k in count.items() if k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    neighbours = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(neighbours[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(neighbours[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def edited(r, w):
    i, c = r.randrange(len(w)), r.choice("abé")
    return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])


def test_variants_equal_brute_force(spark):
    r = random.Random(11)
    base = ["".join(r.choice("abcdé") for _ in range(r.randrange(6, 12))) for _ in range(25)] + ["aaaaaaaa", "abababab", "zzzzzzzzzz" * 40]
    pool = [w for w in base for _ in range(r.choice([1, 30, 300]))] + [edited(r, w) for w in base for _ in range(30)]
    pool += [edited(r, edited(r, w)) for w in base for _ in range(20)] + ["quartett"] * 400 + ["quartetta"] * 33 + ["quartettaa"] * 3
    r.shuffle(pool)
    rows = [(k, " ".join(r.choice([w, w.upper() if w.isascii() else w]) for w in pool[k * 60 : k * 60 + 60])) for k in range(len(pool) // 60 + 1)]
    rows += [(None, None), (7000, ""), (7001, "a-b 12 \n"), (None, rows[0][1]), rows[1], rows[1]]
    want = variants(rows)
    assert len(want) > 150 and any(x[1] and x[2] != x[1] for x in want)  # chains are there
    assert plain(spelling.group_variants(docs(spark, rows))) == want
    # a full bit table lets every candidate through, and the join decides
    assert plain(spelling.group_variants(docs(spark, rows), bits=6, words_per_task=10)) == want


def test_variants_of_nothing(spark):
    assert plain(spelling.group_variants(docs(spark, []))) == []
    assert plain(spelling.group_variants(docs(spark, [(1, None), (2, "short words only")]))) == []


class Table:
    def __init__(self, value):
        self.value = value


@given(st.lists(st.text("abc", min_size=3, max_size=9), min_size=1, max_size=4, unique=True))
@settings(max_examples=60, deadline=None)
def test_neighbourhoods_are_whole_and_distinct(words):
    letters = sorted({ord(c) for w in words for c in w})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words)], ["id", "word"])
    full = Table(np.full(1 << 5, 255, np.uint8).tobytes())
    got = [(x["id"], x["near"]) for b in spelling.neighbour_batches(letters, full, 8, 3)([batch]) for x in b.to_pylist()]
    assert len(got) == len(set(got))
    signs = [chr(x) for x in letters]
    for k, w in enumerate(words):
        want = {w[:i] + c + w[i + e :] for i in range(len(w) + 1) for c in signs for e in (0, 1) if i + e <= len(w)} - {w}
        want |= {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 3 else set()
        assert {x for i, x in got if i == k} == want


def test_codes_of_candidates_are_codes_of_words():
    # a bit table with the very words lets each word's neighbours through, whatever the edit
    words = ["abcdefgh", "abcdefg", "abcdefghi", "xabcdefgh", "abcxefgh", "bcdefgh", "abcddefgh"]
    part = next(spelling.filter_batches(24)([pa.RecordBatch.from_arrays([pa.array(words)], ["word"])]))
    table = np.zeros(1 << 18, np.int64)
    table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array(words[:1])], ["id", "word"])
    got = {x["near"] for b in spelling.neighbour_batches([ord(c) for c in "abcdefghix"], Table(table.tobytes()), 24, 7)([batch]) for x in b.to_pylist()}
    assert got == set(words[1:])


# --- LSH forest


def components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))})
    holders = defaultdict(list)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, own in enumerate(sets):
        common = Counter(j for g in own for j in holders[g])
        for j, n in common.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                up[root(j)] = root(k)
        for g in own:
            holders[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def families(r, n, copies):
    """Texts around the threshold, and unrelated ones that share a long passage."""
    rows, passage = [], " ".join(f"p{k}" for k in range(60))
    for _ in range(n):
        base = [f"w{r.randrange(9000)}" for _ in range(150)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [" ".join(f"u{r.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(60)]
    r.shuffle(rows)
    return [(i, x) for i, x in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"dense": 20, "chunk": 8, "chunk_bytes": 20_000}])
def test_forest_equals_brute_force(spark, options):
    r = random.Random(12)
    rows = families(r, 3, 120) + families(r, 20, 3) + [(9000, None), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "A  b"), (9005, "a\tB")]
    rows += [(None, "a b"), (None, "only without id"), (None, "only without id"), (9006, "w " * 30_000), (9007, "w " * 20_000), (9008, "one two three four five"), (9008, "one two three four five")]
    assert plain(lsh_forest.near_duplicates(docs(spark, rows).repartition(5), **options)) == components(rows)


def test_forest_of_nothing(spark):
    assert plain(lsh_forest.near_duplicates(docs(spark, []))) == []
    assert plain(lsh_forest.near_duplicates(docs(spark, [(3, None), (3, "")]))) == [(3, 0, 3, True)] * 2


def test_planes_miss_almost_nothing():
    # of pairs at the threshold: share of those without a common region of four, and of six values
    r = np.random.default_rng(5)
    shallow = deep = 0
    for _ in range(20):
        same = r.random((20_000, lsh_forest.VALUES)) < 0.85
        shallow += (~same[:, lsh_forest.PLACES[:, :4]].all(axis=2).any(axis=1)).sum()
        deep += (~same[:, lsh_forest.PLACES].all(axis=2).any(axis=1)).sum()
    assert shallow == 0 and deep <= 8
    assert lsh_forest.least_equal(0.85)[-1] < 0.85 * lsh_forest.VALUES


# --- conversation trie


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    for v in own.values():
        v.sort()
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = [x[2:] for x in own.get(c - c % 20, [])[:h]] + [x[2:] for x in v[h:]]
    nodes, children = defaultdict(list), Counter()
    for c, v in path.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(path[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns(spark, rows):
    return spark.createDataFrame([(*x, "r", "d") for x in rows], TURN)


def test_trie_equals_brute_force(spark, monkeypatch):
    # small blocks and pieces, so that hot nodes and long conversations go over many of them
    monkeypatch.setattr(conversation_trie, "PIECE", 8)
    monkeypatch.setattr(conversation_trie, "BLOCK_ROWS", 64)
    r = random.Random(13)
    rows = []
    for c in [*range(0, 70), 200, 203, 2_000_001, -7, -20]:
        same = r.random() < 0.5
        for t in range(r.choice([0, 1, 2, 3, 4, 40, 100])):
            rows.append((c, r.choice([None, t, t]), r.choice(["user", None]), "a b" if same else r.choice(["x y z", None, "q"])))
    rows += [(300 + i, 0, "user", "hot line") for i in range(50)]
    rows += [(300, t, "u", "tail") for t in range(2, 300)] + [(320, t, "u", "tail") for t in range(2, 301)] + [(340, t, "u", "tail") for t in range(2, 1100)]
    rows += [(None, 1, "user", "none")] * 3 + rows[:5]
    assert plain(conversation_trie.build_trie(turns(spark, rows).repartition(5))) == trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert plain(conversation_trie.build_trie(turns(spark, []))) == []
    # the only turn of 41 is among its first three, and 40 is absent: it has none left
    lone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    assert plain(conversation_trie.build_trie(turns(spark, [(lone, 0, "user", "hello you")]))) == trie([(lone, 0, "user", "hello you")])
    assert plain(conversation_trie.build_trie(turns(spark, [(lone, 0, "user", "hello you")])))[0][1:6] == (0, None, 1, 0, 1)
