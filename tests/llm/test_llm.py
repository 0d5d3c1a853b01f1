import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowlog.llm import common, components, html_text, jaccard, lang_id, lm_score, media_ts, packing, ppm, quality, queries, quotes, tiling, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"
ODD = [None, "", " \n\t ", "a", "Été ☃", "one two", "x" * 30_000, "word " * 9000, "<|endoftext|> b  c\n", "\x00 \x1c", "the same text here again and", "the same text here again and"]


def docs(spark, texts, langs=None):
    # extra columns with names that the operators use themselves
    rows = [(i, t, langs[i] if langs else "en", "s", 0, "row", "key") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture
def empty(spark):
    return docs(spark, [])


def held(n=4):
    return common.remainder(F.col("doc_id"), n) == 2


def words(r, n, pool=500):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


# --- kernels


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_and_shingle_hashes(texts):
    plain = [common.canonical(t.encode()) for t in texts]
    hashes, counts = common.word_hashes(plain)
    flat = [w for t in plain for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in plain] and len(hashes) == len(flat)
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    runs, n = common.shingle_hashes(plain)
    want = [tuple(t.split()[i : i + 5]) for t in plain for i in range(max(len(t.split()) - 4, 1 if t else 0))]
    assert len(runs) == len(want) == n.sum() and len(set(zip(want, runs.tolist(), strict=True))) == len(set(want)) == len(set(runs.tolist()))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in got} and set(got) == {n for e in edges for n in e if e[0] != e[1]}


# --- PPM


def train_trie(texts, order, least=0):
    packed = np.concatenate([ppm.grams([t], order)[0] for t in texts])
    levels = []
    for j in range(order + 1):
        k, n = np.unique(packed & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True)
        levels.append((k[n >= least], n[n >= least]))
    return ppm.Trie(levels, len(packed), len(texts))


@pytest.mark.parametrize("least", [0, 3])
def test_trie_is_a_distribution_and_equals_brute_force(least):
    texts, order = [b"abracadabra", b"abrakadabra banana", b"", b"ban"], 3
    trie = train_trie(texts, order, least)
    table = Counter()
    for t in texts:
        s = [0xFE] * order + list(t) + [0xFF]
        for i in range(order, len(s)):
            for j in range(order + 1):
                table[tuple(s[i - j : i]), s[i]] += 1
    total = Counter()
    for (c, _), n in table.items():
        total[c] += n
    kept = {k: n for k, n in table.items() if n >= least}

    def p(context, symbol):
        out, excluded = 1.0, set()
        for j in range(order, -1, -1):
            c = context[order - j :]
            own = {s: n for (x, s), n in kept.items() if x == c}
            if not own:
                continue
            new = {s: n for s, n in own.items() if s not in excluded}
            left = total[c] - sum(own[s] for s in own if s in excluded)
            if new:
                if symbol in new:
                    return out * (new[symbol] - 0.5) / left
                out *= (left - sum(new.values()) + len(new) / 2) / left
            excluded |= set(own)
        return out / (257 - len(excluded))

    for context in [b"\xfe\xfe\xfe", b"bra", b"ana", b"zzz", b"aba", b"\xfe\xfeb"]:
        packed = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        got = np.exp(trie.logp(packed))
        np.testing.assert_allclose(got, [p(tuple(context), s) for s in range(256)], rtol=1e-9)
        assert 0.99 < got.sum() <= 1 + 1e-9
    memo = ppm.Memo([trie], 4)
    for _ in range(2):
        np.testing.assert_allclose(memo.logp(packed)[:, 0], trie.logp(packed), rtol=1e-5)


@given(st.lists(st.binary(max_size=20).filter(lambda b: not {0xFE, 0xFF} & set(b)), max_size=6), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_grams(texts, order):
    packed, counts = ppm.grams(texts, order)
    want = []
    for t in texts:
        s = b"\xfe" * order + t + b"\xff"
        want += [int.from_bytes(s[i - order : i + 1], "big") for i in range(order, len(s))]
    assert packed.tolist() == want and counts.tolist() == [len(t) + 1 for t in texts]


def test_lm_score(spark):
    r = random.Random(1)
    texts = ODD + [words(r, 60, 80) for _ in range(80)]
    rows = lm_score.score_documents(docs(spark, texts), held(7), frequent_parts=20).collect()
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in split[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda k: np.log10((k + 1) / (n + v + 1))
    assert len(rows) == len(texts)
    for x in rows:
        w = split[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (x.doc_id not in train, len(w) + 1, sum(y in c for y in w) + 1, n)
        assert abs(x.base_score - sum(base(c[y]) for y in w) - base(len(train))) < 1e-6 * len(w) + 1e-9
        assert x.score < 0


def test_lm_score_keeps_rare_contexts(spark):
    r = random.Random(11)
    texts = [words(r, 60, 80) for _ in range(60)] + ["a name seen once: Zsófia Őry", "Zsófia Őry again", *ODD]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    streams = [lm_score.stream((t or "").encode()) for t in texts]
    trie = train_trie([streams[i] for i in train], 5)
    want = [trie.logp(ppm.grams([x], 5)[0]).sum() / np.log(10) for x in streams]
    for parts in (1 << 21, 40, 0):
        got = {x.doc_id: x.score for x in lm_score.score_documents(docs(spark, texts), held(7), parts=parts).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)


def test_lm_score_of_nothing(spark, empty):
    assert lm_score.score_documents(empty, held(7)).count() == 0
    only = lm_score.score_documents(docs(spark, ["a b"]), F.lit(True)).first()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0) and abs(only.score + 5 * np.log10(257)) < 1e-5


# --- language and quality


def test_language(spark):
    r = random.Random(2)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(30))
    kinds = {"aa": ["ba", "la", "ka"], "bb": ["st", "rk", "pf"], "cc": ["éè", "ço", "un"]}
    langs = [r.choice(list(kinds)) for _ in range(150)]
    texts = [make(kinds[x]) for x in langs] + ODD
    rows = lang_id.identify(docs(spark, texts, langs + [None] * len(ODD)), held()).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert 0 <= x.score <= 1
        if x.doc_id < 150:
            assert x.lang_pred == langs[x.doc_id]
        elif not re.search(r"[^\W\d_]", texts[x.doc_id] or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
    none = lang_id.identify(docs(spark, ["a"], [None]), held()).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert lang_id.identify(docs(spark, []), held()).count() == 0


def test_language_keeps_contexts_of_small_languages(spark):
    r = random.Random(12)
    big = [(words(r, 60, 80), "big") for _ in range(60)]
    texts, langs = zip(*big, ("zsófia őry jól van", "small"), ("zsófia jól van ma", None), *[(t, None) for t in ODD], strict=True)
    train = {x: [common.canonical((texts[i] or "").lower().encode()) for i in range(len(texts)) if langs[i] == x and i % 4 != 2] for x in ("big", "small")}
    tries = [train_trie(t, 4) for t in train.values()]
    want = np.array([[t.logp(ppm.grams([common.canonical((x or "").lower().encode())], 4)[0]).sum() for t in tries] for x in texts])
    for parts in (1 << 22, 60, 0):
        rows = {x.doc_id: x for x in lang_id.identify(docs(spark, texts, langs), F.col("doc_id") % 4 == 2, parts=parts).collect()}
        assert rows[61].lang_pred == "small" and len(rows) == len(texts)
        for i, t in enumerate(texts):
            if rows[i].lang_pred != "und":
                size = len(common.canonical((t or "").lower().encode())) + 1
                assert rows[i].bits_per_byte == pytest.approx(-want[i].max() / size / np.log(2), rel=1e-5)


def test_language_ignores_held_out_langs_and_finds_texts_of_no_language(spark):
    r = random.Random(8)
    make = lambda parts, n=40: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["ba", "la", "ka", "mi"], "bb": ["st", "rk", "pf", "eu"]}
    langs = [r.choice(list(kinds)) for _ in range(300)]
    texts = [make(kinds[x], r.choice([1, 5, 40, 80])) for x in langs]
    strange = [make(["xy", "wö", "qu", "zz"]), "".join(r.choice("bcdfghjkmnpqrvwxyz ") for _ in range(300)), "Это текст на другом языке, не на этих", "1234 5678", "", None]
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(306)]
    known = [*langs, *[None] * 6]
    found = lambda given: lang_id.identify(docs(spark, texts + strange, given), held())
    rows = found(known).cache()
    assert sorted(x.doc_id for x in lang_id.without_language(rows).collect()) == list(range(300, 306))
    swapped = found([None if x is None else {"aa": "bb", "bb": "aa"}[x] if out[i] else x for i, x in enumerate(known)])
    key = lambda x: x.doc_id
    assert [x[:7] for x in sorted(rows.collect(), key=key)] == [x[:7] for x in sorted(swapped.collect(), key=key)]
    assert lang_id.without_language(found([None] * 306)).count() == 306 and lang_id.without_language(rows.filter("false")).count() == 0


def test_quality(spark, empty):
    r = random.Random(4)
    good = [r.random() < 0.7 for _ in range(300)]
    texts = [words(r, 40) if g else words(r, 40).upper().replace(" ", "!! ") for g in good]
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(5000, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs(spark, texts + ODD), labels, held(), sample=150).collect()
    assert len(rows) == 300 + len(ODD) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows)
    assert sum(x.predicted == good[x.doc_id] for x in rows if x.held_out and x.doc_id < 300) >= 0.98 * sum(x.held_out for x in rows if x.doc_id < 300)
    assert quality.score_quality(empty, labels, held()).count() == 0
    assert {x.score for x in quality.score_quality(docs(spark, ["a", "b"]), labels.filter("false"), held()).collect()} == {0.5}


def test_quality_equals_brute_force_and_ignores_held_out_labels(spark):
    r = random.Random(14)
    good = [r.random() < 0.6 for _ in range(80)]
    texts = [words(r, 12, 60) if g else words(r, 6, 60) + " spam spam " + words(r, 6, 60) for g in good]
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)]
    labels = [(i, int(g), 0, "x") for i, g in enumerate(good) if i % 5]
    score = lambda rows, **o: {x.doc_id: x.score for x in quality.score_quality(docs(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string"), held(), **o).collect()}
    got = score(labels)
    wrong = score([(i, 1 - q if out[i] else q, t, x) for i, q, t, x in labels] + [(i, None, 0, "x") for i in range(80) if i % 5 == 0] + [(9999, 1, 0, "no document")])
    assert got == wrong, "labels of held-out rows and of no document change nothing"
    maker = quality.Indicators()
    features = [maker.of([t.encode()])[0] for t in texts]
    rows = [i for i in range(80) if not out[i] and i % 5]
    p, q = np.ones(quality.SIZE), np.ones(quality.SIZE)
    for i in rows:
        (p if good[i] else q)[features[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    unit = lambda i: ratio[features[i]] / np.linalg.norm(ratio[features[i]])
    y = np.array([1.0 if good[i] else -1.0 for i in rows])
    fit = lambda keep: quality.descend([(features[rows[k]], unit(rows[k])) for k in keep], y[keep], 1.0, 12)
    margin = np.zeros(len(rows))
    for k in range(3):
        w, b = fit(np.flatnonzero(np.arange(len(rows)) % 3 != k))
        margin[k::3] = [w[features[i]] @ unit(i) + b for i in rows[k::3]]
    (w, b), (slope, offset) = fit(np.arange(len(rows))), quality.logistic(margin, y)
    for i in range(80):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * (w[features[i]] @ unit(i) + b) + offset))), abs=2e-3)
    few = score(labels, sample_bytes=3000)
    assert len(few) == 80 and few != got, "the sample is bounded by bytes too"
    # rows of one id, too large for the bound as a whole, are cut too
    again = docs(spark, [texts[0]] * 400 + texts).withColumn("doc_id", F.when(F.col("doc_id") < 400, F.lit(rows[0])).otherwise(F.col("doc_id") - 400))
    label = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    for bound in (dict(sample_bytes=300_000), dict(sample=60)):
        assert len({x.score for x in quality.score_quality(again, label, held(), **bound).collect()}) > 1


def test_dual_coordinate_descent_separates():
    rows = [(np.array([i % 2], np.int32), np.array([1.0])) for i in range(20)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(20)])
    w, b = quality.descend(rows, y, 1.0, 50)
    assert all(np.sign(w[x] @ v + b) == t for (x, v), t in zip(rows, y, strict=True))


# --- HTML

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy now, this is quite a long advert text.</div><!-- note -->
<article><h1>Head &amp; line</h1><p>First   paragraph<br>goes on, with enough words to count as text.<p>Caf&eacute; &#8364;.</p><aside>Side</aside><ul><li>One item<li>Two item</ul>
<form><p>Name</p><input></form><div id="comments"><p>A reader says something long and pointless here.</p></div></article><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph goes on, with enough words to count as text.\n\nCafé €.\n\nOne item\n\nTwo item"
    assert html_text.main_text("<nav>menu</nav>") == html_text.main_text("") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>short</p><div class=menu>" + "x" * 99 + "</div>") == "short"


def test_html_long_blocks_do_not_hide_the_others():
    for n_long in (1, 3):
        texts = (["a" * 100] * 10 + ["b" * 10_000]) * n_long + ["a" * 100] * 10
        assert html_text.main_text("".join(f"<p>{x}</p>" for x in texts)) == "\n\n".join(texts)
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(30))
    text = ["word " * 29 + "word"] * 8
    assert html_text.main_text(f"<div>{links}</div>{''.join(f'<p>{x}</p>' for x in text)}<div>{links}</div>") == "\n\n".join(text)


@pytest.mark.parametrize("html, text", [("<p>a</p><![foo[ x ]]>b", "a\n\nb"), ("<![if !IE]>a<![endif]>", "a"), ("<p>x<![CDATA[ y ]]>z", "xz"), ("<p>a</p><!x y><!>b", "a\n\nb"), ("a<b", "a<b"), ("<p>a&#0;&#xD800;&bogus;</p></p></div>b", None)])
def test_html_malformed(html, text):
    assert text is None and html_text.main_text(html) or html_text.main_text(html) == text
    html_text.main_text("<!["), html_text.main_text("<!"), html_text.main_text("<")


def article(r, paragraphs):
    return [" ".join(r.choice(["word", "longer", "a", "sentence"]) for _ in range(r.choice([2, 30, 60]))) + "." for _ in range(paragraphs)] + ["so " * 50 + "it ends."]


def test_html_ratios_choose_the_region(monkeypatch):
    """Without article, main or any telling class; the lists that veto elements are switched off."""
    r = random.Random(2)
    for n in range(3, 12):
        text = article(r, n)
        menu = "".join(f"<li><b>{i}</b> <a href=/{i}>of the menu</a></li>" for i in range(20))
        page = f"<body><div><ul>{menu}</ul></div><div><h1>Title here</h1>{''.join(f'<p>{x}</p>' for x in text)}</div><div><span><i>Terms</i></span> <b><a href=x>Contact</a></b></div></body>"
        want = "\n\n".join(["Title here", *text])
        assert html_text.main_text(page, veto=False) == want
        with monkeypatch.context() as m:  # without the curve all lines weigh the same, and the menu wins
            m.setattr(html_text, "smooth", lambda ratios, sigma: np.ones(len(ratios)))
            m.setattr(np, "log1p", lambda x: np.ones(len(x)))
            if n < 10:
                assert html_text.main_text(page, veto=False) != want


def test_html_article_pages_need_no_lists(spark):
    pages = [x.html for x in queries.read(spark, "/root/testdata/sf0.01", "pages").collect()]
    same = [html_text.main_text(x or "") == html_text.main_text(x or "", veto=False) for x in pages]
    assert np.mean(same) > 0.99


def test_html_headings_and_link_blocks():
    body = "<p>" + "word " * 60 + "</p>"
    links = "".join(f"<li><a href=x>Link {i} to another page</a></li>" for i in range(6))
    want = "Title\n\n" + ("word " * 60).strip()
    assert html_text.main_text(f"<h1>Title</h1><div>{body}<ul>{links}</ul></div>") == want
    two = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(2))  # two linked lines may be text
    assert html_text.main_text(f"<h1>Title</h1><div>{body}<ul>{two}</ul></div>") == want + "\n\nLink 0\n\nLink 1"


LONG = "word " * 60
HELD = f"<p>{LONG}</p>", LONG.strip()


@pytest.mark.parametrize("name", ["article-comments", "ad-container", "post-footer", "entry-share", "sponsored-content"])
def test_html_unwanted_word_of_a_class_name_counts(name):
    p, text = HELD
    assert html_text.main_text(f"<article>{p}<div class={name}><p>Something long and quite pointless to read here, said by nobody.</p></div>{p}</article>") == f"{text}\n\n{text}"
    for kept in ("entry-content", "article main", "has-sidebar", "content-with-ads"):
        assert html_text.main_text(f"<div class='{kept}'>{p}</div>") == text


def test_html_sections_without_telling_names(monkeypatch):
    p, text = HELD
    voices = "".join(f"<div><p><a href=/u{i}>User {i}</a> <time>today</time></p><p>I think that this is all very well said and true, number {i}.</p></div>" for i in range(3))
    assert html_text.main_text(f"<article>{p}<section class=zone><h3>3 voices</h3><div>{voices}</div></section></article>") == text
    share = "<div class=zz><span><i>Share</i></span> <span><i>Send it</i></span></div>"
    body = "\n\n".join([text] * 5)
    assert html_text.main_text(f"<article>{p * 5}{share}</article>") == body
    with monkeypatch.context() as m:  # a flat curve puts all in clusters, and the bar stays
        m.setattr(html_text, "smooth", lambda ratios, sigma: np.ones(len(ratios)))
        assert html_text.main_text(f"<article>{p * 5}{share}</article>") == f"{body}\n\nShare Send it"
    parts = "".join(f"<section><h2>Part {i}</h2><p>A short text {i}.</p></section>" for i in range(3))
    assert html_text.main_text(f"<article>{p}<div>{parts}</div></article>") == text + "".join(f"\n\nPart {i}\n\nA short text {i}." for i in range(3))
    linked = "".join(f"<li><a href=/{i}>Source {i}</a>" for i in range(4))
    assert html_text.main_text(f"<article>{p}<ul>{linked}</ul></article>") == text + "".join(f"\n\nSource {i}" for i in range(4))
    assert html_text.main_text(f"<body>{p}{p}<p>Copyright 2024 Some Company</p></body>") == f"{text}\n\n{text}"


def test_html_link_only_pages_and_long_runs_of_open_tags():
    assert html_text.main_text("<p><a href=/>all</a></p>") == "all" and html_text.main_text("<p></p>") == ""
    assert html_text.main_text("a<b") == "a<b" and html_text.main_text("<p>a</p>b &amp; c<!-- d") == "a\n\nb & c"
    began = time.time()
    for page in ("<a " * 20_000, "<a " * 20_000 + ">", "<!-- " * 20_000, '<a href="' * 20_000, "<div>x" * 20_000, "<ul><li><a href=x>z</a>" * 10_000, "</a " * 20_000):
        html_text.main_text(page)
    assert time.time() - began < 30


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "<p>" + "y " * 50_000, "x")], "page_id long, url string, html string, text string")
    rows = {(x.page_id, x.url): x for x in html_text.extract_text(pages).collect()}
    assert rows[2, None].text == "" and rows[None, "v"].n_chars == 99_999 and rows[1, "u"].n_chars == len(rows[1, "u"].text)
    assert html_text.extract_text(pages.filter("false")).count() == 0


# --- near duplicates


def brute_classes(texts):
    runs = []
    for t in texts:
        w = (t or "").encode().lower().split()
        runs.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))))
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    reps, up, links = sorted(first.values()), list(range(len(texts))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            if runs[a] and runs[b] and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= 0.8 - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (root(first[t or ""]), links[first[t or ""]], sum((u or "") == (t or "") for u in texts)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("chunk", [512, 7])
def test_jaccard(spark, chunk):
    r = random.Random(5)
    texts = list(ODD)
    for size in (40, 120, 300):
        own = words(r, size, 10_000).split()
        for _ in range(25):
            w = list(own)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [words(r, 50, 10_000) for _ in range(60)]
    rows = jaccard.similar_documents(docs(spark, texts), chunk=chunk).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in rows} == brute_classes(texts)


def test_jaccard_edges(spark, empty):
    assert jaccard.similar_documents(empty).count() == 0
    rows = jaccard.similar_documents(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links, x.n_copies) for x in rows if x.doc_id) == [(3, 3, 0, 2), (4, 3, 0, 2)] and len(rows) == 4


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard.least_matches(0.8, 1e-5)
    p, n = 0.8 + 0.2 / 256, np.arange(16, 129, 16)
    draws = np.random.default_rng(0).random((20_000, 128)) < p
    assert (draws.cumsum(axis=1)[:, n - 1] >= need).all(axis=1).mean() > 0.999
    assert need[-1] > 64, "pairs of half the threshold are dropped"


# --- tiling


def brute_tiles(doc, item, least):
    """Longest unmarked common run first, ties by place."""
    in_doc, in_item, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in in_doc and q + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        in_doc |= set(range(p, p + n))
        in_item |= set(range(q, q + n))
        out.append((p, q, n))


@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_tiles(a, b):
    assert tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tiles(a, b, 3)


def test_tiles_of_periodic_texts_are_fast():
    """One of 20,000 words with a period against items of 205 and 2,000 words of the same period, with breaks."""
    period = np.arange(1, 8, dtype=np.uint64)
    doc = np.tile(period, 3000)[:20_000]
    item = np.tile(period, 300)[:2000].copy()
    item[::97] = np.arange(100, 100 + len(item[::97]), dtype=np.uint64)
    began = time.time()
    assert sum(t[2] for t in tiling.tile(doc, np.tile(period, 40)[:205], 4)) == 205
    assert sum(t[2] for t in tiling.tile(doc, item, 4)) == 2000 - len(item[::97])
    assert sum(t[2] for t in tiling.tile(np.ones(20_000, np.uint64), np.ones(2000, np.uint64), 4)) == 2000
    assert time.time() - began < 5


def test_contaminated(spark, empty):
    r = random.Random(6)
    items = [" ".join(f"i{k}x{j}" for j in range(20)) for k in range(30)] + ["too short", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[3].split()
    texts = [words(r, 200) + " " + items[5].upper().replace(" ", ", ") + " " + words(r, 50), " ".join(w[10:]) + " between " + " ".join(w[:10]), " ".join(w[:9]), words(r, 300), "is too, short", *ODD]
    more = bench.unionByName(spark.createDataFrame([(5, items[5]), (None, items[5]), (77, items[5])], bench.schema)).withColumn("doc_id", F.lit("clash"))
    for size in (16_000_000, 500):  # by broadcast, and by a shuffle join of seeds
        rows = tiling.contaminated(docs(spark, texts), bench, most_bytes=size).collect()
        assert sorted((x.doc_id, x.item_id, x.tiles, x.coverage) for x in rows) == [(0, 5, 1, 1.0), (1, 3, 2, 1.0), (4, 30, 1, 1.0)]
        assert {x.text_md5 for x in rows} == {hashlib.md5(texts[i].encode()).hexdigest() for i in (0, 1, 4)}
        rows = tiling.contaminated(docs(spark, texts), more, most_bytes=size).collect()
        assert sorted(str((x.doc_id, x.item_id)) for x in rows) == sorted(["(0, 5)", "(0, 5)", "(0, None)", "(0, 77)", "(1, 3)", "(4, 30)"])
    assert tiling.contaminated(empty, bench).count() == tiling.contaminated(docs(spark, texts), bench.filter("false")).count() == 0


# --- packing, counts and media


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.lists(st.text(st.sampled_from("ab é'ſ\n\t 1!<|\x1c　"), max_size=25), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    code, whole = packing.coder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    for t in [*texts, "x <|endoftext|> y", "it's they'LL don't"]:
        assert np.frombuffer(code.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(spark, paths):
    from tokenizers import Tokenizer

    r = random.Random(7)
    texts = ODD + [words(r, r.choice([3, 30, 200, 900])) for _ in range(120)]
    rows = packing.pack_documents(docs(spark, texts), *paths, items_per_task=40, fan_in=2).collect()
    whole, pieces, bins = Tokenizer.from_file(paths[0]), {}, {}
    for x in rows:
        assert (x.doc_id, x.piece) not in pieces
        pieces[x.doc_id, x.piece] = x
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids, at, k = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0, 0
        while (i, k) in pieces:
            x = pieces[i, k]
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes()) and (k == 0 or x.length == 2048)
            at, k = at + x.length, k + 1
        assert at == len(ids) and k == -(-len(ids) // 2048)
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(x.length for x in rows) / 2048 + 1


@pytest.mark.parametrize("short", [0, 150])
def test_packing_leaves_no_task_with_all_that_is_open(spark, short):
    lengths = [1100 + i for i in range(400)] + [300] * short
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack_pieces(pieces, items_per_task=20).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(lengths))
    bins, tasks = Counter(), {}
    for x in rows:
        bins[x.sequence_id] += x.length
        tasks.setdefault(x.sequence_id >> 32, set()).add(x.sequence_id)
    assert max(bins.values()) <= 2048 and len(bins) <= 1.1 * 400
    assert max(map(len, tasks.values())) <= 2 * 20, "a round and task emits what one task may hold"
    alone = packing.pack_pieces(pieces, items_per_task=10**6).select("sequence_id").distinct().count()
    assert len(bins) <= alone + -(-len(lengths) // 20), "stopping costs a sequence a task at most"


def test_packing_of_nothing(empty, paths):
    assert packing.pack_documents(empty, *paths).count() == 0


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert sum(sum(lengths[i] for i in b) <= 25 for b in bins) <= 1


def test_token_counts(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    whole = Tokenizer.from_file(path)
    want = {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in enumerate(ODD)}
    for _ in range(2):
        rows = token_counts.count_tokens(odd, path, cache).collect()
        assert {x.doc_id: x.n_tokens for x in rows} == want
        assert all(x.n_bytes == len((ODD[x.doc_id] or "").encode()) and x.over_limit == (x.n_tokens > 2048) for x in rows)
        assert spark.read.parquet(cache).count() == 9, "distinct contents are encoded once and kept"
    more = token_counts.count_tokens(docs(spark, ["one  two\n", "new text"]), path, cache).collect()
    assert [x.n_tokens for x in sorted(more, key=lambda x: x.doc_id)] == [want[5], 2]
    assert spark.read.parquet(cache).count() == 10
    assert token_counts.count_tokens(empty, path, cache).count() == 0


@given(st.text(st.sampled_from("ab É1́' \n\t<|>\x1c"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = re.sub(r"[ \t\n\r]+", " ", text).strip(" ")
    assert token_counts.counts_of([plain], path) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))]


@given(st.binary(max_size=40_000))
@settings(max_examples=60, deadline=None)
def test_transport_stream_round_trip(data):
    media = media_ts.encode(media_ts.pad(data))
    x = media_ts.decode(media)
    assert x["payload"] == data.ljust(max(192, -(-len(data) // 192) * 192)) and x["continuity_errors"] == 0 and x["stream_type"] == 6
    assert x["timestamps"] == [3600 * i for i in range(len(x["timestamps"]))] and len(media) == 188 * x["packets"]


def test_every_stuffing_length():
    for n in range(1, 400):
        assert media_ts.decode(media_ts.encode(b"z" * n))["payload"] == b"z" * n


def test_broken_streams():
    media = bytearray(media_ts.encode(media_ts.pad(b"q" * 90_000)))
    assert len(media_ts.decode(bytes(media))["random_access"]) == 2
    assert media_ts.decode(bytes(media[: 188 * 5] + media[188 * 6 :]))["continuity_errors"] == 1
    assert media_ts.decode(bytes(media[: 188 * 5] + media[188 * 4 : 188 * 5] + media[188 * 5 :]))["payload"] == media_ts.pad(b"q" * 90_000)
    cut = bytearray(media[: 188 * 5] + media[188 * 6 :])
    payload = cut[188 * 5 : 188 * 6]
    cut[188 * 5 : 188 * 6] = payload[:3] + bytes([payload[3] | 0x20, 1, 0x80]) + payload[4:186]  # flagged as a discontinuity
    assert media_ts.decode(bytes(cut))["continuity_errors"] == 0
    media[12] ^= 1
    with pytest.raises(ValueError):
        media_ts.decode(bytes(media))


def test_media_sections_over_packets_and_several_programs():
    programs = b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in [(0, 0x10), (7, 0x100), *[(k, 0x200) for k in range(8, 70)]])
    pat = media_ts.section(0, 1, programs)
    first = bytes([0x47, 0x40, 0, 0x10, 0]) + pat[:183]
    rest = (bytes([0x47, 0, 0, 0x11]) + pat[183:]).ljust(188, b"\xff")
    media = media_ts.encode(media_ts.pad(b"text"))
    x = media_ts.decode(first + rest + media[188:])
    assert x["payload"] == media_ts.pad(b"text") and x["continuity_errors"] == 0


def test_damaged_media_give_errors_not_failures(spark):
    good = media_ts.encode(media_ts.pad(b"q" * 3000))
    bad = [None, b"", b"x", b"G" * 188, good[:-1], b"\0" + good[1:], good[:20] + b"\0" + good[21:], good[188 * 2 :], good[:188] + good[188 * 2 :], bytes([0x47, 0x40, 0, 0x30, 183]) + b"\0" * 183]
    r = random.Random(1)
    for _ in range(200):
        x = bytearray(good)
        x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        assert len(media_ts.features(bytes(x))) == 10
    rows = media_ts.read_documents(spark.createDataFrame([(i, 1, m) for i, m in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")).collect()
    assert [x.doc_id for x in rows if x.error is None] == [len(bad)] and len(rows) == len(bad) + 1
    assert all(x.payload_sha256 is None and (x.media_bytes is None) == (bad[x.doc_id] is None) for x in rows if x.error)


def test_packing_ids_are_the_library_s_over_a_whole_corpus(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {x.doc_id: x.text or "" for x in queries.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    for x in queries.op4_packing(spark, "/root/testdata/sf0.01").collect():
        assert x.ids_crc32 == zlib.crc32(want[x.doc_id][x.start : x.start + x.length].tobytes())


def test_media_rows(spark, odd, empty):
    rows = media_ts.read_documents(media_ts.store_documents(odd)).collect()
    for x in rows:
        data = media_ts.pad((ODD[x.doc_id] or "").encode())
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert len({x.media_sha256 for x in rows if x.doc_id in (0, 1)}) == 1
    assert media_ts.read_documents(media_ts.store_documents(empty)).count() == 0


# --- quotes


def brute_replies(rows):
    """Of rows in order (conv, turn, role, text): parent's place, depth and reply order, conversation by conversation."""
    norm = lambda t: " ".join(t.lower().split())
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(("own", k) if row[0] is None else row[0], []).append(row)
    out = []
    for group in groups.values():
        group.sort(key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", hashlib.md5((x[3] or "").encode()).hexdigest()))
        parsed = [quotes.parse(x[3] or "") for x in group]

        def pieces(text):
            parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
            return [norm(p) for i, p in enumerate(parts) if len(p.split()) >= (3 if i else 1)]

        parents, branch, depth = [], [], []
        for k, (_, passages) in enumerate(parsed):
            best = None
            for place, (level, text) in enumerate(passages):
                for unit in pieces(text):
                    found = next((j for j in range(len(parsed)) if unit in pieces(parsed[j][0])), None)
                    if found is not None and found < k and (best is None or (level, -len(unit.split()), place) < best[0]):
                        best = ((level, -len(unit.split()), place), found)
            parent = best[1] if best else (k - 1 if k else None)
            parents.append(parent)
            new = parent is not None and parent < k - 1
            branch.append(k if new or not k else branch[k - 1])
            depth.append(depth[parent] + 1 if new else (depth[k - 1] if k else 0))

        order = []

        def visit(head, order=order, branch=branch, parents=parents):
            chain = [i for i in range(len(branch)) if branch[i] == head]
            order += chain
            for i in reversed(chain):
                for h in [h for h in range(len(branch)) if branch[h] == h and parents[h] == i and h]:
                    visit(h)

        visit(0)
        for k, row in enumerate(group):
            out.append((row[0], row[1], row[2], parsed[k][0], None if parents[k] is None else order.index(parents[k]) + 1, depth[k], order.index(k) + 1))
    return sorted(out, key=str)


def chat(r, n_convs, odd=True):
    rows = []
    for c in range(n_convs):
        said = []
        for turn in range(r.choice([1, 3, 9])):
            own = "\n".join(words(r, r.choice([1, 3, 4]), 30) for _ in range(r.choice([1, 2, 3])))
            text = own
            if said and r.random() < 0.7:
                old = r.choice(said).split("\n")
                quoted = r.sample(old, r.randrange(1, len(old) + 1))
                text = "On Monday A wrote:\n" + "\n".join(r.choice(["> ", ">> "]) + x.upper() for x in quoted) + "\n" + own
            said.append(own)
            rows.append((c, turn, r.choice(["user", "assistant"]), text))
    if odd:
        rows += [(None, 1, "user", "alone"), (None, None, None, None), (0, None, "user", "> late\nno turn"), (0, 0, None, None), (0, 1, "user", "same"), (0, 1, "user", "same"), (99, 0, "user", ""), (99, 1, "user", "> "), (99, 2, "user", "x " * 50_000)]
    return rows


CHAT = "conv_id long, turn long, role string, text string, rank string, first string"


def test_parse_quotes():
    assert quotes.parse("Hi\n> With  FLOUR.\n>> And cake?\nWhich flour?") == ("Hi\nWhich flour?", [(1, "With  FLOUR."), (2, "And cake?")])
    assert [d for d, _ in quotes.parse("> a\n> b\n>> c\n> d")[1]] == [1, 2, 1]
    assert quotes.parse("On Monday A wrote:\n> a\n>\n> b\nyes") == ("yes", [(1, "a\n\nb")])
    assert quotes.parse("") == ("", [])


def test_trimmed_quotes_find_their_original(spark):
    text = "The first line is here\nand a second line too\n\nAnother paragraph of the message\n\nAnd a third one follows now"
    rows = [(1, 0, "a", "Opening words of it"), (1, 1, "b", text), (1, 2, "a", "something else entirely"), (1, 3, "c", "> and a second line too\nyes"), (1, 4, "c", "> Another paragraph of the message\n> And a third one follows now\nno"), (2, 0, "a", "> Opening words of it\nanother conversation")]
    got = {(x.conv_id, x.turn): (x.parent_turn, x.depth, x.position) for x in quotes.link_quotes(spark.createDataFrame([(*x, "", "") for x in rows], CHAT)).collect()}
    assert got == {(1, 0): (None, 0, 1), (1, 1): (0, 0, 2), (1, 2): (1, 0, 3), (1, 3): (1, 1, 4), (1, 4): (1, 1, 5), (2, 0): (None, 0, 1)}


@pytest.mark.parametrize("block", [100_000, 7])
def test_link_quotes_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK_ROWS", block)
    rows = chat(random.Random(block), 25)
    got = quotes.link_quotes(spark.createDataFrame([(*x, "clash", "clash") for x in rows], CHAT)).collect()
    assert sorted([(x.conv_id, x.turn, x.role, x.text, x.parent_position, x.depth, x.position) for x in got], key=str) == brute_replies(rows)
    assert sum(x.depth > 0 for x in got) > 20 and max(x.depth for x in got) > 1
    assert all(json.loads(x.message).get("content") == x.text for x in got)
    assert quotes.link_quotes(spark.createDataFrame([], CHAT)).count() == 0


def test_branches_that_hang_on_branches_cost_a_fixed_size_each(spark):
    """Every message quotes the one two before, so messages 2, 4, ... and 3, 5, ... are two chains of branches."""
    n = 1500
    own = [f"This is what message number {k} says" for k in range(n)]
    rows = [(1, k, "a", own[k] if k < 2 else f"> {own[k - 2]}\n{own[k]}") for k in range(n)]
    before = {d.name for d in Path(common.shared_dir(spark).removeprefix("file://")).iterdir()}
    got = {x.turn: (x.parent_turn, x.depth, x.position) for x in quotes.link_quotes(spark.createDataFrame([(*x, "", "") for x in rows], CHAT)).collect()}
    odd = (n - 2) // 2
    want = {k: (k - 2, k // 2, 2 + k // 2 if k % 2 else 2 + odd + k // 2) for k in range(2, n)} | {0: (None, 0, 1), 1: (0, 0, 2)}
    assert got == want
    new = [d for d in Path(common.shared_dir(spark).removeprefix("file://")).iterdir() if d.name not in before]
    assert sum(f.stat().st_size for d in new for f in d.glob("*.parquet")) < 3000 * n


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs_, taken = queries.read(spark, "/root/testdata/sf0.001", "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs_
        docs_ = common.materialise(stage(spark, docs_, "/root/testdata/sf0.001"), "stage")
        taken.append((name, before.count(), docs_.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs_.columns == before.columns
        if "Jaccard" in name:
            want = brute_classes([r.text for r in before.orderBy("doc_id").collect()])
            ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
            assert sorted(r.doc_id for r in docs_.collect()) == sorted({ids[c] for c, _, _ in want.values()})
    assert all(a >= b > 0 for _, a, b in taken[:-1]) and taken[0][1] > taken[3][2]
    assert {r.doc_id for r in docs_.collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == taken[-1][2]


def test_decisions_are_on_an_id_and_its_text(spark):
    import corpus_pipeline

    d = docs(spark, ["a", "b", "a", None, "", "c"]).withColumn("doc_id", F.expr("CASE WHEN doc_id = 5 THEN 5 WHEN doc_id > 2 THEN NULL ELSE 1 END"))
    gone = d.filter("text = 'a' OR text IS NULL").select("doc_id", F.md5(common.utf8(F.col("text"))).alias("text_md5"))
    assert sorted(x.text for x in corpus_pipeline.drop(d, gone).collect()) == ["b", "c"]  # null is the empty text
    assert corpus_pipeline.drop(d, gone.filter("false")).count() == 6


def test_near_copies_go_by_their_own_id_and_text(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-k], *[f"x{i}" for i in range(k)]])
    rows = [(1, " ".join(base)), (None, near(1)), (None, "nothing like it at all but without an id"), (5, near(2)), (5, "a text of its own under a used id"), (7, near(1)), (None, "twice without an id"), (None, "twice without an id"), (1, near(2)), (1, " ".join(base))]
    rows += [(None, "alone a b c d e f g h i j k l m n o p q r s t u v w x y z " + x) for x in ("one", "two")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((x.doc_id, x.text) for x in corpus_pipeline.duplicate_stage(spark, d, "").collect()), key=str)
    alone = [x for x in kept if (x[1] or "").startswith("alone")]
    named = min(rows[0], rows[8], key=lambda x: hashlib.sha256(x[1].encode()).digest())  # of two texts of the least id
    assert len(alone) == 1 and sorted((x for x in kept if x not in alone), key=str) == sorted([named, rows[2], rows[4], rows[6]], key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, stage):
    import corpus_pipeline

    for texts in (ODD, []):
        d = docs(spark, texts)
        out = corpus_pipeline.STAGES[stage][1](spark, d, "/root/testdata/sf0.001")
        assert out.count() <= max(len(ODD), 100)
