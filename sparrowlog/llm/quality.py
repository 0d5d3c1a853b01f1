"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: of its bytes (one to three, the longest hashed), of its words (one and two,
hashed), and, of the sequence that says of each word whether it equals the one before, the n-grams of 1, 2, 4 and 8 times
"equal", which find repetition of any word. Each indicator is scaled by the log-count ratio of the two classes (add-one
smoothed, so one seen in few documents has little weight), counted over all labelled training texts in Spark; the scaled
vector has unit length. A linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of training rows:
at most ``sample`` of those with a document, lowest hash of the id first, and at most ``sample_bytes`` of features of these.
Its margin becomes a probability by a logistic curve fitted to margins of held-back folds; folds and model are fitted in
tasks of their own.

Null and empty texts have the features of no n-gram but the border, and get a score like any other. Repeated rows count as
often as they occur. With no training row of one class the score is the share of the other. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import U64, canonical, materialise, mix, slices, utf8, word_hashes

BITS, WORD_BITS = 18, 18
RUNS = (1, 2, 4, 8)
WORDS = (1 << BITS) + len(RUNS)
SIZE = WORDS + (1 << WORD_BITS)
STATS = "kind byte, key long, good long, bad long, features binary"


class Indicators:
    """Sorted feature numbers of texts."""

    def __init__(self):
        self.flags = np.zeros(1 << BITS, bool)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        words, counts = word_hashes([canonical(x) for x in texts])
        begins = np.cumsum(counts) - counts
        return [self.one(x, words[b : b + n]) for x, b, n in zip(texts, begins, counts, strict=True)]

    def one(self, text: bytes, words: np.ndarray) -> np.ndarray:
        a = np.frombuffer(b"\n" + text + b"\n", np.uint8).astype(np.uint32)
        two = (a[:-1] << 8) | a[1:]
        three = (a[:-2] << 16) | two[1:] if len(a) > 2 else a[:0]
        hashed = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS + 1)
        self.flags[a] = True
        self.flags[two ^ 0x10000] = True
        self.flags[hashed | (1 << BITS - 1)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        same = np.concatenate([[False], words[1:] == words[:-1], [False]]) if len(words) else np.zeros(1, bool)
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        pairs = mix(words[:-1] * U64(3) + words[1:])
        spoken = np.unique((np.concatenate([words, pairs]) >> U64(64 - WORD_BITS)).astype(np.int32))
        return np.concatenate([found, [(1 << BITS) + i for i, n in enumerate(RUNS) if longest >= n], WORDS + spoken]).astype(np.int32)


def train_batches(batches):
    """A map over (doc_id, utf8, label, sampled): document counts of features by class, and the features of sampled rows."""
    good, bad, maker, sampled = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64), Indicators(), []

    def rows(kind, key, a, b, features):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.int8()), pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(features, pa.binary())], ["kind", "key", "good", "bad", "features"])

    for batch in batches:
        texts, labels, keep = (batch.column(i).to_pylist() for i in (1, 2, 3))
        for a, b in slices([len(x) for x in texts], 2_000_000):
            found = maker.of(texts[a:b])
            for x, y in zip(found, labels[a:b], strict=True):
                (good if y else bad)[x] += 1
            sampled = [i for i in range(a, b) if keep[i]]
            if sampled:
                yield rows(1, [batch.column(0)[i].as_py() for i in sampled], [labels[i] for i in sampled], [1 - labels[i] for i in sampled], [found[i - a].tobytes() for i in sampled])
    keys = np.flatnonzero(good + bad)
    if len(keys):
        yield rows(0, keys, good[keys], bad[keys], [None] * len(keys))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with the bias as one more feature."""
    w, bias, alpha, rng = np.zeros(SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    square = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b, goal = 1.0, 0.0, np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, d = p - goal, p * (1 - p) + 1e-9
        g = np.array([r @ margin + 1e-3 * a, r.sum() + 1e-3 * b])
        h = np.array([[d @ margin**2 + 1e-3, d @ margin], [d @ margin, d.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_batches(shared, cost: float, epochs: int, folds: int):
    """A map over (fold): the model fitted without that fold, and the margins of the fold's rows; fold -1 is fitted on all."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ratio, features, y = shared.value
                rows = [(x, unit(ratio, x)) for x in (np.frombuffer(f, np.int32) for f in features)]
                inside, outside = ([i for i in range(len(rows)) if (i % folds == k) == held] for held in (False, True))
                w, bias = descend([rows[i] for i in inside], y[inside], cost, epochs)
                margins = np.array([w[x] @ v + bias for x, v in (rows[i] for i in outside)])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.astype(np.float32).tobytes() if k < 0 else b""]), pa.array([bias]), pa.array([margins.tobytes()])], ["fold", "weights", "bias", "margins"])

    return run


def fit(spark, ratio: np.ndarray, features: list[bytes], y: np.ndarray, cost: float = 1.0, epochs: int = 12, folds: int = 3) -> tuple[np.ndarray, float, float, float]:
    shared = spark.sparkContext.broadcast((ratio, features, y))
    table = spark.range(-1, folds, 1, folds + 1).mapInArrow(fit_batches(shared, cost, epochs, folds), "fold long, weights binary, bias double, margins binary").toArrow().to_pylist()
    margin, models = np.zeros(len(y)), {r["fold"]: r for r in table}
    for k in range(folds):
        margin[k::folds] = np.frombuffer(models[k]["margins"])
    return np.frombuffer(models[-1]["weights"], np.float32), models[-1]["bias"], *logistic(margin, y)


def unit(ratio: np.ndarray, x: np.ndarray) -> np.ndarray:
    v = ratio[x]
    return v / math.sqrt(float(v @ v) + 1e-12)


def score_batches(model):
    """A map over (doc_id, held_out, utf8, text_md5); model: broadcast (ratio, weights, bias, slope, offset) or a constant."""

    def run(batches):
        maker, fitted = Indicators(), model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(x) for x in texts], 2_000_000):
                if isinstance(fitted, float):
                    score = np.full(b - a, fitted)
                else:
                    ratio, weights, bias, slope, offset = fitted
                    margin = np.array([weights[x] @ unit(ratio, x) + bias for x in maker.of(texts[a:b])])
                    score = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score.astype(np.float64)), pa.array((score >= 0.7).astype(np.int32)), batch.column(3).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "text_md5"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 9000, sample_bytes: int = 128_000_000):
    """Fit on rows of ``docs`` (doc_id, text) that have a label in ``labels`` (doc_id, quality); returns the model."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    order, ids = F.xxhash64("doc_id"), docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    last = known.join(ids, "doc_id", "left_semi").select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    known = known.withColumn("sampled", order <= F.lit(last if last is not None else 0))
    # labels grow with the documents, so they meet by one shuffle at every size and are never broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data")).join(known.hint("merge"), "doc_id").select("doc_id", "data", "label", "sampled")
    stats = materialise(rows.mapInArrow(train_batches, STATS), "quality-stats")
    counts = stats.filter("kind = 0").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    # rows of one id share its hash; the hash of their features orders them, and a cut may fall between any two rows
    drawn = stats.filter("kind = 1").select("key", "good", "features", F.xxhash64("key").alias("h"), F.xxhash64("features").alias("f"))
    heads = drawn.select("h", "f", F.octet_length("features").alias("size")).orderBy("h", "f").limit(sample).toArrow().to_pydict()
    most = max(1, int(np.searchsorted(np.cumsum(heads["size"]), sample_bytes, "right")))
    if heads["h"]:
        h, f = (heads[c][:most][-1] for c in ("h", "f"))
        like_last = sum(x == (h, f) for x in zip(heads["h"][:most], heads["f"][:most], strict=True))
        here = F.col("h") == F.lit(h)
        drawn = drawn.filter((F.col("h") < F.lit(h)) | here & (F.col("f") < F.lit(f))).unionByName(drawn.filter(here & (F.col("f") == F.lit(f))).limit(like_last))
    picked = drawn.select("key", "good", "features").toArrow().sort_by([("key", "ascending"), ("good", "ascending"), ("features", "ascending")])
    y = np.where(np.asarray(picked["good"]) > 0, 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        return float((y > 0).mean()) if len(y) else 0.5
    p, q = np.ones(SIZE), np.ones(SIZE)
    p[np.asarray(counts["key"])] += np.asarray(counts["good"])
    q[np.asarray(counts["key"])] += np.asarray(counts["bad"])
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    return ratio, *fit(docs.sparkSession, ratio, picked["features"].to_pylist(), y)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and text_md5 of every row of (doc_id, text); labels of held-out rows are not used."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out), labels, **options))
    data = utf8(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), data.alias("data"), F.md5(data).alias("text_md5"))
    return rows.mapInArrow(score_batches(model), "doc_id long, held_out boolean, score double, predicted int, text_md5 string")
