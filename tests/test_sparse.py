"""Sparse feature-set models against dense ones on a small table."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import sparse as Q

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(120):
        y = i % 3 == 0
        ws = list(rng.choice(WORDS, rng.integers(0, 9)))
        if y and rng.random() < 0.7:
            ws.append("Signal")
        out.append((i, int(y), " ".join(ws) if i % 17 else None, float(rng.integers(0, 5)) if i % 7 else None, f"c{rng.integers(0, 4)}" if i % 11 else None))
    return out


def dense(rows, train, terms, least):
    """Columns of text, number and category as plain arrays, by the same rules."""
    tokens = {}
    for r in rows:
        ws = re.findall(r"[^\W]{2,}", (r[2] or "").lower())
        tokens[r[0]] = collections.Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)])
    df, total = collections.Counter(), collections.Counter()
    for i in train:
        df.update(tokens[i].keys())
        total.update(tokens[i])
    vocabulary = sorted((t for t in df if df[t] >= least), key=lambda t: (-total[t], t))[:terms]
    text = np.array([[(1 + math.log(tokens[r[0]][t])) * (math.log((1 + len(train)) / (1 + df[t])) + 1) if tokens[r[0]][t] else 0 for t in vocabulary] for r in rows])
    norm = np.sqrt((text**2).sum(1, keepdims=True))
    text = np.divide(text, norm, out=np.zeros_like(text), where=norm > 0)
    inside = [r for r in rows if r[0] in train]
    median = np.median([r[3] for r in inside if r[3] is not None])
    number = np.array([[median if r[3] is None else r[3]] for r in rows])
    number = number / np.std([median if r[3] is None else r[3] for r in inside])
    values = sorted({r[4] for r in inside if r[4] is not None}, key=lambda v: (hashlib.sha256(v.encode()).hexdigest()[:2], v))
    return {"text:t": text, "number:x": number, "category:c": np.array([[float(r[4] == v) for v in values] for r in rows])}


def plain_fit(x, y, l2):
    a, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    free = np.append(np.ones(x.shape[1]), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(l2 * free + 1e-12), a.T @ (p - y) / len(a) + l2 * free * w)
    return w


SETS = {"words": ("text:t",), "rest": ("number:x", "category:c"), "all": ("text:t", "number:x", "category:c")}


def prepared(spark, rows, terms=25):
    df = spark.createDataFrame([*rows, (900, None, "alpha", 1.0, "c1")], "id int, label int, t string, x double, c string").repartition(2)
    splits = df.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("split")).withColumn("role", F.when((F.col("id") + F.col("split")) % 4 == 0, 3).otherwise(1))
    return Q.design(df, splits, ["t"], ["x"], ["c"], terms)


def test_masked_models_equal_dense_ones(spark, rows):
    data, blocks = prepared(spark, rows)
    models = Q.fit(data, Q.models_of(data, blocks, SETS), steps=400, done=1e-8)
    out = {(r.id, r.split, r.feature_set): r.probability for r in Q.scored(data, models).collect()}
    y = np.array([r[1] for r in rows])
    assert len(out) == 3 * 60
    for split in range(2):
        train = {r[0] for r in rows if (r[0] + split) % 4}
        inside = np.array([r[0] in train for r in rows])
        columns = dense(rows, train, 25, 2)
        for name, parts in SETS.items():
            x = np.concatenate([columns[b] for b in parts], 1)
            w = plain_fit(x[inside], y[inside], 1 / len(train))
            m = next(m for m in models if (m.split, m.name) == (split, name))
            assert m.n == len(train) and not m.weights[:-1][~m.allowed].any()
            assert np.abs(np.append(m.weights[:-1][m.allowed], m.weights[-1]) - w).max() < 1e-5
            for r, p in zip(rows, 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), strict=True):
                if r[0] not in train:
                    assert out[r[0], split, name] == pytest.approx(p, abs=1e-6)


def test_averaged_steps_equal_dense_ones(spark, rows):
    data, blocks = prepared(spark, rows)
    models = Q.fit_averaged(data, Q.models_of(data, blocks, {"all": SETS["all"]}), epochs=3, batches=2, rate=0.5)
    batch = {r.id: r.b for r in data.select("id", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(2)).alias("b")).collect()}
    y = np.array([r[1] for r in rows])
    for m in models:
        train = {r[0] for r in rows if (r[0] + m.split) % 4}
        columns = dense(rows, train, 25, 2)
        x = np.concatenate([columns[b] for b in SETS["all"]] + [np.ones((len(rows), 1))], 1)
        w, total, n, step = np.zeros(x.shape[1]), 0, 0, 0
        for epoch in range(3):
            for b in range(2):
                step += 1
                at = np.array([r[0] in train and batch[r[0]] == b for r in rows])
                g = x[at].T @ (1 / (1 + np.exp(-x[at] @ w)) - y[at]) / at.sum() + m.l2 * np.append(w[:-1], 0)
                w = w - 0.5 / step**0.5 * g
                if epoch >= 1:
                    total, n = total + w, n + 1
        assert np.abs(m.weights - total / n).max() < 1e-9


def test_terms_are_the_most_frequent_ones_and_rows_stay_sparse(spark, rows):
    data, blocks = prepared(spark, rows, terms=5)
    assert all(blocks.size[s, "text:t"] == 5 for s in range(2))
    wide, _ = prepared(spark, rows, terms=100_000)
    longest = wide.select(F.max(F.size("at"))).first()[0]
    assert longest <= 2 * 10 + 2 and data.count() == 2 * len(rows)
    one = spark.createDataFrame([(i, 1, "a", 1.0, "c") for i in range(4)], "id int, label int, t string, x double, c string")
    design, blocks = Q.design(one, one.select("id", F.lit(0).alias("split"), F.lit(1).alias("role")), ["t"], ["x"], ["c"])
    with pytest.raises(ValueError, match="one class"):
        Q.models_of(design, blocks, SETS)
