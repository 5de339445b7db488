"""Whitening against numpy over the whole table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import whitening
from palimpsest.llm.common import prepare

KIND = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def brute(rows, k=32):
    """n, exact deviations and whitened rows of vectors of one length."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], object)
    n, sums = len(x), x.sum(0)
    deviations = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    y = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    values, vectors = values[order], vectors[:, order]
    return n, deviations, y @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(y.T @ y / n)


def compared(spark, vectors, passes=None, partitions=3):
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], KIND).repartition(partitions)
    out = whitening.whiten(table).collect()
    n, deviations, want, explained = brute(vectors)
    got = np.zeros((len(vectors), want.shape[1]))
    for r in out:
        assert r.n == n and r.deviation == deviations[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[r.vec_id, r.component - 1] = r.whitened
    assert len(out) == len(vectors) * want.shape[1]
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(want.shape[1])).max() < 1e-9


def test_flat_spectrum_expands_to_all_dimensions(spark, monkeypatch):
    widths = []
    real = whitening._pass
    monkeypatch.setattr(whitening, "_pass", lambda v, m, b, square=False: widths.append([x.shape[1] for x in b.values()]) or real(v, m, b, square))
    compared(spark, np.random.default_rng(1).standard_normal((400, 64)))
    assert widths[0] == [42] and [64] in widths


def test_steep_spectrum_needs_no_expansion(spark, monkeypatch):
    widths = []
    real = whitening._pass
    monkeypatch.setattr(whitening, "_pass", lambda v, m, b, square=False: widths.append([x.shape[1] for x in b.values()]) or real(v, m, b, square))
    rng = np.random.default_rng(2)
    scale = np.concatenate([np.geomspace(400, 60, 36), np.full(60, 1e-9)])
    compared(spark, rng.standard_normal((300, 96)) * scale)
    assert [96] not in widths


def test_few_dimensions_and_repeated_rows(spark):
    v = np.random.default_rng(3).standard_normal((50, 5))
    compared(spark, np.concatenate([v, v[:20]]))


def test_odd_rows(spark):
    good = np.random.default_rng(4).standard_normal((20, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(good + bad)] + [(None, good[0], None), (3, good[3], 2), (90, [1.0, 2.0], 1), (91, [2.0, 1.0], 1), (92, [1.0], 1)]
    table = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("n", "component", "whitened", "dim", "i")})
    out = whitening.whiten(table).collect()
    three = [r for r in out if r.n == 22]
    assert len(three) == 22 * 3 and sum(r.vec_id == 3 for r in three) == 6 and sum(r.vec_id is None for r in three) == 3
    # two points span one direction, one point none
    two = [r for r in out if r.n == 2]
    assert sorted((r.vec_id, r.component) for r in two) == [(90, 1), (91, 1)] and all(abs(abs(r.whitened) - 1) < 1e-12 for r in two)
    assert len(out) == len(three) + len(two)
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 92")).count() == 0


def test_entries_of_any_size(spark):
    rows = [(i, [x, 0.5]) for i, x in enumerate([1e300, -1e300, 3.0, 1e18])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 4 and all(r.deviation == (1 << 63) - 1 and math.isfinite(r.whitened) for r in out if r.vec_id < 2)
    x = [1 << 40, -(1 << 40), 5]
    out = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(i, [v / 64]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [min(out[i].deviation, (1 << 63) - 1) for i in range(3)] == [min((3 * v - sum(x)) ** 2, (1 << 63) - 1) for v in x]
