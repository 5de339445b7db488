"""Ranks by a number that lies badly in its range: parts end at quantiles, and results equal sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit as U
from palimpsest.operators import corpora as C
from palimpsest.operators import metrics as M
from palimpsest.operators import resample as R
from palimpsest.operators.selection import PARTS, in_parts

N = 20_000


@pytest.fixture(scope="module")
def far(spark):
    """id, g, x and label: x is within 0 and 1, but for one row of 1e12, one of -1e12 and a null."""
    x = F.when(F.col("id") == 7, 1e12).when(F.col("id") == 8, -1e12).when(F.col("id") == 9, None).otherwise(F.abs(F.xxhash64("id") % 1_000_003) / 1_000_003)
    return spark.range(N).select("id", F.lit("all").alias("g"), x.alias("x"), (F.abs(F.xxhash64("id", F.lit(1))) % 3 == 0).cast("int").alias("label")).cache()


def test_one_outlier_leaves_parts_even(far):
    sizes = [r["count"] for r in in_parts(far, "x").groupBy("_part").count().collect()]
    assert len(sizes) > PARTS * 0.9 and max(sizes) <= 3 * N / PARTS


def test_parts_follow_the_order(far):
    bounds = in_parts(far, "x", ["g"], n=F.count("*")).groupBy("_part").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.first("n").alias("n")).orderBy("_part").collect()
    assert bounds[0]["_part"] == -1 and bounds[0].low is None and {b.n for b in bounds} == {N}
    assert all(a.high < b.low for a, b in zip(bounds[1:-1], bounds[2:], strict=True))


def test_quantiles_with_an_outlier(far):
    at = (0.0, 0.01, 0.5, 0.777, 1.0)
    x = np.array([r.x for r in far.where("x is not null").collect()])
    got = U.quantiles(far, "x", at, ["g"]).first()
    assert got.n == len(x) and got.q == pytest.approx(np.quantile(x, at).tolist(), rel=1e-12)


def test_rank_area_of_scores_near_zero(far):
    rows = far.where("x between 0 and 1").withColumn("p", F.round("x", 4) * 1e-9)
    sizes = [r["count"] for r in in_parts(rows.select("id", "x"), "x", large=1000).groupBy("_part").count().collect()]
    assert max(sizes) <= 3 * N / PARTS
    p, y = (np.array(c) for c in zip(*[(r.p, r.label) for r in rows.select("p", "label").collect()], strict=True))
    order = np.argsort(p, kind="stable")
    _, at, n = np.unique(p[order], return_index=True, return_counts=True)
    rank = np.repeat(at + (n + 1) / 2, n)
    pos = y[order].sum()
    expected = (rank[y[order] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    assert M.roc_auc(rows, ["g"], "p").first().roc_auc == pytest.approx(expected, rel=1e-12)
    assert sum(r.n for r in M._steps(rows.withColumn("y", F.lit(0)), [], "x", "y").collect()) == len(y)


def test_a_value_of_a_third_of_all_rows_is_dealt_over_parts(spark):
    rows = spark.range(N).select("id", F.when(F.col("id") % 3 == 0, F.lit(500.0)).otherwise(F.col("id") % 1000 + 0.5).alias("x"))
    parts = in_parts(rows, "x", tie=F.col("id")).groupBy("_part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("_part").collect()
    assert max(p.n for p in parts) <= 4 * N / PARTS and all(a.high <= b.low for a, b in zip(parts, parts[1:]))
    got = R.sequential_batches(rows, "x", 64, "id").collect()
    ends = {}
    for r in got:
        low, high, n = ends.get(r.batch, (r.x, r.x, 0))
        ends[r.batch] = min(low, r.x), max(high, r.x), n + 1
    assert sorted(r.id for r in got) == list(range(N)) and all(ends[b][2] == 64 for b in range(N // 64))
    assert all(ends[b][1] <= ends[b + 1][0] for b in range(len(ends) - 1))


def test_blocks_with_an_outlier_equal_a_loop(far):
    got = {r.id: r.donor for r in C.block_shift(far.where("x is not null"), "g", ["x"], "id", 16).collect()}
    order = [r.id for r in far.where("x is not null").orderBy("x", "id").collect()]
    place = {k: i for i, k in enumerate(order)}
    assert sorted(got) == sorted(got.values()) == sorted(order) and all(k != d for k, d in got.items())
    last = (len(order) - 1) // 16 - (len(order) % 16 == 1)
    assert all(min(place[k] // 16, last) == min(place[d] // 16, last) for k, d in got.items())


def test_small_and_empty_groups_are_one_part(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "g string, x double")
    assert {r["_part"] for r in in_parts(rows, "x", ["g"]).collect()} == {-1}
    assert U.quantiles(rows.limit(0), "x", (0.5,), ["g"]).count() == 0 and M.roc_auc(rows.limit(0).withColumn("y", F.lit(1)), ["g"], "x", "y").count() == 0
