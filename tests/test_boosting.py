"""Boosted trees against a plain loop, and states by networks that did not see their rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import boosting as T
from palimpsest.operators import models as L
from palimpsest.operators import reports as B
from palimpsest.operators.logistic import TRAIN, VALIDATION, Arm


def plain(bins, y, role, place, arm, settings):
    """Trees of one model, row by row."""
    train, valid = np.flatnonzero(role == TRAIN), np.flatnonzero(role == VALIDATION)
    rate = y[train].mean()
    z = np.full(len(y), math.log(rate / (1 - rate)))
    soft = lambda g: math.copysign(max(abs(g) - settings.l1, 0), g)
    trees, best, kept = [], None, 0
    for r in range(settings.rounds + 1):
        if len(valid):
            loss = np.mean([math.log1p(math.exp(z[i])) - y[i] * z[i] for i in valid])
            if r == 1 or (r > 1 and loss < best - 1e-12) or best is None:
                best, kept = loss, r
            if r - kept >= settings.patience:
                break
        if r == settings.rounds:
            break
        columns = T.columns_of(arm, r, settings)
        used = [i for i in train if T.drawn(place[i : i + 1], r, settings.seed + arm.split, settings.rows)[0]]
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
            found = None
            if depth < settings.depth:
                for c in columns:
                    for b in range(T.BINS - 1):
                        left = [i for i in rows if bins[i, c] <= b]
                        a, k = sum(g[i] for i in left), sum(h[i] for i in left)
                        if k < settings.least_curvature or H - k < settings.least_curvature:
                            continue
                        gain = round(soft(a) ** 2 / (k + settings.l2) + soft(G - a) ** 2 / (H - k + settings.l2) - soft(G) ** 2 / (H + settings.l2), 9)
                        if gain > 1e-6 and (found is None or gain > found[0]):
                            found = gain, c, b
            if found is None:
                return -settings.rate * soft(G) / (H + settings.l2)
            _, c, b = found
            return c, b, grow([i for i in rows if bins[i, c] <= b], depth + 1), grow([i for i in rows if bins[i, c] > b], depth + 1)

        tree = grow(used, 0)

        def value(t, i):
            while isinstance(t, tuple):
                t = t[2] if bins[i, t[0]] <= t[1] else t[3]
            return t

        z = z + np.array([value(tree, i) for i in range(len(y))])
        trees.append(tree)
    return trees[: kept if len(valid) else settings.rounds], value


@pytest.mark.parametrize("fold", [3, 50])
def test_trees_equal_a_plain_loop(spark, monkeypatch, fold):
    monkeypatch.setattr(T, "FOLD", fold)
    monkeypatch.setattr(T, "BINS", 8)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (150, 5)).astype(float)
    y = (rng.random(150) < 1 / (1 + np.exp(-(x[:, 0] - 2.5) * np.sign(x[:, 1] - 2.5)))).astype(int)
    bucket = rng.integers(0, 3, 150)
    df = spark.createDataFrame([(i, [None if v == 5 and j == 4 else float(v) for j, v in enumerate(x[i])], int(y[i]), int(bucket[i])) for i in range(150)], "id int, v array<double>, label int, fold_bucket int").repartition(3)
    settings = T.Settings(rate=0.3, least_curvature=1.0, l2=2.0, l1=0.1, rounds=7, patience=3, columns=0.6)
    role = [F.when(F.col("fold_bucket") == f, 3).when(F.col("fold_bucket") == (f + 1) % 3, 2).otherwise(1) for f in range(3)]
    data, _ = T.binned(df, F.col("v"), F.col("label"), F.array(*[F.lit(f) for f in range(3)]), F.array(*role), most=8)
    arms = [Arm(f, n, c) for f in range(3) for n, c in {"all": (0, 1, 2, 3, 4), "some": (4, 2, 0)}.items()]
    models = T.boost(data, arms, settings)
    rows = {r.id: r for r in data.collect()}
    bins = np.array([list(rows[i].bins) for i in range(150)])
    # the bins keep the order of values, missing ones below all
    filled = x.copy()
    filled[filled[:, 4] == 5, 4] = -1
    for c in range(5):
        for a, b in zip(np.argsort(filled[:, c], kind="stable"), np.argsort(filled[:, c], kind="stable")[1:], strict=False):
            assert (bins[a, c] <= bins[b, c]) and (filled[a, c] < filled[b, c] or bins[a, c] == bins[b, c])
    place = np.array([rows[i].place for i in range(150)])
    out = {(r.id, r.arm): r.probability for r in T.scored(data, models).collect()}
    assert len(out) == 300
    for m in models:
        role_ = np.where(bucket == m.arm.split, 3, np.where(bucket == (m.arm.split + 1) % 3, 2, 1))
        trees, value = plain(bins, y, role_, place, m.arm, settings)
        assert len(trees) == m.best == len(m.trees)
        for i in np.flatnonzero(role_ == 3):
            z = m.base + sum(value(t, i) for t in trees)
            assert out[i, m.arm.name] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def triples(spark, n=240, dim=4):
    rng = np.random.default_rng(3)
    c, a, b = (rng.standard_normal((n, dim)) for _ in range(3))
    y = (b[:, 0] > a[:, 0]).astype(int)
    rows = [(i, i % 3, c[i].tolist(), a[i].tolist(), b[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, fold_bucket int, context array<double>, candidate_a array<double>, candidate_b array<double>, label int").repartition(3)


def test_states_come_from_networks_that_did_not_see_the_row(spark):
    rows = triples(spark)
    labels = rows.withColumn("labels", F.array(F.col("label").cast("double"), F.lit(1.0) - F.col("label")))
    nets = L.transfer_networks(labels, 3, hidden=4, bottleneck=2, epochs=3)
    assert set(nets) == {(r, f) for r in range(2) for f in range(3)}
    pdf = rows.toPandas().sort_values("id")
    got = {r.id: r for r in L.transfer_states(rows, nets).collect()}
    assert len(got) == len(pdf)
    for replica in range(2):
        for fold in range(3):
            part = pdf[pdf.fold_bucket != fold].copy()
            part["label"] = part["label"].astype(float) if replica == 0 else 1.0 - part["label"]
            flat = L.trained(part.sort_values("id"), fold, 3, 4, 2, 3, 3e-3, 1e-2, 17 + fold + 1000 * replica)
            assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(flat, nets[replica, fold], strict=True))
            test = pdf[pdf.fold_bucket == fold]
            want = L._states(L.ValueNetwork(flat), *(np.stack(test[c].to_numpy()) for c in ("context", "candidate_a", "candidate_b")), test.label.to_numpy() == 1)
            for side, name in zip(want, ("blind", "choice_aware"), strict=True):
                for i, row in zip(test.id, side, strict=True):
                    assert np.allclose(got[i][name][replica], row, atol=1e-9)
    assert isinstance(pdf, pd.DataFrame)


def test_boosted_arms_and_their_aggregate(spark):
    rows = triples(spark)
    blocks = {"generic": L.geometry("context", "candidate_a", "candidate_b"), "s0": F.zip_with("candidate_b", "candidate_a", lambda x, y: x - y), "s1": F.col("context")}
    arms = {"g": ("generic",), "t": ("generic", "s0"), "r0": ("generic", "s1")}
    out = L.boosted_arms(rows, blocks, arms, "label", 3, T.Settings(rate=0.3, least_curvature=1.0, l2=1.0, columns=1.0, rounds=12, patience=4))
    assert {(r.arm, r.n) for r in out.groupBy("arm").agg(F.count("*").alias("n")).collect()} == {(a, 240) for a in arms}
    pooled = out.select(F.col("id").alias("episode_id"), (F.col("id") % 40).cast("string").alias("lineage_id"), "arm", "label", "probability").cache()
    found = {r.comparison: r for r in B.boosted_aggregate(pooled, "t", "g", "r", 100, least_negative=1).collect()}
    assert set(found) == {"t - g", "t - r0", "t - mean of replicas"} and all(r.passed and r.supported and r.faulty_rows == 0 for r in found.values())
    p = pooled.toPandas().pivot(index="episode_id", columns="arm", values="probability")
    y = pooled.select("episode_id", "label").distinct().toPandas().set_index("episode_id")["label"].loc[p.index]
    loss = {a: -np.log(np.where(y == 1, p[a], 1 - p[a]).clip(1e-7, 1 - 1e-7)) for a in arms}
    assert found["t - g"].mean_difference == pytest.approx((loss["t"] - loss["g"]).mean())
    bad = pooled.unionByName(pooled.where("arm = 'r0' and episode_id = 3"))
    assert {r.comparison: r.faulty_rows for r in B.boosted_aggregate(bad, "t", "g", "r", 10).collect()} == {"t - g": 0, "t - r0": 1, "t - mean of replicas": 1}


def test_passes_go_by_rows_not_by_files_and_leave_nothing_behind(spark, monkeypatch):
    """Rows of many partitions are few files, so histograms are sent by few tasks; no plan holds a list of quantiles for each column;
    broadcasts are destroyed on the driver; models that are dealt over tasks are those of one task."""
    from pyspark.core.broadcast import Broadcast

    destroyed = []
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False, own=Broadcast.destroy: destroyed.append(1) or own(self, blocking))
    df = spark.range(300).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(50)).cast("double") for j in range(70)]).alias("v"), (F.col("id") % 3 % 2).cast("int").alias("label")).repartition(12)
    role = F.when(F.col("id") % 5 == 0, VALIDATION).otherwise(TRAIN)
    data, edges = T.binned(df, F.col("v"), F.col("label"), F.array(F.lit(0)), F.array(role))
    assert len(data.inputFiles()) == 1
    want = np.array([sorted(r["v"][69] for r in df.collect())]).ravel()
    assert np.isfinite(edges[69]).sum() == len(set(want)) and set(edges[69][np.isfinite(edges[69])]) == set(want)
    arms = [Arm(0, str(n), tuple(range(n, 70))) for n in range(5)]
    settings = T.Settings(rate=0.3, least_curvature=1.0, l2=1.0, l1=0.0, rounds=2, patience=3)
    found = []
    for shares in (1, 3):
        monkeypatch.setattr(T, "SHARES", shares)
        found.append([(m.best, m.losses, [(t.column.tolist(), t.bin.tolist(), t.value.tolist()) for t in m.trees]) for m in T.boost(data, arms, settings)])
    assert found[0] == found[1] and any(trees for *_, trees in found[0])
    assert len(destroyed) >= 2 * (1 + 2 * 2)


def test_networks_learn_from_every_row_and_hold_batches(spark, monkeypatch):
    """Beyond 20,000 rows, of which a hash picked a share before: the networks are those of all rows, whatever their number, and a
    task reads them from its file in bounded pieces."""
    n = 20_400
    x = lambda k: F.array(*[F.pmod(F.xxhash64("id", F.lit(10 * k + j)), F.lit(1000)).cast("double") / 500 - 1 for j in range(2)])
    rows = spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("fold_bucket"), x(1).alias("context"), x(2).alias("candidate_a"), x(3).alias("candidate_b"))
    rows = rows.withColumn("labels", F.array((F.col("candidate_b")[0] > F.col("candidate_a")[0]).cast("double"), (F.col("id") % 2).cast("double"))).cache()
    nets = L.transfer_networks(rows, 3, hidden=3, bottleneck=2, epochs=1)
    assert set(nets) == {(r, f) for r in range(2) for f in range(3)}
    pdf = rows.toPandas().sort_values("id")
    for replica, fold in ((0, 1), (1, 2)):
        part = pdf[pdf.fold_bucket != fold].assign(label=pdf.labels.str[replica])
        want = L.trained(part, fold, 3, 3, 2, 1, 3e-3, 1e-2, 17 + fold + 1000 * replica)
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(want, nets[replica, fold], strict=True))
    spool, most = L._Spool(), []
    spool.add(np.random.default_rng(2).standard_normal((5000, 7)))
    spool.file.flush()
    L._fitted(lambda at: most.append(len(at)) or spool.read(at), 2, 0, np.arange(5000) % 4 == 0, 3, 2, 1, 3e-3, 1e-2, 17)
    assert max(most) <= 1024 and sum(most) == 2 * 3750 + 3750 + 1250


def test_networks_do_not_switch_by_the_number_of_rows(spark):
    """A row more in a fold's test bucket leaves the fold's network as it is, also from 20,000 rows to 20,001."""
    x = lambda k: F.array(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).cast("double") / 500 - 1)
    rows = spark.range(20_001).select("id", F.when(F.col("id") == 20_000, 0).otherwise(F.col("id") % 3).cast("int").alias("fold_bucket"), x(1).alias("context"), x(2).alias("candidate_a"), x(3).alias("candidate_b"), (F.col("id") % 2).cast("int").alias("label"))
    less, more = (L.value_networks(r, 3, hidden=2, bottleneck=2, epochs=1) for r in (rows.where("id < 20000"), rows))
    assert less[0] == more[0] and less[1] != more[1]


def test_driver_keeps_one_scan_a_pass_and_no_rows(spark, monkeypatch, tmp_path):
    """Models dealt over tasks come from one scan of shares, as plans of passes stay with the driver; labels and states meet their rows
    without a broadcast, which the driver would hold whole."""
    from palimpsest.plans import experiments as E

    df = spark.range(60).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(50)).cast("double") for j in range(4)]).alias("v"), (F.col("id") % 2).cast("int").alias("label"))
    data, _ = T.binned(df, F.col("v"), F.col("label"), F.array(F.lit(0)), F.array(F.lit(TRAIN)))
    passes = []
    monkeypatch.setattr(T, "SHARES", 3)
    monkeypatch.setattr(T, "summed", lambda rows, *a, own=T.summed: passes.append(rows) or own(rows, *a))
    T.boost(data, [Arm(0, str(n), tuple(range(n, 4))) for n in range(3)], T.Settings(least_curvature=0.1, rounds=2))
    assert len(passes) > 3 and all(p._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1 for p in passes[1:])
    plans = []
    spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"), (F.col("id") % 2).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    nets = lambda rows, folds, own=L.transfer_networks: plans.append(rows) or own(rows, folds, 2, 2, 1)
    monkeypatch.setattr(L, "transfer_networks", nets)
    monkeypatch.setattr(E, "written", lambda t, name, own=E.written: (plans.append(t) if name == "states" else None) or own(t, name))
    assert E.transfer(spark, str(tmp_path)).count() == 58
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
