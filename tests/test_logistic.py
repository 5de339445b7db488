"""Many logistic models at once against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import logistic as G
from palimpsest.operators import models as L
from palimpsest.plans import experiments as E
from palimpsest.plans import registry


def newton(x, y, l2, intercept=True, steps=60):
    """A plain fit on standardised columns of training rows."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd <= 1e-6] = 1
    a = (x - mean) / sd
    if intercept:
        a = np.concatenate([np.ones((len(a), 1)), a], 1)
    free = np.ones(a.shape[1])
    free[0] = not intercept
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(l2 * free + 1e-14), a.T @ (p - y) / len(a) + l2 * free * w)
    return mean, sd, w


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)) * [1, 10, 0.1, 1, 1, 1000] + [0, 5, 0, 0, 0, 1e6]
    x[:, 3] = 2.5
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * x[:, 1])))).astype(int)
    return x, y, rng.integers(0, 4, 400)


def frame(spark, sample):
    x, y, bucket = sample
    return spark.createDataFrame([(i, int(bucket[i]), x[i].tolist(), int(y[i])) for i in range(len(y))], "id int, fold_bucket int, v array<double>, label int").repartition(3)


@pytest.mark.parametrize("intercept", [True, False])
def test_models_equal_separate_fits(spark, sample, intercept):
    x, y, bucket = sample
    arms = [G.Arm(f, name, c) for f in range(4) for name, c in {"all": (0, 1, 2, 3, 4, 5), "two": (5, 1)}.items()]
    data = G.folds_design(frame(spark, sample), F.col("v"), "label", 4)
    at, models = G.fit(data, arms, G.EXTENDED_GRID, intercept)
    assert len(models) == 4 * 2 * 8 and not any(m.open for m in models)
    for m in models:
        train = (bucket != m.arm.split) & (bucket != (m.arm.split + 1) % 4)
        _, _, w = newton(x[train][:, list(m.arm.columns)], y[train], m.l2, intercept)
        got = np.concatenate([[m.intercept], m.weights]) if intercept else m.weights
        assert np.abs(got - w).max() < 1e-6
    # the penalty by validation, and scores of the test rows
    best = G.chosen(data, at, models)
    out = {(r.id, r.arm): r for r in G.scored(data, at, best).collect()}
    assert len(out) == 2 * len(y) and len(best) == 8
    for m in best:
        c, fold = list(m.arm.columns), m.arm.split
        train, valid = (bucket != fold) & (bucket != (fold + 1) % 4), bucket == (fold + 1) % 4
        losses = {}
        for l2 in G.EXTENDED_GRID:
            mean, sd, w = newton(x[train][:, c], y[train], l2, intercept)
            z = (x[:, c] - mean) / sd @ (w[1:] if intercept else w) + (w[0] if intercept else 0)
            p = 1 / (1 + np.exp(-z))
            losses[l2] = -np.log(np.where(y == 1, p, 1 - p))[valid].mean(), p
        assert m.l2 == min(losses, key=lambda k: losses[k][0])
        for i in np.flatnonzero(bucket == fold):
            assert out[i, m.arm.name].probability == pytest.approx(losses[m.l2][1][i], abs=1e-6) and out[i, m.arm.name].l2_lambda == m.l2


def test_passes_within_a_budget_change_nothing(spark, sample, monkeypatch):
    data = G.folds_design(frame(spark, sample), F.col("v"), "label", 4)
    arms = [G.Arm(f, "all", (0, 1, 2)) for f in range(4)]
    one = G.fit(data, arms)[1]
    monkeypatch.setattr(G, "BUDGET", 8 * 25 * 3)
    models = [G.Model(a, l2) for a in arms for l2 in G.GRID]
    assert [sum(len(ks) for _, ks in g) for g in G._groups(models)] == [3, 2] * 4
    two = G.fit(data, arms)[1]
    assert all(np.allclose(a.weights, b.weights, atol=1e-9) for a, b in zip(one, two, strict=True))


def test_missing_numbers_and_single_classes(spark):
    rows = [(i, [float(i % 7) if i % 5 else None, None], i % 2, i % 3) for i in range(60)] + [(100, [1.0, 2.0], None, 0), (101, None, 1, 0)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int, fold_bucket int")
    data = G.folds_design(df, F.col("v"), "label", 3)
    at, models = G.fit(data, [G.Arm(f, "a", (0, 1)) for f in range(3)], (0.01,))
    for m in models:
        part = [r for r in rows[:60] if r[3] not in (m.arm.split, (m.arm.split + 1) % 3)]
        median = np.median([r[1][0] for r in part if r[1][0] is not None])
        x = np.array([[median if r[1][0] is None else r[1][0]] for r in part])
        _, _, w = newton(x, np.array([r[2] for r in part]), 0.01)
        assert [m.intercept, m.weights[0], m.weights[1]] == pytest.approx([w[0], w[1], 0], abs=1e-6)
    same = df.withColumn("label", F.lit(1))
    data = G.folds_design(same, F.col("v"), "label", 3)
    with pytest.raises(ValueError, match="one class"):
        G.fit(data, [G.Arm(0, "a", (0,))])
    assert {round(r.probability, 4) for r in L.probe(same.where("v is not null"), "v", "label", 3).collect()} == {1.0}
    assert L.probe(df.where("false"), "v", "label", 3).count() == 0


def test_four_arms_hold_out_groups_and_deal_votes(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{g}:{k}", f"g{g}", float(k), int(v), int(rng.random() < (0.85 if v else 0.15)), k % 2) for g in range(60) for k, v in enumerate(rng.integers(0, 2, 5))]
    df = spark.createDataFrame(rows, "id string, g string, b double, pref int, y int, bucket int")
    both = df.withColumn("condition", F.lit("x")).unionByName(df.withColumn("condition", F.lit("y")))
    out = L.arm_matrix(both, "g", "y", ["b"], ["pref"], [1, 2], bucket="bucket").collect()
    keys = {(r.condition, r.seed, r.arm) for r in out}
    assert len(keys) == 2 * 2 * 4
    for seed in (1, 2):
        held = {r.lineage_id for r in out if r.seed == seed}
        assert len(held) == 12 and len([r for r in out if r.seed == seed and r.condition == "x" and r.arm == "full"]) == 60
        loss = {}
        for arm in ("no_preference", "preference_only", "full", "shuffled"):
            part = [r for r in out if r.seed == seed and r.condition == "y" and r.arm == arm]
            loss[arm] = np.mean([-np.log(r.probability if r.label else 1 - r.probability) for r in part])
        assert loss["full"] < loss["shuffled"] - 0.1 and loss["preference_only"] < loss["no_preference"] - 0.1
    one = L.four_arms(df, "g", "y", ["b"], ["pref"], 1, bucket="bucket")
    assert one.columns == ["arm", "id", "lineage_id", "label", "probability"] and one.count() == 4 * 60
    with pytest.raises(ValueError, match="one class"):
        L.four_arms(df.withColumn("y", F.lit(0)), "g", "y", ["b"], ["pref"])


def test_planted_effects_are_found(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.queries()["session_effect_matrix"](spark, sf).collect()
    assert len(rows) == len(E.EFFECTS) * len(E.SEEDS)
    gain = {e: np.mean([r.gain for r in rows if r.condition == f"effect_{e}"]) for e in E.EFFECTS}
    assert gain[1.5] > gain[0.0] + 0.01


def test_conditions_of_the_same_rows_are_dealt_once(spark, monkeypatch):
    """Targets by name give what rows of each condition give; votes are staged once, whatever the conditions and seeds, and removed."""
    rng, kept, gone = np.random.default_rng(4), [], []
    rows = [(i, i // 4, i % 4, float(rng.random()), int(rng.random() < 0.5), int(rng.random() < 0.5), int(rng.random() < 0.5)) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, g int, bucket int, b double, pref int, x int, y int")
    long = df.withColumn("condition", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("target", F.when(F.col("condition") == "x", F.col("x")).otherwise(F.col("y")))
    want = L.arm_matrix(long, "g", "target", ["b"], ["pref"], [1, 2], bucket="bucket")
    monkeypatch.setattr(L, "written", lambda t, name, own=L.written: kept.append((name, own(t, name))) or kept[-1][1])
    monkeypatch.setattr(L, "drop", lambda *t, own=L.drop: gone.extend(x.count() for x in t) or own(*t))
    got = L.arm_matrix(df, "g", "", ["b"], ["pref"], [1, 2], bucket="bucket", conditions={"x": F.col("x"), "y": F.col("y")})
    assert [name for name, _ in kept] == ["arms"] and gone == [160]
    key = lambda r: (r.condition, r.seed, r.arm, r.id)
    a, b = ({key(r): (r.lineage_id, r.label, round(r.probability, 9)) for r in t.collect()} for t in (want, got))
    assert a == b and len(a) == 2 * 2 * 4 * 32
