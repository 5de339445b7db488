"""Splits, corpora, scores and resampling on small rows."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import corpora as C
from palimpsest.operators import metrics as M
from palimpsest.operators import models as L
from palimpsest.operators import resample as R
from palimpsest.operators import selection as S
from palimpsest.operators import sessions as Z
from palimpsest.operators import splits as P
from palimpsest.plans import registry


@pytest.fixture(scope="module")
def episodes(spark):
    rows = [(f"e{i:02d}-{k}", f"lineage-{i:02d}", (i + k) % 3 == 0, k % 2, f"b {i}", f"candidate a {i} {k}", f"candidate b {i} {k}", "after") for i in range(80) for k in range(1 + i % 5)]
    return spark.createDataFrame(rows, "episode_id string, lineage_id string, future_revised boolean, selected_index int, context_before string, candidate_a string, candidate_b string, context_after string").cache()


def test_greedy_folds_are_balanced_and_repeatable(spark, episodes):
    stats = P.lineage_stats(episodes)
    a, b = ({r.lineage_id: r.bucket for r in P.greedy_folds(stats, 5).collect()} for _ in range(2))
    assert a == b and len(a) == 80
    sizes = {}
    for r in stats.collect():
        sizes[a[r.lineage_id]] = sizes.get(a[r.lineage_id], 0) + r.episodes
    assert max(sizes.values()) - min(sizes.values()) <= 3
    checks = P.verification(P.membership(P.greedy_folds(stats, 5), 5), stats, 5).first().asDict()
    assert checks.pop("lineages") == 80 and not any(checks.values())


def test_two_folds_are_refused(spark, episodes):
    with pytest.raises(ValueError):
        P.greedy_folds(P.lineage_stats(episodes), 2)


def test_donors_are_of_other_lineages(spark, episodes):
    cells = C.in_cells(episodes, P.membership(P.hash_folds(P.lineage_stats(episodes), 5), 5))
    rows = C.donors(cells, 118, "shuffle").collect()
    assert len(rows) == 5 * 240 and all(r.lineage_id != r.donor_lineage for r in rows)
    for key in {(r.fold, r.partition) for r in rows}:
        part = [r for r in rows if (r.fold, r.partition) == key]
        assert sorted(r.episode_id for r in part) == sorted(r.donor_id for r in part)


def test_impossible_donors_are_an_error(spark):
    rows = [(0, "train", f"e{i}", "big" if i < 8 else f"l{i}") for i in range(10)]
    with pytest.raises(Exception, match="no donors of other lineages"):
        C.donors(spark.createDataFrame(rows, "fold int, partition string, episode_id string, lineage_id string"), 118, "shuffle").collect()


def test_greedy_folds_by_a_plain_loop(spark, episodes):
    stats = P.lineage_stats(episodes)
    rows = {r.lineage_id: r.asDict() for r in stats.collect()}
    digest = lambda *x: hashlib.sha256("\x1f".join(map(str, x)).encode()).hexdigest()
    fields = ["lineages", *P.COUNTERS]
    for r in rows.values():
        r["lineages"] = 1
    total = {f: sum(r[f] for r in rows.values()) for f in fields}
    target = {f: max(total[f] / 5, 1.0) for f in fields}
    rate = total["future_revised"] / total["episodes"]
    held, want = [dict.fromkeys(fields, 0) for _ in range(5)], {}
    for i in sorted(rows, key=lambda i: (-rows[i]["episodes"], -abs(rows[i]["future_revised"] - rate * rows[i]["episodes"]), digest(17, i))):

        def cost(k, i=i):
            after = sum(P.WEIGHTS[f] * ((held[k][f] + rows[i][f] - target[f]) / target[f]) ** 2 for f in fields)
            return round(after - sum(P.WEIGHTS[f] * ((held[k][f] - target[f]) / target[f]) ** 2 for f in fields), 12), digest(17, i, k)

        k = min(range(5), key=cost)
        want[i] = k
        for f in fields:
            held[k][f] += rows[i][f]
    assert {r.lineage_id: r.bucket for r in P.greedy_folds(stats, 5).collect()} == want


def test_length_matched_rules(spark):
    pool = spark.createDataFrame([(0, "a", f"p{i}", 10 * i) for i in range(5)] + [(0, "b", "q", 1)], "fold int, partition string, temporal_pair_id string, tokens int")
    wanted = lambda *rows: spark.createDataFrame(list(rows), "fold int, partition string, n int, nearest int")
    assert [r.temporal_pair_id for r in C.length_matched(pool, wanted((0, "a", 1, 25))).collect()] == ["p2"]
    assert sorted(r.temporal_pair_id for r in C.length_matched(pool, wanted((0, "a", 3, 0), (0, "b", 1, 9))).collect()) == ["p0", "p2", "p4", "q"]
    with pytest.raises(Exception, match="fewer rows than are wanted"):
        C.length_matched(pool, wanted((0, "b", 2, 0))).collect()


@pytest.mark.parametrize("limit", [1, 10, 40, 1000])
def test_whole_sessions_by_a_plain_loop(spark, limit):
    sizes = [50, 3, 4, 2, 40, 9, 1, 1, 6]
    rows = [(f"s{i}",) for i, n in enumerate(sizes) for _ in range(n)]
    order = sorted(range(len(sizes)), key=lambda i: hashlib.sha256(f"1729\x1fs{i}".encode()).hexdigest())
    kept, used = [], 0
    for i in order:
        if kept and used + sizes[i] > limit:
            continue
        kept.append(f"s{i}")
        used += sizes[i]
        if used >= limit:
            break
    got = S.whole_sessions(spark.createDataFrame(rows, "session_id string"), "session_id", limit)
    assert sorted({r.session_id for r in got.collect()}) == sorted(kept) and got.count() == used


def test_gates_see_what_is_wrong(spark, episodes):
    members = P.membership(P.hash_folds(P.lineage_stats(episodes), 5), 5)
    pairs = spark.createDataFrame([(f"t{i}", f"out-{i}", "b", f"one {i}", f"two {i}", "a") for i in range(400)], "temporal_pair_id string, lineage_id string, context_before string, earlier_text string, later_text string, context_after string")
    records = C.build(episodes, members, pairs, P.hash_folds(pairs.select("lineage_id"), 5), 5).cache()
    assert all(C.gates(records, episodes, pairs, members).first())
    own = F.when(F.col("corpus") == "shuffled_preference", F.col("source_id")).otherwise(F.col("partner_id"))
    bad = C.gates(records.withColumn("partner_id", own), episodes, pairs, members).first().asDict()
    assert [k for k, v in bad.items() if not v] == ["shuffled_preference_donors_cross_lineages"]
    bad = C.gates(records.where("corpus <> 'random_label' or target = 0").withColumn("future_revised", F.lit(1)), episodes, pairs, members).first().asDict()
    assert [k for k, v in bad.items() if not v] == ["all_six_corpora_have_equal_record_counts", "no_source_task_record_contains_future_fields", "random_labels_are_balanced"]


def test_labels_are_balanced(spark, episodes):
    cells = C.in_cells(episodes, P.membership(P.hash_folds(P.lineage_stats(episodes), 5), 5))
    for r in C.balanced_labels(cells, "episode_id", 17).groupBy("fold", "partition").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect():
        assert r.s == r.n - r.n // 2


def test_metric_vector(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, probability double")
    r = M.binary_metrics(df).first()
    assert r.accuracy == 1 and r.roc_auc == 1 and r.log_loss == pytest.approx(-sum(map(math.log, (0.9, 0.8, 0.8, 0.9))) / 4)


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 5) / 5) for _ in range(60)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, probability double")
    assert M.roc_auc(df).first().roc_auc == pytest.approx(want)
    assert M.roc_auc(df.where("label = 1")).first().roc_auc is None


def test_penalty_ties(spark):
    df = spark.createDataFrame([(0, 1e-4, 0.5), (0, 1e-3, 0.5 + 1e-13), (0, 1e-2, 0.6)], "fold int, l2_lambda double, validation_log_loss double")
    assert M.select_l2(df, ["fold"]).first().l2_lambda == 1e-3
    assert M.select_l2(df, ["fold"], stronger=False).first().l2_lambda == 1e-4


def test_pairing_flags_metadata(spark):
    df = spark.createDataFrame([("t", "e1", "l", 1, 0.9), ("c", "e1", "l", 0, 0.8), ("t", "e2", "l", 1, 0.9), ("c", "e2", "l", 1, 0.8)], "arm string, episode_id string, lineage_id string, label int, probability double")
    assert {r.episode_id: r.consistent for r in M.paired(df, "t", "c").collect()} == {"e1": False, "e2": True}


def test_bootstrap_of_one_value(spark):
    sums = spark.createDataFrame([(f"l{i}", 2.0 * (i + 1), i + 1) for i in range(7)], "lineage_id string, total double, n int")
    for replicates in (R.bootstrap(sums, "lineage_id", "total", "n", 20), R.poisson_bootstrap(sums, "total", "n", 20)):
        r = R.interval(replicates).first()
        assert r.lower == pytest.approx(2) and r.upper == pytest.approx(2) and r.result == "supported"


def test_shuffle_keeps_counts(spark):
    df = spark.createDataFrame([(i, i % 3, int(i % 4 == 0)) for i in range(60)], "id int, part int, label int")
    out = C.within_label_shuffle(df, ["part"], "id", "label")
    for r in out.groupBy("part").agg(F.sum("label").alias("a"), F.sum("shuffled").alias("b")).collect():
        assert r.a == r.b


def test_block_shift_has_no_self(spark):
    df = spark.createDataFrame([("s", i, i * 7 % 11) for i in range(17)] + [("alone", 99, 1)], "source string, id int, size int")
    got = {r.id: r.donor for r in C.block_shift(df, "source", ["size"], "id", 8).collect()}
    assert got[99] == 99 and all(k != v for k, v in got.items() if k != 99) and sorted(got) == sorted(got.values())


def test_session_targets(spark):
    df = spark.createDataFrame([("s", 1, "model_a"), ("s", 2, "tie"), ("t", 1, None)], "sid string, t int, winner string")
    rows = Z.prepared(df, "sid", ["t"], "winner").orderBy("session_id", "round").collect()
    assert [(r.vote, r.continues, r.pref_a) for r in rows] == [("a", 1, 1), ("tie", 0, 0), ("unknown", 0, 0)]


def test_scaling_uses_training_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [100.0, 6.0])], "id int, v array<double>")
    got = {r.id: r.scaled for r in L.scaled(df, "v", F.col("id") < 2).collect()}
    assert got[0] == [-1.0, 0.0] and got[2] == [98.0, 1.0]


def test_value_network_learns(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, i % 3, [1.0], [a, 0.1], [b, 0.1], int(b > a)))
    df = spark.createDataFrame(rows, "id int, fold_bucket int, context array<double>, candidate_a array<double>, candidate_b array<double>, label int")
    df = df.withColumn("context", F.array(F.lit(1.0), F.lit(1.0)))
    assert M.binary_metrics(L.value_network(df, 3)).first().accuracy > 0.9


def test_registry_names_have_functions():
    assert registry.FLAGSHIP in registry.queries() and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def vectors_dir(spark, tmp_path_factory):
    rng, at = random.Random(7), tmp_path_factory.mktemp("vectors")
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], rng.randint(0, 5)) for i in range(102)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["value_network_oof", "gbt_arm_metrics"])
def test_every_row_is_scored_out_of_fold(spark, vectors_dir, name):
    out = {r.fold: r.n for r in registry.queries()[name](spark, vectors_dir).collect()}
    assert out == {fold: 20 for fold in range(5)}


@pytest.mark.parametrize("name", ["logistic_probe_metrics", "ranker_linear_oof"])
def test_probes_use_every_fold_and_penalty(spark, vectors_dir, name, monkeypatch):
    seen = []

    def probe(rows, vector, label, folds, grid=L.GRID, intercept=True):
        seen.append((folds, grid, rows.select("fold_bucket").distinct().count()))
        return rows.select("id", F.col("fold_bucket").alias("fold"), "label", F.lit(0.5).alias("probability"))

    monkeypatch.setattr(L, "probe", probe)
    registry.queries()[name](spark, vectors_dir)
    assert seen == [(5, L.GRID, 5)]
