"""Reports, projections, verifiers, artifacts and the command line on small rows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest import settings
from palimpsest.__main__ import COMMANDS, main
from palimpsest.functions import text as X
from palimpsest.operators import audit as U
from palimpsest.operators import models as L
from palimpsest.operators import projections as J
from palimpsest.operators import reports as B
from palimpsest.operators import verify as V
from palimpsest.sources import artifacts as R


def test_selections():
    assert settings.numbers("all", 3) == (0, 1, 2) and settings.numbers("1, 3-5,", 6) == (1, 3, 4, 5)
    assert settings.names("b,a,b", ("a", "b", "c")) == ("b", "a") and settings.names("ALL", ("a", "b")) == ("a", "b")
    for bad in ("7", "", "-"):
        with pytest.raises(ValueError):
            settings.numbers(bad, 3)
    with pytest.raises(ValueError):
        settings.names("d", ("a",))


@pytest.mark.parametrize("bad", [{"context_before": -1}, {"least": 0}, {"least": 9, "most": 8}, {"low": 0.9, "high": 0.5}, {"high": 1.5}])
def test_bad_extraction_settings(bad):
    with pytest.raises(ValueError):
        settings.Extraction(**bad)


def test_artifacts(tmp_path):
    R.write_json(tmp_path / "a" / "x.json", {"b": 1, "a": [2]})
    assert R.load_json(tmp_path / "a" / "x.json") == {"a": [2], "b": 1} and (tmp_path / "a" / "x.json").read_text().startswith('{\n  "a"')
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        R.load_json(tmp_path / "list.json")
    assert R.value_digest({"b": 1, "a": 2}) == R.value_digest({"a": 2, "b": 1}) != R.value_digest({"a": 2})
    one = R.folder_digest(tmp_path / "a")
    made = R.contract("probe", {"seed": 17}, {"data": tmp_path / "a", "list": tmp_path / "list.json"})
    assert R.check_contract(made) == made
    (tmp_path / "a" / "y").write_text("more")
    assert R.folder_digest(tmp_path / "a") != one
    with pytest.raises(ValueError, match="input data"):
        R.check_contract(made)
    with pytest.raises(ValueError, match="contract"):
        R.check_contract(made | {"settings": {}})
    with pytest.raises(ValueError):
        R.folder_digest(tmp_path / "none")

    def fill(folder):
        R.write_json(folder / "contract.json", made)

    R.published(tmp_path / "out", fill)
    assert R.is_complete(tmp_path / "out", made) and not R.is_complete(tmp_path / "none", made)
    with pytest.raises(FileExistsError):
        R.published(tmp_path / "out", fill)

    def broken(folder):
        (folder / "half").write_text("x")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        R.published(tmp_path / "out", broken, force=True)
    assert R.is_complete(tmp_path / "out", made) and sorted(p.name for p in tmp_path.iterdir()) == ["a", "list.json", "out"]


def test_projections_refuse_bad_rows(spark):
    rows = spark.createDataFrame([("e1", "l", "a", "b", 0, None, None), ("e1", "l", "a", "b", 1, "x", "y")], "episode_id string, lineage_id string, candidate_a string, candidate_b string, selected_index int, context_before string, context_after string")
    assert J.source_store(rows.limit(1)).first().context_before == ""
    with pytest.raises(Exception, match="comes twice"):
        J.source_store(rows).collect()
    with pytest.raises(ValueError, match="future_revised"):
        J.checked_episodes(rows)
    with pytest.raises(ValueError, match="no episodes"):
        J.checked_episodes(rows.where("false"), ("episode_id",))
    with pytest.raises(Exception, match="missing field"):
        J.checked_episodes(rows.withColumn("selected_index", F.lit(3)), ("episode_id", "selected_index")).collect()
    with pytest.raises(Exception, match="invalid teacher"):
        J.with_teacher(rows, spark.createDataFrame([("e1", 1.5)], "episode_id string, probability_a double")).collect()
    with pytest.raises(Exception, match="no label"):
        J.labelled(rows, spark.createDataFrame([("e2", 1)], "episode_id string, label int")).collect()


def test_comparison_needs_the_same_episodes(spark):
    rows = [("t", "e1", "l1", 1, 0.9), ("c", "e1", "l1", 1, 0.6), ("t", "e2", "l2", 0, 0.2), ("c", "e2", "l2", 0, 0.4)]
    df = spark.createDataFrame(rows, "arm string, episode_id string, lineage_id string, label int, probability double")
    r = B.comparison(df, "t", "c", 50).first()
    assert r.passed and r.episodes == 2 and r.treatment_accuracy == 1 and r.mean_difference < 0
    with pytest.raises(Exception, match="same episodes"):
        B.comparison(df.where("not (arm = 'c' and episode_id = 'e2')"), "t", "c", 50).collect()
    with pytest.raises(ValueError):
        B.statistic(df, "other")
    assert [c[0] for c in B.available_comparisons({"baseline", "full_preference"})] == ["full_vs_baseline"] and len(B.COMPARISONS) == 11


def test_learnability(spark):
    kind = "condition string, kind string, train_accuracy double, validation_loss double, status string"
    rows = [("m1", "tiny_set_memorization", 0.99, 1.0, ""), ("c1", "full_train_learning_curve", 0.6, 0.5, "null_like"), ("c2", "full_train_learning_curve", 0.6, 0.4, "learned_above_prior")]
    r = B.learnability(spark.createDataFrame(rows, kind)).first()
    assert r.memorised and r.learned and r.best_condition == "c2" and r.outcome.startswith("preference_generalised")
    assert B.learnability(spark.createDataFrame(rows[1:], kind)).first().outcome == "tiny_set_memorization_failed"


def test_quantiles_by_sorting(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 200)] + [("b", float(x)) for x in rng.standard_normal(101)] + [("c", 5.0), ("d", None)]
    got = {r.g: (r.n, r.q) for r in U.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", (0.0, 0.1, 0.5, 0.99, 1.0), ["g"]).collect()}
    for g in "abc":
        x = [v for k, v in rows if k == g]
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist())
    assert "d" not in got


def test_verifier_of_representations(spark):
    episodes = spark.createDataFrame([("e1", "l1"), ("e2", "l2")], "episode_id string, lineage_id string")
    members = spark.createDataFrame([(0, "train", "l1"), (0, "test", "l2")], "fold int, partition string, lineage_id string")
    v = spark.createDataFrame([("a", 0, "train", "e1", [1.0]), ("a", 0, "train", "e2", [float("nan")])], "arm string, fold int, partition string, episode_id string, v array<double>")
    assert V.representations(v, members, episodes, 1).first()[2:] == (1, 1, 0, 1)


def test_value_states_do_not_tell_the_choice(spark):
    import random

    rng = random.Random(5)
    rows = [(i, i % 3, [1.0, 1.0], [rng.gauss(0, 1), 0.1], [rng.gauss(0, 1), 0.1], i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, fold_bucket int, context array<double>, candidate_a array<double>, candidate_b array<double>, label int")
    net = L.value_networks(df, 3, epochs=1)[0]
    a = {r.id: r for r in L.value_states(df, net).collect()}
    b = {r.id: r for r in L.value_states(df.withColumn("label", 1 - F.col("label")), net).collect()}
    assert len(a) == 90 and all(a[i].blind == b[i].blind and a[i].choice_aware != b[i].choice_aware for i in a)


def test_command_line(spark, tmp_path):
    base = [f"Sentence number {i} of the story says word{i} quite plainly in article" for i in range(6)]
    with sqlite3.connect(tmp_path / "news.db") as c:
        c.execute("CREATE TABLE articles (source TEXT, a_id INTEGER, version_id INTEGER, text TEXT, created TEXT)")
        for a in range(40):
            for v in range(3):
                lines = [f"{s} {a}" for s in base]
                if a % 4 != 3 or v < 2:
                    lines[a % 6] += " changed" * v if a % 2 else " changed" * min(v, 1)
                c.execute("INSERT INTO articles VALUES ('paper', ?, ?, ?, ?)", (a, v, "\n".join(lines), f"2020-01-0{v + 1}"))
    run = lambda *args: main([str(x) for x in args], spark)
    assert run("inspect", "--database", tmp_path / "news.db")["tables"][0]["rows"] == 120
    audit = run("extract", "--database", tmp_path / "news.db", "--output", tmp_path / "e")
    assert audit["articles_seen"] == 40 and audit["accepted_examples"] == spark.read.parquet(f"{tmp_path}/e/episodes").count() > 20
    with pytest.raises(FileExistsError):
        run("extract", "--database", tmp_path / "news.db", "--output", tmp_path / "e")
    e = f"{tmp_path}/e/episodes"
    assert run("audit-context", "--episodes", e, "--output", tmp_path / "c")["context"]["episodes"] == audit["accepted_examples"]
    assert len(run("audit-numeric", "--episodes", e, "--output", tmp_path / "n")["categories"]) == 8
    done = run("splits", "--episodes", e, "--output", tmp_path / "s", "--folds", 4)
    assert done["verification"]["missing"] == 0 and json.loads((tmp_path / "s" / "settings.json").read_text()) == {"folds": 4, "seed": 17}
    assert run("prompts", "--episodes", e, "--output", tmp_path / "p", "--size", 10)["items"] <= 10
    assert set(COMMANDS) >= {"extract", "audit-context", "splits", "corpora", "probes"}


def test_schedule_rises_and_falls(spark):
    got = [r.x for r in spark.range(6).select(X.linear_schedule("id", 2, 5).alias("x")).collect()]
    assert got == pytest.approx([0, 0.5, 1, 2 / 3, 1 / 3, 0])
