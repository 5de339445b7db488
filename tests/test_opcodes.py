"""Opcodes and ratios without Python against difflib: random arrays with repetitions, moves, nulls and empty ones; texts that hold one another."""

import difflib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import alignment as A
from palimpsest.operators import selection as S
from palimpsest.plans import registry
from palimpsest.plans import revisions as P


def test_opcodes_equal_difflib(spark):
    rng = random.Random(5)
    pairs = [([], []), (["a"], []), ([], ["a"]), (None, ["a"]), (["a"], None), (["a", "b"], ["b", "a"]), (["a", "a", "a"], ["a", "b", "a"]), (["a", "b", "c"], ["x", "b", "x"])]
    for _ in range(300):
        one = [f"s{rng.randrange(30)}" for _ in range(rng.randrange(12))] if rng.random() < 0.5 else [f"s{i}" for i in range(rng.randrange(1, 20))]
        two = [f"n{rng.randrange(40)}" if rng.random() < 0.3 else s for s in one]
        if rng.random() < 0.4 and two:
            two.insert(rng.randrange(len(two)), two.pop(rng.randrange(len(two))) if rng.random() < 0.5 else "new")
        pairs.append((one, two))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>")
    out = {r["id"]: r["ops"] for r in A.with_opcodes(df, {"ops": ("a", "b")}).collect()}
    for i, (a, b) in enumerate(pairs):
        want = None if a is None or b is None else difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
        assert (None if out[i] is None else [tuple(o) for o in out[i]]) == want, (a, b)


def test_in_place_changes_and_held_texts_stay_out_of_python(spark, monkeypatch):
    """Nothing reaches difflib, so long lines that only grew cost no more than their length."""

    def only_nulls(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            assert one.null_count == two.null_count == len(one)
            yield one.cast("double")

    monkeypatch.setattr(A, "_ratio", only_nulls)
    long = "".join(chr(97 + i * i % 23) for i in range(200_000))
    rows = spark.createDataFrame([(long, long + " updated"), ("b" + long, long), ("", ""), ("", "abc"), ("é“x", "a é“x b")], "a string, b string")
    out = [r["r"] for r in rows.select(A.similarity_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert out == [2 * 200_000 / 400_008, 2 * 200_000 / 400_001, 1.0, 0.0, difflib.SequenceMatcher(None, "é“x", "a é“x b").ratio()]


def test_ratio_equals_difflib(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé ”") for _ in range(rng.randrange(40))) for _ in range(200)]
    pairs = [(a, a[: len(a) // 2] + rng.choice(texts)) if i % 2 else (a, rng.choice(texts)) for i, a in enumerate(texts)] + [(None, "a"), ("a", None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    out = {r["id"]: r["r"] for r in rows.select("id", A.similarity_ratio("a", "b").alias("r")).collect()}
    assert all(out[i] == (None if a is None or b is None else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) for i, (a, b) in enumerate(pairs))


def test_versions_are_sorted_once(spark):
    rows = spark.createDataFrame([("a", str(k), [f"s{k}", "t"]) for k in range(5)], "lineage_id string, version_id string, sentences array<string>")
    out = A.windows(rows, A.version_order(None, "version_id"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1
    got = [(r["nth"], r["version_0"], r["version_2"], r["sentences_1"]) for r in out.orderBy("nth").collect()]
    assert got == [(1, "0", "2", ["s1", "t"]), (2, "1", "3", ["s2", "t"]), (3, "2", "4", ["s3", "t"])]


def test_balanced_subset_reads_its_rows_once(spark):
    rows = spark.range(400).select(F.col("id").alias("source_id"), (F.col("id") % 2).cast("int").alias("target"))
    out = S.balanced_subset(rows, 31)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r["target"]: r["count"] for r in out.groupBy("target").count().collect()} == {0: 15, 1: 16}


def test_matched_characters_are_those_of_difflib(monkeypatch):
    """By bits, by the longest block alone and through difflib; on alphabets where ties abound."""
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("abcab", "cabca"), ("a" * 70, "a" * 64), ("\U0001f600é漢" * 5, "é漢\U0001f600" * 4)]
    pairs += [tuple("".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(2)) for letters in ("ab", "abc", "abcdefgh ", "aé漢") for most in (3, 8, 9, 17, 60) for _ in range(60)]
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()) for a, b in pairs]
    for small, large in ((1 << 19, 1 << 26), (64, 1 << 26), (64, 512), (0, 0)):
        monkeypatch.setattr(A, "SMALL", small)
        monkeypatch.setattr(A, "LARGE", large)
        assert [A.matched(a, b) for a, b in pairs] == want


def test_ratio_of_unlike_sentences_needs_no_loop_over_characters(monkeypatch):
    """Unlike sentences of a few hundred characters never reach difflib."""
    monkeypatch.setattr(A, "_matcher", None)
    rng = random.Random(6)
    a, b = ("".join(rng.choice("etaoin shrdlu") for _ in range(600)) for _ in range(2))
    assert next(A._ratio(iter([(pa.array([a, None, ""]), pa.array([b, "x", ""]))]))).to_pylist() == [difflib.SequenceMatcher(None, a, b, False).ratio(), None, 1.0]


def test_windows_of_whole_versions_keep_their_parts(spark):
    """Parts of versions are not put together by their size in a shuffle, where versions that are alike take little room."""
    rows = spark.range(30).selectExpr("cast(id % 10 as string) as lineage_id", "cast(id div 10 as string) as version_id", "array('a', 'b') as sentences")
    found = A.windows(rows, A.version_order(None, "version_id"))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(r["lineage_id"] for r in found.collect()) == sorted(str(i) for i in range(10))


def test_parts_of_versions_grow_with_their_bytes(spark, monkeypatch):
    """Whatever is set: ten times the versions meet in ten times the parts, so a task holds no more of them."""
    rows = lambda n: spark.range(3 * n).selectExpr(f"cast(id % {n} as string) as lineage_id", f"cast(id div {n} as string) as version_id", "array(repeat('é', 50), null, 'b') as sentences")
    monkeypatch.setattr(A, "PART", 1000)
    order = A.version_order(None, "version_id")
    assert [A.windows(rows(n), order).rdd.getNumPartitions() for n in (10, 40, 400)] == [4, 13, 122]
    assert A.windows(rows(40), order, n_parts=7).rdd.getNumPartitions() == 7
    assert A.windows(rows(40), order).count() == 40 and A.parts(rows(40).limit(0), F.lit(1)) == 4


def test_excluded_lineages_cost_no_second_sort_of_versions(spark, monkeypatch):
    """Where excluded lineages are too many for a broadcast, whole versions are shuffled and sorted once, in parts by their bytes."""
    monkeypatch.setattr(A, "PART", 300)
    rows = spark.range(30).selectExpr("cast(id % 10 as string) as lineage_id", "cast(id div 10 as string) as version_id", "array('the first line is here', concat('the other line ends as ', repeat(chr(int(97 + id)), 3))) as sentences")
    excluded = spark.range(4).selectExpr("cast(id as string) as lineage_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = A.temporal_pairs(rows, A.version_order(None, "version_id"), excluded)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["lineage_id"], r["temporal_pair_id"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # of versions for the window, of excluded lineages for the join
    assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [lineage_id") == 2
    assert found == [(str(k), f"{k}::{v}->{v + 1}::1::temporal") for k in range(4, 10) for v in range(2)]


def test_versions_are_dealt_as_documents_and_episodes_meet_in_more_parts(spark, monkeypatch, tmp_path):
    """Versions are made where their lineages lie, so that a third of their bytes is dealt, once; episodes follow the bytes of versions."""
    text = "\n".join(["a line of the document that is long enough"] * 40)
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(text).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    same = lambda: sorted(map(tuple, P.episodes(spark, str(tmp_path)).select("episode_id", "candidate_a", "future_revised").collect()))
    few = same()
    monkeypatch.setattr(A, "PART", 3 * 60 * len(text) // 48)
    assert P.version_parts(spark, str(tmp_path)) in (48, 49)
    plan = P.replaced(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
    assert P.episodes(spark, str(tmp_path)).rdd.getNumPartitions() == 6 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert same() == few != []


def test_future_label_in_more_parts_than_are_set(spark, monkeypatch, tmp_path):
    text = "\n".join(["a line of the document that is long enough"] * 40)
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(text).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = lambda: registry.queries()["future_label"](spark, str(tmp_path))
    few = sorted(map(tuple, labels().collect()))
    monkeypatch.setattr(A, "PART", 3 * 60 * len(text) // 48)
    plan = labels()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(episode_id#\d+, 6\)", plan) and re.search(r"hashpartitioning\(lineage_id#\d+, 4[89]\)", plan)
    assert sorted(map(tuple, labels().collect())) == few != []
