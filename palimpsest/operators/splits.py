"""Leakage-free grouped folds and their checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X

COUNTERS = ("episodes", "future_revised", "selected_b", "number_changed", "number_dominant", "casualty_count")
# What a fold's deviation from its share costs, by counter.
WEIGHTS = {"lineages": 0.35, "episodes": 1.0, "future_revised": 1.0, "selected_b": 0.25, "number_changed": 0.35, "number_dominant": 0.20, "casualty_count": 0.10}
#: Lineages that are balanced together; more are dealt by hash into shards, each balanced by itself.
SHARD = 200_000


def lineage_stats(episodes: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """[G01, J02] Counters of each lineage; episodes without flags count as unflagged. Flags may be columns of episodes."""
    names = ("number_changed", "number_dominant_edit", "casualty_count_update")
    rows = episodes.select("episode_id", "lineage_id", "future_revised", "selected_index", *[n for n in names if n in episodes.columns])
    if flags is None:
        rows = rows.select("*", *[F.lit(False).alias(n) for n in names if n not in rows.columns])
    else:
        rows = rows.join(flags.select("episode_id", *names), "episode_id", "left").fillna(False, list(names))
    n = lambda x: F.count_if(x).cast("long")
    return rows.groupBy("lineage_id").agg(F.count("*").alias("episodes"), n("future_revised").alias("future_revised"), n(F.col("selected_index") == 1).alias("selected_b"),
                                          n("number_changed").alias("number_changed"), n("number_dominant_edit").alias("number_dominant"), n("casualty_count_update").alias("casualty_count"))


def hash_folds(stats: DataFrame, folds: int = 5, seed: int = 17) -> DataFrame:
    """lineage_id and bucket from a hash: balanced in expectation, without any exchange."""
    h = X.stable_hash(seed, F.col("lineage_id"))
    return stats.select("lineage_id", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % folds).cast("int").alias("bucket"))


def greedy_folds(stats: DataFrame, folds: int = 10, seed: int = 17, shard: int = SHARD) -> DataFrame:
    """[M01-M03, T01] lineage_id and bucket: largest lineages first, each to the fold whose weighted squared deviation from
    its equal share grows least; ties by hash. Balanced exactly within shards of bounded size."""
    if folds < 3:
        raise ValueError("at least three folds are needed")
    shards = max(1, -(-stats.count() // shard))
    rows = stats.withColumn("place", X.stable_hash(seed, F.col("lineage_id"))).withColumn("shard", F.pmod(F.xxhash64("lineage_id", F.lit(seed)), F.lit(shards)))
    for k in range(folds):
        rows = rows.withColumn(f"tie_{k}", X.stable_hash(seed, F.col("lineage_id"), k))
    fields = ["lineages", *COUNTERS]

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(lineages=1)
        x = part[fields].to_numpy(float)
        target = np.maximum(x.sum(0) / folds, 1.0)
        rate = x[:, 2].sum() / max(x[:, 1].sum(), 1)
        gap = np.abs(x[:, 2] - rate * x[:, 1])
        order = sorted(range(len(part)), key=lambda i: (-x[i, 1], -gap[i], part["place"].iat[i]))
        preference = np.argsort(part[[f"tie_{k}" for k in range(folds)]].to_numpy(str), axis=1)
        cost = np.array([WEIGHTS[f] for f in fields]) / target**2
        held = np.zeros((folds, len(fields)))
        bucket = np.zeros(len(part), np.int32)
        for i in order:
            # what this lineage adds to a fold's cost: (v + x - t)^2 - (v - t)^2
            added = ((2 * (held - target) * x[i] + x[i] ** 2) * cost).sum(1)
            near = preference[i]
            pick = near[np.argmin(np.round(added[near], 12))]
            held[pick] += x[i]
            bucket[i] = pick
        return pd.DataFrame({"lineage_id": part["lineage_id"], "bucket": bucket})

    return rows.groupBy("shard").applyInPandas(assign, "lineage_id string, bucket int")


def balanced_buckets(sizes: DataFrame, folds: int, namespace: str = "temporal-fold:17:", shard: int = SHARD) -> DataFrame:
    """[M07] lineage_id and bucket of sizes(lineage_id, n): largest first, each to the emptiest bucket."""
    shards = max(1, -(-sizes.count() // shard))
    rows = sizes.withColumn("place", F.sha2(F.concat(F.lit(namespace), "lineage_id"), 256)).withColumn("shard", F.pmod(F.xxhash64("lineage_id"), F.lit(shards)))

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "place"], ascending=[False, True])
        held, bucket = np.zeros(folds), []
        for n in part["n"]:
            k = int(held.argmin())
            held[k] += n
            bucket.append(k)
        return pd.DataFrame({"lineage_id": part["lineage_id"], "bucket": np.array(bucket, np.int32)})

    return rows.groupBy("shard").applyInPandas(assign, "lineage_id string, bucket int")


def membership(assignment: DataFrame, folds: int) -> DataFrame:
    """[P11, P12, M04, U02] fold, partition and lineage: bucket k is tested in fold k and validates fold k - 1."""
    rows = assignment.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    part = F.when(F.col("bucket") == F.col("fold"), "test").when(F.col("bucket") == (F.col("fold") + 1) % folds, "validation").otherwise("train")
    return rows.select("fold", part.alias("partition"), "lineage_id")


def partition_summary(members: DataFrame, stats: DataFrame) -> DataFrame:
    """[G02, G03] Counters, rates and shares of each partition of each fold."""
    rows = members.join(stats, "lineage_id").groupBy("fold", "partition").agg(F.count("*").alias("lineages"), *[F.sum(c).alias(c) for c in COUNTERS])
    total = stats.agg(F.count("*").alias("all_lineages"), F.sum("episodes").alias("all_episodes"))
    out = rows.crossJoin(F.broadcast(total))
    return out.select("fold", "partition", "lineages", *COUNTERS, X.share("future_revised", "episodes").alias("future_revised_rate"), X.share("selected_b", "episodes").alias("selected_b_rate"),
                      X.share("number_changed", "episodes").alias("number_changed_rate"), X.share("lineages", "all_lineages").alias("lineage_share"), X.share("episodes", "all_episodes").alias("episode_share"))


def balance(summary: DataFrame, stats: DataFrame, folds: int) -> DataFrame:
    """[G04]"""
    rates = stats.agg(X.share(F.sum("future_revised"), F.sum("episodes")).alias("rate"), X.share(F.sum("number_changed"), F.sum("episodes")).alias("numeric"))
    rows = summary.crossJoin(F.broadcast(rates))
    test = F.col("partition") == "test"
    worst = lambda x: F.max(F.when(test, F.abs(x)))
    return rows.agg(
        F.sum(F.when(test, F.col("lineages"))).alias("test_lineage_assignments"), F.sum(F.when(F.col("partition") == "validation", F.col("lineages"))).alias("validation_lineage_assignments"),
        worst(F.col("episode_share") - 1 / folds).alias("max_test_episode_share_deviation"), worst(F.col("lineage_share") - 1 / folds).alias("max_test_lineage_share_deviation"),
        worst(F.col("future_revised_rate") - F.col("rate")).alias("max_test_future_rate_deviation"), worst(F.col("number_changed_rate") - F.col("numeric")).alias("max_test_numeric_rate_deviation"),
    )


def gates(diagnostics: DataFrame) -> DataFrame:
    """[M05]"""
    d = F.col
    same = d("test_lineage_assignments") == d("validation_lineage_assignments")
    return diagnostics.select(
        same.alias("all_lineages_tested_exactly_once"), same.alias("all_lineages_validated_exactly_once"),
        (d("max_test_episode_share_deviation") <= 0.02).alias("test_episode_share_within_2_points"), (d("max_test_lineage_share_deviation") <= 0.02).alias("test_lineage_share_within_2_points"),
        (d("max_test_future_rate_deviation") <= 0.03).alias("test_future_rate_within_3_points"), (d("max_test_numeric_rate_deviation") <= 0.03).alias("test_numeric_change_rate_within_3_points"),
    )


def verification(members: DataFrame, stats: DataFrame, folds: int) -> DataFrame:
    """[M06, U01, U03] Each lineage once in every fold, tested once, validated once, and next fold's test validates."""
    per = members.groupBy("lineage_id").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("f"), F.count_if(F.col("partition") == "test").alias("t"), F.count_if(F.col("partition") == "validation").alias("v"),
                                            F.max(F.when(F.col("partition") == "test", F.col("fold"))).alias("test"), F.max(F.when(F.col("partition") == "validation", F.col("fold"))).alias("validation"))
    every = stats.select("lineage_id").join(per, "lineage_id", "full")
    return every.agg(
        F.count("*").alias("lineages"), F.count_if(F.col("n") != folds).alias("not_in_every_fold"), F.count_if(F.col("f") != folds).alias("overlapping"), F.count_if(F.col("t") != 1).alias("not_tested_once"),
        F.count_if(F.col("v") != 1).alias("not_validated_once"), F.count_if((F.col("validation") + 1) % folds != F.col("test")).alias("validation_not_next_test"), F.count_if(F.col("n").isNull()).alias("missing"),
    )


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """[J03, U03] Keys of one side only."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(key, F.lit("left_only").alias("side"))
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").select(key, F.lit("right_only").alias("side"))
    return a.unionByName(b)
