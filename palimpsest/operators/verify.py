"""Verifiers: they read what was written, compute it again and say what does not agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import corpora as C
from palimpsest.operators import metrics as M


def corpora(path: str, episodes: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """[M14] The gates of corpora written by sources.tables.write_corpora(), and whether every record's source is known and comes once
    in its cell."""
    records = episodes.sparkSession.read.parquet(path)
    known = episodes.select(F.col("episode_id").alias("source_id")).unionByName(pairs.select(F.col("temporal_pair_id").alias("source_id")))
    unknown = records.select("source_id").distinct().join(known, "source_id", "left_anti").agg((F.count("*") == 0).alias("all_sources_are_known"))
    twice = records.groupBy("corpus", *C.CELL, "source_id").count().where("count > 1").agg((F.count("*") == 0).alias("sources_come_once"))
    return C.gates(records, episodes, pairs, members).crossJoin(unknown).crossJoin(twice)


def forecasts(predictions: DataFrame, reported: DataFrame, labels: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """[M26] By arm and fold, of predictions(arm, fold, episode_id, lineage_id, label, logit, probability) and reported(arm, fold, n,
    log_loss, brier, accuracy): whether probabilities are those of the logits, labels are the true ones, and the reported
    metrics come out again. labels(episode_id, label)."""
    rows = predictions.join(labels.select("episode_id", F.col("label").alias("truth")), "episode_id", "left")
    again = rows.groupBy("arm", "fold").agg(
        F.count("*").alias("rows"), F.countDistinct("episode_id").alias("ids"), F.coalesce(F.bool_and(F.abs(X.sigmoid("logit") - F.col("probability")) <= tolerance), F.lit(False)).alias("probabilities_match"),
        F.bool_and(F.coalesce(F.col("label") == F.col("truth"), F.lit(False))).alias("labels_match"), F.avg(X.log_loss("label", "probability")).alias("own_log_loss"), F.avg(X.brier("label", "probability")).alias("own_brier"),
        F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("own_accuracy"),
    )
    both = again.join(reported, ["arm", "fold"], "full")
    same = F.coalesce(F.col("rows") == F.col("n"), F.lit(False))
    for m in ("log_loss", "brier", "accuracy"):
        same = same & F.coalesce(X.close(m, f"own_{m}", tolerance), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return both.select("arm", "fold", flag(F.col("ids") == F.col("rows")).alias("ids_unique"), flag(F.col("probabilities_match")).alias("probabilities_match"), flag(F.col("labels_match")).alias("labels_match"), same.alias("metrics_match"))


def training_runs(runs: DataFrame, steps: DataFrame, wanted_steps: int) -> DataFrame:
    """[M57] Of runs(regime, fold, update_steps, contract_sha256) and steps(regime, fold, step, loss): by regime whether every fold ran all steps,
    under one contract, with finite losses at rising steps, and how many folds there are."""
    per = M.trajectory(steps, ["regime", "fold"]).select("regime", "fold", "steps_rise", (~F.isnan("last") & ~F.isnan("first")).alias("finite"))
    both = runs.join(per, ["regime", "fold"], "left")
    return both.groupBy("regime").agg(F.count("*").alias("folds"), F.bool_and(F.col("update_steps") == wanted_steps).alias("all_steps_done"), (F.countDistinct("contract_sha256") == 1).alias("one_contract"),
                                      F.bool_and(F.coalesce("steps_rise", F.lit(False))).alias("steps_rise"), F.bool_and(F.coalesce("finite", F.lit(False))).alias("losses_finite"))


def representations(vectors: DataFrame, members: DataFrame, episodes: DataFrame, dimension: int) -> DataFrame:
    """[M58] Of vectors(arm, fold, partition, episode_id, v): by arm and fold whether the rows are exactly the episodes of the fold's
    partitions, once each, finite and of the right dimension."""
    wanted = episodes.select("episode_id", "lineage_id").join(members, "lineage_id").select("fold", "partition", "episode_id").withColumn("wanted", F.lit(1))
    arms = vectors.select("arm").distinct()
    fine = (F.size("v") == dimension) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vectors.groupBy("arm", "fold", "partition", "episode_id").agg(F.count("*").alias("n"), F.bool_and(fine).alias("fine"))
    both = found.join(arms.crossJoin(wanted), ["arm", "fold", "partition", "episode_id"], "full")
    return both.groupBy("arm", "fold").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("fine")).alias("malformed"))
