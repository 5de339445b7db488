"""Reports over forecasts, runs and artifacts: comparisons, aggregates by arm, regime and seed, and learnability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import metrics as M
from palimpsest.operators import resample as R
from palimpsest.operators.audit import quantiles
from palimpsest.sources.staging import written

Z = 1.959963984540054
# Comparisons of feature sets, as name, reference and candidate.
COMPARISONS = (
    ("full_vs_baseline", "baseline", "full_preference"),
    ("geometry_vs_baseline", "baseline", "plus_edit_geometry"),
    ("lexical_vs_baseline", "baseline", "plus_lexical_relation"),
    ("rejected_text_vs_baseline", "baseline", "plus_rejected_text"),
    ("text_geometry_vs_baseline", "baseline", "plus_text_geometry"),
    ("text_lexical_vs_baseline", "baseline", "plus_text_lexical"),
    ("geometry_lexical_vs_baseline", "baseline", "plus_geometry_lexical"),
    ("semantic_increment_beyond_nontext", "plus_geometry_lexical", "full_preference"),
    ("geometry_increment_beyond_text_lexical", "plus_text_lexical", "full_preference"),
    ("lexical_increment_beyond_text_geometry", "plus_text_geometry", "full_preference"),
    ("authentic_vs_matched_shuffle", "matched_shuffled_full_preference", "full_preference"),
)
# Statistics as the sums whose difference they are.
STATISTICS = {
    "pfi_log_loss": ("no_pref_log_sum", "full_log_sum"),
    "pfi_brier": ("no_pref_brier_sum", "full_brier_sum"),
    "shuffle_gap_log_loss": ("shuffled_log_sum", "full_log_sum"),
    "shuffle_gap_brier": ("shuffled_brier_sum", "full_brier_sum"),
}


def _hit(p: str = "probability", label: str = "label"):
    return ((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("double")


def comparison(rows: DataFrame, treatment: str, control: str, replicates: int = 1000, seed: int = 17, name: str | None = None) -> DataFrame:
    """[M30, G49, F44] One row: mean loss difference of two arms over the same episodes, its lineage bootstrap interval, each
    arm's loss and accuracy, and whether the treatment is surely better. Arms with other episodes or labels are an error."""
    both = M.paired(rows, treatment, control)
    fine = F.when(F.col("consistent"), F.col("difference")).otherwise(F.raise_error(F.lit(f"{treatment} and {control} do not have the same episodes")))
    sums = both.withColumn("difference", fine).groupBy("lineage_id").agg(F.sum("difference").alias("total"), F.count("*").alias("n"))
    return _compared(sums, rows, treatment, control, replicates, seed, name or f"{treatment}_vs_{control}")


def _compared(sums: DataFrame, rows: DataFrame, treatment: str, control: str, replicates: int, seed: int, name: str) -> DataFrame:
    interval = R.interval(R.bootstrap(sums, "lineage_id", "total", "n", replicates, seed)).select("lower", "upper")
    mean = sums.agg((F.sum("total") / F.sum("n")).alias("mean_difference"), F.sum("n").alias("episodes"), F.count("*").alias("lineages"))
    own = lambda arm, c: rows.where(F.col("arm").startswith(arm)).agg(F.avg(X.log_loss("label", "probability")).alias(f"{c}_log_loss"), F.avg(_hit()).alias(f"{c}_accuracy"))
    out = mean.crossJoin(interval).crossJoin(own(treatment, "treatment")).crossJoin(own(control, "control"))
    return out.select(F.lit(name).alias("comparison"), "*", M.comparison_passed("mean_difference", "upper").alias("passed"))


def replica_comparison(rows: DataFrame, treatment: str, prefix: str, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """[M31] The same against the mean loss of an arm's replicas."""
    sums = M.against_replicas(rows, treatment, prefix).groupBy("lineage_id").agg(F.sum("difference").alias("total"), F.count("*").alias("n"))
    return _compared(sums, rows, treatment, prefix, replicates, seed, f"{treatment}_vs_mean_{prefix}")


def comparisons(rows: DataFrame, pairs: list[tuple[str, str]], replicates: int = 1000, seed: int = 17) -> DataFrame:
    """[G49] A row for each pair of arms."""
    return reduce(DataFrame.unionByName, [comparison(rows, a, b, replicates, seed + k) for k, (a, b) in enumerate(pairs)])


def available_comparisons(available: set[str]) -> list[tuple[str, str, str]]:
    """[G57] The comparisons whose feature sets are both there."""
    return [c for c in COMPARISONS if c[1] in available and c[2] in available]


def comparison_gains(rows: DataFrame, metrics: tuple[str, ...] = ("log_loss", "brier")) -> DataFrame:
    """[G56, G57, G55] Of rows(seed, feature_set, metrics...): gain of each comparison in each metric over seeds: mean, sample
    deviation (0 for one seed), positive seeds. Comparisons are joined in, so feature sets that are missing drop out."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(list(COMPARISONS), "comparison string, reference string, candidate string"))
    long = rows.select("seed", "feature_set", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("seed", "feature_set", "m.*")
    base = long.join(table, F.col("feature_set") == F.col("reference")).select("comparison", "candidate", "seed", "metric", F.col("x").alias("before"))
    both = base.join(long.select("seed", "metric", F.col("feature_set").alias("candidate"), F.col("x").alias("after")), ["candidate", "seed", "metric"])
    gain = F.col("before") - F.col("after")
    return both.groupBy("comparison", "metric").agg(F.count("*").alias("seeds"), F.avg(gain).alias("mean_gain"), F.coalesce(F.stddev_samp(gain), F.lit(0.0)).alias("sd_gain"), F.count_if(gain > 0).alias("positive_seeds"))


def feature_set_means(rows: DataFrame, metrics: tuple[str, ...], null_metric: str, metric: str) -> DataFrame:
    """[G60] Mean and sample deviation of each metric by feature set over seeds, and the mean gain over the null model."""
    out = rows.groupBy("feature_set").agg(F.count("*").alias("seeds"), *[f(m).alias(f"{n}_{m}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))], F.avg(F.col(null_metric) - F.col(metric)).alias("gain_over_null"))
    return out.fillna(0.0, [f"sd_{m}" for m in metrics])


def statistic(sums: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """[G29] A statistic of STATISTICS from sums by group: the difference of two sums over all rows; null for no rows."""
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name}")
    more, less = STATISTICS[name]
    return sums.groupBy(*by).agg(((F.sum(more) - F.sum(less)) / F.nullif(F.sum("n_rows").cast("double"), F.lit(0.0))).alias(name))


def regime_aggregate(rows: DataFrame) -> DataFrame:
    """[G32] Of folds(regime, fold, records, correct, positives, mean_loss, status): pooled accuracy with its interval, range
    over folds, class prior, record-weighted loss and status."""
    rate = F.sum("positives") / F.sum("records")
    out = rows.groupBy("regime").agg(
        F.count("*").alias("folds"), F.sum("records").alias("records"), F.sum("correct").alias("correct"), F.sum("positives").alias("positives"), (F.sum("correct") / F.sum("records")).alias("accuracy"),
        F.min(F.col("correct") / F.col("records")).alias("least_accuracy"), F.max(F.col("correct") / F.col("records")).alias("most_accuracy"), F.greatest(rate, 1 - rate).alias("prior_accuracy"),
        X.binary_entropy(rate).alias("prior_log_loss"), (F.sum(F.col("mean_loss") * F.col("records")) / F.sum("records")).alias("mean_loss"), F.count_if(F.col("status") == "learned_above_prior").alias("learned_folds"),
    )
    lower, upper = X.wilson("correct", "records", Z)
    status = F.when((lower > F.col("prior_accuracy")) & (F.col("mean_loss") < F.col("prior_log_loss")), "learned_above_prior").when(upper < F.col("prior_accuracy"), "below_prior").otherwise("null_like")
    return out.select("*", lower.alias("lower"), upper.alias("upper"), status.alias("status"))


def language_aggregate(rows: DataFrame) -> DataFrame:
    """[G32, G35] Of folds(regime, units, accuracy, mean_loss, first_loss, last_loss, fallbacks): unit-weighted accuracy and
    loss, perplexity, fallbacks, and whether every fold learned: its loss fell and no mask fell back."""
    learned = (F.col("last_loss") < F.col("first_loss")) & (F.col("fallbacks") == 0)
    out = rows.groupBy("regime").agg(F.count("*").alias("folds"), F.sum("units").alias("units"), *[(F.sum(F.col(c) * F.col("units")) / F.sum("units")).alias(c) for c in ("accuracy", "mean_loss")],
                                     F.sum("fallbacks").alias("fallbacks"), F.count_if(learned).alias("learned_folds"))
    return out.select("*", F.exp("mean_loss").alias("perplexity"), F.when(F.col("learned_folds") == F.col("folds"), "learned").otherwise("mixed").alias("status"))


def trajectory_means(trajectories: DataFrame, by: str = "regime") -> DataFrame:
    """[G37] Of trajectory() rows: means of first and last losses, and folds in which the loss fell."""
    return trajectories.groupBy(by).agg(F.count("*").alias("folds"), F.avg("first").alias("mean_first"), F.avg("last").alias("mean_last"), F.count_if(F.col("last") < F.col("first")).alias("folds_with_loss_decrease"))


def weighted_summary(rows: DataFrame, by: list[str], metrics: tuple[str, ...], weight: str = "records") -> DataFrame:
    """[G51] Means of metrics over rows, weighted by their records."""
    return rows.groupBy(*by).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in metrics])


def fold_spread(rows: DataFrame) -> DataFrame:
    """[G46, G47, G52] Pooled accuracy, loss and Brier score of each arm, and mean, median, least and most of its folds'."""
    metrics = {"accuracy": _hit(), "log_loss": X.log_loss("label", "probability"), "brier": X.brier("label", "probability")}
    pooled = rows.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("lineage_id").alias("lineages"), *[F.avg(e).alias(m) for m, e in metrics.items()])
    per = rows.groupBy("arm", "fold").agg(*[F.avg(e).alias(m) for m, e in metrics.items()])
    spread = per.groupBy("arm").agg(*[f(m).alias(f"{n}_{m}") for m in metrics for f, n in ((F.avg, "mean"), (lambda c: F.percentile(c, F.lit(0.5)), "median"), (F.min, "least"), (F.max, "most"))])
    return pooled.join(spread, "arm")


def replica_aggregate(rows: DataFrame, prefix: str) -> DataFrame:
    """[G50] Loss and accuracy of each replica of an arm, and `mean` of the replicas."""
    per = rows.where(F.col("arm").startswith(prefix)).groupBy("arm").agg(F.count("*").alias("n"), F.avg(X.log_loss("label", "probability")).alias("log_loss"), F.avg(_hit()).alias("accuracy"))
    return per.unionByName(per.agg(F.lit("mean").alias("arm"), F.max("n").alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("accuracy").alias("accuracy")))


def full_summary(rows: DataFrame, baseline: str = "generic") -> DataFrame:
    """[G45] Pooled metrics of each arm, folds that beat the baseline, and the record-weighted loss of a constant forecast: the
    rate of all other folds."""
    per = rows.groupBy("arm", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.avg(X.log_loss("label", "probability")).alias("loss"))
    all_ = per.groupBy("arm").agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    rate = (F.col("all_pos") - F.col("pos")) / (F.col("all_n") - F.col("n"))
    constant = -(F.col("pos") * F.ln(rate) + (F.col("n") - F.col("pos")) * F.ln(1 - rate))
    out = M.with_base(per, baseline).join(F.broadcast(all_), "arm").groupBy("arm").agg(
        F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("log_loss"), F.count_if(F.col("loss") < F.col("base")).alias("folds_beating_baseline"), (F.sum(constant) / F.sum("n")).alias("constant_prior_log_loss"),
    )
    return out.withColumn("beats_constant", F.col("log_loss") < F.col("constant_prior_log_loss"))


def specificity_report(candidates: DataFrame, dimensions: DataFrame, reference: str) -> DataFrame:
    """[G48] Of candidates(arm, fold, l2_lambda, validation_log_loss) and dimensions(arm, dimension): folds, how many selected the
    largest penalty, mean selected loss, its gap to the reference arm, and dimensions over the reference arm's."""
    chosen = M.select_l2(candidates, ["arm", "fold"])
    most = candidates.agg(F.max("l2_lambda").alias("most"))
    per = chosen.crossJoin(F.broadcast(most)).groupBy("arm").agg(F.count("*").alias("folds"), F.count_if(F.col("l2_lambda") == F.col("most")).alias("at_most"), F.avg("validation_log_loss").alias("mean_loss")).join(F.broadcast(dimensions), "arm")
    base = per.where(F.col("arm") == reference).select(F.col("mean_loss").alias("base_loss"), F.col("dimension").alias("base_dimension"))
    return per.crossJoin(F.broadcast(base)).select("arm", "folds", "at_most", "mean_loss", "dimension", (F.col("mean_loss") - F.col("base_loss")).alias("gap"), (F.col("dimension") / F.col("base_dimension")).alias("dimension_ratio"))


def probability_quantiles(rows: DataFrame, by: list[str], at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """[G30] Quantiles of forecasts with linear interpolation; no task holds the forecasts of a group."""
    return quantiles(rows, "probability", at, by).select(*by, *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)])


def learnability(runs: DataFrame) -> DataFrame:
    """[G62] Of runs(condition, kind, train_accuracy, validation_loss, status): whether every tiny set was memorised (accuracy of
    0.95 and up), whether any longer run learned, the run of least validation loss, and the outcome."""
    tiny, curve = F.col("kind") == "tiny_set_memorization", F.col("kind") == "full_train_learning_curve"
    out = runs.agg(F.coalesce(F.bool_and(F.when(tiny, F.col("train_accuracy") >= 0.95)), F.lit(False)).alias("memorised"), F.coalesce(F.bool_or(curve & (F.col("status") == "learned_above_prior")), F.lit(False)).alias("learned"),
                   F.min_by("condition", F.when(curve, F.col("validation_loss"))).alias("best_condition"), F.min(F.when(curve, F.col("validation_loss"))).alias("best_loss"))
    outcome = F.when(~F.col("memorised"), "tiny_set_memorization_failed").when(F.col("learned"), "preference_generalised_above_prior_at_extended_budget").otherwise("memorisation_succeeded_but_validation_remained_null_like")
    return out.withColumn("outcome", outcome)


def artifact_counts(episodes: DataFrame, audit: DataFrame) -> DataFrame:
    """[G63] Whether episodes agree with their extraction_audit(): counts of rows, lineages, outcomes and unique ids."""
    n = episodes.agg(F.count("*").alias("rows"), F.countDistinct("episode_id").alias("ids"), F.countDistinct("lineage_id").alias("lineages"), F.count_if("future_revised").alias("revised"))
    both = n.crossJoin(audit)
    return both.select((F.col("rows") == F.col("accepted_examples")).alias("rows_match"), (F.col("ids") == F.col("rows")).alias("ids_unique"), (F.col("lineages") == F.col("articles_with_examples")).alias("lineages_match"),
                       (F.col("revised") == F.col("future_revised_examples")).alias("outcomes_match"), (F.col("revised") + F.col("future_stable_examples") == F.col("rows")).alias("outcomes_complete"))


def boosted_aggregate(pooled: DataFrame, treatment: str, control: str, replicas: str, replicates: int = 1000, seed: int = 17, least_negative: int = 4) -> DataFrame:
    """[G52, G53] One row for each comparison of `treatment` in pooled(episode_id, lineage_id, arm, label, probability): with `control`,
    with each arm named `replicas`..., and with their mean: mean loss difference, interval over lineages, whether both are below zero,
    rows of both arms that are not there once, and, alike in all rows, the replicas that it beats and the verdict: better than
    control and mean, and than at least `least_negative` replicas."""
    loss = pooled.select("episode_id", "lineage_id", "arm", X.log_loss("label", "probability", 1e-7).alias("loss"))
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("loss")))
    names = sorted(r[0] for r in pooled.where(F.col("arm").startswith(replicas)).select("arm").distinct().collect())
    wide = loss.groupBy("episode_id", "lineage_id").agg(one(treatment).alias("t"), one(control).alias("c"), F.avg(F.when(F.col("arm").startswith(replicas), F.col("loss"))).alias("m"), *[one(n).alias(f"r{i}") for i, n in enumerate(names)])
    parts = [(control, "c"), *[(n, f"r{i}") for i, n in enumerate(names)], ("mean of replicas", "m")]
    # each comparison's sums by lineage in one pass, as columns of one table
    sums = wide.groupBy("lineage_id").agg(F.count("*").alias("n"), *[F.sum(F.col("t") - F.col(x)).alias(x) for _, x in parts])
    sums = written(sums, "sums")
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for _, x in parts]).first()
    repeated = pooled.groupBy("arm", "episode_id").agg(F.count("*").alias("k")).groupBy("arm").agg(F.count_if(F.col("k") > 1).alias("repeated"), F.count("*").alias("episodes"))
    whole = {r["arm"]: (r["repeated"], r["episodes"]) for r in repeated.collect()}
    out = []
    for k, (name, x) in enumerate(parts):
        i = R.interval(R.bootstrap(sums.select("lineage_id", "n", F.col(x).alias("total")), "lineage_id", "total", "n", replicates, seed + k)).first()
        mean = total[x] / total["n"] if total["n"] else None
        own = [whole.get(n, (0, 0)) for n in (treatment, *([name] if x != "m" else names))]
        out.append((f"{treatment} - {name}", mean, i["lower"], i["upper"], mean is not None and mean < 0 and i["upper"] is not None and i["upper"] < 0, int(sum(r for r, _ in own) + sum(abs(e - own[0][1]) for _, e in own))))
    negative = sum(m is not None and m < 0 for _, m, *_ in out[1:-1])
    supported = bool(out[0][4] and out[-1][4] and negative >= least_negative)
    return pooled.sparkSession.createDataFrame([(*r, negative, supported) for r in out], "comparison string, mean_difference double, lower double, upper double, passed boolean, faulty_rows int, negative_replicas int, supported boolean")
