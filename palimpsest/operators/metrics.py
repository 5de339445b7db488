"""Forecast scoring: proper scores, ranks, paired differences, diagnostics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.selection import before_head, in_parts

LN2 = 0.6931471805599453


def _steps(rows: DataFrame, by: list[str], p: str, label: str) -> DataFrame:
    """Per distinct score: rows, positives, and both counted below it; scores are dealt into parts that end at quantiles, so
    ties meet and no task sees a whole group, also where all scores are near 0."""
    at = rows.groupBy(*by, F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    at = in_parts(at, "p", by)
    for name, value in (("n", F.col("n")), ("pos", F.col("pos"))):
        at = before_head(at, F.col("_part"), by, value)
        w = Window.partitionBy(*by, "_head").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        at = at.withColumn(f"{name}_below", F.coalesce(F.sum(name).over(w), F.lit(0)) + F.col("_before")).drop("_head", "_before")
    return at.drop("_part")


def roc_auc(rows: DataFrame, by: list[str] = (), p: str = "probability", label: str = "label") -> DataFrame:
    """[G22, W06] By average ranks; null where one class is absent."""
    by = list(by)
    at = _steps(rows, by, p, label)
    neg, below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    out = at.groupBy(*by).agg(F.sum(F.col("pos") * (below + neg / 2)).alias("u"), F.sum("pos").alias("pos"), F.sum(neg).alias("neg"))
    return out.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str] = (), p: str = "probability", label: str = "label") -> DataFrame:
    """[G30] Sum over descending scores of precision times the gain in recall."""
    by = list(by)
    at = _steps(rows.withColumn("_q", -F.col(p) + 1), by, "_q", label)
    precision = (F.col("pos_below") + F.col("pos")) / (F.col("n_below") + F.col("n"))
    out = at.groupBy(*by).agg(F.sum(F.col("pos") * precision).alias("s"), F.sum("pos").alias("pos"))
    return out.select(*by, F.when(F.col("pos") > 0, F.col("s") / F.col("pos")).alias("average_precision"))


def binary_metrics(rows: DataFrame, by: list[str] = (), p: str = "probability", label: str = "label", epsilon: float = 1e-7) -> DataFrame:
    """[G21, G30, G31] Counts, prevalence, mean score, log loss (clipped), Brier score (not clipped), accuracy at one half,
    balanced accuracy, calibration gap, the losses of the constant prevalence, and the rank area."""
    by = list(by)
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("double")
    rate = F.avg(label)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), rate.alias("prevalence"), F.avg(p).alias("mean_probability"), F.avg(X.log_loss(label, p, epsilon)).alias("log_loss"),
        F.avg(X.brier(label, p)).alias("brier"), F.avg(hit).alias("accuracy"), ((F.avg(F.when(F.col(label) == 1, hit)) + F.avg(F.when(F.col(label) == 0, hit))) / 2).alias("balanced_accuracy"),
        (F.avg(p) - rate).alias("calibration_gap"), X.binary_entropy(rate).alias("null_log_loss"), (rate * (1 - rate)).alias("null_brier"), F.greatest(rate, 1 - rate).alias("null_accuracy"),
    )
    auc = roc_auc(rows, by, p, label)
    return out.join(auc, by) if by else out.crossJoin(auc)


def group_losses(rows: DataFrame, group: list[str], epsilon: float = 1e-12) -> DataFrame:
    """[G26-G28] Sums per group, enough for any resampling of groups."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(X.log_loss("label", "probability", epsilon)).alias("log_loss_sum"), F.sum(X.brier("label", "probability")).alias("brier_sum"))


def unique_predictions(rows: DataFrame, by: list[str] = ("arm",), key: str = "episode_id") -> DataFrame:
    """[G53] Whether each arm has each episode once."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("episodes")).withColumn("unique", F.col("n") == F.col("episodes"))


def paired(rows: DataFrame, treatment: str, control: str, key: str = "episode_id") -> DataFrame:
    """[J09, M30] Loss differences of two arms (treatment less control), with a flag where their metadata differ."""
    pick = lambda arm, s: rows.where(F.col("arm") == arm).select(F.col(key), F.col("label").alias(f"label{s}"), F.col("lineage_id").alias(f"lineage{s}"), X.log_loss("label", "probability").alias(f"loss{s}"))
    both = pick(treatment, "_t").join(pick(control, "_c"), key, "full")
    fine = F.coalesce((F.col("label_t") == F.col("label_c")) & (F.col("lineage_t") == F.col("lineage_c")), F.lit(False))
    return both.select(key, F.coalesce("lineage_t", "lineage_c").alias("lineage_id"), (F.col("loss_t") - F.col("loss_c")).alias("difference"), fine.alias("consistent"))


def against_replicas(rows: DataFrame, treatment: str, replica_prefix: str, key: str = "episode_id") -> DataFrame:
    """[J13, M31] Loss of an arm less the mean loss of its replicas."""
    own = rows.where(F.col("arm") == treatment).select(key, "lineage_id", X.log_loss("label", "probability").alias("own"))
    other = rows.where(F.col("arm").startswith(replica_prefix)).groupBy(key).agg(F.avg(X.log_loss("label", "probability")).alias("mean"))
    return own.join(other, key).select(key, "lineage_id", (F.col("own") - F.col("mean")).alias("difference"))


def select_l2(candidates: DataFrame, by: list[str], stronger: bool = True, tolerance: float = 1e-12) -> DataFrame:
    """[T02, T03] The penalty with least validation loss; among ties the strongest, or the weakest."""
    least = candidates.groupBy(*by).agg(F.min("validation_log_loss").alias("_least"))
    ties = candidates.join(least, by).where(F.col("validation_log_loss") <= F.col("_least") + tolerance)
    return ties.groupBy(*by).agg((F.max if stronger else F.min)("l2_lambda").alias("l2_lambda"), F.first("_least").alias("validation_log_loss"))


def prior_diagnostic(rows: DataFrame, by: list[str]) -> DataFrame:
    """[G33, G34, G32] Accuracy with its interval against the class prior: learned_above_prior, below_prior or null_like."""
    out = rows.groupBy(*by).agg(F.count("*").alias("records"), F.count_if((F.col("probability") >= 0.5).cast("int") == F.col("label")).alias("correct"), F.avg("label").alias("rate"), F.avg(X.log_loss("label", "probability")).alias("mean_loss"))
    lower, upper = X.wilson("correct", "records", 1.959963984540054, clamp=True)
    prior = F.greatest(F.col("rate"), 1 - F.col("rate"))
    status = F.when((lower > prior) & (F.col("mean_loss") < X.binary_entropy("rate")), "learned_above_prior").when(upper < prior, "below_prior").otherwise("null_like")
    return out.select(*by, "records", "correct", (F.col("correct") / F.col("records")).alias("accuracy"), lower.alias("lower"), upper.alias("upper"), prior.alias("prior_accuracy"), "mean_loss", status.alias("status"))


def source_gate() -> Column:
    """[M52] Accuracy surely above one half, and loss below that of a coin."""
    lower, _ = X.wilson(F.round(F.col("accuracy") * F.col("n")), "n", 1.959963984540054)
    return (lower > 0.5) & (F.col("log_loss") < LN2)


def comparison_passed(mean, upper) -> Column:
    """[F44]"""
    return (X.col(mean) < 0) & (X.col(upper) < 0)


def trajectory(rows: DataFrame, by: list[str]) -> DataFrame:
    """[G36, G37, G35] First, last, least and most loss over steps, its relative reduction, and whether steps rise."""
    w = Window.partitionBy(*by).orderBy("step")
    rows = rows.withColumn("_rises", F.coalesce(F.col("step") > F.lag("step").over(w), F.lit(True)))
    out = rows.groupBy(*by).agg(F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.min("loss").alias("least"), F.max("loss").alias("most"), F.count("*").alias("points"), F.bool_and("_rises").alias("steps_rise"))
    return out.withColumn("relative_reduction", X.share(F.col("first") - F.col("last"), "first"))


def duplicate_hashes(rows: DataFrame, digest: str) -> DataFrame:
    """[G38]"""
    return rows.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def surface_baselines(episodes: DataFrame, target: str = "selected_index", key: str = "episode_id") -> DataFrame:
    """[G43, F31-F33] Accuracy of four fixed shortcuts; ties are broken by hash."""
    context = F.concat_ws(" ", "context_before", "context_after")
    guess = {
        "longer_candidate": X.compare_scores(F.length("candidate_a"), F.length("candidate_b")), "shorter_candidate": X.compare_scores(-F.length("candidate_a"), -F.length("candidate_b")),
        "context_token_overlap": X.compare_scores(X.token_overlap("candidate_a", context), X.token_overlap("candidate_b", context)), "more_numeric_tokens": X.compare_scores(X.numeric_token_count("candidate_a"), X.numeric_token_count("candidate_b")),
    }
    one = lambda name, g: F.struct(F.lit(name).alias("name"), g.alias("guess"), X.hash_bit(F.sha2(F.concat(F.lit(f"surface-tie:{name}:"), F.col(key)), 256), 16).alias("tie"))
    rows = episodes.select(F.col(target).alias("target"), F.explode(F.array(*[one(k, v) for k, v in guess.items()])).alias("g"))
    return rows.groupBy(F.col("g.name").alias("baseline")).agg(F.count("*").alias("records"), F.count_if(F.coalesce("g.guess", "g.tie") == F.col("target")).alias("correct"), F.count_if(F.col("g.guess").isNull()).alias("ties")).withColumn("accuracy", F.col("correct") / F.col("records"))


def swap_consistency(original: DataFrame, swapped: DataFrame, answers: DataFrame) -> DataFrame:
    """[G44, G20, J10, P16] Predictions before and after exchanging candidates: consistent where the second is the opposite."""
    rows = original.select("item_id", F.col("prediction").alias("first")).join(swapped.select("item_id", X.opposite("prediction").alias("second")), "item_id").join(answers.select("item_id", "selected"), "item_id")
    same = F.col("first") == F.col("second")
    out = rows.agg(F.count("*").alias("items"), F.count_if(same).alias("consistent"), F.count_if(same & (F.col("first") == F.col("selected"))).alias("consensus_correct"),
                   F.count_if(F.col("first") == F.col("selected")).alias("original_correct"), F.count_if(F.col("second") == F.col("selected")).alias("swapped_correct"), F.count_if(F.col("first") == "A").alias("original_a"))
    lower, upper = X.wilson("consensus_correct", "consistent", 1.959963984540054, clamp=True)
    return out.select("*", X.share("consistent", "items").alias("consistency"), X.share("consensus_correct", "consistent").alias("consensus_accuracy"), F.coalesce(lower, F.lit(0.0)).alias("lower"), F.coalesce(upper, F.lit(1.0)).alias("upper"))


def with_base(per: DataFrame, baseline: str) -> DataFrame:
    """per(arm, fold, loss) with `base`, the baseline's loss in the fold; folds without one are left out. A window, not a join of the
    rows with themselves: means that are taken twice differ in their last digits, and the baseline would beat itself."""
    base = F.max(F.when(F.col("arm") == baseline, F.col("loss"))).over(Window.partitionBy("fold"))
    return per.withColumn("base", base).where("base is not null")


def arm_summary(rows: DataFrame, baseline: str = "generic") -> DataFrame:
    """[G45-G50, G52, J11, G62] Pooled scores of each arm, folds in which it beats the baseline, and spread over folds."""
    per = rows.groupBy("arm", "fold").agg(F.avg(X.log_loss("label", "probability")).alias("loss"), F.count("*").alias("n"))
    folds = with_base(per, baseline).groupBy("arm").agg(F.count_if(F.col("loss") < F.col("base")).alias("folds_beating_baseline"), F.avg("loss").alias("fold_mean"), F.percentile("loss", F.lit(0.5)).alias("fold_median"),
                                                                   F.min("loss").alias("fold_least"), F.max("loss").alias("fold_most"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("weighted_loss"))
    return folds.join(rows.groupBy("arm").agg(F.count("*").alias("n"), F.avg(X.brier("label", "probability")).alias("brier")), "arm")


def specificity(runs: DataFrame) -> DataFrame:
    """[G48] Selected penalties per arm: how often each, and how often the largest."""
    most = runs.agg(F.max("l2_lambda").alias("most"))
    return runs.crossJoin(F.broadcast(most)).groupBy("arm", "l2_lambda").agg(F.count("*").alias("n"), F.count_if(F.col("l2_lambda") == F.col("most")).alias("at_most"), F.avg("validation_log_loss").alias("mean_loss"))


def seed_gains(rows: DataFrame, reference: str, candidate: str) -> DataFrame:
    """[G55, G56] Gains of a feature set over another by seed: mean, sample deviation (0 for one seed), positive seeds."""
    wide = rows.groupBy("seed").agg(F.max(F.when(F.col("feature_set") == reference, F.col("loss"))).alias("r"), F.max(F.when(F.col("feature_set") == candidate, F.col("loss"))).alias("c"))
    gain = F.col("r") - F.col("c")
    return wide.agg(F.count(gain).alias("seeds"), F.avg(gain).alias("mean_gain"), F.coalesce(F.stddev_samp(gain), F.lit(0.0)).alias("sd_gain"), F.count_if(gain > 0).alias("positive_seeds"))


def changed_fraction(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """[G54]"""
    return rows.groupBy(*by).agg(F.avg((F.col(a) != F.col(b)).cast("int")).alias("changed_fraction"))


def movement(a: str, b: str) -> Column:
    """[G61] Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
