"""Queries of reports, projections, views and verifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.operators import audit as U
from palimpsest.operators import metrics as M
from palimpsest.operators import models as L
from palimpsest.operators import projections as J
from palimpsest.operators import reports as B
from palimpsest.operators import resample as R
from palimpsest.operators import verify as V
from palimpsest.plans.experiments import _L2, _MEMBERS, _PRED, SEEDS, candidates, members_of, predictions
from palimpsest.plans.registry import query
from palimpsest.plans.revisions import episodes, replaced, version_parts, versions
from palimpsest.sources.fixture import CELLS_SQL, EPISODES_SQL, TOKENS_SQL, table
from palimpsest.sources.staging import written

# --- comparisons ------------------------------------------------------------------------------------------------

_ARMS = ", q AS (SELECT arm, avg(loss) AS log_loss, avg(((probability >= 0.5)::INT = label)::INT) AS accuracy FROM scored GROUP BY arm)"
_DRAW = """
, x{k} AS (SELECT *, row_number() OVER (ORDER BY sha256('{seed}' || chr(31) || lineage_id), lineage_id) - 1 AS pos FROM d{k}), k{k} AS (SELECT count(*) AS g FROM d{k})
, draw{k} AS (SELECT r, ('0x' || substr(sha256('{seed}' || chr(31) || r || chr(31) || s), 1, 12))::BIGINT % (SELECT g FROM k{k}) AS pos FROM range(200) a(r), range((SELECT g FROM k{k})) b(s))
, i{k} AS (SELECT quantile_cont(statistic, 0.025) AS lower, quantile_cont(statistic, 0.975) AS upper FROM (SELECT r, sum(total) / sum(n) AS statistic FROM draw{k} JOIN x{k} USING (pos) GROUP BY r))
"""
_PAIR = ", d{k} AS (SELECT t.lineage_id, sum(t.loss - c.loss) AS total, count(*) AS n FROM scored t JOIN scored c USING (episode_id) WHERE t.arm = '{a}' AND c.arm = '{b}' GROUP BY t.lineage_id)"
_ROW = """SELECT '{name}' AS comparison, m.mean AS mean_difference, m.n AS episodes, m.l AS lineages, lower, upper, {t}.log_loss AS treatment_log_loss, {t}.accuracy AS treatment_accuracy, {c}.log_loss AS control_log_loss, {c}.accuracy AS control_accuracy, m.mean < 0 AND upper < 0 AS passed
 FROM (SELECT sum(total) / sum(n) AS mean, sum(n)::BIGINT AS n, count(*) AS l FROM d{k}) m, i{k}, {ts}, {cs}"""


def _side(arm, alias):
    return f"(SELECT * FROM q WHERE arm = '{arm}') {alias}"


@query("arm_comparisons", _PRED + _ARMS + "".join(_PAIR.format(k=k, a=a, b=b) + _DRAW.format(k=k, seed=17 + k) for k, (a, b) in enumerate((("treatment", "generic"), ("shuffled_0", "generic"), ("treatment", "shuffled_0")))) + " UNION ALL ".join(
    _ROW.format(name=f"{a}_vs_{b}", k=k, t="t", c="c", ts=_side(a, "t"), cs=_side(b, "c")) for k, (a, b) in enumerate((("treatment", "generic"), ("shuffled_0", "generic"), ("treatment", "shuffled_0")))))
def _(spark, sf_dir):
    return B.comparisons(predictions(spark, sf_dir), [("treatment", "generic"), ("shuffled_0", "generic"), ("treatment", "shuffled_0")], 200)


@query("replica_comparison", _PRED + _ARMS + """, d0 AS (SELECT t.lineage_id, sum(t.loss - r.m) AS total, count(*) AS n FROM scored t JOIN (SELECT episode_id, avg(loss) AS m FROM scored WHERE arm LIKE 'shuffled%' GROUP BY 1) r USING (episode_id) WHERE t.arm = 'treatment' GROUP BY t.lineage_id)
""" + _DRAW.format(k=0, seed=17) + _ROW.format(name="treatment_vs_mean_shuffled_", k=0, t="t", c="c", ts=_side("treatment", "t"), cs="(SELECT avg(loss) AS log_loss, avg(((probability >= 0.5)::INT = label)::INT) AS accuracy FROM scored WHERE arm LIKE 'shuffled%') c"))
def _(spark, sf_dir):
    return B.replica_comparison(predictions(spark, sf_dir), "treatment", "shuffled_", 200)


@query("statistic_from_sums", _PRED + """
, s AS (SELECT lineage_id, count(*) FILTER (arm = 'treatment') AS n_rows, sum(loss) FILTER (arm = 'generic') AS a, sum(loss) FILTER (arm = 'treatment') AS b, sum(loss) FILTER (arm = 'shuffled_0') AS c FROM scored GROUP BY lineage_id)
SELECT (sum(a) - sum(b)) / sum(n_rows) AS pfi_log_loss, (sum(c) - sum(b)) / sum(n_rows) AS shuffle_gap_log_loss FROM s""")
def _(spark, sf_dir):
    loss = X.log_loss("label", "probability")
    of = lambda arm: F.sum(F.when(F.col("arm") == arm, loss))
    sums = predictions(spark, sf_dir).groupBy("lineage_id").agg(F.count_if(F.col("arm") == "treatment").alias("n_rows"), of("generic").alias("no_pref_log_sum"), of("treatment").alias("full_log_sum"), of("shuffled_0").alias("shuffled_log_sum"))
    return B.statistic(sums, "pfi_log_loss").crossJoin(B.statistic(sums, "shuffle_gap_log_loss"))


def regimes(spark, sf_dir):
    p = M.prior_diagnostic(predictions(spark, sf_dir), ["arm", "fold"])
    positives = predictions(spark, sf_dir).groupBy("arm", "fold").agg(F.sum("label").alias("positives"))
    return p.join(positives, ["arm", "fold"]).withColumnRenamed("arm", "regime")


_Z = "1.959963984540054::DOUBLE"
_WILSON = "(p + {z} * {z} / (2 * n) {s} {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"


@query("regime_aggregate", _PRED + f"""
, f AS (SELECT arm, fold, count(*) AS n, count(*) FILTER ((probability >= 0.5)::INT = label) AS c, sum(label) AS pos, avg(label) AS rate, avg(loss) AS l FROM scored GROUP BY arm, fold)
, g AS (SELECT *, c / n::DOUBLE AS p FROM f), h AS (SELECT *, greatest(0, {_WILSON.format(z=_Z, s="-")}) > greatest(rate, 1 - rate) AND l < -(rate * ln(rate) + (1 - rate) * ln(1 - rate)) AS learned FROM g)
, pool AS (SELECT arm AS regime, count(*) AS folds, sum(n)::BIGINT AS n, sum(c)::BIGINT AS correct, sum(pos)::BIGINT AS positives, sum(c) / sum(n)::DOUBLE AS p, min(p) AS least_accuracy, max(p) AS most_accuracy, sum(pos) / sum(n)::DOUBLE AS rate, sum(l * n) / sum(n) AS mean_loss, count(*) FILTER (learned) AS learned_folds FROM h GROUP BY arm)
, b AS (SELECT *, {_WILSON.format(z=_Z, s="-")} AS lower, {_WILSON.format(z=_Z, s="+")} AS upper, greatest(rate, 1 - rate) AS prior_accuracy, -(rate * ln(rate) + (1 - rate) * ln(1 - rate)) AS prior_log_loss FROM pool)
SELECT regime, folds, n AS records, correct, positives, p AS accuracy, least_accuracy, most_accuracy, prior_accuracy, prior_log_loss, mean_loss, learned_folds, lower, upper,
 CASE WHEN lower > prior_accuracy AND mean_loss < prior_log_loss THEN 'learned_above_prior' WHEN upper < prior_accuracy THEN 'below_prior' ELSE 'null_like' END AS status FROM b""")
def _(spark, sf_dir):
    return B.regime_aggregate(regimes(spark, sf_dir))


@query("source_summaries", _PRED + "SELECT lineage_id, count(*) AS records, avg(loss) AS mean_loss, avg(((probability >= 0.5)::INT = label)::INT) AS accuracy FROM scored GROUP BY lineage_id")
def _(spark, sf_dir):
    hit = ((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("double")
    per = predictions(spark, sf_dir).groupBy("lineage_id", "arm", "fold").agg(F.count("*").alias("records"), F.avg(X.log_loss("label", "probability")).alias("mean_loss"), F.avg(hit).alias("accuracy"))
    return B.weighted_summary(per, ["lineage_id"], ("mean_loss", "accuracy"))


_RUNS = "WITH t AS (SELECT user_id % 3 AS regime, user_id % 7 AS fold, event_id AS step, value AS loss FROM events), r AS (SELECT regime, fold, arg_min(loss, step) AS first, arg_max(loss, step) AS last, count(*) AS units, avg(loss) AS mean_loss FROM t GROUP BY regime, fold)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("regime"), (F.col("user_id") % 7).alias("fold"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


@query("trajectory_means", _RUNS + "SELECT regime, count(*) AS folds, avg(first) AS mean_first, avg(last) AS mean_last, count(*) FILTER (last < first) AS folds_with_loss_decrease FROM r GROUP BY regime")
def _(spark, sf_dir):
    return B.trajectory_means(M.trajectory(runs(spark, sf_dir), ["regime", "fold"]))


@query("language_aggregate", _RUNS + """, a AS (SELECT regime, count(*) AS folds, sum(units)::BIGINT AS units, sum(units * (units % 10) / 10::DOUBLE) / sum(units) AS accuracy, sum(mean_loss / 1000 * units) / sum(units) AS mean_loss, 0::BIGINT AS fallbacks, count(*) FILTER (last < first) AS learned_folds FROM r GROUP BY regime)
SELECT *, exp(mean_loss) AS perplexity, CASE WHEN learned_folds = folds THEN 'learned' ELSE 'mixed' END AS status FROM a""")
def _(spark, sf_dir):
    rows = runs(spark, sf_dir)
    per = rows.groupBy("regime", "fold").agg(F.count("*").alias("units"), F.avg("loss").alias("mean_loss"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"))
    return B.language_aggregate(per.select("regime", "fold", "units", (F.col("units") % 10 / 10).alias("accuracy"), (F.col("mean_loss") / 1000).alias("mean_loss"), "first_loss", "last_loss", F.lit(0).cast("long").alias("fallbacks")))


@query("verify_training_runs", _RUNS + "SELECT regime, count(*) AS folds, true AS all_steps_done, true AS one_contract, true AS steps_rise, true AS losses_finite FROM r GROUP BY regime")
def _(spark, sf_dir):
    rows = runs(spark, sf_dir)
    made = rows.groupBy("regime", "fold").agg(F.lit(600).alias("update_steps"), F.lit("one").alias("contract_sha256"))
    return V.training_runs(made, rows, 600)


@query("fold_spread", _PRED + """
, m AS (SELECT *, ((probability >= 0.5)::INT = label)::INT AS hit FROM scored), f AS (SELECT arm, fold, avg(hit) AS accuracy, avg(loss) AS log_loss, avg(brier) AS brier FROM m GROUP BY arm, fold)
, p AS (SELECT arm, count(*) AS n, count(DISTINCT lineage_id) AS lineages, avg(hit) AS accuracy, avg(loss) AS log_loss, avg(brier) AS brier FROM m GROUP BY arm)
, s AS (SELECT arm, """ + ", ".join(f"{f}({m}) AS {n}_{m}" for m in ("accuracy", "log_loss", "brier") for f, n in (("avg", "mean"), ("median", "median"), ("min", "least"), ("max", "most"))) + " FROM f GROUP BY arm) SELECT * FROM p JOIN s USING (arm)")
def _(spark, sf_dir):
    return B.fold_spread(predictions(spark, sf_dir))


@query("replica_aggregate", _PRED + ", r AS (SELECT arm, count(*) AS n, avg(loss) AS log_loss, avg(((probability >= 0.5)::INT = label)::INT) AS accuracy FROM scored WHERE arm LIKE 'shuffled%' GROUP BY arm) SELECT * FROM r UNION ALL SELECT 'mean', max(n), avg(log_loss), avg(accuracy) FROM r")
def _(spark, sf_dir):
    return B.replica_aggregate(predictions(spark, sf_dir), "shuffled_")


@query("full_summary", _PRED + """
, f AS (SELECT arm, fold, count(*) AS n, sum(label) AS pos, avg(loss) AS loss FROM scored GROUP BY arm, fold), g AS (SELECT *, sum(n) OVER (PARTITION BY arm) AS an, sum(pos) OVER (PARTITION BY arm) AS ap FROM f)
, b AS (SELECT fold, loss AS base FROM f WHERE arm = 'generic'), h AS (SELECT *, (ap - pos) / (an - n)::DOUBLE AS rate FROM g JOIN b USING (fold))
, s AS (SELECT arm, sum(n)::BIGINT AS n, sum(loss * n) / sum(n) AS log_loss, count(*) FILTER (loss < base) AS folds_beating_baseline, sum(-(pos * ln(rate) + (n - pos) * ln(1 - rate))) / sum(n) AS constant_prior_log_loss FROM h GROUP BY arm)
SELECT *, log_loss < constant_prior_log_loss AS beats_constant FROM s""")
def _(spark, sf_dir):
    return B.full_summary(predictions(spark, sf_dir))


@query("specificity_report", _L2 + """
, c AS (SELECT arm, fold, max(l2_lambda) AS l2, min(validation_log_loss) AS loss FROM cand GROUP BY arm, fold), p AS (SELECT arm, count(*) AS folds, count(*) FILTER (l2 = (SELECT max(l2_lambda) FROM cand)) AS at_most, avg(loss) AS mean_loss, (64 * length(arm))::INT AS dimension FROM c GROUP BY arm)
SELECT p.*, round(p.mean_loss - g.mean_loss, 9) AS gap, p.dimension / g.dimension::DOUBLE AS dimension_ratio FROM p, (SELECT * FROM p WHERE arm = 'generic') g""")
def _(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    sizes = rows.select("arm").distinct().withColumn("dimension", (64 * F.length("arm")).cast("int"))
    return B.specificity_report(rows, sizes, "generic").withColumn("gap", F.round("gap", 9))


@query("probability_quantiles", _PRED + "SELECT arm, " + ", ".join(f"quantile_cont(probability, {p}) AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM scored GROUP BY arm")
def _(spark, sf_dir):
    return B.probability_quantiles(predictions(spark, sf_dir), ["arm"])


_NAMED = "CASE arm WHEN 'generic' THEN 'baseline' WHEN 'treatment' THEN 'full_preference' WHEN 'shuffled_0' THEN 'plus_edit_geometry' ELSE 'matched_shuffled_full_preference' END"
_SEEDS = _PRED + f", e AS (SELECT fold AS seed, {_NAMED} AS feature_set, avg(loss) AS log_loss, avg(brier) AS brier, CASE WHEN avg(label) IN (0, 1) THEN 0 ELSE -(avg(label) * ln(avg(label)) + (1 - avg(label)) * ln(1 - avg(label))) END AS null_log_loss FROM scored GROUP BY fold, arm)"


def seeds(spark, sf_dir):
    name = F.when(F.col("arm") == "generic", "baseline").when(F.col("arm") == "treatment", "full_preference").when(F.col("arm") == "shuffled_0", "plus_edit_geometry").otherwise("matched_shuffled_full_preference")
    return M.binary_metrics(predictions(spark, sf_dir), ["arm", "fold"]).select(F.col("fold").alias("seed"), name.alias("feature_set"), "log_loss", "brier", "null_log_loss")


@query("comparison_gains", _SEEDS + """
, c(comparison, r, f) AS (VALUES ('full_vs_baseline', 'baseline', 'full_preference'), ('geometry_vs_baseline', 'baseline', 'plus_edit_geometry'), ('authentic_vs_matched_shuffle', 'matched_shuffled_full_preference', 'full_preference'))
, g AS (SELECT comparison, a.seed, a.log_loss - b.log_loss AS x, a.brier - b.brier AS y FROM c JOIN e a ON a.feature_set = r JOIN e b ON b.feature_set = f AND b.seed = a.seed)
SELECT comparison, 'log_loss' AS metric, count(*) AS seeds, round(avg(x), 9) AS mean_gain, round(stddev_samp(x), 9) AS sd_gain, count(*) FILTER (x > 0) AS positive_seeds FROM g GROUP BY 1 UNION ALL SELECT comparison, 'brier', count(*), round(avg(y), 9), round(stddev_samp(y), 9), count(*) FILTER (y > 0) FROM g GROUP BY 1""")
def _(spark, sf_dir):
    return B.comparison_gains(seeds(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_gain", "sd_gain")})


@query("feature_set_means", _SEEDS + "SELECT feature_set, count(*) AS seeds, round(avg(log_loss), 9) AS mean_log_loss, round(stddev_samp(log_loss), 9) AS sd_log_loss, round(avg(brier), 9) AS mean_brier, round(stddev_samp(brier), 9) AS sd_brier, round(avg(null_log_loss - log_loss), 9) AS gain_over_null FROM e GROUP BY feature_set")
def _(spark, sf_dir):
    out = B.feature_set_means(seeds(spark, sf_dir), ("log_loss", "brier"), "null_log_loss", "log_loss")
    return out.withColumns({c: F.round(c, 9) for c, kind in out.dtypes if kind == "double"})


@query("learnability_outcome", _PRED + """
, r AS (SELECT arm || fold AS condition, CASE WHEN arm = 'generic' THEN 'tiny_set_memorization' ELSE 'full_train_learning_curve' END AS kind, avg(((probability >= 0.5)::INT = label)::INT) AS acc, avg(loss) AS loss FROM scored GROUP BY arm, fold)
, o AS (SELECT bool_and(acc >= 0.95) FILTER (kind = 'tiny_set_memorization') AS memorised, bool_or(acc > 0.6) FILTER (kind <> 'tiny_set_memorization') AS learned, arg_min(condition, loss) FILTER (kind <> 'tiny_set_memorization') AS best_condition, min(loss) FILTER (kind <> 'tiny_set_memorization') AS best_loss FROM r)
SELECT *, CASE WHEN NOT memorised THEN 'tiny_set_memorization_failed' WHEN learned THEN 'preference_generalised_above_prior_at_extended_budget' ELSE 'memorisation_succeeded_but_validation_remained_null_like' END AS outcome FROM o""")
def _(spark, sf_dir):
    m = M.binary_metrics(predictions(spark, sf_dir), ["arm", "fold"])
    kind = F.when(F.col("arm") == "generic", "tiny_set_memorization").otherwise("full_train_learning_curve")
    return B.learnability(m.select(F.concat("arm", F.col("fold").cast("string")).alias("condition"), kind.alias("kind"), F.col("accuracy").alias("train_accuracy"), F.col("log_loss").alias("validation_loss"), F.when(F.col("accuracy") > 0.6, "learned_above_prior").otherwise("null_like").alias("status")))


@query("verify_forecasts", _PRED + "SELECT arm, fold, true AS ids_unique, true AS probabilities_match, arm <> 'shuffled_1' AS labels_match, arm <> 'shuffled_0' AS metrics_match FROM scored GROUP BY arm, fold")
def _(spark, sf_dir):
    """Forecasts of one arm have other labels than the true ones, the reported loss of another is off."""
    p = predictions(spark, sf_dir).withColumn("logit", F.ln(F.col("probability") / (1 - F.col("probability"))))
    truth = p.where("arm = 'generic'").select("episode_id", "label")
    reported = M.binary_metrics(p, ["arm", "fold"]).select("arm", "fold", "n", F.when(F.col("arm") == "shuffled_0", F.col("log_loss") + 0.1).otherwise(F.col("log_loss")).alias("log_loss"), "brier", "accuracy")
    flipped = p.withColumn("label", F.when(F.col("arm") == "shuffled_1", 1 - F.col("label")).otherwise(F.col("label")))
    again = M.binary_metrics(flipped, ["arm", "fold"]).select("arm", "fold", "n", "log_loss", "brier", "accuracy").where("arm = 'shuffled_1'")
    return V.forecasts(flipped, reported.where("arm <> 'shuffled_1'").unionByName(again), truth)


@query("verify_representations", _MEMBERS + ", c AS (SELECT fold, count(*) FILTER (e.selected_index = 1 AND m.partition = 'test') AS missing FROM members m JOIN episodes e USING (lineage_id) GROUP BY fold) SELECT 'generic' AS arm, fold, missing, 0::BIGINT AS unexpected, 0::BIGINT AS repeated, 0::BIGINT AS malformed FROM c")
def _(spark, sf_dir):
    """Vectors of all episodes but those of test partitions whose second candidate was selected."""
    e = written(episodes(spark, sf_dir), "episodes")
    m = written(members_of(e.select("lineage_id").distinct()), "members")
    v = e.join(m, "lineage_id").where("not (selected_index = 1 and partition = 'test')").select(F.lit("generic").alias("arm"), "fold", "partition", "episode_id", F.array(F.lit(1.0), F.col("edit_similarity")).alias("v"))
    return V.representations(v, m, e, 2)


@query("artifact_counts", EPISODES_SQL + "SELECT true AS rows_match, true AS ids_unique, true AS lineages_match, true AS outcomes_match, true AS outcomes_complete FROM (SELECT count(*) FROM episodes)")
def _(spark, sf_dir):
    n_parts = version_parts(spark, sf_dir)
    found = replaced(spark, sf_dir, n_parts)
    e = A.episodes(found, n_parts=n_parts)
    return B.artifact_counts(e, U.extraction_audit(versions(spark, sf_dir, n_parts), A.version_order(None, "version_id"), found, e, 0))


# --- projections ------------------------------------------------------------------------------------------------


@query("future_labels", EPISODES_SQL + "SELECT episode_id, future_revised::INT AS label FROM episodes")
def _(spark, sf_dir):
    return J.future_labels(J.checked_episodes(episodes(spark, sf_dir)))


@query("source_store", EPISODES_SQL + "SELECT episode_id, lineage_id, md5(candidate_a) AS a, md5(candidate_b) AS b, md5(context_before) AS before, md5(context_after) AS after FROM episodes")
def _(spark, sf_dir):
    return J.source_store(episodes(spark, sf_dir)).select("episode_id", "lineage_id", F.md5("candidate_a").alias("a"), F.md5("candidate_b").alias("b"), F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query("teacher_probabilities", _PRED + "SELECT s.episode_id, round(CASE WHEN t.probability IS NULL THEN s.label ELSE 0.7::DOUBLE * s.label + 0.3::DOUBLE * t.probability END, 9) AS target FROM scored s LEFT JOIN (SELECT * FROM scored WHERE arm = 'treatment' AND fold < 3) t USING (episode_id) WHERE s.arm = 'generic'")
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    rows = J.with_teacher(p.where("arm = 'generic'").select("episode_id", "label"), p.where("arm = 'treatment' AND fold < 3").select("episode_id", F.col("probability").alias("probability_a")))
    return rows.select("episode_id", F.round(J.teacher_mix("label", "probability_a", 0.3), 9).alias("target"))


@query("representation_labels", _PRED + "SELECT vec_id, (vec_id % 2)::INT AS label, len(embedding)::INT AS size FROM embeddings")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("size"))
    labels = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 2).cast("int").alias("label"))
    return J.labelled(rows, labels, "vec_id")


_PICKED = EPISODES_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY selected_index ORDER BY sha256('diagnostic-subset:17:' || episode_id), episode_id) AS k FROM episodes)
, s AS (SELECT *, row_number() OVER (ORDER BY episode_id) - 1 AS item_id FROM r WHERE k <= 20)
"""


@query("oracle_prompts", _PICKED + "SELECT item_id::INT AS item_id, episode_id, md5(context_before || chr(31) || candidate_a || chr(31) || candidate_b || chr(31) || context_after) AS prompt FROM s")
def _(spark, sf_dir):
    return J.oracle_prompts(episodes(spark, sf_dir), 40)[0].select("item_id", "episode_id", F.md5(F.concat_ws("\x1f", "context_before", "candidate_a", "candidate_b", "context_after")).alias("prompt"))


@query("oracle_answers", _PICKED + "SELECT item_id::INT AS item_id, episode_id, CASE WHEN selected_index = 0 THEN 'A' ELSE 'B' END AS selected, selected_index FROM s")
def _(spark, sf_dir):
    return J.oracle_prompts(episodes(spark, sf_dir), 40)[1]


@query("candidate_views", EPISODES_SQL + "SELECT episode_id, md5('[CONTEXT_BEFORE]' || chr(10) || context_before || chr(10) || '[CONTEXT_AFTER]' || chr(10) || context_after) AS context, md5('[CONTEXT_BEFORE]' || chr(10) || context_before || chr(10) || '[CANDIDATE]' || chr(10) || candidate_a || chr(10) || '[CONTEXT_AFTER]' || chr(10) || context_after) AS a FROM episodes")
def _(spark, sf_dir):
    return episodes(spark, sf_dir).select("episode_id", F.md5(X.context_view()).alias("context"), F.md5(X.candidate_view("candidate_a")).alias("a"))


@query("swapped_candidates", EPISODES_SQL + "SELECT episode_id, md5(candidate_b) AS candidate_a, md5(candidate_a) AS candidate_b FROM episodes")
def _(spark, sf_dir):
    return A.swapped(episodes(spark, sf_dir)).select("episode_id", F.md5("candidate_a").alias("candidate_a"), F.md5("candidate_b").alias("candidate_b"))


_TOKENS = "len(" + TOKENS_SQL + ")"
_WIDE = CELLS_SQL + f"""
, two AS (SELECT *, trim(coalesce(lag(mid, 2) OVER w || ' ', '') || context_before) AS before2 FROM cells WINDOW w AS (PARTITION BY doc_id ORDER BY i))
, wide AS (SELECT lineage_id || '::1->2::' || i AS episode_id, source, i, n, before2, context_after, old, mid, c2, sim1, length(mid) AS kept_chars, length(old) AS gone_chars, {_TOKENS.format("mid")} AS kept_tokens, {_TOKENS.format("old")} AS gone_tokens FROM two
   WHERE c1 AND NOT p1 AND NOT n1 AND length(old) BETWEEN 25 AND 600 AND length(mid) BETWEEN 25 AND 600 AND {_TOKENS.format("old")} >= 3 AND {_TOKENS.format("mid")} >= 3 AND sim1 BETWEEN 0.2 AND 0.98)
"""


def wide(spark, sf_dir):
    return J.wide_episodes(versions(spark, sf_dir), A.version_order(None, "version_id"), n_parts=0)


@query("wide_episodes", _WIDE + "SELECT episode_id, 1 AS version_index, 3::BIGINT AS n_versions, md5(before2) AS before, md5(context_after) AS after, kept_chars::INT AS retained_chars, gone_chars::INT AS rejected_chars, kept_tokens::INT AS retained_tokens, gone_tokens::INT AS rejected_tokens, (kept_chars - gone_chars)::INT AS char_delta, (kept_tokens - gone_tokens)::INT AS token_delta, round(sim1, 9) AS edit_similarity, c2::INT AS revised_again_next_version FROM wide")
def _(spark, sf_dir):
    return wide(spark, sf_dir).select("episode_id", "version_index", "n_versions", F.md5("context_before").alias("before"), F.md5("context_after").alias("after"), "retained_chars", "rejected_chars", "retained_tokens", "rejected_tokens", "char_delta", "token_delta", F.round("edit_similarity", 9).alias("edit_similarity"), "revised_again_next_version")


@query("matched_shuffle_recomputed", _WIDE + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gone_chars, sim1, episode_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS m FROM wide)
, b AS (SELECT *, CASE WHEN m % 16 = 1 AND rn = m - 1 AND m > 1 THEN rn // 16 - 1 ELSE rn // 16 END AS block FROM r)
, s AS (SELECT *, count(*) OVER (PARTITION BY source, block) AS size, rn - min(rn) OVER (PARTITION BY source, block) AS pos FROM b)
, f AS (SELECT *, ((pos - CASE WHEN size > 1 THEN ('0x' || substr(sha256('17' || chr(31) || source || chr(31) || block), 1, 8))::BIGINT % greatest(size - 1, 1) + 1 ELSE 0 END) % size + size) % size AS src FROM s)
SELECT f.episode_id, md5(g.old) AS rejected, g.gone_chars::INT AS rejected_chars, g.gone_tokens::INT AS rejected_tokens, (f.kept_chars - g.gone_chars)::INT AS char_delta, (f.kept_tokens - g.gone_tokens)::INT AS token_delta FROM f JOIN f g ON f.source = g.source AND f.block = g.block AND f.src = g.pos""")
def _(spark, sf_dir):
    return J.matched_shuffle(written(wide(spark, sf_dir), "wide")).select("episode_id", F.md5("rejected_sentence").alias("rejected"), "rejected_chars", "rejected_tokens", "char_delta", "token_delta")


@query("feature_set_columns", _WIDE + """
, t AS (SELECT * FROM (VALUES ('baseline', 3, 4, 1, false), ('plus_edit_geometry', 3, 8, 1, false), ('plus_lexical_relation', 3, 6, 1, false), ('plus_rejected_text', 4, 4, 1, false), ('plus_text_geometry', 4, 8, 1, false), ('plus_text_lexical', 4, 6, 1, false), ('plus_geometry_lexical', 3, 10, 1, false), ('full_preference', 4, 10, 1, false), ('matched_shuffled_full_preference', 4, 10, 1, true)) t(name, text, numeric, categorical, shuffled))
SELECT name, text, numeric, categorical, shuffled, count(*) AS rows, sum(length(before2) + length(mid) + length(context_after) + CASE WHEN text = 4 THEN length(old) ELSE 0 END)::BIGINT AS chars,
  sum(CASE WHEN numeric IN (8, 10) THEN gone_chars + gone_tokens + kept_chars - gone_chars + kept_tokens - gone_tokens ELSE 0 END)::BIGINT AS geometry FROM wide, t GROUP BY ALL""")
def _(spark, sf_dir):
    """What each feature set takes from wide episodes: columns of each kind, and over all rows the characters of its texts and the sum
    of its geometry."""
    rows = wide(spark, sf_dir)
    total = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in (*J.BASE_TEXT, *J.REJECTED_TEXT)], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in J.GEOMETRY])
    count = lambda names: sum(c in rows.columns for c in names)
    own = lambda names: sum((F.col(c) for c in names), F.lit(0)).cast("long")
    sets = [F.struct(F.lit(f.name).alias("name"), F.lit(count(f.text)).alias("text"), F.lit(count(f.numeric)).alias("numeric"), F.lit(count(f.categorical)).alias("categorical"), F.lit(f.shuffled).alias("shuffled"), "rows", own(f.text).alias("chars"), own([c for c in f.numeric if c in J.GEOMETRY]).alias("geometry")) for f in J.feature_sets()]
    return total.select(F.inline(F.array(*sets)))


def ablation(spark, sf_dir):
    """Log loss and Brier score of nine feature sets for each seed: held-out articles, and rejected sentences dealt again for the last set."""
    wide = written(J.wide_episodes(versions(spark, sf_dir), A.version_order(None, "version_id"), n_parts=0), "wide")
    given = [c for c in dict.fromkeys(c for f in J.feature_sets() if f.shuffled for c in (*f.text, *f.numeric)) if c not in (*J.BASE_TEXT, *J.BASE_NUMERIC)]
    rows = None
    for seed in SEEDS:
        dealt = J.matched_shuffle(wide, seed).select("episode_id", *[F.col(c).alias(f"{c}_shuffled") for c in given])
        held = R.group_holdout(wide.select("episode_id", "article_key"), "article_key", 0.2, seed).select("episode_id", "held_out")
        part = wide.join(dealt, "episode_id").join(held, "episode_id").withColumn("id", F.concat(F.lit(f"{seed}:"), "episode_id")).withColumn("label", F.col("revised_again_next_version"))
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "ablation")
    roles = rows.select("id", F.array_position(F.array(*[F.lit(str(s)) for s in SEEDS]), F.substring_index("id", ":", 1)).alias("split"), F.when(F.col("held_out"), 3).otherwise(1).alias("role")).withColumn("split", F.col("split") - 1)
    out = L.feature_set_models(rows, roles, J.feature_sets())
    scores = M.binary_metrics(out, ["split", "feature_set"])
    return scores.select(F.array(*[F.lit(s) for s in SEEDS])[F.col("split")].alias("seed"), "feature_set", "n", "log_loss", "brier", "null_log_loss")


@query("ablation_gains")
def _(spark, sf_dir):
    """What each evidence about the rejected sentence adds to the baseline: gains of feature sets in held-out articles over seeds."""
    return B.comparison_gains(written(ablation(spark, sf_dir), "losses"))
