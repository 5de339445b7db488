"""Queries of splits, control corpora, metrics, resampling, sessions and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.operators import audit as U
from palimpsest.operators import boosting as T
from palimpsest.operators import corpora as C
from palimpsest.operators import logistic as G
from palimpsest.operators import masks as K
from palimpsest.operators import metrics as M
from palimpsest.operators import models as L
from palimpsest.operators import reports as B
from palimpsest.operators import resample as R
from palimpsest.operators import selection as S
from palimpsest.operators import sessions as Z
from palimpsest.operators import splits as P
from palimpsest.plans.registry import query
from palimpsest.plans.revisions import TEMPORAL_SQL, episodes, versions
from palimpsest.sources.fixture import EPISODES_SQL, FLAGS_SQL, table
from palimpsest.sources.staging import written

FOLDS = 5
#: Seeds of resampled splits, and planted effects of votes.
SEEDS, EFFECTS = [17, 18, 19], (0.0, 0.5, 1.5)

_STATS = FLAGS_SQL + """
, stats AS (SELECT lineage_id, count(*) AS episodes, count(*) FILTER (e.future_revised) AS future_revised, count(*) FILTER (selected_index = 1) AS selected_b,
  count(*) FILTER (f.number_changed) AS number_changed, count(*) FILTER (number_dominant_edit) AS number_dominant, count(*) FILTER (casualty_count_update) AS casualty_count FROM episodes e JOIN flags f USING (episode_id, lineage_id) GROUP BY lineage_id)
"""
_MEMBERS = _STATS + """
, buckets AS (SELECT lineage_id, (('0x' || substr(sha256('17' || chr(31) || lineage_id), 1, 8))::BIGINT % 5)::INT AS bucket FROM stats)
, members AS (SELECT f::INT AS fold, CASE WHEN bucket = f THEN 'test' WHEN bucket = (f + 1) % 5 THEN 'validation' ELSE 'train' END AS partition, lineage_id FROM buckets, range(5) t(f))
"""
_SUMMARY = _MEMBERS + """
, summary AS (SELECT fold, partition, count(*) AS lineages, sum(episodes)::BIGINT AS episodes, sum(future_revised)::BIGINT AS future_revised, sum(selected_b)::BIGINT AS selected_b, sum(number_changed)::BIGINT AS number_changed,
  sum(number_dominant)::BIGINT AS number_dominant, sum(casualty_count)::BIGINT AS casualty_count FROM members JOIN stats USING (lineage_id) GROUP BY fold, partition)
, rates AS (SELECT *, future_revised / episodes::DOUBLE AS future_revised_rate, selected_b / episodes::DOUBLE AS selected_b_rate, number_changed / episodes::DOUBLE AS number_changed_rate,
  lineages / (SELECT count(*) FROM stats)::DOUBLE AS lineage_share, episodes / (SELECT sum(episodes) FROM stats)::DOUBLE AS episode_share FROM summary)
"""


def stats_of(spark, sf_dir):
    """Lineage counters, written once: aligning versions is the dear part, and every reader comes back to them."""
    flags = U.numeric_flags(episodes(spark, sf_dir), "selected_index")
    return written(P.lineage_stats(flags), "stats")


def members_of(stats):
    return P.membership(P.hash_folds(stats, FOLDS), FOLDS)


@query("lineage_stats", _STATS + "SELECT * FROM stats")
def _(spark, sf_dir):
    return stats_of(spark, sf_dir)


@query("partition_membership", _MEMBERS + "SELECT * FROM members")
def _(spark, sf_dir):
    return members_of(stats_of(spark, sf_dir))


@query("fold_partition_summary", _SUMMARY + "SELECT * FROM rates")
def _(spark, sf_dir):
    stats = stats_of(spark, sf_dir)
    return P.partition_summary(members_of(stats), stats)


_BALANCE = _SUMMARY + """
, total AS (SELECT sum(future_revised) / sum(episodes)::DOUBLE AS rate, sum(number_changed) / sum(episodes)::DOUBLE AS numeric FROM stats)
, diag AS (SELECT sum(lineages) FILTER (partition = 'test')::BIGINT AS test_lineage_assignments, sum(lineages) FILTER (partition = 'validation')::BIGINT AS validation_lineage_assignments,
  max(abs(episode_share - 0.2::DOUBLE)) FILTER (partition = 'test') AS max_test_episode_share_deviation, max(abs(lineage_share - 0.2::DOUBLE)) FILTER (partition = 'test') AS max_test_lineage_share_deviation,
  max(abs(future_revised_rate - rate)) FILTER (partition = 'test') AS max_test_future_rate_deviation, max(abs(number_changed_rate - numeric)) FILTER (partition = 'test') AS max_test_numeric_rate_deviation FROM rates, total)
"""


@query("split_balance_diagnostics", _BALANCE + "SELECT * FROM diag")
def _(spark, sf_dir):
    stats = stats_of(spark, sf_dir)
    return P.balance(P.partition_summary(members_of(stats), stats), stats, FOLDS)


@query("split_gates", _BALANCE + """SELECT test_lineage_assignments = validation_lineage_assignments AS all_lineages_tested_exactly_once, test_lineage_assignments = validation_lineage_assignments AS all_lineages_validated_exactly_once,
 max_test_episode_share_deviation <= 0.02 AS test_episode_share_within_2_points, max_test_lineage_share_deviation <= 0.02 AS test_lineage_share_within_2_points, max_test_future_rate_deviation <= 0.03 AS test_future_rate_within_3_points,
 max_test_numeric_rate_deviation <= 0.03 AS test_numeric_change_rate_within_3_points FROM diag""")
def _(spark, sf_dir):
    stats = stats_of(spark, sf_dir)
    return P.gates(P.balance(P.partition_summary(members_of(stats), stats), stats, FOLDS))


_CHECK = "SELECT count(*) AS lineages, 0::BIGINT AS not_in_every_fold, 0::BIGINT AS overlapping, 0::BIGINT AS not_tested_once, 0::BIGINT AS not_validated_once, 0::BIGINT AS validation_not_next_test, 0::BIGINT AS missing FROM stats"


@query("fold_disjointness_check", _STATS + _CHECK)
def _(spark, sf_dir):
    stats = stats_of(spark, sf_dir)
    return P.verification(members_of(stats), stats, FOLDS)


@query("grouped_folds_greedy", _STATS + _CHECK)
def _(spark, sf_dir):
    """Invariants of the greedy assignment: they hold for any right one."""
    stats = stats_of(spark, sf_dir)
    return P.verification(P.membership(P.greedy_folds(stats, FOLDS), FOLDS), stats, FOLDS)


@query("key_differences", EPISODES_SQL + "SELECT episode_id, 'left_only' AS side FROM episodes WHERE future_revised UNION ALL SELECT episode_id, 'right_only' FROM episodes WHERE selected_index = 9")
def _(spark, sf_dir):
    e = written(episodes(spark, sf_dir).select("episode_id", "future_revised"), "episodes")
    return P.key_differences(e, e.where("not future_revised"), "episode_id")


# --- control corpora --------------------------------------------------------------------------------------------

_CELLS = _MEMBERS + ", placed AS (SELECT m.fold, m.partition, e.* FROM episodes e JOIN members m USING (lineage_id))"
_SER = "'[CONTEXT_BEFORE]' || chr(10) || context_before || chr(10) || '[CANDIDATE_A]' || chr(10) || candidate_a || chr(10) || '[CANDIDATE_B]' || chr(10) || candidate_b || chr(10) || '[CONTEXT_AFTER]' || chr(10) || context_after"
_WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"


def placed(spark, sf_dir):
    e = written(episodes(spark, sf_dir), "episodes")
    return C.in_cells(e, members_of(e.select("lineage_id").distinct()))


@query("balanced_labels", _CELLS + "SELECT fold, partition, episode_id, (row_number() OVER w - 1 >= floor(count(*) OVER (PARTITION BY fold, partition) / 2))::INT AS label FROM placed WINDOW w AS (PARTITION BY fold, partition ORDER BY sha256('label:17:' || fold || ':' || partition || ':' || episode_id))")
def _(spark, sf_dir):
    return C.balanced_labels(placed(spark, sf_dir), "episode_id", 17).select("fold", "partition", "episode_id", "label")


_DONORS = _CELLS + """
, sized AS (SELECT fold, partition, lineage_id, episode_id, count(*) OVER (PARTITION BY fold, partition, lineage_id) AS size FROM placed)
, ordered AS (SELECT *, row_number() OVER (PARTITION BY fold, partition ORDER BY size DESC, sha256('shuffle:' || fold || ':' || partition || ':group:118:' || lineage_id), sha256('shuffle:' || fold || ':' || partition || ':record:118:' || episode_id)) - 1 AS pos,
  max(size) OVER (PARTITION BY fold, partition) AS shift, count(*) OVER (PARTITION BY fold, partition) AS n FROM sized)
, given AS (SELECT a.fold, a.partition, a.episode_id, b.episode_id AS donor_id, a.lineage_id, b.lineage_id AS donor_lineage FROM ordered a JOIN ordered b ON a.fold = b.fold AND a.partition = b.partition AND b.pos = (a.pos + a.shift) % a.n)
"""


@query("cross_lineage_donors", _DONORS + "SELECT fold, partition, episode_id, donor_id, lineage_id <> donor_lineage AS other_lineage FROM given")
def _(spark, sf_dir):
    return C.donors(placed(spark, sf_dir), 118, "shuffle").select("fold", "partition", "episode_id", "donor_id", (F.col("lineage_id") != F.col("donor_lineage")).alias("other_lineage"))


@query("shuffled_preference_labels", _DONORS + "SELECT g.fold, g.partition, g.episode_id, e.selected_index AS target FROM given g JOIN episodes e ON e.episode_id = g.donor_id")
def _(spark, sf_dir):
    rows = placed(spark, sf_dir)
    label = rows.select(F.col("episode_id").alias("donor_id"), F.col("selected_index").alias("target")).distinct()
    return C.donors(rows, 118, "shuffle").join(label, "donor_id").select("fold", "partition", "episode_id", "target")


@query("mask_indices", _CELLS + f"""
, w AS (SELECT fold, partition, episode_id, {_WORDS.format(_SER)} AS words FROM placed)
, r AS (SELECT *, row_number() OVER (PARTITION BY fold, partition, episode_id ORDER BY sha256('mask:17:' || fold || ':' || partition || ':' || episode_id || ':' || i)) AS k FROM (SELECT *, unnest(range(words)) AS i FROM w))
SELECT fold, partition, episode_id, words::INT AS words, string_agg(i::VARCHAR, ',' ORDER BY i) AS mask FROM r WHERE k <= greatest(1, least(words, round_even(words * 0.15::DOUBLE, 0))) GROUP BY fold, partition, episode_id, words""")
def _(spark, sf_dir):
    return C.mask_indices(placed(spark, sf_dir)).select("fold", "partition", "episode_id", "words", F.array_join(F.col("mask_indices").cast("array<string>"), ",").alias("mask"))


_MASKED = _CELLS + f"""
, w AS (SELECT fold, partition, episode_id, list_filter(string_split_regex({_SER}, '\\s+'), lambda x: x <> '') AS w FROM placed)
, u AS (SELECT fold, partition, episode_id, len(w) AS words, unnest(w) AS word, unnest(range(len(w))) AS i FROM w)
, k AS (SELECT *, ceil(length(word) / 4.0)::BIGINT AS n, row_number() OVER (PARTITION BY fold, partition, episode_id ORDER BY sha256('mask:17:' || fold || ':' || partition || ':' || episode_id || ':' || i)) <= greatest(1, least(words, round_even(words * 0.15::DOUBLE, 0))) AS chosen FROM u)
, s AS (SELECT *, least(62, coalesce(sum(n) OVER (PARTITION BY fold, partition, episode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, least(62, sum(n) OVER (PARTITION BY fold, partition, episode_id ORDER BY i)) AS b FROM k)
, m AS (SELECT fold, partition, episode_id, max(b) AS kept, coalesce(sum(b - a) FILTER (chosen), 0) AS masked, coalesce(sum((b - a) * (a + 1 + b) // 2) FILTER (chosen), 0) AS places FROM s GROUP BY ALL)
, c AS (SELECT fold, partition, count(*) AS records, sum(kept)::BIGINT AS kept, sum(greatest(masked, 1))::BIGINT AS masked, sum(greatest(places, 1))::BIGINT AS places, count(*) FILTER (masked = 0) AS fallbacks FROM m GROUP BY fold, partition)
"""


def masked_pieces(spark, sf_dir):
    """Whole-word masks of all episodes in all cells on pieces of up to 4 characters, 64 places a record."""
    rows = placed(spark, sf_dir)
    words = rows.select(*C.CELL, "episode_id", K.chunk_words(X.split_tokens(C.serialised())).alias("pieces"))
    return K.token_masks(words.join(C.mask_indices(rows), [*C.CELL, "episode_id"]), "pieces", max_length=64)


@query("token_mask_counts", _MASKED + "SELECT * FROM c")
def _(spark, sf_dir):
    return K.mask_counts(masked_pieces(spark, sf_dir), C.CELL)


@query("serialised_episode_text", EPISODES_SQL + f"SELECT episode_id, md5({_SER}) AS digest, {_WORDS.format(_SER)}::INT AS tokens FROM episodes")
def _(spark, sf_dir):
    return episodes(spark, sf_dir).select("episode_id", F.md5(C.serialised()).alias("digest"), X.token_count(C.serialised()).alias("tokens"))


@query("length_matched_selection", """
WITH p AS (SELECT 0 AS fold, lang AS partition, doc_id::VARCHAR AS id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tokens FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY tokens, id) - 1 AS k, count(*) OVER (PARTITION BY partition) AS m FROM p),
t AS (SELECT partition, m, least(40, m) AS n, unnest(range(least(40, m))) AS i FROM (SELECT DISTINCT partition, m FROM r)), c AS (SELECT partition, round_even(i * (m - 1) / (n - 1)::DOUBLE, 0) AS k FROM t)
SELECT r.partition, r.id AS temporal_pair_id, r.tokens::INT AS tokens FROM r JOIN c ON r.partition = c.partition AND r.k = c.k""")
def _(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select(F.lit(0).alias("fold"), F.col("lang").alias("partition"), F.col("doc_id").cast("string").alias("temporal_pair_id"), X.token_count("text").alias("tokens"))
    wanted = pool.groupBy("fold", "partition").agg(F.least(F.lit(40), F.count("*")).alias("n"), F.lit(0).alias("nearest"))
    return C.length_matched(pool, wanted).select("partition", "temporal_pair_id", "tokens")


def corpora(spark, sf_dir):
    """Records of all corpora, episodes, temporal pairs and members; pairs count three times, for a pool that is large
    enough."""
    e = written(episodes(spark, sf_dir), "episodes")
    pairs = A.temporal_pairs(versions(spark, sf_dir), A.version_order(None, "version_id"), e, n_parts=0)
    pairs = written(pairs.crossJoin(spark.range(3)).withColumn("temporal_pair_id", F.concat_ws("#", "temporal_pair_id", F.col("id").cast("string"))).drop("id"), "pairs")
    m = members_of(e.select("lineage_id").distinct())
    buckets = P.hash_folds(pairs.select("lineage_id").distinct(), FOLDS)
    return written(C.build(e, m, pairs, buckets, FOLDS), "records"), e, pairs, m


_DONE = """
, {0}_sized AS (SELECT fold, partition, lineage_id, episode_id, count(*) OVER (PARTITION BY fold, partition, lineage_id) AS size FROM rows_)
, {0}_ordered AS (SELECT *, row_number() OVER (PARTITION BY fold, partition ORDER BY size DESC, sha256('{0}:' || fold || ':' || partition || ':group:{1}:' || lineage_id), sha256('{0}:' || fold || ':' || partition || ':record:{1}:' || episode_id)) - 1 AS pos,
  max(size) OVER (PARTITION BY fold, partition) AS shift, count(*) OVER (PARTITION BY fold, partition) AS n FROM {0}_sized)
, {0}_given AS (SELECT a.fold, a.partition, a.episode_id, a.lineage_id, b.episode_id AS donor_id FROM {0}_ordered a JOIN {0}_ordered b ON a.fold = b.fold AND a.partition = b.partition AND b.pos = (a.pos + a.shift) % a.n)
"""
_LABELLED = "SELECT fold, partition, {0} AS source_id, lineage_id, (row_number() OVER w - 1 >= floor(count(*) OVER (PARTITION BY fold, partition) / 2))::INT AS target FROM {1} WINDOW w AS (PARTITION BY fold, partition ORDER BY sha256('label:{2}:' || fold || ':' || partition || ':' || {0}))"
_TSER = "'[CONTEXT_BEFORE] ' || cb || ' [CANDIDATE_A] ' || earlier_text || ' [CANDIDATE_B] ' || later_text || ' [CONTEXT_AFTER] ' || ca"
#: With `records` of all corpora at the end.
_CORPORA = TEMPORAL_SQL + f"""
, pool AS (SELECT temporal_pair_id || '#' || k AS temporal_pair_id, lineage_id, earlier_text, later_text, cb, ca, {_WORDS.format(_TSER)} AS tokens FROM temporal, range(3) t(k))
, homes AS (SELECT lineage_id, (('0x' || substr(sha256('17' || chr(31) || lineage_id), 1, 8))::BIGINT % 5)::INT AS bucket FROM (SELECT lineage_id FROM episodes UNION SELECT lineage_id FROM pool))
, places AS (SELECT f::INT AS fold, CASE WHEN bucket = f THEN 'test' WHEN bucket = (f + 1) % 5 THEN 'validation' ELSE 'train' END AS partition, lineage_id FROM homes, range(5) t(f))
, rows_ AS (SELECT fold, partition, e.*, {_WORDS.format(_SER)} AS words FROM episodes e JOIN places USING (lineage_id) WHERE partition <> 'test')
{_DONE.format("shuffle", 118)} {_DONE.format("pair", 324)}
, need AS (SELECT fold, partition, count(*) AS n, min(words) AS nearest FROM rows_ GROUP BY fold, partition)
, ranked AS (SELECT fold, partition, temporal_pair_id, lineage_id, tokens, row_number() OVER (PARTITION BY fold, partition ORDER BY tokens, temporal_pair_id) - 1 AS k, count(*) OVER (PARTITION BY fold, partition) AS m FROM pool JOIN places USING (lineage_id) WHERE partition <> 'test')
, steps AS (SELECT fold, partition, n, m, unnest(range(n)) AS i FROM need JOIN (SELECT DISTINCT fold, partition, m FROM ranked) USING (fold, partition) WHERE n > 1)
, chosen AS (SELECT r.* FROM ranked r JOIN steps s ON r.fold = s.fold AND r.partition = s.partition AND r.k = round_even(s.i * (s.m - 1) / (s.n - 1)::DOUBLE, 0)
   UNION ALL (SELECT DISTINCT ON (r.fold, r.partition) r.* FROM ranked r JOIN need d USING (fold, partition) WHERE d.n = 1 ORDER BY r.fold, r.partition, abs(r.tokens - d.nearest), r.k))
, exposed AS ({_LABELLED.format("episode_id", "rows_", 228)})
, records AS (SELECT 'authentic_preference' AS corpus, fold, partition, episode_id AS source_id, lineage_id, selected_index AS target, NULL AS partner_id FROM rows_
   UNION ALL SELECT 'random_label', fold, partition, source_id, lineage_id, target, NULL FROM ({_LABELLED.format("episode_id", "rows_", 17)})
   UNION ALL SELECT 'shuffled_preference', g.fold, g.partition, g.episode_id, g.lineage_id, e.selected_index, g.donor_id FROM shuffle_given g JOIN episodes e ON e.episode_id = g.donor_id
   UNION ALL SELECT 'pair_exposure', g.fold, g.partition, g.episode_id, g.lineage_id, x.target, CASE WHEN x.target = 1 THEN g.episode_id ELSE g.donor_id END FROM pair_given g JOIN exposed x ON g.fold = x.fold AND g.partition = x.partition AND g.episode_id = x.source_id
   UNION ALL SELECT 'language_adaptation', fold, partition, episode_id, lineage_id, NULL, NULL FROM rows_
   UNION ALL SELECT 'temporal_direction', fold, partition, source_id, lineage_id, target, NULL FROM ({_LABELLED.format("temporal_pair_id", "chosen", 418)}))
"""


@query("six_corpora_counts", _CORPORA + "SELECT corpus, fold, partition, count(*) AS records, sum(target)::BIGINT AS positives, count(DISTINCT lineage_id) AS lineages FROM records GROUP BY corpus, fold, partition")
def _(spark, sf_dir):
    """Records, labels and lineages of all six corpora by fold and partition."""
    return corpora(spark, sf_dir)[0].groupBy("corpus", "fold", "partition").agg(F.count("*").alias("records"), F.sum("target").alias("positives"), F.countDistinct("lineage_id").alias("lineages"))


_TEXTS = _CORPORA + f"""
, texts AS (SELECT r.*, CASE WHEN corpus = 'temporal_direction' THEN NULL ELSE '[CONTEXT_BEFORE]' || chr(10) || e.context_before || chr(10) || '[CANDIDATE_A]' || chr(10) || e.candidate_a || chr(10) || '[CANDIDATE_B]' || chr(10) ||
   CASE WHEN corpus = 'pair_exposure' AND r.target = 0 THEN d.candidate_b ELSE e.candidate_b END || chr(10) || '[CONTEXT_AFTER]' || chr(10) || e.context_after END AS text, p.tokens AS pair_tokens
   FROM records r LEFT JOIN episodes e ON e.episode_id = r.source_id LEFT JOIN episodes d ON d.episode_id = r.partner_id LEFT JOIN pool p ON p.temporal_pair_id = r.source_id)
"""


@query("exposure_tokens", _TEXTS + f"SELECT corpus, fold, partition, sum(t)::BIGINT AS tokens, min(t)::INT AS least, max(t)::INT AS most FROM (SELECT *, coalesce(pair_tokens, {_WORDS.format('text')}) AS t FROM texts) GROUP BY corpus, fold, partition")
def _(spark, sf_dir):
    records, e, pairs, _ = corpora(spark, sf_dir)
    return C.exposure_tokens(records, e, pairs).groupBy("corpus", "fold", "partition").agg(F.sum("tokens").alias("tokens"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))


@query("pair_exposure_corpus", _TEXTS + "SELECT fold, partition, source_id, target::INT AS target, md5(text) AS digest FROM texts WHERE corpus = 'pair_exposure'")
def _(spark, sf_dir):
    records, e, pairs, _ = corpora(spark, sf_dir)
    return C.materialised(records.where("corpus = 'pair_exposure'"), e, pairs).select("fold", "partition", "source_id", "target", F.md5("text").alias("digest"))


@query("corpus_gates", _CORPORA + """
, c AS (SELECT fold, partition, list_sort(list(n)) AS ns FROM (SELECT fold, partition, corpus, count(*) AS n FROM records GROUP BY fold, partition, corpus) GROUP BY fold, partition)
, g AS (SELECT corpus, max(abs(d)) AS gap FROM (SELECT corpus, fold, partition, sum(2 * target - 1) AS d FROM records GROUP BY corpus, fold, partition) GROUP BY corpus)
, o AS (SELECT bool_and(a = s) AS same FROM (SELECT sum(target) FILTER (corpus = 'authentic_preference') AS a, sum(target) FILTER (corpus = 'shuffled_preference') AS s FROM records GROUP BY fold, partition))
, w AS (SELECT r.corpus, count(*) FILTER (s.lineage_id = d.lineage_id) AS bad FROM records r JOIN episodes s ON s.episode_id = r.source_id JOIN episodes d ON d.episode_id = r.partner_id WHERE r.corpus = 'shuffled_preference' OR r.corpus = 'pair_exposure' AND r.target = 0 GROUP BY r.corpus)
SELECT (SELECT bool_and(len(ns) = 6 AND ns[1] = ns[6]) FROM c) AS all_six_corpora_have_equal_record_counts,
 (SELECT count(*) = 0 FROM records r JOIN places p ON p.fold = r.fold AND p.lineage_id = r.lineage_id WHERE p.partition = 'test' AND corpus <> 'temporal_direction') AS no_preference_source_record_uses_test_lineages, true AS no_source_task_record_contains_future_fields,
 (SELECT gap <= 1 FROM g WHERE corpus = 'random_label') AS random_labels_are_balanced, (SELECT gap <= 1 FROM g WHERE corpus = 'pair_exposure') AS pair_exposure_labels_are_balanced,
 (SELECT bad = 0 FROM w WHERE corpus = 'pair_exposure') AS pair_exposure_negative_donors_cross_lineages, (SELECT same FROM o) AS shuffled_preferences_preserve_label_counts,
 (SELECT bad = 0 FROM w WHERE corpus = 'shuffled_preference') AS shuffled_preference_donors_cross_lineages,
 (SELECT count(*) = 0 FROM records WHERE corpus = 'temporal_direction' AND (lineage_id IN (SELECT lineage_id FROM episodes) OR source_id NOT IN (SELECT temporal_pair_id FROM pool))) AS temporal_pairs_are_external_to_evaluation_lineages,
 (SELECT gap <= 1 FROM g WHERE corpus = 'temporal_direction') AS temporal_direction_labels_are_balanced""")
def _(spark, sf_dir):
    return C.gates(*corpora(spark, sf_dir))


@query("balanced_subset", """
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('diagnostic-subset:17:' || doc_id)) AS k FROM labels)
SELECT doc_id AS source_id, toxic AS target FROM r WHERE k <= CASE WHEN toxic = 0 THEN 15 ELSE 16 END""")
def _(spark, sf_dir):
    return S.balanced_subset(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), F.col("toxic").cast("int").alias("target")), 31)


# --- metrics ----------------------------------------------------------------------------------------------------

_PRED = """
WITH a AS (SELECT unnest(['generic', 'treatment', 'shuffled_0', 'shuffled_1']) AS arm),
predictions AS (SELECT arm, doc_id::VARCHAR AS episode_id, source AS lineage_id, (doc_id % 5)::INT AS fold, toxic::INT AS label,
  round(0.05 + 0.25 * toxic + 0.6 * ('0x' || substr(sha256(arm || chr(31) || doc_id), 1, 4))::BIGINT / 65536, 3)::DOUBLE AS probability FROM labels JOIN documents USING (doc_id), a)
, scored AS (SELECT *, -CASE WHEN label = 1 THEN ln(probability) ELSE ln(1 - probability) END AS loss, (probability - label) * (probability - label) AS brier FROM predictions)
"""


def predictions(spark, sf_dir):
    """Four arms of made-up forecasts of labels.toxic, from hashes, so that SQL can make the same."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ("generic", "treatment", "shuffled_0", "shuffled_1")])))
    u = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "arm", F.col("doc_id").cast("string")), 256), 1, 4), 16, 10).cast("double") / 65536
    return rows.select("arm", F.col("doc_id").cast("string").alias("episode_id"), F.col("source").alias("lineage_id"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("toxic").cast("int").alias("label"),
                       F.round(0.05 + 0.25 * F.col("toxic") + 0.6 * u, 3).alias("probability"))


@query("binary_metrics_by_fold", _PRED + """
, ranks AS (SELECT arm, fold, label, rank() OVER (PARTITION BY arm, fold ORDER BY probability) + (count(*) OVER (PARTITION BY arm, fold, probability) - 1) / 2.0::DOUBLE AS r FROM scored)
, auc AS (SELECT arm, fold, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM ranks GROUP BY arm, fold)
, m AS (SELECT arm, fold, count(*) AS n, sum(label)::BIGINT AS positives, avg(label) AS prevalence, avg(probability) AS mean_probability, avg(loss) AS log_loss, avg(brier) AS brier, avg(((probability >= 0.5)::INT = label)::INT) AS accuracy,
  (avg(((probability >= 0.5)::INT = label)::INT) FILTER (label = 1) + avg(((probability >= 0.5)::INT = label)::INT) FILTER (label = 0)) / 2 AS balanced_accuracy, avg(probability) - avg(label) AS calibration_gap FROM scored GROUP BY arm, fold)
SELECT m.*, -(prevalence * ln(prevalence) + (1 - prevalence) * ln(1 - prevalence)) AS null_log_loss, prevalence * (1 - prevalence) AS null_brier, greatest(prevalence, 1 - prevalence) AS null_accuracy, roc_auc FROM m JOIN auc USING (arm, fold)""")
def _(spark, sf_dir):
    return M.binary_metrics(predictions(spark, sf_dir), ["arm", "fold"])


@query("roc_auc_avg_rank", """
WITH r AS (SELECT (l_returnflag = 'R')::INT AS y, rank() OVER (ORDER BY round(l_extendedprice / 200000, 4)) + (count(*) OVER (PARTITION BY round(l_extendedprice / 200000, 4)) - 1) / 2.0::DOUBLE AS r FROM lineitem)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS roc_auc FROM r""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_extendedprice") / 200000, 4).alias("probability"))
    return M.roc_auc(rows).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("average_precision", _PRED + """
, t AS (SELECT arm, probability, count(*) AS n, sum(label) AS pos FROM scored GROUP BY arm, probability)
, c AS (SELECT arm, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM t WINDOW w AS (PARTITION BY arm ORDER BY probability DESC))
SELECT arm, sum(pos * cp / cn::DOUBLE) / sum(pos) AS average_precision FROM c GROUP BY arm""")
def _(spark, sf_dir):
    return M.average_precision(predictions(spark, sf_dir), ["arm"])


@query("log_loss_by_group", _PRED + "SELECT arm, lineage_id, count(*) AS n, sum(loss) AS log_loss_sum, sum(brier) AS brier_sum FROM scored GROUP BY arm, lineage_id")
def _(spark, sf_dir):
    return M.group_losses(predictions(spark, sf_dir), ["arm", "lineage_id"])


@query("oof_pool_uniqueness", _PRED + "SELECT arm, count(*) AS n, count(DISTINCT episode_id) AS episodes, count(*) = count(DISTINCT episode_id) AS \"unique\" FROM predictions GROUP BY arm")
def _(spark, sf_dir):
    return M.unique_predictions(predictions(spark, sf_dir))


@query("paired_log_loss_diff", _PRED + "SELECT t.episode_id, t.lineage_id, t.loss - c.loss AS difference, true AS consistent FROM scored t JOIN scored c USING (episode_id) WHERE t.arm = 'treatment' AND c.arm = 'generic'")
def _(spark, sf_dir):
    return M.paired(predictions(spark, sf_dir), "treatment", "generic")


@query("against_mean_replicas", _PRED + "SELECT t.episode_id, t.lineage_id, t.loss - r.m AS difference FROM scored t JOIN (SELECT episode_id, avg(loss) AS m FROM scored WHERE arm LIKE 'shuffled%' GROUP BY 1) r USING (episode_id) WHERE t.arm = 'treatment'")
def _(spark, sf_dir):
    return M.against_replicas(predictions(spark, sf_dir), "treatment", "shuffled_")


_L2 = _PRED + ", cand AS (SELECT arm, fold, power(10.0::DOUBLE, -1 - k) AS l2_lambda, round(loss, 2) AS validation_log_loss FROM (SELECT arm, fold, avg(loss) AS loss FROM scored GROUP BY arm, fold), range(5) t(k))"


def candidates(spark, sf_dir):
    rows = predictions(spark, sf_dir).groupBy("arm", "fold").agg(F.avg(X.log_loss("label", "probability")).alias("loss")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.select("arm", "fold", F.pow(F.lit(10.0), -1 - F.col("k")).alias("l2_lambda"), F.round("loss", 2).alias("validation_log_loss"))


@query("select_l2_min_loss", _L2 + "SELECT arm, fold, max(l2_lambda) AS l2_lambda, min(validation_log_loss) AS validation_log_loss FROM cand GROUP BY arm, fold")
def _(spark, sf_dir):
    return M.select_l2(candidates(spark, sf_dir), ["arm", "fold"])


@query("specificity_audit", _L2 + "SELECT arm, l2_lambda, count(*) AS n, count(*) FILTER (l2_lambda = (SELECT max(l2_lambda) FROM cand)) AS at_most, avg(validation_log_loss) AS mean_loss FROM cand GROUP BY arm, l2_lambda")
def _(spark, sf_dir):
    return M.specificity(candidates(spark, sf_dir))


@query("prior_diagnostic", _PRED + """
, g AS (SELECT arm, fold, count(*) AS records, count(*) FILTER ((probability >= 0.5)::INT = label) AS correct, avg(label) AS rate, avg(loss) AS mean_loss FROM scored GROUP BY arm, fold)
, w AS (SELECT *, 1.959963984540054::DOUBLE AS z, correct / records::DOUBLE AS p FROM g)
, i AS (SELECT *, greatest(0, (p + z * z / (2 * records) - z * sqrt(p * (1 - p) / records + z * z / (4 * records * records))) / (1 + z * z / records)) AS lower, least(1, (p + z * z / (2 * records) + z * sqrt(p * (1 - p) / records + z * z / (4 * records * records))) / (1 + z * z / records)) AS upper, greatest(rate, 1 - rate) AS prior FROM w)
SELECT arm, fold, records, correct, p AS accuracy, lower, upper, prior AS prior_accuracy, mean_loss, CASE WHEN lower > prior AND mean_loss < -(rate * ln(rate) + (1 - rate) * ln(1 - rate)) THEN 'learned_above_prior' WHEN upper < prior THEN 'below_prior' ELSE 'null_like' END AS status FROM i""")
def _(spark, sf_dir):
    return M.prior_diagnostic(predictions(spark, sf_dir), ["arm", "fold"])


@query("arm_summary", _PRED + """
, f AS (SELECT arm, fold, avg(loss) AS loss, count(*) AS n FROM scored GROUP BY arm, fold), b AS (SELECT fold, loss AS base FROM f WHERE arm = 'generic')
, s AS (SELECT arm, count(*) FILTER (loss < base) AS folds_beating_baseline, avg(loss) AS fold_mean, median(loss) AS fold_median, min(loss) AS fold_least, max(loss) AS fold_most, sum(loss * f.n) / sum(f.n) AS weighted_loss FROM f JOIN b USING (fold) GROUP BY arm)
SELECT s.*, p.n, p.brier FROM s JOIN (SELECT arm, count(*) AS n, avg(brier) AS brier FROM scored GROUP BY arm) p USING (arm)""")
def _(spark, sf_dir):
    return M.arm_summary(predictions(spark, sf_dir))


@query("changed_fraction", _PRED + "SELECT t.fold, avg(((t.probability >= 0.5) <> (c.probability >= 0.5))::INT) AS changed_fraction FROM scored t JOIN scored c USING (episode_id) WHERE t.arm = 'treatment' AND c.arm = 'generic' GROUP BY t.fold")
def _(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("hit", F.col("probability") >= 0.5)
    both = p.where("arm = 'treatment'").select("episode_id", "fold", F.col("hit").alias("a")).join(p.where("arm = 'generic'").select("episode_id", F.col("hit").alias("b")), "episode_id")
    return M.changed_fraction(both, "a", "b", ["fold"])


@query("surface_baseline_accuracy", EPISODES_SQL + """
, f AS (SELECT *, list_distinct(string_split_regex(lower(candidate_a), '\\s+')) AS ta, list_distinct(string_split_regex(lower(candidate_b), '\\s+')) AS tb,
   list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', context_before, context_after)), '\\s+'), lambda x: x <> '')) AS tc,
   len(list_filter(string_split_regex(candidate_a, '\\s+'), lambda x: regexp_matches(x, '\\d'))) AS na, len(list_filter(string_split_regex(candidate_b, '\\s+'), lambda x: regexp_matches(x, '\\d'))) AS nb FROM episodes)
, s AS (SELECT *, CASE WHEN len(tc) = 0 THEN 0 ELSE len(list_intersect(ta, tc))::DOUBLE / len(list_distinct(list_concat(ta, tc))) END AS oa, CASE WHEN len(tc) = 0 THEN 0 ELSE len(list_intersect(tb, tc))::DOUBLE / len(list_distinct(list_concat(tb, tc))) END AS ob FROM f)
, u AS (SELECT 'longer_candidate' AS baseline, episode_id, selected_index AS t, sign(length(candidate_b) - length(candidate_a)) AS g FROM s UNION ALL SELECT 'shorter_candidate', episode_id, selected_index, sign(length(candidate_a) - length(candidate_b)) FROM s
  UNION ALL SELECT 'context_token_overlap', episode_id, selected_index, sign(ob - oa) FROM s UNION ALL SELECT 'more_numeric_tokens', episode_id, selected_index, sign(nb - na) FROM s)
SELECT baseline, count(*) AS records, count(*) FILTER (CASE WHEN g > 0 THEN 1 WHEN g < 0 THEN 0 ELSE (instr('13579bdf', substr(sha256('surface-tie:' || baseline || ':' || episode_id), 16, 1)) > 0)::INT END = t) AS correct,
 count(*) FILTER (g = 0) AS ties, count(*) FILTER (CASE WHEN g > 0 THEN 1 WHEN g < 0 THEN 0 ELSE (instr('13579bdf', substr(sha256('surface-tie:' || baseline || ':' || episode_id), 16, 1)) > 0)::INT END = t) / count(*)::DOUBLE AS accuracy FROM u GROUP BY baseline""")
def _(spark, sf_dir):
    return M.surface_baselines(episodes(spark, sf_dir))


@query("oracle_swap_consistency", EPISODES_SQL + """
, p AS (SELECT episode_id, CASE WHEN selected_index = 0 THEN 'A' ELSE 'B' END AS sel, CASE WHEN instr('01234567', substr(sha256('first' || chr(31) || episode_id), 1, 1)) > 0 THEN 'A' ELSE 'B' END AS f, CASE WHEN instr('0123456789a', substr(sha256('second' || chr(31) || episode_id), 1, 1)) > 0 THEN 'B' ELSE 'A' END AS s FROM episodes)
, c AS (SELECT count(*) AS items, count(*) FILTER (f = s) AS consistent, count(*) FILTER (f = s AND f = sel) AS consensus_correct, count(*) FILTER (f = sel) AS original_correct, count(*) FILTER (s = sel) AS swapped_correct, count(*) FILTER (f = 'A') AS original_a FROM p)
, w AS (SELECT *, 1.959963984540054::DOUBLE AS z, consensus_correct / consistent::DOUBLE AS p FROM c)
SELECT items, consistent, consensus_correct, original_correct, swapped_correct, original_a, consistent / items::DOUBLE AS consistency, p AS consensus_accuracy,
 greatest(0, (p + z * z / (2 * consistent) - z * sqrt(p * (1 - p) / consistent + z * z / (4 * consistent * consistent))) / (1 + z * z / consistent)) AS lower, least(1, (p + z * z / (2 * consistent) + z * sqrt(p * (1 - p) / consistent + z * z / (4 * consistent * consistent))) / (1 + z * z / consistent)) AS upper FROM w""")
def _(spark, sf_dir):
    e = episodes(spark, sf_dir).withColumn("item_id", F.col("episode_id"))
    head = lambda tag: F.substring(X.stable_hash(tag, F.col("episode_id")), 1, 1)
    first = e.select("item_id", F.when(head("first").isin(*"01234567"), "A").otherwise("B").alias("prediction"))
    # what is said of the exchanged candidates
    second = e.select("item_id", F.when(head("second").isin(*"0123456789a"), "A").otherwise("B").alias("prediction"))
    return M.swap_consistency(first, second, e.select("item_id", F.when(F.col("selected_index") == 0, "A").otherwise("B").alias("selected")))


@query("seed_gain_summary", _PRED + """
, s AS (SELECT fold, avg(loss) FILTER (arm = 'generic') - avg(loss) FILTER (arm = 'treatment') AS g FROM scored GROUP BY fold)
SELECT count(g) AS seeds, avg(g) AS mean_gain, stddev_samp(g) AS sd_gain, count(*) FILTER (g > 0) AS positive_seeds FROM s""")
def _(spark, sf_dir):
    rows = predictions(spark, sf_dir).groupBy(F.col("fold").alias("seed"), F.col("arm").alias("feature_set")).agg(F.avg(X.log_loss("label", "probability")).alias("loss"))
    return M.seed_gains(rows, "generic", "treatment")


@query("trajectory_summary", """
WITH t AS (SELECT user_id % 7 AS run, event_id AS step, value AS loss FROM events)
SELECT run, arg_min(loss, step) AS first, arg_max(loss, step) AS last, min(loss) AS least, max(loss) AS most, count(*) AS points, true AS steps_rise, CASE WHEN arg_min(loss, step) = 0 THEN 0 ELSE (arg_min(loss, step) - arg_max(loss, step)) / arg_min(loss, step) END AS relative_reduction FROM t GROUP BY run""")
def _(spark, sf_dir):
    return M.trajectory(table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")), ["run"])


@query("duplicate_hashes", "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    return M.duplicate_hashes(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("source_gates", _PRED + """
, g AS (SELECT arm, count(*) AS n, count(*) FILTER ((probability >= 0.5)::INT = label) AS c, avg(loss) AS l FROM scored GROUP BY arm), w AS (SELECT *, 1.959963984540054::DOUBLE AS z, c / n::DOUBLE AS p FROM g)
SELECT arm, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > 0.5 AND l < ln(2) AS passed FROM w""")
def _(spark, sf_dir):
    return M.binary_metrics(predictions(spark, sf_dir), ["arm"]).select("arm", M.source_gate().alias("passed"))


# --- resampling -------------------------------------------------------------------------------------------------

_SUMS = _PRED + """
, d AS (SELECT t.lineage_id, sum(t.loss - c.loss) AS total, count(*) AS n FROM scored t JOIN scored c USING (episode_id) WHERE t.arm = 'treatment' AND c.arm = 'generic' GROUP BY t.lineage_id)
"""


def loss_sums(spark, sf_dir):
    return M.paired(predictions(spark, sf_dir), "treatment", "generic").groupBy("lineage_id").agg(F.sum("difference").alias("total"), F.count("*").alias("n"))


@query("lineage_bootstrap_ci", _SUMS + """
, x AS (SELECT *, row_number() OVER (ORDER BY sha256('17' || chr(31) || lineage_id), lineage_id) - 1 AS pos FROM d), k AS (SELECT count(*) AS g FROM d)
, draw AS (SELECT r, ('0x' || substr(sha256('17' || chr(31) || r || chr(31) || s), 1, 12))::BIGINT % (SELECT g FROM k) AS pos FROM range(200) a(r), range((SELECT g FROM k)) b(s))
, v AS (SELECT r, sum(total) / sum(n) AS statistic FROM draw JOIN x USING (pos) GROUP BY r)
, i AS (SELECT count(*) AS replicates, avg(statistic) AS mean, quantile_cont(statistic, 0.025) AS lower, quantile_cont(statistic, 0.975) AS upper FROM v)
SELECT *, CASE WHEN lower > 0 THEN 'supported' WHEN upper < 0 THEN 'degraded' ELSE 'not_supported' END AS result FROM i""")
def _(spark, sf_dir):
    return R.interval(R.bootstrap(loss_sums(spark, sf_dir), "lineage_id", "total", "n", 200))


@query("poisson_bootstrap_ci")
def _(spark, sf_dir):
    """The join-free form of the lineage bootstrap."""
    return R.interval(R.poisson_bootstrap(loss_sums(spark, sf_dir), "total", "n", 400))


@query("hierarchical_bootstrap_ci", _PRED + """
, d AS (SELECT t.fold AS seed, t.lineage_id, sum(t.loss - c.loss) AS total, count(*) AS n FROM scored t JOIN scored c USING (episode_id) WHERE t.arm = 'treatment' AND c.arm = 'generic' GROUP BY t.fold, t.lineage_id)
, s AS (SELECT seed, row_number() OVER (ORDER BY sha256('17' || chr(31) || seed), seed) - 1 AS s FROM (SELECT DISTINCT seed FROM d)), k AS (SELECT count(*) AS g FROM s)
, x AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sha256('17' || chr(31) || lineage_id), lineage_id) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS size FROM d)
, slot AS (SELECT r, q, ('0x' || substr(sha256('17' || chr(31) || r || chr(31) || q), 1, 12))::BIGINT % (SELECT g FROM k) AS s FROM range(100) a(r), range((SELECT g FROM k)) b(q))
, z AS (SELECT DISTINCT seed, size FROM x), j AS (SELECT r, q, seed, size, unnest(range(size)) AS j FROM slot JOIN s USING (s) JOIN z USING (seed))
, draw AS (SELECT r, q, seed, ('0x' || substr(sha256('18' || chr(31) || r || chr(31) || q || chr(31) || j), 1, 12))::BIGINT % size AS pos FROM j)
, v AS (SELECT r, q, sum(total) / sum(n) AS v FROM draw JOIN x USING (seed, pos) GROUP BY r, q), w AS (SELECT r, avg(v) AS statistic FROM v GROUP BY r)
, i AS (SELECT count(*) AS replicates, avg(statistic) AS mean, quantile_cont(statistic, 0.025) AS lower, quantile_cont(statistic, 0.975) AS upper FROM w)
SELECT *, CASE WHEN lower > 0 THEN 'supported' WHEN upper < 0 THEN 'degraded' ELSE 'not_supported' END AS result FROM i""")
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    sums = M.paired(p, "treatment", "generic").join(p.where("arm = 'generic'").select("episode_id", F.col("fold").alias("seed")), "episode_id").groupBy("seed", "lineage_id").agg(F.sum("difference").alias("total"), F.count("*").alias("n"))
    return R.interval(R.hierarchical_bootstrap(sums, "seed", "lineage_id", "total", "n", 100))


@query("group_holdout_split", """
WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('17' || chr(31) || source), source) AS k FROM (SELECT DISTINCT source FROM documents))
SELECT source, count(*) AS n, k <= round_even((SELECT count(*) FROM g) * 0.2::DOUBLE, 0) AS held_out FROM documents JOIN g USING (source) GROUP BY source, k""")
def _(spark, sf_dir):
    return R.group_holdout(table(spark, sf_dir, "documents").select("source"), "source").groupBy("source", "held_out").agg(F.count("*").alias("n"))


@query("within_bucket_permutation", """
WITH a AS (SELECT source, doc_id, toxic, row_number() OVER (PARTITION BY source ORDER BY sha256('natural:17:' || doc_id), doc_id) AS k, row_number() OVER (PARTITION BY source ORDER BY sha256('dealt:17:' || doc_id), doc_id) AS m FROM labels JOIN documents USING (doc_id))
SELECT a.source, a.doc_id, b.toxic AS shuffled FROM a JOIN a b ON a.source = b.source AND a.k = b.m""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return C.within_label_shuffle(rows, ["source"], "doc_id", "toxic").select("source", "doc_id", "shuffled")


@query("matched_block_shuffle", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents),
b AS (SELECT *, CASE WHEN n % 8 = 1 AND rn = n - 1 AND n > 1 THEN rn // 8 - 1 ELSE rn // 8 END AS block FROM r),
s AS (SELECT *, count(*) OVER (PARTITION BY source, block) AS size, rn - min(rn) OVER (PARTITION BY source, block) AS pos FROM b),
f AS (SELECT *, ((pos - CASE WHEN size > 1 THEN ('0x' || substr(sha256('17' || chr(31) || source || chr(31) || block), 1, 8))::BIGINT % greatest(size - 1, 1) + 1 ELSE 0 END) % size + size) % size AS src FROM s)
SELECT f.doc_id, g.doc_id AS donor FROM f JOIN f g ON f.source = g.source AND f.block = g.block AND f.src = g.pos""")
def _(spark, sf_dir):
    return C.block_shift(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars"], "doc_id", 8)


@query("epoch_batches", """
WITH e AS (SELECT doc_id, unnest(range(2)) AS epoch FROM labels), n AS (SELECT count(*) AS n FROM labels),
r AS (SELECT doc_id, epoch * (SELECT n FROM n) + row_number() OVER (PARTITION BY epoch ORDER BY sha256('17' || chr(31) || epoch || chr(31) || doc_id), doc_id) - 1 AS pos FROM e)
SELECT pos // 16 AS step, pos % 16 AS slot, doc_id FROM r WHERE pos // 16 < (SELECT n // 16 + 2 FROM n)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return R.batches(rows, "doc_id", 16, rows.count() // 16 + 2)


@query("sequential_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def _(spark, sf_dir):
    return R.sequential_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


# --- sessions ---------------------------------------------------------------------------------------------------

_SES = """
WITH v AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS round, count(*) OVER (PARTITION BY user_id) AS size,
  CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'tie' ELSE 'both_bad' END AS vote FROM events), s AS (SELECT *, (round < size - 1)::INT AS continues FROM v)
"""


def sessions(spark, sf_dir):
    vote = F.when(F.col("event_type") == "click", " Model_A ").when(F.col("event_type") == "view", "winner_model_b").when(F.col("event_type") == "purchase", "tie").otherwise("Tie (bothbad)")
    return Z.prepared(table(spark, sf_dir, "events").withColumn("winner", vote), "user_id", ["ts", "event_id"], "winner")


@query("session_continuation_target", _SES + "SELECT session_id, round::INT AS round, size, vote, continues FROM s")
def _(spark, sf_dir):
    return sessions(spark, sf_dir).select("session_id", "round", "size", "vote", "continues")


@query("vote_one_hot", _SES + "SELECT session_id, sum((vote = 'a')::INT)::BIGINT AS pref_a, sum((vote = 'b')::INT)::BIGINT AS pref_b, sum((vote = 'tie')::INT)::BIGINT AS pref_tie, sum((vote = 'both_bad')::INT)::BIGINT AS pref_both_bad FROM s GROUP BY session_id")
def _(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("session_id").agg(*[F.sum(f"pref_{v}").alias(f"pref_{v}") for v in Z.VOTES])


@query("continuation_by_vote", _SES + "SELECT vote, count(*) AS n, avg(continues) AS rate, avg(continues) - (SELECT avg(continues) FROM s) AS lift FROM s GROUP BY vote")
def _(spark, sf_dir):
    return Z.continuation(sessions(spark, sf_dir), ["vote"])


@query("continuation_by_order", _SES + "SELECT round::INT AS round, count(*) AS n, avg(continues) AS rate, round(avg(continues) - (SELECT avg(continues) FROM s), 9) AS lift FROM s GROUP BY round ORDER BY round LIMIT 12")
def _(spark, sf_dir):
    return Z.continuation(sessions(spark, sf_dir), ["round"]).orderBy("round").limit(12).withColumn("lift", F.round("lift", 9))


@query("session_sizes", _SES + ", p AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1) SELECT count(*) AS sessions, avg(n) AS mean, stddev_samp(n) AS sd, min(n) AS least, median(n) AS median, max(n) AS most FROM p")
def _(spark, sf_dir):
    return Z.session_sizes(sessions(spark, sf_dir))


@query("session_row_limited_sample", _SES.replace("WITH v", "WITH RECURSIVE v") + """
, z AS (SELECT session_id, count(*) AS n, row_number() OVER (ORDER BY sha256('1729' || chr(31) || session_id)) AS k FROM s GROUP BY 1)
, g(k, used) AS (SELECT 1::BIGINT, n FROM z WHERE k = 1 UNION ALL SELECT z.k, CASE WHEN g.used < 500 AND g.used + z.n <= 500 THEN g.used + z.n ELSE g.used END FROM g JOIN z ON z.k = g.k + 1)
, t AS (SELECT z.session_id, g.used - lag(g.used, 1, 0) OVER (ORDER BY z.k) AS taken FROM g JOIN z USING (k))
SELECT session_id, count(*) AS n FROM s WHERE session_id IN (SELECT session_id FROM t WHERE taken > 0) GROUP BY 1""")
def _(spark, sf_dir):
    return S.whole_sessions(sessions(spark, sf_dir), "session_id", 500).groupBy("session_id").agg(F.count("*").alias("n"))


@query("synthetic_sessions")
def _(spark, sf_dir):
    """Generated sessions, by round: how many are left and how many stop."""
    return Z.synthetic(spark, 2000, 12).groupBy("round").agg(F.count("*").alias("n"), F.sum("stop").alias("stops"))


# --- vectors and models -----------------------------------------------------------------------------------------


def triples(spark, sf_dir):
    """Each vector as context with the next two (by vec_id) as candidates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    n = e.select("vec_id", F.col("v").alias("n"))
    rows = e.join(n.select((F.col("vec_id") - 1).alias("vec_id"), F.col("n").alias("a")), "vec_id").join(n.select((F.col("vec_id") - 2).alias("vec_id"), F.col("n").alias("b")), "vec_id")
    return rows.select(F.col("vec_id").alias("id"), F.col("v").alias("context"), F.col("a").alias("candidate_a"), F.col("b").alias("candidate_b"), (F.col("label") % 2).cast("int").alias("label"), (F.col("vec_id") % FOLDS).cast("int").alias("fold_bucket"))


_TRI = "WITH t AS (SELECT c.vec_id AS id, c.embedding::DOUBLE[] AS c, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings c JOIN embeddings a ON a.vec_id = c.vec_id + 1 JOIN embeddings b ON b.vec_id = c.vec_id + 2)"


def _ends(name, v="v"):
    """A vector's length, sum and ends, which compare without arrays."""
    return [F.size(v).alias("size"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get(v, F.size(v) - 1), 6).alias("last")]


@query("generic_geometry_features", _TRI + ", g AS (SELECT id, list_concat(list_concat(c, list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) / 2)), list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) AS v FROM t) SELECT id, len(v)::INT AS size, round(list_sum(v), 6) AS total, round(v[len(v)], 6) AS last FROM g")
def _(spark, sf_dir):
    return triples(spark, sf_dir).withColumn("v", L.geometry("context", "candidate_a", "candidate_b")).select("id", *_ends("v"))


@query("choice_geometry_features", _TRI + ", g AS (SELECT id, list_concat(list_concat(list_concat(c, a), b), list_transform(list_zip(a, b), lambda x: x[1] - x[2])) AS v FROM t) SELECT id, len(v)::INT AS size, round(list_sum(v), 6) AS total, round(v[len(v)], 6) AS last FROM g")
def _(spark, sf_dir):
    return triples(spark, sf_dir).withColumn("v", L.choice_geometry("context", "candidate_a", "candidate_b")).select("id", *_ends("v"))


@query("antisymmetric_features", _TRI + ", d AS (SELECT id, c, list_transform(list_zip(a, b), lambda x: x[1] - x[2]) AS d FROM t), g AS (SELECT id, list_concat(d, list_transform(list_zip(d, c), lambda x: x[1] * x[2])) AS v FROM d) SELECT id, len(v)::INT AS size, round(list_sum(v), 6) AS total, round(v[len(v)], 6) AS last FROM g")
def _(spark, sf_dir):
    return triples(spark, sf_dir).withColumn("v", L.antisymmetric("candidate_a", "candidate_b", "context")).select("id", *_ends("v"))


@query("train_only_zscore", """
WITH l AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) <= 1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM l WHERE vec_id % 5 > 1 GROUP BY i)
SELECT vec_id AS id, count(*)::INT AS size, round(sum((x - m) / s), 6) AS total, round(arg_max((x - m) / s, i), 6) AS last FROM l JOIN s USING (i) GROUP BY vec_id""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return L.scaled(rows, "v", F.col("id") % 5 > 1).select("id", *_ends("scaled", "scaled"))


@query("vector_movement", "SELECT a.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    return triples_next(spark, sf_dir).select("id", F.round(M.movement("v", "next"), 6).alias("distance"))


def triples_next(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("next")), "id")


@query("pca_projection")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    p = L.projected(rows, "v", F.col("id") % 5 > 1, 8)
    return p.select("id", F.size("projected").alias("size"), F.round(F.aggregate("projected", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


@query("logistic_probe_metrics")
def _(spark, sf_dir):
    rows = triples(spark, sf_dir).select("id", "fold_bucket", F.col("context").alias("v"), "label")
    return M.binary_metrics(L.probe(rows, "v", "label", FOLDS), ["fold"])


@query("ranker_linear_oof")
def _(spark, sf_dir):
    rows = triples(spark, sf_dir).withColumn("v", L.antisymmetric("candidate_a", "candidate_b", "context"))
    return M.binary_metrics(L.probe(rows, "v", "label", FOLDS, intercept=False), ["fold"])


@query("value_network_oof")
def _(spark, sf_dir):
    return M.binary_metrics(L.value_network(triples(spark, sf_dir), FOLDS), ["fold"])


def stated_network(dim: int) -> list[list[float]]:
    """A network whose weights follow a rule, so that SQL can compute its states: 4 * dim inputs, two units, two states."""
    first = [[math.sin(i * (k + 1) + 1) / 16 for k in range(2)] for i in range(4 * dim)]
    return [[0.0] * (4 * dim), [1.0] * (4 * dim), [x for row in first for x in row], [0.1, 0.2], [math.cos(k + 2 * j) / 2 for k in range(2) for j in range(2)], [0.0, -0.05], [1.0, 2.0]]


_STATES = _TRI + """
, y AS (SELECT vec_id AS id, label % 2 AS y FROM embeddings), w AS (SELECT id, c, y, unnest([{'s': 'a', 'x': a}, {'s': 'b', 'x': b}], recursive := true) FROM t JOIN y USING (id)),
v AS (SELECT id, s, y, list_concat(list_concat(list_concat(c, x), list_transform(list_zip(x, c), lambda z: z[1] * z[2])), list_transform(list_zip(x, c), lambda z: abs(z[1] - z[2]))) AS v FROM w),
h AS (SELECT id, s, y, tanh(list_inner_product(v, list_transform(range(len(v)), lambda i: sin(i + 1) / 16)) + 0.1) AS h1, tanh(list_inner_product(v, list_transform(range(len(v)), lambda i: sin(i * 2 + 1) / 16)) + 0.2) AS h2 FROM v),
z AS (SELECT id, s, y, tanh(h1 * cos(0) / 2 + h2 * cos(1) / 2) AS z1, tanh(h1 * cos(2) / 2 + h2 * cos(3) / 2 - 0.05) AS z2 FROM h),
p AS (SELECT a.id, a.y, a.z1 AS a1, a.z2 AS a2, b.z1 AS b1, b.z2 AS b2, a.z1 + 2 * a.z2 AS qa, b.z1 + 2 * b.z2 AS qb FROM z a JOIN z b ON a.id = b.id AND a.s = 'a' AND b.s = 'b')
SELECT id, round(a1 + b1, 6) AS blind_0, round(abs(a2 - b2), 6) AS blind_3, round(abs(qa - qb), 6) AS blind_4,
  round(CASE WHEN y = 1 THEN b1 ELSE a1 END, 6) AS aware_0, round(CASE WHEN y = 1 THEN a2 ELSE b2 END, 6) AS aware_3, round(CASE WHEN y = 1 THEN b2 - a2 ELSE a2 - b2 END, 6) AS aware_5, round(CASE WHEN y = 1 THEN qb - qa ELSE qa - qb END, 6) AS aware_6 FROM p
"""


@query("value_states", _STATES)
def _(spark, sf_dir):
    """Entries of both states of every row under a network whose weights follow a rule."""
    rows = triples(spark, sf_dir)
    dim = rows.select(F.size("context")).first()
    states = L.value_states(rows, stated_network(dim[0] if dim else 1))
    pick = lambda c, i: F.round(F.col(c)[i], 6).alias(f"{'aware' if c == 'choice_aware' else c}_{i}")
    return states.select("id", *[pick("blind", i) for i in (0, 3, 4)], *[pick("choice_aware", i) for i in (0, 3, 5, 6)])


REPLICAS = 5


def transfer(spark, sf_dir):
    """Triples with out-of-fold states of networks trained on authentic labels (replica 0) and on labels dealt again within each
    fold's bucket."""
    rows = written(triples(spark, sf_dir), "triples")
    labels = rows.select("id", "fold_bucket", "label")
    for k in range(REPLICAS):
        dealt = C.within_label_shuffle(rows.select("id", "fold_bucket", "label"), ["fold_bucket"], "id", "label", 100 + k)
        # no broadcasts, which would grow with the rows on the driver: the size of a compressed file says little of them
        labels = labels.join(dealt.select("id", F.col("shuffled").alias(f"r{k}")).hint("merge"), "id")
    every = labels.select("id", F.array("label", *[f"r{k}" for k in range(REPLICAS)]).cast("array<double>").alias("labels"))
    nets = L.transfer_networks(rows.join(every.hint("merge"), "id"), FOLDS)
    states = L.transfer_states(rows, nets).select("id", "blind", "choice_aware")
    return written(rows.join(states.hint("merge"), "id"), "states")


@query("shuffled_transfer_metrics")
def _(spark, sf_dir):
    """Probes on geometry, on authentic states and on each control's states, all folds, arms and penalties fitted together."""
    rows = transfer(spark, sf_dir)
    arms = {"generic": L.geometry("context", "candidate_a", "candidate_b"), "mrq_blind": F.col("blind")[0], "mrq_choice_aware": F.col("choice_aware")[0]}
    arms |= {f"shuffled_r{k:02d}": F.col("choice_aware")[k + 1] for k in range(REPLICAS)}
    return M.binary_metrics(L.probes(rows, arms, "label", FOLDS, G.EXTENDED_GRID), ["arm"])


def boosted(spark, sf_dir):
    """Eight arms of boosted trees over geometry and states, scored out of fold."""
    rows = transfer(spark, sf_dir)
    blocks = {"generic": L.geometry("context", "candidate_a", "candidate_b")} | {f"s{k}": F.col("choice_aware")[k] for k in range(REPLICAS + 1)}
    arms = {"xgb_generic_all": ("generic",), "xgb_authentic_mrq_only": ("s0",), "xgb_generic_plus_authentic_mrq": ("generic", "s0")}
    arms |= {f"xgb_generic_plus_shuffled_mrq_r{k:02d}": ("generic", f"s{k + 1}") for k in range(REPLICAS)}
    return L.boosted_arms(rows, blocks, arms, "label", FOLDS, T.Settings(rate=0.1, patience=10))


@query("gbt_arm_metrics")
def _(spark, sf_dir):
    return M.binary_metrics(boosted(spark, sf_dir), ["arm", "fold"])


@query("boosted_aggregate")
def _(spark, sf_dir):
    """The arm with authentic states against the generic one, each control and their mean: pooled rows once each, intervals over
    groups, and whether the states are supported."""
    pooled = boosted(spark, sf_dir).select(F.col("id").alias("episode_id"), F.floor(F.col("id") / 5).cast("string").alias("lineage_id"), "arm", "fold", "label", "probability")
    return B.boosted_aggregate(written(pooled, "pooled"), "xgb_generic_plus_authentic_mrq", "xgb_generic_all", "xgb_generic_plus_shuffled_mrq_r")


def labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), "text", "n_chars", "source", "label")


@query("text_pipeline_metrics")
def _(spark, sf_dir):
    """Words, length and source of labelled documents, for a held-out fifth: quasi-Newton and averaged mini-batch steps."""
    rows = labelled(spark, sf_dir)
    splits = rows.select("id", F.lit(0).alias("split"), F.when(F.col("id") % 5 == 0, G.TEST).otherwise(G.TRAIN).alias("role"))
    both = [L.text_models(rows, splits, ["text"], ["n_chars"], ["source"], averaged=a).withColumn("steps", F.lit(name)) for a, name in ((False, "quasi-Newton"), (True, "averaged"))]
    return M.binary_metrics(both[0].unionByName(both[1]), ["steps"])


@query("tfidf_logistic_metrics")
def _(spark, sf_dir):
    """Words of labelled documents, three folds, each with the vocabulary and weights of its own training rows."""
    rows = labelled(spark, sf_dir)
    splits = rows.select("id", F.explode(F.array(*[F.lit(f) for f in range(3)])).alias("split"))
    splits = splits.withColumn("role", F.when(F.col("id") % 3 == F.col("split"), G.TEST).otherwise(G.TRAIN))
    return M.binary_metrics(L.text_models(rows, splits, ["text"], [], []).withColumnRenamed("split", "fold"), ["fold"])


@query("session_arms")
def _(spark, sf_dir):
    """Whether a session goes on, by its round and size, by votes, by both, and by votes dealt again among rows of the same round."""
    rows = sessions(spark, sf_dir).withColumn("id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("round").cast("string"))).withColumn("condition", F.lit("events"))
    return M.binary_metrics(L.arm_matrix(rows, "session_id", "continues", ["round"], [f"pref_{v}" for v in Z.VOTES], SEEDS, bucket="round"), ["condition", "seed", "arm"])


def session_effects(spark, sf_dir):
    """Every vote of events, and its target under each planted effect: it is kept on if a hash is below the chance that its vote and a
    mood of its session give."""
    u = lambda *parts: F.conv(F.substring(X.stable_hash(17, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = sessions(spark, sf_dir)
    mood = u(F.lit("mood"), F.col("session_id")) * 2 - 1
    sway = F.when(F.col("vote") == "a", 1.0).when(F.col("vote") == "b", -1.0).otherwise(0.0)
    stays = lambda effect: u(F.lit("stay"), F.col("session_id"), F.col("round")) < X.sigmoid(0.3 + 0.8 * mood + F.lit(effect) * sway)
    return rows.withColumn("id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("round").cast("string"))), {f"effect_{e}": stays(e).cast("int") for e in EFFECTS}


@query("session_effect_matrix")
def _(spark, sf_dir):
    """Planted effects by seeds, four arms each: mean losses and what votes gain over the base."""
    rows, targets = session_effects(spark, sf_dir)
    out = L.arm_matrix(rows, "session_id", "target", ["round", "size"], [f"pref_{v}" for v in Z.VOTES], SEEDS, bucket="round", conditions=targets)
    loss = out.groupBy("condition", "seed", "arm").agg(F.avg(X.log_loss("label", "probability")).alias("loss"), F.count("*").alias("n"))
    wide = loss.groupBy("condition", "seed").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("arm") == a, F.col("loss"))).alias(a) for a in ("no_preference", "preference_only", "full", "shuffled")])
    return wide.withColumns({"gain": F.col("no_preference") - F.col("full"), "control_gain": F.col("shuffled") - F.col("full")})


_FITS = """
WITH RECURSIVE q AS (SELECT doc_id % 5 AS bucket, quality AS y, ln(1 + length(text)) AS chars, ln(1 + length(text) - length(replace(text, ' ', ''))) AS gaps FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
l AS (SELECT bucket, y, 'chars' AS arm, chars AS x FROM q UNION ALL SELECT bucket, y, 'gaps', gaps FROM q),
tr AS (SELECT f::INT AS fold, arm, y, x FROM l, range(5) t(f) WHERE bucket <> f AND bucket <> (f + 1) % 5),
s AS (SELECT fold, arm, avg(x) AS m, CASE WHEN stddev_pop(x) <= 1e-6 THEN 1 ELSE stddev_pop(x) END AS sd, count(*) AS n FROM tr GROUP BY fold, arm),
z AS (SELECT fold, arm, y, (x - m) / sd AS x FROM tr JOIN s USING (fold, arm)),
it(i, fold, arm, l2, b, w) AS (
  SELECT 0, fold, arm, l2, 0.0::DOUBLE, 0.0::DOUBLE FROM s, (VALUES (1e-5::DOUBLE), (1e-4), (1e-3), (1e-2), (1e-1), (1.0), (10.0), (100.0)) g(l2)
  UNION ALL SELECT i + 1, fold, arm, l2, b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT i, fold, arm, l2, b, w, avg(p - y) AS g0, avg((p - y) * x) + l2 * w AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * x) AS h01, avg(p * (1 - p) * x * x) + l2 AS h11
    FROM (SELECT i, fold, arm, l2, b, w, x, y, 1 / (1 + exp(-(b + w * x))) AS p FROM it JOIN z USING (fold, arm) WHERE i < 14) GROUP BY i, fold, arm, l2, b, w)),
done AS (SELECT * FROM it WHERE i = 14)
"""


def quality_fits(spark, sf_dir):
    """All folds, two arms of one column and eight penalties, fitted together on labelled documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")).where("label is not null"), "doc_id")
    gaps = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % FOLDS).cast("int").alias("fold_bucket"), "label", F.array(F.log1p(F.length("text").cast("double")), F.log1p(gaps.cast("double"))).alias("v"))
    data = G.folds_design(rows, F.col("v"), "label", FOLDS)
    return data, *G.fit(data, [G.Arm(f, name, (i,)) for f in range(FOLDS) for i, name in enumerate(("chars", "gaps"))], G.EXTENDED_GRID)


@query("logistic_coefficients", _FITS + "SELECT fold, arm, l2 AS l2_lambda, n AS train_rows, round(b, 6) AS intercept, round(w, 6) AS weight FROM done JOIN s USING (fold, arm)")
def _(spark, sf_dir):
    _, _, models = quality_fits(spark, sf_dir)
    rows = [(fold, arm, l2, n, round(b, 6) + 0.0, round(w[0], 6) + 0.0) for fold, arm, l2, n, b, w in G.coefficients(models)]
    return spark.createDataFrame(rows, "fold int, arm string, l2_lambda double, train_rows long, intercept double, weight double")


@query("logistic_selected_scores", _FITS + """
, v AS (SELECT fold, arm, l2, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS loss FROM (
    SELECT d.fold, d.arm, l2, y, least(greatest(1 / (1 + exp(-(b + w * (x - m) / sd))), 1e-7), 1 - 1e-7) AS p FROM done d JOIN s USING (fold, arm) JOIN l ON l.arm = d.arm AND l.bucket = (d.fold + 1) % 5) GROUP BY fold, arm, l2),
best AS (SELECT fold, arm, max(l2) AS l2 FROM (SELECT *, min(loss) OVER (PARTITION BY fold, arm) AS least FROM v) WHERE loss <= least + 1e-12 GROUP BY fold, arm)
SELECT d.fold, d.arm, l2 AS l2_lambda, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(1 / (1 + exp(-(b + w * (x - m) / sd)))), 6) AS mean_probability
FROM best JOIN done d USING (fold, arm, l2) JOIN s USING (fold, arm) JOIN l ON l.arm = d.arm AND l.bucket = d.fold GROUP BY d.fold, d.arm, l2""")
def _(spark, sf_dir):
    """The penalty that validation rows choose for each fold and arm, and the scores of the test rows."""
    data, scales, models = quality_fits(spark, sf_dir)
    out = G.scored(data, scales, G.chosen(data, scales, models))
    return out.groupBy(F.col("split").alias("fold"), "arm", "l2_lambda").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.round(F.avg("probability"), 6).alias("mean_probability"))


@query("matched_control_metrics")
def _(spark, sf_dir):
    """Arms of vector geometry with eight penalties each, every fold at once."""
    v = {"context": F.col("context"), "generic": L.geometry("context", "candidate_a", "candidate_b"), "choice": L.choice_geometry("context", "candidate_a", "candidate_b")}
    return M.binary_metrics(L.probes(triples(spark, sf_dir), v, "label", FOLDS, G.EXTENDED_GRID), ["arm", "fold"])
