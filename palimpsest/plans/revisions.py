"""Queries of ingest, text scalars, alignment and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.operators import audit as U
from palimpsest.operators import selection as S
from palimpsest.plans.registry import query
from palimpsest.sources.fixture import CELLS_SQL, EPISODES_SQL, FLAGS_SQL, TEMPORAL_FORM, TOKENS_SQL, revisions, sentence_rows, table

_SPACE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def versions(spark: SparkSession, sf_dir: str, n_parts: int | None = None) -> DataFrame:
    """Versions that lie together by lineage, in version_parts(): windows of them take n_parts=0."""
    return revisions(table(spark, sf_dir, "documents"), n_parts or version_parts(spark, sf_dir))


def version_parts(spark: SparkSession, sf_dir: str) -> int:
    """A.parts() of versions() by the bytes of the documents that they are made of: each has three."""
    return A.parts(table(spark, sf_dir, "documents"), 3 * F.octet_length("text").cast("long"))


def replaced(spark: SparkSession, sf_dir: str, n_parts: int | None = None) -> DataFrame:
    return A.replacements(versions(spark, sf_dir, n_parts), A.version_order(None, "version_id"), n_parts=0)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_parts = version_parts(spark, sf_dir)
    return A.episodes(replaced(spark, sf_dir, n_parts), n_parts=n_parts)


# --- ingest -----------------------------------------------------------------------------------------------------


@query("qualifying_lineages_min3", "SELECT conv_id::VARCHAR AS lineage_id, count(*) AS n FROM conversations WHERE text IS NOT NULL AND length(trim(text)) > 0 GROUP BY conv_id HAVING count(*) >= 3")
def _(spark, sf_dir):
    return S.qualifying(table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0), F.col("conv_id").cast("string"), least=3)


@query("qualifying_distinct_versions", "SELECT conv_id::VARCHAR AS lineage_id, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) >= 2")
def _(spark, sf_dir):
    return S.qualifying(table(spark, sf_dir, "conversations"), F.col("conv_id").cast("string"), least=2, distinct="turn")


@query("versions_of_sampled_lineages", """
WITH k AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3),
s AS (SELECT conv_id FROM k ORDER BY sha256('17' || chr(31) || conv_id) LIMIT 20)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS nth FROM conversations WHERE conv_id IN (SELECT conv_id FROM s)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    keys = S.sample_keys(rows.groupBy("conv_id").count().where("count >= 3").select("conv_id"), "conv_id", 20)
    picked = rows.join(F.broadcast(keys), "conv_id", "left_semi")
    return picked.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("nth"))


@query("external_lineages_anti", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0') AND turn >= 1")
def _(spark, sf_dir):
    held = table(spark, sf_dir, "documents").where("source = 'src0'").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").where("turn >= 1").select("conv_id").distinct().join(held, "conv_id", "left_anti")


@query("version_reconstruct_sentences", """
SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS text, count(*) AS sentences FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return S.rebuilt(rows, ["doc_id"], "i", "line").select("doc_id", F.array_join("sentences", " ").alias("text"), F.size("sentences").cast("long").alias("sentences"))


@query("natural_version_order", "SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn)::INT AS nth FROM conversations")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("version", F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))
    return rows.select("role", "conv_id", "turn", F.row_number().over(Window.partitionBy("role").orderBy(*A.version_order(None, "version"))).alias("nth"))


@query("dedup_first_episode", EPISODES_SQL + "SELECT episode_id, md5(candidate_a) AS a, future_revised FROM episodes")
def _(spark, sf_dir):
    """Blocks that come a second time, in a later window with other outcomes, leave the first ones as they are."""
    found = replaced(spark, sf_dir)
    again = found.withColumn("nth", F.col("nth") + 1).withColumn("v2_sentence", F.concat("v2_sentence", F.lit(" again")))
    return A.episodes(found.unionByName(again)).select("episode_id", F.md5("candidate_a").alias("a"), "future_revised")


@query("source_from_path", "SELECT 'documents' AS source_name, count(*) AS n FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(S.source_name(F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", "")).alias("source_name")).agg(F.count("*").alias("n"))


# --- text scalars -----------------------------------------------------------------------------------------------


@query("normalise_space_docs", f"SELECT doc_id, md5({_SPACE}) AS digest FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalise_space("text")).alias("digest"))


@query("token_counts_docs", f"SELECT doc_id, len({TOKENS_SQL.format('text')})::INT AS tokens, len(list_distinct({TOKENS_SQL.format('text')}))::INT AS kinds, len(string_split({_SPACE}, ' '))::INT AS spaced FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens("text")).alias("tokens"), F.size(F.array_distinct(X.tokens("text"))).alias("kinds"), X.token_count("text").alias("spaced"))


@query("sentence_split_counts", r"""
SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])[\t ]+(["''“‘(\[]?[A-Z0-9])', '\1' || chr(10) || '\2', 'g'),
  '([.!?])[\t ]+(["''“‘(\[]?[A-Z0-9])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda x: trim(x) <> ''))::INT AS sentences FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentence_split("text")).alias("sentences"))


@query("valid_sentences_filter", CELLS_SQL + f"SELECT doc_id, count(*) AS valid FROM cells WHERE length(old) BETWEEN 20 AND 500 AND len({TOKENS_SQL.format('old')}) >= 3 GROUP BY doc_id")
def _(spark, sf_dir):
    rows = sentence_rows(table(spark, sf_dir, "documents")).select("doc_id", F.explode("sentences").alias("s"))
    return rows.where(X.valid_sentence("s")).groupBy("doc_id").agg(F.count("*").alias("valid"))


@query("lexical_jaccard_adjacent_turns", f"""
WITH t AS (SELECT conv_id, turn, list_distinct({TOKENS_SQL.format('text')}) AS a, list_distinct(lead({TOKENS_SQL.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
  ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END::DOUBLE AS jaccard FROM t WHERE b IS NOT NULL""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return rows.select("conv_id", "turn", X.lexical_jaccard("text", "next").alias("jaccard"))


_NUMBERS = r"regexp_extract_all(text, '(?i)(?:^|[^\pL\pN_.])((?:[$£€]\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:%|(?:st|nd|rd|th)\b)?)', 1)"


@query("number_extract_docs", f"SELECT doc_id, len({_NUMBERS})::INT AS n, array_to_string(list_transform({_NUMBERS}, lambda x: lower(regexp_replace(x, '[\\s,]', '', 'g'))), ' ') AS numbers FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.numbers("text")).alias("n"), F.array_join(X.numbers("text"), " ").alias("numbers"))


_MASK = r"regexp_replace(text, '(?i)(^|[^\pL\pN_.])(?:[$£€]\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:%|(?:st|nd|rd|th)\b)?', '\1<NUM>', 'g')"


@query("mask_numbers_docs", rf"SELECT doc_id, regexp_matches(text, '\d') AS has_digit, len(regexp_extract_all(text, '\d'))::INT AS digits, md5({_MASK}) AS masked FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"\d").alias("has_digit"), F.regexp_count("text", F.lit(r"\d")).alias("digits"), F.md5(X.mask_numbers("text")).alias("masked"))


@query("numeric_category_flags", r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(?:updated?|update|as\s+of|revised?)\b') AS has_update, regexp_matches(text, '(?i)\b(?:dead|deaths?|died|killed|injured|wounded|fatalities|casualties|death\s+toll|missing)\b') AS casualty,
  regexp_matches(text, '(?i)(?:\d+(?:\.\d+)?\s*%)|(?:\bpercent(?:age)?\b)') AS has_percent,
  regexp_matches(text, '(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b') AS month,
  regexp_matches(text, '(?i)\b(?:game|games|match|matches|season|inning|innings|quarter|halftime|touchdown|goal|goals|runs?|points?|score|scored|defeated|beat|won|lost|league|tournament|playoffs?|series)\b') AS sports,
  regexp_matches(text, '(?i)(?:[$£€]\s*\d)|(?:\b\d+(?:\.\d+)?\s*(?:dollars?|euros?|pounds?|million|billion|trillion)\b)') AS money FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.has("text", X.UPDATE).alias("has_update"), X.has("text", X.CASUALTY).alias("casualty"), X.has("text", X.PERCENT).alias("has_percent"), X.has("text", X.MONTH).alias("month"), X.has("text", X.SPORTS).alias("sports"), X.has("text", X.MONEY).alias("money"))


@query("boilerplate_flags", """
SELECT doc_id, contains(t, 'contributed reporting') OR contains(t, 'this article has been revised') OR contains(t, 'correction:') OR contains(t, 'sign up for')
  OR contains(t, 'newsletter') OR contains(t, '[the new york times]') OR contains(t, '_____') AS boilerplate FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents)""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.boilerplate("text").alias("boilerplate"))


@query("normalisation_mismatch_category", f"""
WITH t AS (SELECT doc_id, text AS a, CASE doc_id % 5 WHEN 0 THEN text || '  ' WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, ',', '”') WHEN 3 THEN text || '“' ELSE text || ' x' END AS b FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM t)
SELECT category, count(*) AS n FROM (SELECT CASE WHEN a = b THEN 'whitespace_only' WHEN lower(a) = lower(b) THEN 'case_only'
  WHEN translate(a, '“”‘’', '""''''') = translate(b, '“”‘’', '""''''') THEN 'quote_style_only'
  WHEN lower(translate(a, '“”‘’', '""''''')) = lower(translate(b, '“”‘’', '""''''')) THEN 'case_and_quote_style' ELSE 'not_explained_by_existing_normalization' END AS category FROM n) GROUP BY category""")
def _(spark, sf_dir):
    r = F.col("doc_id") % 5
    b = F.when(r == 0, F.concat("text", F.lit("  "))).when(r == 1, F.lower("text")).when(r == 2, F.replace("text", F.lit(","), F.lit("”"))).when(r == 3, F.concat("text", F.lit("“"))).otherwise(F.concat("text", F.lit(" x")))
    return table(spark, sf_dir, "documents").select("text", b.alias("b")).groupBy(X.mismatch_category("text", "b").alias("category")).agg(F.count("*").alias("n"))


@query("text_measures", r"""
SELECT doc_id, length(coalesce(text, '')) AS chars, len(regexp_extract_all(text, '[\pL\pN_]+'))::INT AS words,
  len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: regexp_matches(x, '\d')))::INT AS with_digit FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.jsonish_length("text").cast("long").alias("chars"), X.word_count("text").alias("words"), X.numeric_token_count("text").alias("with_digit"))


@query("stable_hash_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('17' || chr(31) || doc_id))::INT AS nth, substr(sha256('17' || chr(31) || doc_id), 1, 16) AS head FROM documents")
def _(spark, sf_dir):
    return S.hash_ranked(table(spark, sf_dir, "documents").select("doc_id"), X.stable_hash(17, F.col("doc_id"))).select("doc_id", "nth", F.substring("place", 1, 16).alias("head"))


# --- alignment --------------------------------------------------------------------------------------------------


@query("episodes_from_revisions", EPISODES_SQL + "SELECT episode_id, lineage_id, selected_sentence_index, md5(candidate_a) AS a, md5(candidate_b) AS b, selected_index, future_revised, md5(context_before) AS before, md5(context_after) AS after, round(sentence_position, 9) AS sentence_position, round(edit_similarity, 9) AS edit_similarity, round(lexical_jaccard, 9) AS lexical_jaccard FROM episodes")
def _(spark, sf_dir):
    e = episodes(spark, sf_dir)
    return e.select("episode_id", "lineage_id", "selected_sentence_index", F.md5("candidate_a").alias("a"), F.md5("candidate_b").alias("b"), "selected_index", "future_revised", F.md5("context_before").alias("before"), F.md5("context_after").alias("after"),
                    *[F.round(c, 9).alias(c) for c in ("sentence_position", "edit_similarity", "lexical_jaccard")])


@query("extraction_funnel", EPISODES_SQL + """
, runs AS (SELECT sum((c1 AND NOT p1)::INT) AS opcodes, sum((c1 AND NOT p1 AND n1)::INT) AS ambiguous FROM cells)
, single AS (SELECT *, length(old) BETWEEN 20 AND 500 AND len(%s) >= 3 AS ok_old, length(mid) BETWEEN 20 AND 500 AND len(%s) >= 3 AS ok_mid FROM cells WHERE c1 AND NOT p1 AND NOT n1)
SELECT outcome, n FROM (SELECT 'ambiguous_replacement' AS outcome, ambiguous::BIGINT AS n FROM runs
 UNION ALL SELECT CASE WHEN NOT ok_old THEN 'invalid_rejected_sentence' WHEN NOT ok_mid THEN 'invalid_selected_sentence' WHEN sim1 < 0.15 THEN 'similarity_below_min' WHEN sim1 > 0.98 THEN 'similarity_above_max' ELSE 'accepted' END, count(*) FROM single GROUP BY 1) WHERE n > 0
""" % (TOKENS_SQL.format("old"), TOKENS_SQL.format("mid")))
def _(spark, sf_dir):
    return U.funnel(replaced(spark, sf_dir))


@query("candidate_orientation", EPISODES_SQL + "SELECT selected_index, count(*) AS n, count(*) FILTER (selected = CASE WHEN selected_index = 0 THEN candidate_a ELSE candidate_b END) AS selected_matches FROM episodes GROUP BY selected_index")
def _(spark, sf_dir):
    return episodes(spark, sf_dir).groupBy("selected_index").agg(F.count("*").alias("n"), F.count_if(F.col("selected") == A.selected_text()).alias("selected_matches"))


@query("future_label", EPISODES_SQL + "SELECT lineage_id, count(*) AS episodes, sum(future_revised::INT)::BIGINT AS revised FROM episodes GROUP BY lineage_id")
def _(spark, sf_dir):
    return episodes(spark, sf_dir).groupBy("lineage_id").agg(F.count("*").alias("episodes"), F.count_if("future_revised").alias("revised"))


#: With `temporal` at the end: replaced pairs of lineages without episodes, scored in folded form without punctuation.
TEMPORAL_SQL = EPISODES_SQL + f"""
, t1 AS (SELECT lineage_id, lineage_id || '::1->2::' || i || '::temporal' AS id, old AS earlier, mid AS later, context_before AS cb, context_after AS ca FROM cells WHERE c1 AND NOT p1 AND NOT n1
  UNION ALL SELECT lineage_id, lineage_id || '::2->3::' || i || '::temporal', mid, fut, fut_before, fut_after FROM cells WHERE c2 AND NOT p2 AND NOT n2),
t2 AS (SELECT *, {TEMPORAL_FORM.format("earlier")} AS ef, {TEMPORAL_FORM.format("later")} AS lf FROM t1 WHERE lineage_id NOT IN (SELECT lineage_id FROM episodes) AND length(earlier) BETWEEN 20 AND 500 AND length(later) BETWEEN 20 AND 500
  AND regexp_matches(earlier, '\\pL') AND regexp_matches(later, '\\pL')),
t3 AS (SELECT *, 2.0::DOUBLE * length(ef) / (length(ef) + length(lf)) AS sim FROM t2),
temporal AS (SELECT id AS temporal_pair_id, lineage_id, earlier AS earlier_text, later AS later_text, sim, cb, ca FROM (SELECT *, row_number() OVER (PARTITION BY ef, lf ORDER BY sha256('17' || chr(31) || id)) AS nth FROM t3 WHERE sim BETWEEN 0.05 AND 0.995) WHERE nth = 1)
"""


@query("temporal_pairs_external", TEMPORAL_SQL + "SELECT temporal_pair_id, lineage_id, md5(earlier_text) AS a, md5(later_text) AS b, round(sim, 9) AS sim, md5(cb) AS before, md5(ca) AS after FROM temporal")
def _(spark, sf_dir):
    v = versions(spark, sf_dir)
    pairs = A.temporal_pairs(v, A.version_order(None, "version_id"), episodes(spark, sf_dir), n_parts=0)
    return pairs.select("temporal_pair_id", "lineage_id", F.md5("earlier_text").alias("a"), F.md5("later_text").alias("b"), F.round("edit_similarity", 9).alias("sim"), F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query("similarity_ratio_adjacent", CELLS_SQL + "SELECT lineage_id, '1' AS version_id, i::INT AS i, round(sim1, 9) AS ratio FROM cells WHERE c1 UNION ALL SELECT lineage_id, '2', i::INT, round(sim2, 9) FROM cells WHERE c2")
def _(spark, sf_dir):
    """Character similarity of each line and its revision; every line of the fixture, by difflib."""
    rows = A.windows(versions(spark, sf_dir), [F.col("version_id")], 2, 0)
    rows = rows.select("lineage_id", "version_id", F.posexplode(F.arrays_zip("sentences_0", "sentences_1")).alias("i", "s"))
    rows = rows.where("s.sentences_0 <> s.sentences_1").select("lineage_id", "version_id", "i", F.col("s.sentences_0").alias("a"), F.col("s.sentences_1").alias("b"))
    return rows.select("lineage_id", "version_id", "i", F.round(A.similarity_ratio(X.normalise_sentence("a"), X.normalise_sentence("b")), 9).alias("ratio"))


@query("sentence_fates", CELLS_SQL + "SELECT lineage_id, (2 * count(*))::BIGINT AS aligned, 0::BIGINT AS gone, (count(*) FILTER (c1) + count(*) FILTER (c2))::BIGINT AS gone_or_replaced FROM cells GROUP BY lineage_id")
def _(spark, sf_dir):
    """Sentences of the middle version by fate in the next, by both rules."""
    rows = A.windows(versions(spark, sf_dir), [F.col("version_id")], 2, 0)
    rows = A.with_opcodes(rows, {"ops": ("sentences_0", "sentences_1")})
    rows = rows.select("lineage_id", A.futures("ops", "sentences_1").alias("f"), A.futures("ops", "sentences_1", strict=False).alias("g"))
    gone = lambda c: F.size(F.filter(c, lambda e: e["value"].isNull()))
    return rows.groupBy("lineage_id").agg(F.sum(F.size("f")).alias("aligned"), F.sum(gone("f")).alias("gone"), F.sum(gone("g")).alias("gone_or_replaced"))


# --- audits -----------------------------------------------------------------------------------------------------

_WILSON = "(r + 1.9208 / n {s} 1.96 * sqrt(r * (1 - r) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"
_BALANCE = "SELECT {by} n AS episodes, l AS lineages, rev AS revised, b AS selected_b, r AS revised_rate, b / n::DOUBLE AS selected_b_rate, " + _WILSON.format(s="-") + " AS lower, " + _WILSON.format(s="+") + " AS upper FROM (SELECT {by} count(*) AS n, count(DISTINCT lineage_id) AS l, count(*) FILTER (future_revised) AS rev, count(*) FILTER (selected_index = 1) AS b, count(*) FILTER (future_revised) / count(*)::DOUBLE AS r FROM episodes {group})"


@query("context_target_balance", EPISODES_SQL + _BALANCE.format(by="", group=""))
def _(spark, sf_dir):
    return U.target_balance(episodes(spark, sf_dir))


@query("wilson_by_source", EPISODES_SQL + "SELECT * REPLACE (round(lower, 9) AS lower, round(upper, 9) AS upper) FROM (" + _BALANCE.format(by="source,", group="GROUP BY source") + ")")
def _(spark, sf_dir):
    return U.target_balance(episodes(spark, sf_dir), ["source"]).withColumn("lower", F.round("lower", 9)).withColumn("upper", F.round("upper", 9))


_ODD = r"""(?i)^[“"(\[]?(?:Mr|Mrs|Ms|Dr|Gen|Gov|Col|Lt|Capt|Adm|Sgt|Cpl|Sen|Rep|Prof|St)\.$"""
_LAST = r"""(?i)(^|\s)[“"(\[]?(?:Mr|Mrs|Ms|Dr|Gen|Gov|Col|Lt|Capt|Adm|Sgt|Cpl|Sen|Rep|Prof|St)\.\s*$"""
_TERMS = "['contributed reporting', 'this article has been revised', 'correction:', 'sign up for', 'newsletter', '[the new york times]', '_____']"
_REPORT = EPISODES_SQL + f"""
, k AS (SELECT *, trim(context_before) IN ('.', ';', '&amp;') OR trim(context_after) IN ('.', ';', '&amp;') OR regexp_matches(trim(context_before), '{_ODD}') OR regexp_matches(trim(context_after), '{_ODD}') OR regexp_matches(candidate_a, '{_LAST}') OR regexp_matches(candidate_b, '{_LAST}') AS odd,
  len(list_filter({_TERMS}, lambda x: contains(replace(lower(candidate_a || ' ' || candidate_b || ' ' || context_before || ' ' || context_after), 'ß', 'ss'), x))) > 0 AS credit FROM episodes)
, c AS (SELECT count(*) AS episodes, count(DISTINCT lineage_id) AS lineages, count(*) FILTER (future_revised) AS revised, count(*) FILTER (selected_index = 1) AS selected_b, count(*) FILTER (trim(context_before) = '') AS context_before_empty, count(*) FILTER (trim(context_after) = '') AS context_after_empty,
  count(*) FILTER (trim(context_before) <> '' AND trim(context_after) <> '') AS both_context_sides_present, count(*) FILTER (odd) AS source_boundary_artifacts, count(*) FILTER (credit) AS boilerplate_or_credit_records FROM k)
, v AS (SELECT *, episodes AS n, revised / episodes::DOUBLE AS revised_rate, selected_b / episodes::DOUBLE AS selected_b_rate, both_context_sides_present / episodes::DOUBLE AS both_context_sides_present_rate, source_boundary_artifacts / episodes::DOUBLE AS source_boundary_artifact_rate, boilerplate_or_credit_records / episodes::DOUBLE AS boilerplate_or_credit_rate FROM c)
, report AS (SELECT * EXCLUDE (n), round({_WILSON.format(s="-").replace("r +", "revised_rate +").replace("r * (1 - r)", "revised_rate * (1 - revised_rate)")}, 9) AS lower, round({_WILSON.format(s="+").replace("r +", "revised_rate +").replace("r * (1 - r)", "revised_rate * (1 - revised_rate)")}, 9) AS upper,
  round({_WILSON.format(s="-").replace("r +", "selected_b_rate +").replace("r * (1 - r)", "selected_b_rate * (1 - selected_b_rate)")}, 9) AS selected_b_lower, round({_WILSON.format(s="+").replace("r +", "selected_b_rate +").replace("r * (1 - r)", "selected_b_rate * (1 - selected_b_rate)")}, 9) AS selected_b_upper FROM v)
"""


@query("context_viability_report", _REPORT + "SELECT * FROM report")
def _(spark, sf_dir):
    return U.context_report(episodes(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("lower", "upper", "selected_b_lower", "selected_b_upper")})


@query("viability_gates", _REPORT + "SELECT episodes >= 10000 AS at_least_10000_episodes, lineages >= 3000 AS at_least_3000_lineages, revised_rate BETWEEN 0.15 AND 0.4 AS usable_target_balance, selected_b_rate BETWEEN 0.45 AND 0.55 AS candidate_orientation_balanced, source_boundary_artifact_rate <= 0.03 AS source_boundary_artifacts_below_3_percent FROM report")
def _(spark, sf_dir):
    return U.viability_gates(U.context_report(episodes(spark, sf_dir)))


@query("extraction_audit", EPISODES_SQL + """
, blocks AS (SELECT count(*) FILTER (c1 AND NOT p1) AS opcodes, count(*) FILTER (c1 AND NOT p1 AND n1) AS ambiguous, count(DISTINCT doc_id) AS articles FROM cells)
, single AS (SELECT *, length(old) BETWEEN 20 AND 500 AND len(%s) >= 3 AS ok_old, length(mid) BETWEEN 20 AND 500 AND len(%s) >= 3 AS ok_mid FROM cells WHERE c1 AND NOT p1 AND NOT n1)
, s AS (SELECT count(*) FILTER (NOT ok_old) AS r, count(*) FILTER (ok_old AND NOT ok_mid) AS m, count(*) FILTER (ok_old AND ok_mid AND sim1 < 0.15) AS lo, count(*) FILTER (ok_old AND ok_mid AND sim1 > 0.98) AS hi FROM single)
, e AS (SELECT count(*) AS n, count(DISTINCT lineage_id) AS l, count(*) FILTER (future_revised) AS f FROM episodes)
SELECT articles AS articles_seen, l AS articles_with_examples, articles AS version_windows_seen, opcodes AS replacement_opcodes_seen, n AS accepted_examples, n / opcodes::DOUBLE AS acceptance_rate, f AS future_revised_examples, n - f AS future_stable_examples, f / n::DOUBLE AS future_revised_rate,
 0::BIGINT AS too_few_versions, 0::BIGINT AS empty_version, ambiguous AS ambiguous_replacement, r AS invalid_rejected_sentence, m AS invalid_selected_sentence, 0::BIGINT AS future_unresolved, lo AS similarity_below_min, hi AS similarity_above_max FROM blocks, s, e""" % (TOKENS_SQL.format("old"), TOKENS_SQL.format("mid")))
def _(spark, sf_dir):
    n_parts = version_parts(spark, sf_dir)
    found = replaced(spark, sf_dir, n_parts)
    return U.extraction_audit(versions(spark, sf_dir, n_parts), A.version_order(None, "version_id"), found, A.episodes(found, n_parts=n_parts), 0)


@query("lineage_concentration", EPISODES_SQL + """
, c AS (SELECT lineage_id, count(*) AS n FROM episodes GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, count(*) OVER () AS m, sum(n) OVER () AS t FROM c)
SELECT avg(n) AS mean_episodes, max(n) AS max_episodes, count(*) FILTER (n = 1) AS single_episode_lineages, median(n) AS median_episodes,
 sum(n) FILTER (k <= greatest(1, ceil(m * 0.01::DOUBLE))) / max(t) AS top_1_percent_rate, sum(n) FILTER (k <= greatest(1, ceil(m * 0.05::DOUBLE))) / max(t) AS top_5_percent_rate,
 sum(n) FILTER (k <= greatest(1, ceil(m * 0.1::DOUBLE))) / max(t) AS top_10_percent_rate, sum(n) FILTER (k <= greatest(1, ceil(m * 0.2::DOUBLE))) / max(t) AS top_20_percent_rate FROM r""")
def _(spark, sf_dir):
    return U.lineage_concentration(episodes(spark, sf_dir))


_Q = ", ".join(f"quantile_cont({{c}}, {p}) AS p{int(p * 100):02d}" for p in U.QUANTILES)


@query("feature_quantiles", EPISODES_SQL + "SELECT avg(edit_similarity) AS mean, median(edit_similarity) AS median, min(edit_similarity) AS least, max(edit_similarity) AS most, " + _Q.format(c="edit_similarity") + " FROM episodes")
def _(spark, sf_dir):
    return U.distribution(episodes(spark, sf_dir), "edit_similarity")


@query("lineitem_price_quantiles", "SELECT l_returnflag, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, min(l_extendedprice) AS least, max(l_extendedprice) AS most, " + _Q.format(c="l_extendedprice") + " FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    return U.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("similarity_bands", EPISODES_SQL + """
SELECT b.lower, b.upper, count(e.episode_id) AS episodes, count(*) FILTER (e.future_revised) AS revised, count(*) FILTER (e.future_revised) / nullif(count(e.episode_id), 0)::DOUBLE AS revised_rate
FROM (VALUES (0.15::DOUBLE, 0.5::DOUBLE), (0.5, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 0.98), (0.98, 1.0)) b(lower, upper) LEFT JOIN episodes e ON e.edit_similarity >= b.lower AND e.edit_similarity < b.upper GROUP BY 1, 2""")
def _(spark, sf_dir):
    return U.bands(episodes(spark, sf_dir), "edit_similarity", [0.15, 0.5, 0.8, 0.9, 0.95, 0.98, 1.0])


@query("version_bands", """
WITH t AS (SELECT turn AS v, role = 'user' AS future_revised FROM conversations)
SELECT CASE WHEN v <= 5 THEN v::VARCHAR WHEN v <= 10 THEN '6-10' ELSE '11+' END AS version_band, count(*) AS episodes, count(*) FILTER (future_revised) AS revised, avg(future_revised::INT) AS revised_rate FROM t WHERE v > 0 GROUP BY 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("v"), F.col("turn").cast("string")).alias("v"), (F.col("role") == "user").alias("future_revised"))
    return U.version_bands(rows, "v")


@query("pair_reversals", EPISODES_SQL + r"""
, g AS (SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS n, count(DISTINCT s) AS w, count(DISTINCT lineage_id) AS l FROM
 (SELECT trim(regexp_replace(replace(lower(candidate_a), 'ß', 'ss'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(lower(candidate_b), 'ß', 'ss'), '\s+', ' ', 'g')) AS b, replace(lower(selected), 'ß', 'ss') AS s, lineage_id FROM episodes) GROUP BY 1, 2)
SELECT count(*) AS unique_pairs, count(*) FILTER (n > 1) AS repeated_pair_groups, count(*) FILTER (n > 1 AND w > 1) AS reversal_pair_groups, count(*) FILTER (n > 1 AND w > 1 AND l = 1) AS same_lineage_reversal_groups,
 count(*) FILTER (n > 1 AND w > 1 AND l > 1) AS cross_lineage_reversal_groups, coalesce(sum(n) FILTER (n > 1 AND w > 1), 0)::BIGINT AS episodes_in_reversal_groups, coalesce(sum(n) FILTER (n > 1 AND w > 1), 0) / sum(n)::DOUBLE AS reversal_episode_rate FROM g""")
def _(spark, sf_dir):
    return U.pair_reuse(episodes(spark, sf_dir))


_FLAGS = r"""
, f AS (SELECT lineage_id, future_revised, length(selected) > 200 AS long_edit, selected_index = 1 AS slot_b FROM episodes)
, u AS (SELECT 'long_edit' AS category, lineage_id, future_revised, long_edit AS flag FROM f UNION ALL SELECT 'slot_b', lineage_id, future_revised, slot_b FROM f)
, c AS (SELECT category, count(*) FILTER (flag) AS n, count(*) FILTER (flag AND future_revised) AS rev, count(DISTINCT CASE WHEN flag THEN lineage_id END) AS l, count(*) AS an, count(*) FILTER (future_revised) AS ar FROM u GROUP BY category)
, d AS (SELECT *, rev / nullif(n, 0)::DOUBLE AS r FROM c)
"""


@query("risk_ratio_by_flag", EPISODES_SQL + _FLAGS + "SELECT category, n AS episodes, rev AS revised, l AS lineages, r AS revised_rate, (ar - rev) / nullif(an - n, 0)::DOUBLE AS complement_rate, CASE WHEN n > 0 AND an > n AND ar > rev THEN r / ((ar - rev) / (an - n)::DOUBLE) END AS risk_ratio, " + _WILSON.format(s="-") + " AS lower, " + _WILSON.format(s="+") + " AS upper FROM d")
def _(spark, sf_dir):
    flags = episodes(spark, sf_dir).select("lineage_id", "future_revised", (F.length("selected") > 200).alias("long_edit"), (F.col("selected_index") == 1).alias("slot_b"))
    return U.category_summary(flags, ("long_edit", "slot_b"))


_SUMMARY_SQL = FLAGS_SQL + """
, long AS (UNPIVOT (SELECT lineage_id, future_revised, %s FROM flags) ON %s INTO NAME category VALUE flag)
, c AS (SELECT category, count(*) FILTER (flag) AS n, count(*) FILTER (flag AND future_revised) AS rev, count(DISTINCT CASE WHEN flag THEN lineage_id END) AS l, count(*) AS an, count(*) FILTER (future_revised) AS ar FROM long GROUP BY category)
, d AS (SELECT *, rev / nullif(n, 0)::DOUBLE AS r FROM c)
""" % (", ".join(U.CATEGORIES), ", ".join(U.CATEGORIES))


@query("numeric_category_summary", _SUMMARY_SQL + "SELECT category, n AS episodes, rev AS revised, l AS lineages, r AS revised_rate, (ar - rev) / nullif(an - n, 0)::DOUBLE AS complement_rate, CASE WHEN n > 0 AND an > n AND ar > rev THEN r / ((ar - rev) / (an - n)::DOUBLE) END AS risk_ratio, " + _WILSON.format(s="-") + " AS lower, " + _WILSON.format(s="+") + " AS upper FROM d")
def _(spark, sf_dir):
    return U.category_summary(U.numeric_flags(episodes(spark, sf_dir)))


@query("repeated_trajectories", FLAGS_SQL + "SELECT episode_id, repeated FROM flags")
def _(spark, sf_dir):
    return U.numeric_flags(episodes(spark, sf_dir)).select("episode_id", F.col("repeated_numeric_trajectory").alias("repeated"))


@query("numeric_trajectories", FLAGS_SQL + ", t AS (SELECT unnest(['numeric', 'casualty']) AS trajectory, lineage_id, future_revised FROM flags WHERE repeated) SELECT trajectory, count(*) AS episodes, count(DISTINCT lineage_id) AS lineages, count(*) FILTER (future_revised) AS revised, count(*) FILTER (future_revised) / count(*)::DOUBLE AS revised_rate FROM t GROUP BY trajectory")
def _(spark, sf_dir):
    return U.trajectories(U.numeric_flags(episodes(spark, sf_dir)))


@query("episode_value_counts", EPISODES_SQL + "SELECT source AS value, count(*) AS n FROM episodes GROUP BY source ORDER BY n DESC, source LIMIT 20")
def _(spark, sf_dir):
    return U.value_counts(episodes(spark, sf_dir), "source")


@query("episode_description", EPISODES_SQL + """, l AS (UNPIVOT (SELECT edit_similarity, sentence_position, selected_sentence_index::DOUBLE AS selected_sentence_index FROM episodes) ON edit_similarity, sentence_position, selected_sentence_index INTO NAME field VALUE x)
SELECT field, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS sd, min(x) AS least, max(x) AS most FROM l GROUP BY field""")
def _(spark, sf_dir):
    return U.described(episodes(spark, sf_dir), ["edit_similarity", "sentence_position", "selected_sentence_index"]).withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


_CASED = "CASE WHEN doc_id % 7 = 0 THEN lower(text) WHEN doc_id % 7 = 1 THEN text || '  ' WHEN doc_id % 7 = 2 THEN text || ' x' WHEN doc_id % 7 = 3 THEN NULL ELSE text END"


def recased(spark, sf_dir):
    """Texts with a later form that differs in case, space or words, or is gone."""
    r = F.col("doc_id") % 7
    later = F.when(r == 0, F.lower("text")).when(r == 1, F.concat("text", F.lit("  "))).when(r == 2, F.concat("text", F.lit(" x"))).when(r == 3, F.lit(None)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), F.col("text").alias("selected"), later.alias("v2_sentence"))


_INTEGRITY = f"""
WITH p AS (SELECT doc_id::VARCHAR AS episode_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, trim(regexp_replace({_CASED}, '\\s+', ' ', 'g')) AS b FROM documents)
, r AS (SELECT *, b IS NULL AS gone, b IS NULL OR a <> b AS revised, coalesce(translate(lower(a), '“”‘’', chr(34) || chr(34) || chr(39) || chr(39)) = translate(lower(b), '“”‘’', chr(34) || chr(34) || chr(39) || chr(39)), false) AS aligned FROM p)
"""


@query("integrity_rates", _INTEGRITY + """, c AS (SELECT count(*) AS episodes, count(*) FILTER (revised) AS revised, count(*) FILTER (gone) AS gone, count(*) FILTER (revised AND aligned) AS mismatches, count(*) FILTER (NOT revised AND NOT aligned) AS stable_unaligned FROM r)
SELECT *, revised / episodes::DOUBLE AS revised_rate, mismatches / episodes::DOUBLE AS mismatch_rate, mismatches / revised::DOUBLE AS mismatch_rate_of_revised, gone / episodes::DOUBLE AS gone_rate, (revised - mismatches) / episodes::DOUBLE AS revised_rate_without_mismatches FROM c""")
def _(spark, sf_dir):
    return U.integrity_rates(recased(spark, sf_dir))


@query("mismatch_sample", _INTEGRITY + "SELECT episode_id, CASE WHEN lower(a) = lower(b) THEN 'case_only' ELSE 'other' END AS category FROM r WHERE revised AND aligned ORDER BY episode_id LIMIT 50")
def _(spark, sf_dir):
    return U.mismatch_sample(recased(spark, sf_dir)).select("episode_id", "category")


@query("label_integrity_counts", EPISODES_SQL + "SELECT CASE WHEN future_revised THEN 'revised' ELSE 'stable' END AS category, count(*) AS n FROM episodes GROUP BY 1")
def _(spark, sf_dir):
    return U.label_integrity(episodes(spark, sf_dir))


@query("context_artifact_flags", EPISODES_SQL + r"""SELECT episode_id, trim(context_before) IN ('.', ';', '&amp;') OR trim(context_after) IN ('.', ';', '&amp;') OR regexp_matches(trim(context_before), '(?i)^(Mr|Mrs|Ms|Dr|St)\.$') OR regexp_matches(trim(context_after), '(?i)^(Mr|Mrs|Ms|Dr|St)\.$') OR regexp_matches(selected, '(?i)(^|\s)["“(\[]?(?:Mr|Mrs|Ms|Dr|Gen|Gov|Col|Lt|Capt|Adm|Sgt|Cpl|Sen|Rep|Prof|St)\.$') OR regexp_matches(rejected, '(?i)(^|\s)["“(\[]?(?:Mr|Mrs|Ms|Dr|Gen|Gov|Col|Lt|Capt|Adm|Sgt|Cpl|Sen|Rep|Prof|St)\.$') AS boundary_artifact, contains(lower(selected || ' ' || rejected || ' ' || context_before || ' ' || context_after), '_____') OR contains(lower(selected || ' ' || rejected || ' ' || context_before || ' ' || context_after), 'newsletter') AS boilerplate FROM episodes""")
def _(spark, sf_dir):
    return U.context_flags(episodes(spark, sf_dir))
