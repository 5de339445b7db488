"""Revision histories made from documents by a rule, so that SQL can say what alignment must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changed(tag: str, key: Column, i: Column, values: tuple[str, ...] = ("0", "1")) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{tag}\x1f"), key.cast("string"), F.lit("\x1f"), i.cast("string")), 256), 64, 1).isin(*values)


def sentence_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Documents with a line that is not empty; sentences are these lines, each after its number, so that all differ."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.normalise_space), lambda s: s != "")
    numbered = F.transform(lines, lambda s, i: F.concat(F.lpad(i.cast("string"), 5, "0"), F.lit(" "), s))
    return docs.select("doc_id", "source", *more, numbered.alias("sentences")).where(F.size("sentences") > 0)


def revisions(docs: DataFrame, n_parts: int = 0) -> DataFrame:
    """Three versions of each document: as it is, with ' amended' or ' 12 dead' at some lines, then ' updated' at some. With n_parts
    documents are dealt by lineage, a third of the bytes of their versions, which then lie together."""
    docs = docs.select("doc_id", "source", "text", F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias("lineage_id"))
    rows = sentence_rows(docs.repartition(n_parts, "lineage_id") if n_parts else docs, "lineage_id")
    key = F.col("doc_id")
    amended = lambda i: F.when(changed("number", key, i, tuple("01234567")), F.lit(" 12 dead")).otherwise(F.lit(" amended"))

    def mark(sentences: str, tag: str, ending) -> Column:
        return F.transform(sentences, lambda s, i: F.when(changed(tag, key, i), F.concat(s, ending(i))).otherwise(s))

    rows = rows.withColumn("second", mark("sentences", "amended", amended)).withColumn("third", mark("second", "updated", lambda i: F.lit(" updated")))
    version = lambda n, c: F.struct(F.lit(n).alias("version_id"), F.col(c).alias("sentences"))
    rows = rows.select("doc_id", "source", "lineage_id", F.explode(F.array(version("1", "sentences"), version("2", "second"), version("3", "third"))).alias("v"))
    return rows.select("lineage_id", "source", F.col("doc_id").cast("string").alias("article_id"), "v.version_id", "v.sentences")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_NORMAL = "translate(lower({}), '“”‘’', '\"\"''''')"
TOKENS_SQL = "regexp_extract_all(lower({}), '[\\pL\\pN_](?:[\\pL\\pN_''-]*[\\pL\\pN_])?')"
_VALID = "(length({0}) BETWEEN 20 AND 500 AND len(" + TOKENS_SQL.format("{0}") + ") >= 3)"
_CHANGED = "right(sha256('{}' || chr(31) || doc_id || chr(31) || i), 1) IN ('0', '1')"

TEMPORAL_FORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\pL\\pN\\pM_]+', ' ', 'g'))"
_AUDIT_FORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_MASKED = "regexp_replace({}, '(?i)(^|[^\\pL\\pN_.])(?:[$£€]\\s*)?[+-]?(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?(?:%|(?:st|nd|rd|th)\\b)?', '\\1<NUM>', 'g')"

#: Common table expressions that end in `cells`, a row for each line of each document.
CELLS_SQL = f"""
WITH usable AS (SELECT doc_id, source, list_transform(lines, lambda x, i: lpad((i - 1)::VARCHAR, 5, '0') || ' ' || x) AS lines
                FROM (SELECT doc_id, source, {_LINES} AS lines FROM documents) WHERE len(lines) > 0),
flat AS (SELECT doc_id, source, len(lines) AS n, lines, unnest(range(len(lines))) AS i FROM usable),
marks AS (SELECT doc_id, source, n, i, lines[i + 1] AS old, {_CHANGED.format("amended")} AS c1, {_CHANGED.format("updated")} AS c2,
   instr('01234567', right(sha256('number' || chr(31) || doc_id || chr(31) || i), 1)) > 0 AS numeric FROM flat),
lined AS (SELECT *, old || CASE WHEN NOT c1 THEN '' WHEN numeric THEN ' 12 dead' ELSE ' amended' END AS mid FROM marks),
done AS (SELECT *, mid || CASE WHEN c2 THEN ' updated' ELSE '' END AS fut FROM lined),
cells AS (SELECT *, source || '::' || doc_id AS lineage_id,
   coalesce(lag(c1) OVER w, false) AS p1, coalesce(lead(c1) OVER w, false) AS n1,
   coalesce(lag(c2) OVER w, false) AS p2, coalesce(lead(c2) OVER w, false) AS n2,
   coalesce(lag(mid) OVER w, '') AS context_before, coalesce(lead(mid) OVER w, '') AS context_after,
   coalesce(lag(fut) OVER w, '') AS fut_before, coalesce(lead(fut) OVER w, '') AS fut_after,
   2.0::DOUBLE * length({_NORMAL.format("old")}) / (2 * length({_NORMAL.format("old")}) + 8) AS sim1,
   2.0::DOUBLE * length({_NORMAL.format("mid")}) / (2 * length({_NORMAL.format("mid")}) + 8) AS sim2
   FROM done WINDOW w AS (PARTITION BY doc_id ORDER BY i))
"""

#: The same with `episodes` at the end.
EPISODES_SQL = CELLS_SQL + f""",
picked AS (SELECT *, lineage_id || '::1->2::' || i AS episode_id FROM cells
   WHERE c1 AND NOT p1 AND NOT n1 AND {_VALID.format("old")} AND {_VALID.format("mid")} AND sim1 BETWEEN 0.15 AND 0.98),
turned AS (SELECT *, instr('13579bdf', substr(sha256('17' || chr(0) || episode_id), 2, 1)) > 0 AS in_a FROM picked),
episodes AS (SELECT source, doc_id::VARCHAR AS article_id, lineage_id, episode_id, i::INT AS selected_sentence_index, c2 AS future_revised,
   CASE WHEN in_a THEN 0 ELSE 1 END AS selected_index, CASE WHEN in_a THEN mid ELSE old END AS candidate_a,
   CASE WHEN in_a THEN old ELSE mid END AS candidate_b, context_before, context_after, i / greatest(1, n - 1)::DOUBLE AS sentence_position,
   sim1 AS edit_similarity, mid AS selected, old AS rejected, fut AS v2_sentence,
   len(list_distinct({TOKENS_SQL.format("old")})) / len(list_distinct({TOKENS_SQL.format("mid")}))::DOUBLE AS lexical_jaccard, numeric AS number_changed, old, mid FROM turned)
"""

_HAS = {
    "date": r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|updated?|as\s+of|revised?)\b",
    "money": r"(?i)(?:[$£€]\s*\d)|(?:\b\d+(?:\.\d+)?\s*(?:dollars?|euros?|pounds?|million|billion|trillion)\b)|(?:\d+(?:\.\d+)?\s*%)|(?:\bpercent(?:age)?\b)",
    "sports": r"(?i)\b(?:game|games|match|matches|season|inning|innings|quarter|halftime|touchdown|goal|goals|runs?|points?|score|scored|defeated|beat|won|lost|league|tournament|playoffs?|series)\b",
}
_BOTH = "(candidate_a || ' ' || candidate_b)"

#: The same with `flags` at the end: numeric categories of episodes. A numeric edit adds ' 12 dead', so it is never only a
#: number, always a casualty count, and its masked forms differ by ' <num> dead'.
FLAGS_SQL = EPISODES_SQL + f""",
flags AS (SELECT episode_id, lineage_id, future_revised, true AS contains_number, number_changed, false AS number_only_edit,
   number_changed AND 2.0::DOUBLE * m / (2 * m + 11) >= 0.95 AS number_dominant_edit, number_changed AND regexp_matches({_BOTH}, '{_HAS["date"]}') AS date_or_update_edit,
   number_changed AND regexp_matches({_BOTH}, '{_HAS["money"]}') AS money_or_percentage_edit, number_changed AND regexp_matches({_BOTH}, '{_HAS["sports"]}') AS sports_numeric_edit,
   number_changed AS casualty_count_update, number_changed AND count(*) FILTER (number_changed) OVER (PARTITION BY lineage_id) >= 2 AS repeated
   FROM (SELECT *, length({_AUDIT_FORM.format(_MASKED.format("old"))}) AS m FROM episodes))
"""
