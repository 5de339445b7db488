"""Projections that keep outcomes out of inputs: sources, labels, prompts, feature sets, wide episodes and their shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.alignment import replacements, similarity_ratio
from palimpsest.operators.corpora import block_shift
from palimpsest.operators.selection import balanced_subset

# Fields of episodes, and what a task's inputs may hold.
EPISODE_FIELDS = ("episode_id", "lineage_id", "candidate_a", "candidate_b", "selected_index", "future_revised", "context_before", "context_after", "source", "article_id", "v0_version_id", "v1_version_id", "v2_version_id", "sentence_position", "edit_similarity", "lexical_jaccard")
SOURCE_FIELDS = ("episode_id", "lineage_id", "candidate_a", "candidate_b", "context_before", "context_after")
# Columns of the feature sets.
BASE_TEXT, REJECTED_TEXT = ("context_before", "retained_sentence", "context_after"), ("rejected_sentence",)
BASE_NUMERIC, BASE_CATEGORICAL = ("version_index", "sentence_position", "retained_chars", "retained_tokens"), ("source",)
GEOMETRY, LEXICAL = ("rejected_chars", "rejected_tokens", "char_delta", "token_delta"), ("edit_similarity", "lexical_jaccard")
INSTRUCTION = "One sentence was retained by an editor and the other was replaced. Using only the supplied local context, predict whether Candidate A or Candidate B was retained. Return only A or B."


def checked_episodes(rows: DataFrame, required: tuple[str, ...] = EPISODE_FIELDS) -> DataFrame:
    """[S15] rows, or an error: a required column is missing, there is no row, or (when it is read) a value is null or a choice is
    neither 0 nor 1."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"episodes lack {missing}")
    if rows.isEmpty():
        raise ValueError("there are no episodes")
    fine = F.lit(True)
    for c in required:
        fine = fine & F.col(c).isNotNull()
    if "selected_index" in required:
        fine = fine & F.coalesce(F.col("selected_index").isin(0, 1), F.lit(False))
    return rows.withColumn("episode_id", F.when(fine, F.col("episode_id")).otherwise(F.raise_error(F.concat(F.lit("episode with a missing field: "), F.coalesce("episode_id", F.lit("?"))))))


def source_store(episodes: DataFrame, allowed: tuple[str, ...] = SOURCE_FIELDS, key: str = "episode_id") -> DataFrame:
    """[S18, S19] Only the allowed columns, contexts never null; a key that is null or comes twice is an error when it is read."""
    rows = episodes.select(*[F.coalesce(c, F.lit("")).alias(c) if c.startswith("context_") else F.col(c) for c in allowed])
    n = rows.groupBy(key).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in allowed if c != key])
    wrong = F.raise_error(F.concat(F.lit(f"{key} is missing or comes twice: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return n.withColumn(key, F.when((F.col("_n") == 1) & F.col(key).isNotNull(), F.col(key)).otherwise(wrong)).select(*allowed)


def future_labels(episodes: DataFrame) -> DataFrame:
    """[S20] Ids with the outcome as 0 or 1, and nothing else."""
    return episodes.select("episode_id", F.col("future_revised").cast("int").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame, key: str = "episode_id") -> DataFrame:
    """[J08, S26] Representation rows with their labels, joined after extraction; a row without one is an error when it is read."""
    out = rows.join(labels, key, "left")
    return out.withColumn("label", F.when(F.col("label").isNotNull(), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no label for "), F.col(key)))))


def with_teacher(rows: DataFrame, teacher: DataFrame, key: str = "episode_id") -> DataFrame:
    """[S21, J12] rows with probability_a of teacher(key, probability_a), null where it has none; a probability outside of 0 to 1, or
    a key that comes twice, is an error when it is read."""
    one = teacher.groupBy(key).agg(F.count("*").alias("_n"), F.max("probability_a").alias("p"))
    fine = (F.col("_n") == 1) & F.col("p").between(0, 1)
    one = one.select(key, F.when(fine, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("invalid teacher probability of "), F.col(key)))).alias("probability_a"))
    return rows.join(one, key, "left")


def teacher_mix(label: Column | str, teacher: Column | str, share: float) -> Column:
    """[M38] Training target: the label, mixed with a teacher's probability by share where there is one."""
    return F.coalesce((1 - share) * X.col(label) + share * X.col(teacher), X.col(label).cast("double"))


def oracle_prompts(episodes: DataFrame, size: int = 300, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """[P19] Blinded prompts of a balanced sample, and their answer key, by item_id in order of episode_id."""
    rows = episodes.select(F.col("episode_id").alias("source_id"), F.col("selected_index").alias("target"), *SOURCE_FIELDS[2:])
    # a sample of bounded size, so one task may number it
    picked = balanced_subset(rows, size, seed).orderBy("source_id").limit(size)
    picked = picked.withColumn("item_id", F.row_number().over(Window.orderBy("source_id")) - 1)
    prompts = picked.select("item_id", F.col("source_id").alias("episode_id"), F.lit(INSTRUCTION).alias("instruction"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("context_before", "candidate_a", "candidate_b", "context_after")])
    return prompts, picked.select("item_id", F.col("source_id").alias("episode_id"), F.when(F.col("target") == 0, "A").otherwise("B").alias("selected"), F.col("target").alias("selected_index"))


@dataclass(frozen=True)
class FeatureSet:
    """[P20] Named columns of one ablation; the base columns are in all of them."""

    name: str
    text: tuple[str, ...] = BASE_TEXT
    numeric: tuple[str, ...] = BASE_NUMERIC
    categorical: tuple[str, ...] = BASE_CATEGORICAL
    shuffled: bool = False


def feature_sets(profile: str = "full") -> list[FeatureSet]:
    """[P20, M21] Seven sets, nine with the full profile."""
    if profile not in ("core", "full"):
        raise ValueError(f"unknown profile {profile}")
    more = lambda name, text=(), numeric=(), shuffled=False: FeatureSet(name, BASE_TEXT + text, BASE_NUMERIC + numeric, shuffled=shuffled)
    out = [more("baseline"), more("plus_edit_geometry", (), GEOMETRY), more("plus_lexical_relation", (), LEXICAL), more("plus_rejected_text", REJECTED_TEXT), more("plus_text_geometry", REJECTED_TEXT, GEOMETRY)]
    if profile == "full":
        out += [more("plus_text_lexical", REJECTED_TEXT, LEXICAL), more("plus_geometry_lexical", (), GEOMETRY + LEXICAL)]
    return [*out, more("full_preference", REJECTED_TEXT, GEOMETRY + LEXICAL), more("matched_shuffled_full_preference", REJECTED_TEXT, GEOMETRY + LEXICAL, True)]


def _pair_columns() -> dict[str, Column]:
    kept, gone = "retained_sentence", "rejected_sentence"
    return {
        "rejected_chars": F.length(gone), "rejected_tokens": F.size(X.tokens(gone)), "char_delta": F.length(kept) - F.length(gone), "token_delta": F.size(X.tokens(kept)) - F.size(X.tokens(gone)),
        "edit_similarity": similarity_ratio(X.normalise_sentence(gone), X.normalise_sentence(kept)), "lexical_jaccard": X.lexical_jaccard(gone, kept),
    }


def wide_episodes(versions: DataFrame, order: list[Column], least: int = 25, most: int = 600, low: float = 0.20, high: float = 0.98, before: int = 2, after: int = 1, limit: int | None = None, n_parts: int | None = None) -> DataFrame:
    """[R08-R10, R07] Episodes with lengths, word counts and their differences, one for each episode_id (the first in order of
    windows); an outcome counts as revised where the sentence went or was replaced. limit keeps the first in order of article."""
    sizes = versions.groupBy("lineage_id").agg(F.count("*").alias("n_versions"))
    rows = replacements(versions, order, least, most, low, high, before, after, n_parts).where("reason is null").join(sizes, "lineage_id")
    changed = F.col("v2_sentence").isNull() | (X.normalise_sentence("v2_sentence") != X.normalise_sentence("selected"))
    rows = rows.select(
        F.concat("lineage_id", F.lit("::"), "v0_version_id", F.lit("->"), "v1_version_id", F.lit("::"), F.col("selected_sentence_index").cast("string")).alias("episode_id"),
        F.col("lineage_id").alias("article_key"), "source", "article_id", F.col("v0_version_id").alias("old_version_id"), F.col("v1_version_id").alias("retained_version_id"), F.col("v2_version_id").alias("future_version_id"),
        F.col("nth").alias("version_index"), "n_versions", "sentence_position", "context_before", F.col("selected").alias("retained_sentence"), "context_after", F.col("rejected").alias("rejected_sentence"),
        F.length("selected").alias("retained_chars"), F.size(X.tokens("selected")).alias("retained_tokens"), changed.cast("int").alias("revised_again_next_version"), "edit_similarity",
    )
    pair = {k: v for k, v in _pair_columns().items() if k != "edit_similarity"}
    rows = rows.withColumns(pair)
    rows = rows.groupBy("episode_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "episode_id"]), "version_index").alias("r")).select("episode_id", "r.*")
    return rows if limit is None else rows.orderBy("article_key", "version_index", "episode_id").limit(limit)


def matched_shuffle(episodes: DataFrame, seed: int = 17, block: int = 16) -> DataFrame:
    """[M16, W11] Rejected sentences exchanged within blocks of like ones of a source (by length and similarity), with every column
    that is derived from the pair computed again."""
    donors = block_shift(episodes, "source", ["rejected_chars", "edit_similarity"], "episode_id", block, seed)
    given = episodes.select(F.col("episode_id").alias("donor"), F.col("rejected_sentence").alias("given"))
    rows = episodes.withColumn("original_rejected", F.col("rejected_sentence")).join(donors, "episode_id").join(given, "donor").withColumn("rejected_sentence", F.col("given")).drop("given", "donor")
    return rows.withColumns(_pair_columns())


def shuffle_diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """[M16] Share of rows that got an equal sentence, and mean changes of length and similarity."""
    b = before.select("episode_id", F.col("rejected_chars").alias("chars"), F.col("edit_similarity").alias("similarity"))
    same = (X.normalise_sentence("original_rejected") == X.normalise_sentence("rejected_sentence")).cast("double")
    return after.join(b, "episode_id").agg(F.count("*").alias("n"), F.avg(same).alias("same_rejected_text_rate"), F.avg(F.abs(F.col("chars") - F.col("rejected_chars"))).alias("mean_abs_rejected_chars_change"),
                                           F.avg(F.abs(F.col("similarity") - F.col("edit_similarity"))).alias("mean_abs_similarity_change"))
