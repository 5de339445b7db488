"""Six matched control corpora over folds and partitions, as one plan with fold and partition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.selection import in_parts, ranked

CELL = ["fold", "partition"]
# The corpora, and columns that tell the outcome.
OUTCOME_COLUMNS = ("v2_sentence", "future_revised", "v2_version_id")
CORPORA = ("language_adaptation", "pair_exposure", "temporal_direction", "random_label", "shuffled_preference", "authentic_preference")


def _named(*parts) -> Column:
    return F.sha2(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def _cell() -> list[Column]:
    return [F.col("fold").cast("string"), F.lit(":"), F.col("partition")]


def in_cells(episodes: DataFrame, members: DataFrame) -> DataFrame:
    """[J04] Episodes in every fold, with their partition there."""
    return episodes.join(members, "lineage_id")


def balanced_labels(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """[W07, M09] rows with `label`: in each cell the hash-first half is 0, the rest 1."""
    place = _named(f"label:{seed}:", *_cell(), ":", F.col(key))
    rows = ranked(rows.withColumn("_place", place), F.substring("_place", 1, 2), ["_place", key], CELL, "_nth")
    sizes = rows.groupBy(*CELL).agg(F.count("*").alias("_size"))
    return rows.join(F.broadcast(sizes), CELL).withColumn("label", (F.col("_nth") > F.floor(F.col("_size") / 2)).cast("int")).drop("_place", "_nth", "_size")


def donors(rows: DataFrame, seed: int, namespace: str) -> DataFrame:
    """[W08, J06, M10] fold, partition, episode_id, donor_id: records ordered by lineage size, lineage hash and record
    hash, shifted by the largest lineage, so that a donor is never of the same lineage. A cell of one record, or in which one
    lineage owns more than half, is an error when it is read."""
    rows = rows.select(*CELL, "lineage_id", "episode_id")
    sizes = rows.groupBy(*CELL, "lineage_id").agg(F.count("*").alias("_size"))
    cells = sizes.groupBy(*CELL).agg(F.max("_size").alias("_largest"), F.sum("_size").alias("_all"))
    head = F.concat(F.lit(namespace + ":"), *_cell())
    rows = rows.join(sizes, [*CELL, "lineage_id"])
    rows = rows.withColumn("_group", F.sha2(F.concat(head, F.lit(f":group:{seed}:"), "lineage_id"), 256)).withColumn("_record", F.sha2(F.concat(head, F.lit(f":record:{seed}:"), "episode_id"), 256))
    coarse = F.concat(F.lpad((F.lit(10**12) - F.col("_size")).cast("string"), 13, "0"), F.substring("_group", 1, 2))
    rows = ranked(rows, coarse, [F.desc("_size"), "_group", "_record", "episode_id"], CELL, "_nth").join(F.broadcast(cells), CELL)
    giver = rows.select(*CELL, (F.col("_nth") - 1).alias("_at"), F.col("episode_id").alias("donor_id"), F.col("lineage_id").alias("donor_lineage"))
    taker = rows.withColumn("_at", (F.col("_nth") - 1 + F.col("_largest")) % F.col("_all"))
    wrong = F.raise_error(F.concat(F.lit(f"no donors of other lineages for {namespace}:"), *_cell()))
    donor = F.when((F.col("_all") < 2) | (2 * F.col("_largest") > F.col("_all")), wrong).otherwise(F.col("donor_id"))
    return taker.join(giver, [*CELL, "_at"]).select(*CELL, "episode_id", donor.alias("donor_id"), "lineage_id", "donor_lineage")


def serialised() -> Column:
    return X.serialise_episode("context_before", "candidate_a", "candidate_b", "context_after")


def mask_indices(rows: DataFrame, seed: int = 17, rate: float = 0.15) -> DataFrame:
    """[W09] fold, partition, episode_id, words and the sorted places of the hash-first 15 percent of words (half to even,
    one at least)."""
    words = rows.select(*CELL, "episode_id", X.split_tokens(serialised()).alias("w")).withColumn("words", F.size("w"))
    place = lambda i: F.struct(F.sha2(F.concat(F.lit(f"mask:{seed}:"), *_cell(), F.lit(":"), "episode_id", F.lit(":"), i.cast("string")), 256).alias("h"), i.alias("i"))
    # arrays are of one episode's words, so ranking stays within the row
    order = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("words") - 1), place))
    n = F.greatest(F.lit(1), F.least(F.col("words"), F.bround(F.col("words") * F.lit(rate), 0).cast("int")))
    return words.select(*CELL, "episode_id", "words", F.sort_array(F.transform(F.slice(order, 1, n), lambda x: x["i"])).alias("mask_indices"))


def length_matched(pool: DataFrame, wanted: DataFrame, key: str = "temporal_pair_id", tokens: str = "tokens") -> DataFrame:
    """[W10, M11] From each cell of pool, wanted(fold, partition, n, nearest) rows at even ranks of (tokens, key); where n is 1
    the first row with tokens nearest to `nearest`. A cell with fewer rows than are wanted is an error when it is read."""
    head = F.lpad(F.least(F.col(tokens), F.lit(99999)).cast("string"), 5, "0")
    rows = ranked(pool, head, [tokens, key], CELL, "_nth")
    sizes = wanted.where("n > 0").join(pool.groupBy(*CELL).agg(F.count("*").alias("_m")), CELL, "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    short = F.raise_error(F.concat(F.lit("fewer rows than are wanted in "), *_cell()))
    sizes = sizes.withColumn("n", F.when(F.col("_m") < F.col("n"), short).otherwise(F.col("n")))
    ranks = sizes.where("n > 1").withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    # even steps of at least one never collide
    even = F.bround(F.col("_i") * (F.col("_m") - 1) / (F.col("n") - 1), 0).cast("int")
    many = rows.join(ranks.select(*CELL, (even + 1).alias("_nth")), [*CELL, "_nth"])
    single = rows.join(F.broadcast(sizes.where("n = 1").select(*CELL, "nearest")), CELL)
    single = single.groupBy(*CELL).agg(F.min(F.struct(F.abs(F.col(tokens) - F.col("nearest")).alias("gap"), F.col("_nth").alias("at")))["at"].alias("_nth"))
    return many.unionByName(rows.join(F.broadcast(single), [*CELL, "_nth"])).drop("_nth")


def build(episodes: DataFrame, members: DataFrame, pairs: DataFrame, pair_buckets: DataFrame, folds: int, seed: int = 17) -> DataFrame:
    """[M08, M12, K05] Pointer records of all corpora for all folds and the partitions train and validation."""
    rows = in_cells(episodes, members).where("partition <> 'test'")
    base = lambda d, corpus, **more: d.select(F.lit(corpus).alias("corpus"), *CELL, F.col(more.get("id", "episode_id")).alias("source_id"), "lineage_id", more["target"].cast("int").alias("target"),
                                              more.get("partner", F.lit(None).cast("string")).alias("partner_id"), more.get("mask", F.lit(None).cast("array<int>")).alias("mask_indices"))
    authentic = base(rows, "authentic_preference", target=F.col("selected_index"))
    random = base(balanced_labels(rows, "episode_id", seed), "random_label", target=F.col("label"))
    given = donors(rows, seed + 101, "shuffle")
    label = episodes.select(F.col("episode_id").alias("donor_id"), F.col("selected_index").alias("donor_index"))
    shuffled = base(given.join(label, "donor_id"), "shuffled_preference", target=F.col("donor_index"), partner=F.col("donor_id"))
    exposure = balanced_labels(rows, "episode_id", seed + 211).select(*CELL, "episode_id", "label").join(donors(rows, seed + 307, "pair"), [*CELL, "episode_id"])
    exposure = base(exposure, "pair_exposure", target=F.col("label"), partner=F.when(F.col("label") == 1, F.col("episode_id")).otherwise(F.col("donor_id")))
    masked = mask_indices(rows, seed).join(rows.select(*CELL, "episode_id", "lineage_id"), [*CELL, "episode_id"])
    language = base(masked, "language_adaptation", target=F.lit(None), mask=F.col("mask_indices"))
    from palimpsest.operators.splits import membership

    tokens = X.token_count(X.serialise_temporal("context_before", "earlier_text", "later_text", "context_after"))
    pool = pairs.join(membership(pair_buckets, folds), "lineage_id").where("partition <> 'test'").withColumn("tokens", tokens)
    least = F.min(X.token_count(serialised()))
    chosen = length_matched(pool.select(*CELL, "temporal_pair_id", "lineage_id", "tokens"), rows.groupBy(*CELL).agg(F.count("*").cast("int").alias("n"), least.alias("nearest")))
    temporal = base(balanced_labels(chosen, "temporal_pair_id", seed + 401), "temporal_direction", id="temporal_pair_id", target=F.col("label"))
    return authentic.unionByName(random).unionByName(shuffled).unionByName(exposure).unionByName(language).unionByName(temporal)


def exposure_tokens(records: DataFrame, episodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """[G40, G41] Words of each record; a pair-exposure negative has its partner's second candidate."""
    e = episodes.select(F.col("episode_id").alias("source_id"), *[F.col(c) for c in ("context_before", "candidate_a", "candidate_b", "context_after")])
    partner = episodes.select(F.col("episode_id").alias("partner_id"), F.col("candidate_b").alias("partner_b"))
    p = pairs.select(F.col("temporal_pair_id").alias("source_id"), X.token_count(X.serialise_temporal("context_before", "earlier_text", "later_text", "context_after")).alias("pair_tokens"))
    rows = records.join(e, "source_id", "left").join(partner, "partner_id", "left").join(p, "source_id", "left")
    b = F.when((F.col("corpus") == "pair_exposure") & (F.col("target") == 0), F.col("partner_b")).otherwise(F.col("candidate_b"))
    own = X.token_count(X.serialise_episode(F.col("context_before"), F.col("candidate_a"), b, F.col("context_after")))
    return rows.select("corpus", *CELL, "source_id", F.coalesce("pair_tokens", own).alias("tokens"))


def materialised(records: DataFrame, episodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """[M15, J07] Text and target of each record; temporal pairs are turned so that the target indexes the later text."""
    e = episodes.select(F.col("episode_id").alias("source_id"), "context_before", "candidate_a", "candidate_b", "context_after")
    partner = episodes.select(F.col("episode_id").alias("partner_id"), F.col("candidate_b").alias("partner_b"))
    p = pairs.select(F.col("temporal_pair_id").alias("source_id"), "earlier_text", "later_text", F.col("context_before").alias("pb"), F.col("context_after").alias("pa"))
    rows = records.join(e, "source_id", "left").join(partner, "partner_id", "left").join(p, "source_id", "left")
    later_b = F.col("target") == 1
    a = F.coalesce(F.when(later_b, F.col("earlier_text")).otherwise(F.col("later_text")), F.col("candidate_a"))
    b = F.coalesce(F.when(later_b, F.col("later_text")).otherwise(F.col("earlier_text")), F.when((F.col("corpus") == "pair_exposure") & (F.col("target") == 0), F.col("partner_b")), F.col("candidate_b"))
    return rows.select("corpus", *CELL, "source_id", "target", "mask_indices", X.serialise_episode(F.coalesce("context_before", "pb"), a, b, F.coalesce("context_after", "pa")).alias("text"))


def gates(records: DataFrame, episodes: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """[M13, U06, U08] The ten gates as one row, over records of build(): equal sizes, no test lineage, no outcome column,
    balanced labels, donors of other lineages, labels kept by the shuffle, and temporal pairs from other lineages."""
    of = lambda name: F.col("corpus") == name
    own = episodes.select(F.col("episode_id").alias("source_id"), F.col("lineage_id").alias("own_lineage"))
    donor = episodes.select(F.col("episode_id").alias("partner_id"), F.col("lineage_id").alias("partner_lineage"))
    rows = records.select("corpus", *CELL, "source_id", "lineage_id", "target", "partner_id").join(own, "source_id", "left").join(donor, "partner_id", "left")
    test = members.where("partition = 'test'").select("fold", "lineage_id", F.lit(True).alias("tested"))
    inside = episodes.select("lineage_id").distinct().withColumn("evaluated", F.lit(True))
    known = pairs.select(F.col("temporal_pair_id").alias("source_id"), F.lit(True).alias("known"))
    rows = rows.join(test, ["fold", "lineage_id"], "left").join(inside, "lineage_id", "left").join(known, "source_id", "left")
    temporal, moved = of("temporal_direction"), of("shuffled_preference") | (of("pair_exposure") & (F.col("target") == 0))
    n = F.count_if
    cells = rows.groupBy(*CELL).agg(
        *[n(of(c)).alias(c) for c in CORPORA], n(~temporal & F.col("tested").isNotNull()).alias("leaked"),
        *[F.abs(F.sum(F.when(of(c), 2 * F.col("target") - 1))).alias(f"{c}_gap") for c in ("random_label", "pair_exposure", "temporal_direction")],
        *[F.coalesce(F.sum(F.when(of(c), F.col("target"))), F.lit(0)).alias(f"{c}_ones") for c in ("authentic_preference", "shuffled_preference")],
        *[n(of(c) & moved & (F.col("own_lineage") == F.col("partner_lineage"))).alias(f"{c}_same") for c in ("pair_exposure", "shuffled_preference")],
        n(temporal & (F.col("evaluated").isNotNull() | F.col("known").isNull())).alias("inner"),
    )
    every = lambda x: F.coalesce(F.bool_and(x), F.lit(True))
    return cells.agg(
        every(F.greatest(*CORPORA) == F.least(*CORPORA)).alias("all_six_corpora_have_equal_record_counts"), every(F.col("leaked") == 0).alias("no_preference_source_record_uses_test_lineages"),
        F.lit(not set(records.columns) & set(OUTCOME_COLUMNS)).alias("no_source_task_record_contains_future_fields"),
        every(F.coalesce("random_label_gap", F.lit(0)) <= 1).alias("random_labels_are_balanced"), every(F.coalesce("pair_exposure_gap", F.lit(0)) <= 1).alias("pair_exposure_labels_are_balanced"),
        every(F.col("pair_exposure_same") == 0).alias("pair_exposure_negative_donors_cross_lineages"), every(F.col("authentic_preference_ones") == F.col("shuffled_preference_ones")).alias("shuffled_preferences_preserve_label_counts"),
        every(F.col("shuffled_preference_same") == 0).alias("shuffled_preference_donors_cross_lineages"), every(F.col("inner") == 0).alias("temporal_pairs_are_external_to_evaluation_lineages"),
        every(F.coalesce("temporal_direction_gap", F.lit(0)) <= 1).alias("temporal_direction_labels_are_balanced"),
    )


def token_gate(tokens: DataFrame) -> DataFrame:
    """[G40] Cells of exposure_tokens() in which every record has a word."""
    return tokens.groupBy("corpus", *CELL).agg((F.min("tokens") > 0).alias("tokens_positive"))


def within_label_shuffle(rows: DataFrame, by: list[str], key: str, label: str, seed: int = 17) -> DataFrame:
    """[W12, W13, U06] rows with `shuffled`: labels dealt again within groups, so that their counts stay."""
    natural = F.sha2(F.concat(F.lit(f"natural:{seed}:"), F.col(key).cast("string")), 256)
    dealt = F.sha2(F.concat(F.lit(f"dealt:{seed}:"), F.col(key).cast("string")), 256)
    a = ranked(rows.withColumn("_p", natural), F.substring("_p", 1, 2), ["_p", key], by, "_nth").drop("_p")
    b = ranked(rows.withColumn("_p", dealt), F.substring("_p", 1, 2), ["_p", key], by, "_nth").select(*by, "_nth", F.col(label).alias("shuffled"))
    return a.join(b.hint("merge"), [*by, "_nth"]).drop("_nth")


def block_shift(rows: DataFrame, source: str, order: list[str], key: str, block: int, seed: int = 17) -> DataFrame:
    """[W11, T07, M16] key and donor: rows of a source sorted (by a number first) and cut in blocks, each shifted by a hashed
    non-zero amount; a last block of one joins the one before. Tasks share a source by parts that end at quantiles of the number;
    rows of one number are sorted by one task."""
    rows = rows.select(source, key, *[c for c in order if c != key])
    sizes = rows.groupBy(source).agg(F.count("*").alias("_n"))
    rows = ranked(in_parts(rows, order[0], [source]), F.col("_part"), [*order, key], [source], "_rn").drop("_part").withColumn("_rn", F.col("_rn") - 1).join(sizes, source)
    number = F.floor(F.col("_rn") / block)
    number = F.when((F.col("_n") % block == 1) & (F.col("_rn") == F.col("_n") - 1) & (F.col("_n") > 1), number - 1).otherwise(number)
    rows = rows.withColumn("_block", number)
    b = Window.partitionBy(source, "_block")
    rows = rows.withColumn("_size", F.count("*").over(b)).withColumn("_at", F.col("_rn") - F.min("_rn").over(b))
    h = X.stable_hash(seed, F.col(source), F.col("_block"))
    shift = F.when(F.col("_size") > 1, F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.greatest(F.col("_size") - 1, F.lit(1)) + 1).otherwise(0)
    rows = rows.withColumn("_from", F.pmod(F.col("_at") - shift, F.col("_size")))
    giver = rows.select(source, "_block", F.col("_at").alias("_from"), F.col(key).alias("donor"))
    return rows.join(giver, [source, "_block", "_from"]).select(key, "donor")
