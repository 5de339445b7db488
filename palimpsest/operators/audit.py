"""Audits of episodes: balance, concentration, reuse, bands, numeric shortcuts, label integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.alignment import selected_text, similarity_ratio, windows
from palimpsest.operators.selection import before_head, in_parts

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
VERSION_BANDS = ("1", "2", "3", "4", "5", "6-10", "11+", "non_numeric")
CATEGORIES = ("contains_number", "number_changed", "number_only_edit", "number_dominant_edit", "date_or_update_edit", "money_or_percentage_edit", "sports_numeric_edit", "casualty_count_update")


def count_if(x) -> Column:
    return F.count_if(X.col(x)).cast("long")


# Names of what an extraction may leave out, and of the gates of its audit.
EXCLUSIONS = ("too_few_versions", "empty_version", "ambiguous_replacement", "invalid_rejected_sentence", "invalid_selected_sentence", "future_unresolved", "similarity_below_min", "similarity_above_max")


def funnel(replaced: DataFrame) -> DataFrame:
    """[R13] Replaced blocks by reason, and accepted ones."""
    return replaced.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def extraction_audit(versions: DataFrame, order: list[Column], replaced: DataFrame, episodes: DataFrame, n_parts: int | None = None) -> DataFrame:
    """[R13, R14] One row: articles, windows, replaced blocks, episodes (as they are after duplicates and limits), their
    rates, and how many of each were left out by reason."""
    per = versions.groupBy("lineage_id").agg(F.count("*").alias("n"))
    articles = per.agg(F.count("*").alias("articles_seen"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - 2)), F.lit(0)).alias("version_windows_seen"), count_if(F.col("n") < 3).alias("too_few_versions"))
    blocks = replaced.agg(F.count("*").alias("replacement_opcodes_seen"), *[count_if(F.col("reason") == r).alias(r) for r in EXCLUSIONS[2:]])
    kept = episodes.agg(F.countDistinct("lineage_id").alias("articles_with_examples"), F.count("*").alias("accepted_examples"), count_if("future_revised").alias("future_revised_examples"))
    few = lambda k: F.coalesce(F.size(f"sentences_{k}"), F.lit(0)) <= 0
    left = windows(versions, order, n_parts=n_parts).agg(count_if(few(0) | few(1) | few(2)).alias("empty_version"))
    out = articles.crossJoin(blocks).crossJoin(kept).crossJoin(left)
    return out.select(
        "articles_seen", "articles_with_examples", "version_windows_seen", "replacement_opcodes_seen", "accepted_examples", X.share("accepted_examples", "replacement_opcodes_seen").alias("acceptance_rate"),
        "future_revised_examples", (F.col("accepted_examples") - F.col("future_revised_examples")).alias("future_stable_examples"), X.share("future_revised_examples", "accepted_examples").alias("future_revised_rate"), *EXCLUSIONS,
    )


def target_balance(episodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """[G02, G05] Episodes, lineages, revised and selected-B counts and rates with the revised rate's interval."""
    out = episodes.groupBy(*by).agg(F.count("*").alias("episodes"), F.countDistinct("lineage_id").alias("lineages"), count_if("future_revised").alias("revised"), count_if(F.col("selected_index") == 1).alias("selected_b"))
    lower, upper = X.wilson("revised", "episodes")
    return out.select(*by, "episodes", "lineages", "revised", "selected_b", X.share("revised", "episodes").alias("revised_rate"), X.share("selected_b", "episodes").alias("selected_b_rate"), lower.alias("lower"), upper.alias("upper"))


def viability_gates(report: DataFrame) -> DataFrame:
    """[M53] Of a row with episodes, lineages, revised_rate, selected_b_rate and source_boundary_artifact_rate."""
    return report.select(
        (F.col("episodes") >= 10_000).alias("at_least_10000_episodes"), (F.col("lineages") >= 3_000).alias("at_least_3000_lineages"),
        F.col("revised_rate").between(0.15, 0.40).alias("usable_target_balance"), F.col("selected_b_rate").between(0.45, 0.55).alias("candidate_orientation_balanced"),
        (F.col("source_boundary_artifact_rate") <= 0.03).alias("source_boundary_artifacts_below_3_percent"),
    )


def context_report(episodes: DataFrame) -> DataFrame:
    """[G05] One row: target balance, orientation with its interval, empty contexts, artifacts and boilerplate."""
    none = lambda c: F.trim(c) == ""
    flags = context_flags(episodes, "lineage_id", "future_revised", "selected_index", "context_before", "context_after")
    out = flags.agg(
        F.count("*").alias("episodes"), F.countDistinct("lineage_id").alias("lineages"), count_if("future_revised").alias("revised"), count_if(F.col("selected_index") == 1).alias("selected_b"),
        count_if(none("context_before")).alias("context_before_empty"), count_if(none("context_after")).alias("context_after_empty"), count_if(~none("context_before") & ~none("context_after")).alias("both_context_sides_present"),
        count_if("boundary_artifact").alias("source_boundary_artifacts"), count_if("boilerplate").alias("boilerplate_or_credit_records"),
    )
    (low, high), (low_b, high_b) = X.wilson("revised", "episodes"), X.wilson("selected_b", "episodes")
    rates = {"revised_rate": "revised", "selected_b_rate": "selected_b", "both_context_sides_present_rate": "both_context_sides_present", "source_boundary_artifact_rate": "source_boundary_artifacts", "boilerplate_or_credit_rate": "boilerplate_or_credit_records"}
    return out.select("*", *[X.share(c, "episodes").alias(n) for n, c in rates.items()], low.alias("lower"), high.alias("upper"), low_b.alias("selected_b_lower"), high_b.alias("selected_b_upper"))


def context_warnings(report: DataFrame, versions: DataFrame, reuse: DataFrame) -> DataFrame:
    """[G05] Which of the audit's warnings hold, from context_report(), version_bands() and pair_reuse()."""
    spread = versions.agg((F.max("revised_rate") - F.min("revised_rate")).alias("spread"))
    rows = report.crossJoin(spread).crossJoin(reuse)
    named = {"version_bands_vary": F.coalesce(F.col("spread") >= 0.05, F.lit(False)), "pair_reversals_are_material": F.col("reversal_episode_rate") >= 0.01, "boundary_artifacts_left": F.col("source_boundary_artifact_rate") > 0, "metadata_probe_comes_first": F.lit(True)}
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("warning"), v.alias("holds")) for k, v in named.items()])).alias("w")).select("w.*")


def lineage_concentration(episodes: DataFrame) -> DataFrame:
    """[G07, W15] Episodes per lineage: mean, median, most, singletons and the share of the largest 1, 5, 10, 20 percent."""
    per = episodes.groupBy("lineage_id").agg(F.count("*").alias("n"))
    # ranks come from the histogram of counts, so no task sees all lineages
    sizes = per.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n"))
    ranked = sizes.withColumn("before", F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("k").alias("all_k"), F.sum(F.col("k") * F.col("n")).alias("all_n"))
    top = ranked.crossJoin(F.broadcast(total))
    held = lambda f: (F.sum(F.col("n") * F.least(F.col("k"), F.greatest(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("all_k") * F.lit(f))) - F.col("before")))) / F.first("all_n"))
    return top.agg(
        (F.first("all_n") / F.first("all_k")).alias("mean_episodes"), F.max("n").alias("max_episodes"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("k"))), F.lit(0)).cast("long").alias("single_episode_lineages"),
        F.expr("percentile(n, 0.5, k)").alias("median_episodes"),
        *[held(f).alias(f"top_{p}_percent_rate") for f, p in ((0.01, 1), (0.05, 5), (0.1, 10), (0.2, 20))],
    )


def quantiles(rows: DataFrame, field: str, at: tuple[float, ...], by: list[str] = ()) -> DataFrame:
    """[G08, G09, F39, F40] by, n and `q`, exact quantiles with linear interpolation. Values are counted, and ranks come from
    sums over parts of each group that end at its approximate quantiles and a sum within a part, so no task holds a group's
    values, wherever they lie."""
    by = list(by)
    rows = rows.select(*by, F.col(field).cast("double").alias("_x")).where("_x is not null")
    counted = rows.groupBy(*by, "_x").agg(F.count("*").alias("_k"))
    placed = before_head(in_parts(counted, "_x", by, n=F.sum("_k")), F.col("_part"), by, F.col("_k"))
    w = Window.partitionBy(*by, "_head").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_k").over(w), F.lit(0)))
    value = lambda r: F.max(F.when((F.col("_below") <= r) & (r < F.col("_below") + F.col("_k")), F.col("_x")))
    found = placed.groupBy(*by, "n").agg(*[value(f(F.lit(p) * (F.col("n") - 1))).alias(f"_{s}{i}") for i, p in enumerate(at) for f, s in ((F.floor, "a"), (F.ceil, "b"))])
    between = lambda i, p: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)))
    return found.select(*by, "n", F.array(*[between(i, p) for i, p in enumerate(at)]).alias("q"))


def distribution(rows: DataFrame, field: str, by: list[str] = ()) -> DataFrame:
    """[G08, G09] Mean, median, least, most and nine quantiles with linear interpolation."""
    by = list(by)
    out = rows.groupBy(*by).agg(F.avg(field).alias("mean"), F.min(field).alias("least"), F.max(field).alias("most"))
    q = quantiles(rows, field, QUANTILES, by)
    out = out.join(q, by) if by else out.crossJoin(q)
    return out.select(*by, "mean", F.col("q")[QUANTILES.index(0.5)].alias("median"), "least", "most", *[F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(QUANTILES)])


def bands(rows: DataFrame, field: str, edges: list[float]) -> DataFrame:
    """[G10] Half-open bands with counts and revised rates; rows outside of all bands are dropped, empty bands stay."""
    spark = rows.sparkSession
    all_bands = spark.createDataFrame([(float(a), float(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)], "lower double, upper double")
    at = F.lit(None).cast("double")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = F.when((F.col(field) >= a) & (F.col(field) < b), float(a)).otherwise(at)
    found = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), count_if("future_revised").alias("r")).where("at is not null")
    return all_bands.join(F.broadcast(found), F.col("lower") == F.col("at"), "left").select("lower", "upper", F.coalesce("n", F.lit(0)).alias("episodes"), F.coalesce("r", F.lit(0)).alias("revised"), (F.col("r") / F.col("n")).alias("revised_rate"))


def version_band(version) -> Column:
    v = X.numeric_version(version)
    return F.when(v.isNull(), "non_numeric").when(v <= 5, v.cast("int").cast("string")).when(v <= 10, "6-10").otherwise("11+")


def version_bands(rows: DataFrame, version: str) -> DataFrame:
    """[G11]"""
    out = rows.groupBy(version_band(version).alias("version_band")).agg(F.count("*").alias("episodes"), count_if("future_revised").alias("revised"))
    return out.where(F.col("version_band").isin(*VERSION_BANDS)).withColumn("revised_rate", F.col("revised") / F.col("episodes"))


def pair_reuse(episodes: DataFrame) -> DataFrame:
    """[G06] Unordered normalised pairs that repeat, and those whose retained side differs."""
    a, b = X.normalise_audit("candidate_a"), X.normalise_audit("candidate_b")
    groups = episodes.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), X.normalise_audit(selected_text()).alias("s"), "lineage_id")
    groups = groups.groupBy("x", "y").agg(F.count("*").alias("n"), F.countDistinct("s").alias("ways"), F.countDistinct("lineage_id").alias("lineages"))
    reversal = (F.col("n") > 1) & (F.col("ways") > 1)
    return groups.agg(
        F.count("*").alias("unique_pairs"), count_if(F.col("n") > 1).alias("repeated_pair_groups"), count_if(reversal).alias("reversal_pair_groups"),
        count_if(reversal & (F.col("lineages") == 1)).alias("same_lineage_reversal_groups"), count_if(reversal & (F.col("lineages") > 1)).alias("cross_lineage_reversal_groups"),
        F.coalesce(F.sum(F.when(reversal, F.col("n"))), F.lit(0)).cast("long").alias("episodes_in_reversal_groups"),
        X.share(F.coalesce(F.sum(F.when(reversal, F.col("n"))), F.lit(0)), F.sum("n")).alias("reversal_episode_rate"),
    )


def numeric_flags(episodes: DataFrame, *more: str) -> DataFrame:
    """[F11-F14, U05, W14, G12] Numeric categories of each episode, and lineages in which they repeat; more columns stay."""
    a, b = X.numbers("candidate_a"), X.numbers("candidate_b")
    rows = episodes.withColumns({"numbers_a": a, "numbers_b": b, "masked_a": X.normalise_audit(X.mask_numbers("candidate_a")), "masked_b": X.normalise_audit(X.mask_numbers("candidate_b"))})
    rows = rows.withColumn("contains_number", (F.size("numbers_a") > 0) | (F.size("numbers_b") > 0))
    rows = rows.withColumn("number_changed", F.col("contains_number") & (F.array_sort("numbers_a") != F.array_sort("numbers_b")))
    # the ratio is needed only where numbers changed
    rows = rows.withColumn("masked_similarity", similarity_ratio(F.when(F.col("number_changed"), F.col("masked_a")), F.when(F.col("number_changed"), F.col("masked_b"))))
    both = F.concat_ws(" ", "candidate_a", "candidate_b")
    changed = F.col("number_changed")
    rows = rows.withColumns({
        "number_only_edit": changed & (F.col("masked_a") == F.col("masked_b")), "number_dominant_edit": changed & F.coalesce(F.col("masked_similarity") >= 0.95, F.lit(False)),
        "date_or_update_edit": changed & (X.has(both, X.MONTH) | X.has(both, X.UPDATE)), "money_or_percentage_edit": changed & (X.has(both, X.MONEY) | X.has(both, X.PERCENT)),
        "sports_numeric_edit": changed & X.has(both, X.SPORTS), "casualty_count_update": changed & X.has(both, X.CASUALTY),
    })
    w = Window.partitionBy("lineage_id")
    rows = rows.withColumn("repeated_numeric_trajectory", changed & (F.count_if(changed).over(w) >= 2)).withColumn("repeated_casualty_trajectory", F.col("casualty_count_update") & (F.count_if("casualty_count_update").over(w) >= 2))
    return rows.select("episode_id", "lineage_id", "future_revised", *CATEGORIES, "repeated_numeric_trajectory", "repeated_casualty_trajectory", "numbers_a", "numbers_b", "masked_similarity", *more)


def category_summary(flags: DataFrame, names: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """[G12-G15] Each category against its complement."""
    long = flags.select("lineage_id", "future_revised", F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("flag")) for n in names])).alias("c"))
    out = long.groupBy(F.col("c.category").alias("category")).agg(
        count_if("c.flag").alias("episodes"), count_if(F.col("c.flag") & F.col("future_revised")).alias("revised"), F.count("*").alias("all_episodes"), count_if("future_revised").alias("all_revised"),
        F.countDistinct(F.when(F.col("c.flag"), F.col("lineage_id"))).alias("lineages"),
    )
    lower, upper = X.wilson("revised", "episodes")
    rest, rest_revised = F.col("all_episodes") - F.col("episodes"), F.col("all_revised") - F.col("revised")
    return out.select("category", "episodes", "revised", "lineages", (F.col("revised") / F.nullif("episodes", F.lit(0))).alias("revised_rate"), (rest_revised / F.nullif(rest, F.lit(0))).alias("complement_rate"),
                      X.risk_ratio("revised", "episodes", "all_revised", "all_episodes").alias("risk_ratio"), lower.alias("lower"), upper.alias("upper"))


def label_integrity(pairs: DataFrame, selected: str = "selected", future: str = "v2_sentence") -> DataFrame:
    """[G42, F17] Episodes whose label (case kept) and alignment (case and quotes straightened) disagree, by category."""
    revised = F.col(future).isNull() | (X.normalise_space(future) != X.normalise_space(selected))
    aligned = F.col(future).isNotNull() & (X.normalise_sentence(future) == X.normalise_sentence(selected))
    rows = pairs.select(revised.alias("revised"), (revised & aligned).alias("mismatch"), F.when(revised & aligned, X.mismatch_category(selected, future)).alias("category"))
    return rows.groupBy(F.coalesce("category", F.when(F.col("revised"), "revised").otherwise("stable")).alias("category")).agg(F.count("*").alias("n"))


def integrity_rates(pairs: DataFrame, selected: str = "selected", future: str = "v2_sentence") -> DataFrame:
    """[G42] One row: episodes, revised, mismatches, and their rates among all, revised and surviving episodes."""
    revised, gone = F.col(future).isNull() | (X.normalise_space(future) != X.normalise_space(selected)), F.col(future).isNull()
    aligned = ~gone & (X.normalise_sentence(future) == X.normalise_sentence(selected))
    out = pairs.agg(F.count("*").alias("episodes"), count_if(revised).alias("revised"), count_if(gone).alias("gone"), count_if(revised & aligned).alias("mismatches"), count_if(~revised & ~F.coalesce(aligned, F.lit(False))).alias("stable_unaligned"))
    rate = lambda a, b: X.share(a, b)
    return out.select("*", rate("revised", "episodes").alias("revised_rate"), rate("mismatches", "episodes").alias("mismatch_rate"), rate("mismatches", "revised").alias("mismatch_rate_of_revised"),
                      rate("gone", "episodes").alias("gone_rate"), rate(F.col("revised") - F.col("mismatches"), F.col("episodes")).alias("revised_rate_without_mismatches"))


def mismatch_sample(pairs: DataFrame, n: int = 50, selected: str = "selected", future: str = "v2_sentence") -> DataFrame:
    """[T05] The first n mismatches by episode_id, with their category."""
    revised = X.normalise_space(future) != X.normalise_space(selected)
    rows = pairs.where(F.col(future).isNotNull() & revised & (X.normalise_sentence(future) == X.normalise_sentence(selected)))
    return rows.select("episode_id", X.mismatch_category(selected, future).alias("category"), selected, future).orderBy("episode_id").limit(n)


def trajectories(flags: DataFrame) -> DataFrame:
    """[G12, W14] Repeated numeric and casualty trajectories of numeric_flags(): episodes, lineages and revised rates."""
    kinds = {"numeric": "repeated_numeric_trajectory", "casualty": "repeated_casualty_trajectory"}
    long = flags.select("lineage_id", "future_revised", F.explode(F.array(*[F.struct(F.lit(k).alias("trajectory"), F.col(c).alias("flag")) for k, c in kinds.items()])).alias("t")).where("t.flag")
    out = long.groupBy("t.trajectory").agg(F.count("*").alias("episodes"), F.countDistinct("lineage_id").alias("lineages"), count_if("future_revised").alias("revised"))
    return out.withColumn("revised_rate", X.share("revised", "episodes"))


def value_counts(rows: DataFrame, field: str, most: int = 20) -> DataFrame:
    """[G59] The most frequent values of a field, ties by value."""
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def described(rows: DataFrame, fields: list[str]) -> DataFrame:
    """[G59] Count, mean, deviation, least and most of each numeric field."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("v")).select("v.*")
    return long.groupBy("field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))


def context_flags(episodes: DataFrame, *more: str) -> DataFrame:
    """[P09, P10]"""
    return episodes.select("episode_id", X.boundary_artifact("context_before", "context_after", "candidate_a", "candidate_b").alias("boundary_artifact"), X.boilerplate("candidate_a", "candidate_b", "context_before", "context_after").alias("boilerplate"), *more)
