"""Key selection: qualifying lineages, hash samples, rebuilding versions from sentence rows, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.sources.staging import written

#: Parts of a group that is ranked by a number, a power of two, and the size from which a group is cut into parts.
PARTS = 1024
LARGE = 4096


def qualifying(rows: DataFrame, lineage: Column, least: int, distinct: str | None = None) -> DataFrame:
    """[Q1, Q3, Q5, A02-A04] Lineages with enough rows, or enough distinct values."""
    n = F.count("*") if distinct is None else F.countDistinct(distinct)
    return rows.groupBy(lineage.alias("lineage_id")).agg(n.alias("n")).where(F.col("n") >= least)


def sample_keys(keys: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """[A01, A05, A06] The n keys with least hash: a uniform sample that does not depend on row order."""
    return keys.orderBy(X.stable_hash(seed, F.col(key)), key).limit(n)


def source_name(path: Column) -> Column:
    """[S09] The last path component without its extensions, other characters as one underscore."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)(?:\.(?:gz|parquet|db|sqlite3?|jsonl?|csv))+$", "")
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_")


def rebuilt(rows: DataFrame, keys: list[str], index: str, sentence: str) -> DataFrame:
    """[S11, Q4] Sentence rows to versions with their sentences in order."""
    pair = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(sentence).alias("s"))))
    return rows.groupBy(*keys).agg(F.transform(pair, lambda p: p["s"]).alias("sentences"))


def numeric_prefix(x) -> Column:
    """[Q4] The number a text begins with, else 0."""
    digits = F.regexp_extract(X.col(x).cast("string"), r"^\s*[-+]?\d+(\.\d+)?", 0)
    return F.coalesce(F.when(digits != "", F.trim(digits).cast("double")), F.lit(0.0))


def before_head(rows: DataFrame, head: Column, by: list[str], value: Column) -> DataFrame:
    """rows with `_head` and `_before`, the sum of value over smaller heads of the group. Heads of one group are few by design,
    so the running sum over them is small, however many rows there are. Groups may be many, and the size of compressed files
    says little about the rows made of them, so the heads are never broadcast: both sides meet in the shuffle by group and head
    that ranking needs anyway."""
    rows = rows.withColumn("_head", head)
    heads = rows.groupBy(*by, "_head").agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return rows.join(heads.hint("merge"), [*by, "_head"])


def ranked(rows: DataFrame, head: Column, order: list, by: list[str] = (), name: str = "nth") -> DataFrame:
    """rows with their number from 1 in `order` within `by`; head is a coarse form of the first order column, so that a
    task ranks only the rows of one head."""
    rows = before_head(rows, head, list(by), F.lit(1))
    nth = F.row_number().over(Window.partitionBy(*by, "_head").orderBy(*order)) + F.col("_before")
    return rows.withColumn(name, nth.cast("int")).drop("_head", "_before")


def in_parts(rows: DataFrame, value: str, by: list[str] = (), tie: Column | None = None, large: int = LARGE, **sums: Column) -> DataFrame:
    """rows with `_part`, a head for before_head() and ranked() in order of the number `value`, and sums of their group. The
    parts of a group end at its quantiles, from a sketch whose error is a sixteenth of a part, so their sizes do not depend on
    how the values lie in their range. Groups of up to `large` rows are one part, so the table of ends, which goes to the shared
    folder at once, is at most two bytes a row. Rows of one value share a part; with `tie`, the rows of a value that fills parts
    by itself are dealt over as many by its hash, in no order among themselves. Nulls come first, NaN last."""
    by = list(by)
    # one literal, as an expression for each of so many shares makes plans slow
    shares = F.split(F.lit(",".join(str(i / PARTS) for i in range(1, PARTS))), ",").cast("array<double>")
    ends = F.percentile_approx(value, shares, 16 * PARTS)
    ends = F.when(F.count(value) > large, F.sort_array(ends))
    # a sketch depends on the order in which tasks' parts are merged, so its ends are written once for all that read them
    groups = written(rows.groupBy(*by).agg(ends.alias("_ends"), *[v.alias(k) for k, v in sums.items()]), "ends")
    rows = rows.join(groups, by) if by else rows.crossJoin(F.broadcast(groups))
    steps = F.array(*[F.lit(PARTS >> i) for i in range(1, PARTS.bit_length())])
    # binary search: how many ends are less than the value, or at most the value
    ends_where = lambda holds: F.aggregate(steps, F.lit(0), lambda at, step: F.when(holds(F.element_at("_ends", at + step)), at + step).otherwise(at))
    part = ends_where(lambda end: end < F.col(value))
    if tie is not None:
        filled = ends_where(lambda end: end <= F.col(value)) - part
        part = part.cast("long") * (2 * PARTS) + F.when(filled > 1, 1 + F.pmod(F.xxhash64(tie), filled)).otherwise(0)
    return rows.withColumn("_part", F.when(F.col("_ends").isNull() | F.col(value).isNull(), F.lit(-1)).otherwise(part)).drop("_ends")


def hash_ranked(rows: DataFrame, place: Column, by: list[str] = (), tie: list[str] = ()) -> DataFrame:
    """rows with `place` and `nth`, their number from 1 in order of place."""
    return ranked(rows.withColumn("place", place), F.substring("place", 1, 3), ["place", *tie], by)


def balanced_subset(rows: DataFrame, size: int, seed: int = 17, key: str = "source_id", target: str = "target") -> DataFrame:
    """[A07] The hash-first floor(size / 2) of class 0 and the rest of class 1."""
    rows = rows.withColumn("_place", F.sha2(F.concat(F.lit(f"diagnostic-subset:{seed}:"), F.col(key).cast("string")), 256))
    # both classes in one pass over rows; tasks keep no more than the first ones
    nth = F.row_number().over(Window.partitionBy(target).orderBy("_place", key))
    picked = rows.where(F.col(target).isin(0, 1)).withColumn("_nth", nth).where(F.col("_nth") <= size - size // 2)
    return picked.where(F.col("_nth") <= F.when(F.col(target) == 0, size // 2).otherwise(size - size // 2)).drop("_place", "_nth")


def whole_sessions(rows: DataFrame, session: str, limit: int, seed: int = 1729) -> DataFrame:
    """[S23] Whole sessions in hash order: the first one, then each that fits in what is left of limit, until it is used up.
    The driver sees at most limit sizes at a time: no more sessions than rows that are left can come in."""
    sizes = rows.groupBy(session).agg(F.count("*").alias("size")).withColumn("place", X.stable_hash(seed, F.col(session)))
    kept, used, last, first = [], 0, "", True
    while used < limit or first:
        ahead = sizes.where(F.col("place") > last)
        if first:
            found, most = ahead.orderBy("place").limit(1).collect(), 1
        else:
            most = limit - used
            found = ahead.where(F.col("size") <= most).orderBy("place").limit(most).collect()
        for r in found:
            if first or used + r["size"] <= limit:
                kept.append(r[session])
                used += r["size"]
        if len(found) < most:
            break
        last, first = found[-1]["place"], False
    picked = rows.sparkSession.createDataFrame([(k,) for k in kept], sizes.select(session).schema)
    return rows.join(F.broadcast(picked), session, "left_semi")
