"""Revision alignment: ordered versions to one-to-one replacement episodes with their later outcome."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

OPCODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"
#: Rows whose sentences are Python objects at a time.
SLICE = 64
#: Pairs of characters that are compared as one number: with all blocks within, and for the longest block alone.
SMALL, LARGE = 1 << 19, 1 << 26
#: Bytes of sentences in a part of whole versions.
PART = 48 << 20
#: Parts of whole versions whose episodes meet in one part.
JOINED = 8


def _matcher(a, b) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(a=a, b=b, autojunk=False)


def _places(a: str, b: str) -> tuple[int, int]:
    """Which characters of a (rows, from the lowest bits on) and b (columns) are equal, as bits of one number, and the bytes of a row:
    at least a bit behind b is free, so that no run goes on in the next row."""
    wide = len(b) // 8 + 1
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    rows, none = {c: x.to_bytes(wide, "little") for c, x in at.items()}, bytes(wide)
    return int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little"), wide


def _longest(equal: int, wide: int) -> tuple[int, int, int]:
    """Row, column and size of the longest run, of such the first row and in it the first column."""
    run, size, last = equal, 0, 0
    while run:
        last, size = run, size + 1
        run = (run << 8 * wide + 1) & equal
    i, j = divmod((last & -last).bit_length() - 1, 8 * wide) if size else (0, 0)
    return i + 1 - size, j + 1 - size, size


def _matched_within(a: str, b: str) -> int:
    equal, wide = _places(a, b)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 == 1:
            total += b.find(a[a0], b0, b1) >= 0
        elif b1 - b0 == 1:
            total += a.find(b[b0], a0, a1) >= 0
        else:
            columns = int.from_bytes(((1 << b1) - (1 << b0)).to_bytes(wide, "little") * (a1 - a0), "little")
            i, j, size = _longest(equal >> 8 * wide * a0 & columns, wide)
            if size:
                total += size
                i += a0
                todo += [x for x in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if x[0] < x[1] and x[2] < x[3]]
    return total


def matched(a: str, b: str) -> int:
    """Characters in difflib's matching blocks of two texts, found by shifts of bits; in difflib itself where these would be too many."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) * len(b) <= SMALL:
            total += _matched_within(a, b)
            continue
        i, j, size = _longest(*_places(a, b)) if len(a) * len(b) <= LARGE else _matcher(a, b).find_longest_match()
        if size:
            total += size
            todo += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return total


def _ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    ratio = lambda a, b: 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
    for a, b in batches:
        yield pa.array([ratio(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.float64())


def similarity_ratio(a, b) -> Column:
    """[R12] Twice the matched characters over all characters, by longest matching blocks. Where one text holds the other, that is
    the one block, and no text goes to Python; the work on others grows with the product of their lengths."""
    a, b = X.col(a), X.col(b)
    inside = F.contains(a, b) | F.contains(b, a)
    m, n = F.length(a), F.length(b)
    held = F.when(m + n == 0, 1.0).otherwise(2.0 * F.least(m, n) / (m + n))
    return F.when(inside, held).otherwise(F.arrow_udf(_ratio, "double")(F.when(~inside, a), F.when(~inside, b)))


def _opcodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = ("tag", "i1", "i2", "j1", "j2")
    kind = pa.list_(pa.struct([(n, pa.string() if n == "tag" else pa.int32()) for n in names]))
    for olds, news in batches:
        parts = []
        for at in range(0, len(olds), SLICE):
            old, new = olds.slice(at, SLICE), news.slice(at, SLICE)
            # sentences as numbers: equal ones have equal numbers
            ids = pa.chunked_array([old.flatten(), new.flatten()]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ends = [np.cumsum(np.asarray(x.value_lengths().fill_null(0))) for x in (old, new)]
            a, b = (np.split(x, e[:-1]) for x, e in zip((ids[: len(old.flatten())], ids[len(old.flatten()) :]), ends, strict=True))
            known = np.asarray(old.is_valid()) & np.asarray(new.is_valid())
            parts.append(pa.array([[dict(zip(names, op, strict=True)) for op in _matcher(x.tolist(), y.tolist()).get_opcodes()] if k else None for x, y, k in zip(a, b, known, strict=True)], kind))
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)


def opcodes(old, new) -> Column:
    """Edit operations between two arrays of sentences in normalised form, by longest matching blocks."""
    return F.arrow_udf(_opcodes, OPCODES)(X.col(old), X.col(new))


def with_opcodes(rows: DataFrame, pairs: dict[str, tuple[str, str]], normalise=X.normalise_sentence) -> DataFrame:
    """rows with the opcodes() of pairs of columns, compared in normalised form, under the names of `pairs`, which come in
    order: a first column may be a second one of pairs before.

    Where sentences were only replaced where they stand, no matching block leaves its place, so opcodes are the runs of equal and
    of differing places, and nothing goes to Python. That is so for arrays of one size without repetitions in which what differs is in
    one of them alone: all together they have as many values as one array and the places that differ."""
    for c in dict.fromkeys(a for a, _ in pairs.values()):
        if c not in {b for _, b in pairs.values()}:
            rows = rows.withColumn(f"_{c}", F.transform(c, normalise))

    def form(a: str, b: str) -> Column:
        # a sentence that stands where an equal one stood has its form; a place of a null array is null, and so not equal
        return F.transform(b, lambda s, i: F.when(s == F.get(a, i), F.get(f"_{a}", i)).otherwise(normalise(s)))

    for a, b in pairs.values():
        rows = rows.withColumn(f"_{b}", form(a, b))
    # each step is a column of its own: what stands in a lambda is computed again for every element
    rows = rows.withColumns({f"_{n}_same": F.zip_with(f"_{a}", f"_{b}", lambda x, y: x == y) for n, (a, b) in pairs.items()})
    differ = lambda n: F.size(F.filter(f"_{n}_same", lambda s: ~s))
    fine = {f"_{n}_fine": (F.size(f"_{a}") == F.size(f"_{b}")) & (F.size(F.array_distinct(F.concat(f"_{a}", f"_{b}"))) == F.size(f"_{a}") + differ(n)) for n, (a, b) in pairs.items()}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in fine.items()})
    turns = lambda n: F.filter(F.transform(f"_{n}_same", lambda s, i: F.when((i == 0) | (s != F.get(f"_{n}_same", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({f"_{n}_at": F.when(F.col(f"_{n}_fine"), turns(n)) for n in pairs})

    def run(n: str, size: Column, at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(f"_{n}_at", k + 1), size)
        return F.struct(F.when(F.get(f"_{n}_same", at), "equal").otherwise("replace").alias("tag"), at.alias("i1"), end.alias("i2"), at.alias("j1"), end.alias("j2"))

    def found(n: str, a: str, b: str) -> Column:
        here = F.transform(f"_{n}_at", lambda at, k: run(n, F.size(f"_{n}_same"), at, k))
        return F.when(F.col(f"_{n}_fine"), here).otherwise(opcodes(*[F.when(~F.col(f"_{n}_fine"), F.col(f"_{c}")) for c in (a, b)]))

    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, *[found(n, a, b).alias(n) for n, (a, b) in pairs.items()])


def futures(ops, future, strict: bool = True) -> Column:
    """Place and continuation in `future` of each sentence that was aligned by ops, in order; null where it went. Equal sentences and
    replaced blocks of one size go by position; not strict, any replaced sentence counts as gone."""
    sentences = X.col(future)

    def entries(op: Column) -> Column:
        keeps = (op["tag"] == "equal") | ((op["tag"] == "replace") & F.lit(strict) & (op["i2"] - op["i1"] == op["j2"] - op["j1"]))
        rows = F.when(op["i2"] > op["i1"], F.sequence(op["i1"], op["i2"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(rows, lambda i: F.struct(i.alias("key"), F.when(keeps, F.get(sentences, op["j1"] + i - op["i1"])).alias("value")))

    return F.flatten(F.transform(X.col(ops), entries))


def future_map(middle, future, strict: bool = True) -> Column:
    """[R01, R07] futures() as a map of each sentence of `middle`."""
    return F.map_from_entries(futures(opcodes(*[F.transform(X.col(c), X.normalise_sentence) for c in (middle, future)]), future, strict))


def parts(rows: DataFrame, size: Column) -> int:
    """Parts in which whole versions meet: as many as are set, and more where the sum of size, bytes of sentences, is over PART for each.
    The bytes are counted, in a pass over rows: what is set and the size of files say little of what a task will hold."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(_set(rows), -(-int(total) // PART))


def _set(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def windows(versions: DataFrame, order: list[Column], size: int = 3, n_parts: int | None = None) -> DataFrame:
    """[W01, W02] Each version with those after it: sentences_0.., version_0.. for `size` consecutive versions, and `nth`. n_parts, where the
    caller has a cheaper source for parts(), spares a pass over versions; 0 where it has dealt lineages into them, so that versions stay."""
    # the order is a column and all leads are in one select: one sort of whole versions, in parts by their bytes, which are not
    # put together by compressed size: versions of a lineage are alike, and a task would hold many times what is shuffled
    if n_parts is None:
        n_parts = parts(versions, F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.octet_length(s), F.lit(0))))
    rows = versions.withColumns({f"_order_{i}": o for i, o in enumerate(order)})
    if n_parts:
        rows = rows.repartition(n_parts, "lineage_id")
    w = Window.partitionBy("lineage_id").orderBy(*[f"_order_{i}" for i in range(len(order))])
    leads = [x for k in range(1, size) for x in (F.lead("sentences", k).over(w).alias(f"sentences_{k}"), F.lead("version_id", k).over(w).alias(f"version_{k}"))]
    out = rows.select(*versions.columns, F.row_number().over(w).alias("nth"), *leads).where(F.col(f"version_{size - 1}").isNotNull())
    return out.withColumns({"sentences_0": F.col("sentences"), "version_0": F.col("version_id")})


def version_order(created: str | None, version: str) -> list[Column]:
    """[S12] Missing dates last, dates, then the version id by its digit and letter runs, digits as numbers of any size."""
    chunks = F.regexp_extract_all(F.lower(F.col(version).cast("string")), F.lit(r"\d+|\D+"), F.lit(0))

    def place(c: Column) -> Column:
        digits = F.when(c.rlike(r"^\d"), F.regexp_replace(c, r"^0+(?=\d)", ""))
        return F.struct(digits.isNull().alias("alpha"), F.coalesce(F.length(digits), F.lit(0)).alias("size"), F.coalesce(digits, c).alias("text"))

    natural = F.transform(chunks, place)
    return [natural] if created is None else [F.col(created).isNull(), F.col(created), natural]


def raw_order(created: str | None, version: str) -> list[Column]:
    """[S31] The same without splitting the version id: by its text."""
    return [F.col(version)] if created is None else [F.col(created).isNull(), F.col(created), F.col(version)]


def replacements(versions: DataFrame, order: list[Column], least: int = 20, most: int = 500, low: float = 0.15, high: float = 0.98, before: int = 1, after: int = 1, n_parts: int | None = None) -> DataFrame:
    """[R02-R04, W04] One row for each replaced block of each window of three versions, with `reason` null where it is an
    episode. versions(lineage_id, source, article_id, version_id, sentences, order columns). Similarity is taken only of
    one-to-one blocks of valid sentences whose future is known, as no other can be an episode."""
    rows = windows(versions, order, n_parts=n_parts)
    rows = rows.where((F.size("sentences_0") > 0) & (F.size("sentences_1") > 0) & (F.size("sentences_2") > 0))
    rows = with_opcodes(rows, {"ops": ("sentences_0", "sentences_1"), "next": ("sentences_1", "sentences_2")})
    rows = rows.withColumn("future", futures("next", "sentences_2"))
    # what a block needs is taken before rows are made of blocks, so that none of them copies whole versions; futures are in order of
    # their place and leave none out
    def block(op: Column) -> Column:
        i, j = op["i1"], op["j1"]
        return F.struct(
            j.alias("selected_sentence_index"), F.get("sentences_0", i).alias("rejected"), F.get("sentences_1", j).alias("selected"),
            F.get("future", j)["value"].alias("v2_sentence"), F.get("future", j).isNotNull().alias("resolved"), ((op["i2"] - i == 1) & (op["j2"] - j == 1)).alias("one"),
            X.context_before(F.col("sentences_1"), j, before).alias("context_before"), X.context_after(F.col("sentences_1"), j, after).alias("context_after"),
            (j / F.greatest(F.lit(1), F.size("sentences_1") - 1)).alias("sentence_position"),
            *[X.valid_sentence(c, least, most).alias(f"valid_{n}") for n, c in (("rejected", F.get("sentences_0", i)), ("selected", F.get("sentences_1", j)))],
            *[X.normalise_sentence(c).alias(f"form_{n}") for n, c in (("rejected", F.get("sentences_0", i)), ("selected", F.get("sentences_1", j)))],
        )

    blocks = F.transform(F.filter("ops", lambda o: o["tag"] == "replace"), block)
    rows = rows.select("lineage_id", "source", "article_id", F.col("version_0").alias("v0_version_id"), F.col("version_1").alias("v1_version_id"), F.col("version_2").alias("v2_version_id"), "nth", F.inline(blocks))
    usable = F.col("one") & F.col("valid_rejected") & F.col("valid_selected") & F.col("resolved")
    rows = rows.withColumn("edit_similarity", similarity_ratio(F.when(usable, F.col("form_rejected")), F.when(usable, F.col("form_selected"))))
    reason = (
        F.when(~F.col("one"), "ambiguous_replacement").when(~F.col("valid_rejected"), "invalid_rejected_sentence")
        .when(~F.col("valid_selected"), "invalid_selected_sentence").when(~F.col("resolved"), "future_unresolved")
        .when(F.col("edit_similarity") < low, "similarity_below_min").when(F.col("edit_similarity") > high, "similarity_above_max")
    )
    return rows.withColumn("reason", reason).drop("valid_rejected", "valid_selected", "form_rejected", "form_selected")


def episodes(replaced: DataFrame, seed: int = 17, most: int | None = None, n_parts: int = 0) -> DataFrame:
    """[P01-P05, R05, T04] Episodes of replacements(): the first of each episode_id in order of windows, candidates in a
    hashed order, and whether the retained sentence was revised later; with most, the first so many in order of lineage,
    window and sentence. Where n_parts, the parts of whole versions, are many, so are those in which episodes meet."""
    rows = replaced.where(F.col("reason").isNull())
    rows = rows.withColumn("episode_id", F.concat("lineage_id", F.lit("::"), "v0_version_id", F.lit("->"), "v1_version_id", F.lit("::"), F.col("selected_sentence_index").cast("string")))
    if n_parts // JOINED > _set(rows):
        rows = rows.repartition(n_parts // JOINED, "episode_id")
    first = rows.groupBy("episode_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "episode_id"]), "nth").alias("r")).select("episode_id", "r.*")
    if most is not None:
        first = first.orderBy("lineage_id", "nth", "selected_sentence_index").limit(most)
    return oriented(first, seed)


def oriented(rows: DataFrame, seed: int = 17) -> DataFrame:
    """[P01, P02, P05] Put the selected sentence in slot A where the hash bit is 1."""
    in_a = X.hash_bit(F.sha2(F.concat(F.lit(f"{seed}\0"), "episode_id"), 256)) == 1
    return (
        rows.withColumn("selected_index", F.when(in_a, 0).otherwise(1))
        .withColumn("candidate_a", F.when(in_a, F.col("selected")).otherwise(F.col("rejected")))
        .withColumn("candidate_b", F.when(in_a, F.col("rejected")).otherwise(F.col("selected")))
        .withColumn("future_revised", F.col("v2_sentence").isNull() | (X.normalise_space("v2_sentence") != X.normalise_space("selected")))
        .withColumn("lexical_jaccard", X.lexical_jaccard("rejected", "selected"))
        .select("source", "article_id", "lineage_id", "episode_id", "v0_version_id", "v1_version_id", "v2_version_id", "selected_sentence_index", "candidate_a", "candidate_b", "selected_index",
                "future_revised", "context_before", "context_after", "sentence_position", "edit_similarity", "lexical_jaccard", "selected", "rejected", "v2_sentence")
    )


def selected_text(a="candidate_a", b="candidate_b", index="selected_index") -> Column:
    """[P03, F16]"""
    return F.when(F.col(index) == 0, F.col(a)).otherwise(F.col(b))


def swapped(prompts: DataFrame) -> DataFrame:
    """[P16] Candidates exchanged."""
    return prompts.withColumns({"candidate_a": F.col("candidate_b"), "candidate_b": F.col("candidate_a")})


def sentences_or_split(sentences="sentences", text="text") -> Column:
    """[R06] Given sentences where there are any, else the text split."""
    return F.when(F.size(X.col(sentences)) > 0, X.col(sentences)).otherwise(X.sentence_split(text))


def temporal_pairs(versions: DataFrame, order: list[Column], excluded: DataFrame, target: int | None = None, seed: int = 17, low: float = 0.05, high: float = 0.995, least: int = 20, most: int = 500, n_parts: int | None = None) -> DataFrame:
    """[R11, W02, J05, U08, T04] Replaced pairs of consecutive versions of lineages that are not in excluded(lineage_id),
    aligned and scored in folded form without punctuation, one row for each pair of texts in that form (the first in hash
    order); with target, the first `target` of them, and an error if there are fewer."""
    # excluded lineages go after the window, whose parts and order serve the join: whole versions are shuffled and sorted once at any size
    rows = windows(versions, order, 2, n_parts).join(excluded.select("lineage_id").distinct(), "lineage_id", "left_anti")
    rows = with_opcodes(rows, {"ops": ("sentences_0", "sentences_1")}, X.normalise_temporal)
    one = lambda o: (o["tag"] == "replace") & (o["i2"] - o["i1"] == 1) & (o["j2"] - o["j1"] == 1)
    block = lambda o: F.struct(o["j1"].alias("at"), F.get("sentences_0", o["i1"]).alias("earlier"), F.get("sentences_1", o["j1"]).alias("later"),
                               X.context_before(F.col("sentences_1"), o["j1"]).alias("context_before"), X.context_after(F.col("sentences_1"), o["j1"]).alias("context_after"))
    rows = rows.select("lineage_id", "version_0", "version_1", F.inline(F.transform(F.filter("ops", one), block)))
    rows = rows.select("lineage_id", F.concat("lineage_id", F.lit("::"), "version_0", F.lit("->"), "version_1", F.lit("::"), F.col("at").cast("string"), F.lit("::temporal")).alias("temporal_pair_id"),
                       X.normalise_space("earlier").alias("earlier_text"), X.normalise_space("later").alias("later_text"), "context_before", "context_after")
    rows = rows.where(X.valid_temporal("earlier_text", least, most) & X.valid_temporal("later_text", least, most))
    rows = rows.withColumns({"earlier_form": X.normalise_temporal("earlier_text"), "later_form": X.normalise_temporal("later_text")})
    rows = rows.withColumn("edit_similarity", similarity_ratio("earlier_form", "later_form")).where(F.col("edit_similarity").between(low, high))
    rows = rows.withColumn("place", X.stable_hash(seed, F.col("temporal_pair_id")))
    # an aggregate, not a window: it combines before its shuffle
    own = [c for c in rows.columns if c not in ("earlier_form", "later_form")]
    rows = rows.groupBy("earlier_form", "later_form").agg(F.min_by(F.struct(*own), "place").alias("r")).select("r.*")
    if target is None:
        return rows
    found = rows.orderBy("place").limit(target)
    if found.count() < target:
        raise ValueError(f"fewer than {target} temporal pairs")
    return found
