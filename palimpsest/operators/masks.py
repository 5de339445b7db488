"""Whole-word masks on the pieces of a tokenizer: truncation, a mask where none survives, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places before and after the pieces that a model's own marks take.
BEFORE, AFTER = 1, 1


def chunk_words(words, size: int = 4) -> Column:
    """The word of each piece where a piece is up to `size` characters: a tokenizer without a vocabulary."""
    return F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / size).cast("int"))))


def tokenizer_words(path: str):
    """A function of a column of words: the word of each piece of the tokenizer file at `path`, which the workers read. Words
    are split already, and a word without pieces has none."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for words in batches:
            known = words.dropna()
            found = tokenizer.encode_batch([list(w) for w in known], is_pretokenized=True, add_special_tokens=False)
            yield pd.Series([[i for i in e.word_ids if i is not None] for e in found], index=known.index, dtype=object).reindex(words.index)

    return of


def token_masks(rows: DataFrame, pieces: str, mask: str = "mask_indices", max_length: int = 256) -> DataFrame:
    """[M50] rows with `kept` (pieces left of max_length places), `positions` (the masked places, 0 is the mark before the pieces)
    and `fell_back`. All pieces of a masked word that are kept are masked; where none is, the first piece is instead, if there is
    one, and the row fell back. Null pieces or masks count as empty. `pieces` holds the word number of each piece in order."""
    words = F.coalesce(F.slice(pieces, 1, max_length - BEFORE - AFTER), F.array().cast("array<int>"))
    chosen = F.coalesce(F.col(mask), F.array().cast("array<int>"))
    rows = rows.withColumn("_words", words).withColumn("kept", F.size("_words"))
    at = F.filter(F.transform("_words", lambda w, i: F.when(F.array_contains(chosen, w), i + BEFORE)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", at).withColumn("fell_back", F.size("_at") == 0)
    first = F.when(F.col("kept") > 0, F.array(F.lit(BEFORE))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("positions", F.when(F.col("fell_back"), first).otherwise(F.col("_at"))).drop("_words", "_at")


def masked_ids(ids, positions, mask_id: int) -> tuple[Column, Column]:
    """Input ids with the mask at its places, and labels: the ids there, -100 elsewhere. `ids` are those of all places."""
    ids, here = F.col(ids), lambda i: F.array_contains(positions, i)
    return F.transform(ids, lambda t, i: F.when(here(i), F.lit(mask_id)).otherwise(t)), F.transform(ids, lambda t, i: F.when(here(i), t).otherwise(F.lit(-100)))


def mask_counts(masked: DataFrame, by: list[str]) -> DataFrame:
    """[G35, M50] Records, kept pieces, masked pieces, the sum of their places, and records that fell back."""
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda a, i: a + i)
    return masked.groupBy(*by).agg(F.count("*").alias("records"), F.sum("kept").alias("kept"), F.sum(F.size("positions")).alias("masked"), F.sum(places).alias("places"), F.count_if("fell_back").alias("fallbacks"))
