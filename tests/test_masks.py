"""Whole-word masks on pieces against a plain loop, with a rule and with a public tokenizer's file."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import masks as K
from palimpsest.operators import reports as B

VOCABULARY = Path("/opt/tokenizers/word_bpe_49k.json")
SCHEMA = "id int, words array<string>, mask_indices array<int>"


def rows_of(n: int) -> list[tuple]:
    rng = random.Random(5)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeé漢😀") for _ in range(rng.randint(1, 11))) for _ in range(rng.randint(1, 40))]
        out.append((i, words, sorted(rng.sample(range(len(words)), max(1, len(words) // 7)))))
    return out


def loop(pieces: list[int], mask: list[int], most: int) -> tuple:
    kept = pieces[: most - 2]
    at = [i + 1 for i, w in enumerate(kept) if w in set(mask)]
    return len(kept), at or [1] * bool(kept), not at


def test_rule_equals_a_loop(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pieces", K.chunk_words("words"))
    got = {r.id: r for r in K.token_masks(df, "pieces", max_length=20).collect()}
    fell = 0
    for i, words, mask in rows:
        pieces = [k for k, w in enumerate(words) for _ in range(-(-len(w) // 4))]
        expected = loop(pieces, mask, 20)
        assert list(got[i].pieces) == pieces and (got[i].kept, list(got[i].positions), got[i].fell_back) == expected
        fell += expected[2]
    assert 20 < fell < 280


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no public vocabulary here")
def test_tokenizer_equals_its_own_truncation(spark):
    from tokenizers import Tokenizer

    rows = [*rows_of(60), (60, ["ordinary", "words", "unbelievably", "long"], [2, 3]), (61, [], [0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pieces", K.tokenizer_words(str(VOCABULARY))("words"))
    got = {r.id: r for r in K.token_masks(df, "pieces", max_length=16).collect()}
    tokenizer = Tokenizer.from_file(str(VOCABULARY))
    tokenizer.enable_truncation(14)
    for i, words, mask in rows:
        kept = [w for w in tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False).word_ids if w is not None]
        assert (got[i].kept, list(got[i].positions), got[i].fell_back) == loop(kept, mask, 16)


def test_odd_rows_and_counts(spark):
    rows = [(0, None, [0]), (1, [], []), (2, ["word"], None), (3, ["word"], [9]), (4, ["word"], [0]), (4, ["word"], [0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pieces", K.chunk_words("words"))
    masked = K.token_masks(df, "pieces")
    got = sorted((r.id, r.kept, list(r.positions), r.fell_back) for r in masked.collect())
    assert got == [(0, 0, [], True), (1, 0, [], True), (2, 1, [1], True), (3, 1, [1], True), (4, 1, [1], False), (4, 1, [1], False)]
    counts = K.mask_counts(masked, []).first()
    assert tuple(counts) == (6, 4, 4, 4, 4) and K.mask_counts(masked.limit(0), ["id"]).count() == 0


def test_ids_and_labels(spark):
    df = spark.createDataFrame([([7, 8, 9], [1])], "ids array<int>, positions array<int>")
    assert tuple(df.select(*K.masked_ids("ids", "positions", 4)).first()) == ([7, 4, 9], [-100, 8, -100])


def test_a_fold_with_fallbacks_did_not_learn(spark):
    df = spark.createDataFrame([(0, ["a"], [0]), (1, ["a"], [5])], SCHEMA).withColumn("pieces", K.chunk_words("words"))
    counts = K.mask_counts(K.token_masks(df, "pieces").withColumn("fold", F.col("id")), ["fold"])
    runs = counts.select(F.lit("language").alias("regime"), "fold", F.col("masked").alias("units"), F.lit(0.5).alias("accuracy"), F.lit(1.0).alias("mean_loss"), F.lit(2.0).alias("first_loss"), F.lit(1.0).alias("last_loss"), "fallbacks")
    r = B.language_aggregate(runs).first()
    assert (r.folds, r.fallbacks, r.learned_folds, r.status) == (2, 1, 1, "mixed")
