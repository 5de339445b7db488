"""Text functions, alignment and audits on small rows."""

import difflib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.operators import audit as U
from palimpsest.operators import selection as S
from palimpsest.sources import staging


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()[0]


def test_normalisers(spark):
    assert one(spark, X.normalise_space("t"), t="  a \n\t b ") == "a b"
    assert one(spark, X.normalise_space("t"), t=None) == ""
    assert one(spark, X.normalise_sentence("t"), t=" “It’s”  Ok ") == "\"it's\" ok"
    assert one(spark, X.normalise_audit("t"), t="Straße") == "strasse"
    assert one(spark, X.tokens("t"), t="Don't re-do café - ok") == ["don't", "re-do", "café", "ok"]


def test_jaccard_edges(spark):
    assert one(spark, X.lexical_jaccard("a", "b"), a="", b="") == 1.0
    assert one(spark, X.lexical_jaccard("a", "b"), a="x", b="") == 0.0
    assert one(spark, X.lexical_jaccard("a", "b"), a="x y", b="y z") == pytest.approx(1 / 3)


def test_sentences(spark):
    assert one(spark, X.sentence_split("t"), t="One is here. Two!  three? Four\nfive") == ["One is here.", "Two!  three?".replace("  ", " "), "Four", "five"]
    assert one(spark, X.sentence_split_flat("t"), t="One.\nTwo three\nfour") == ["One.", "Two three four"]


def test_numbers(spark):
    assert one(spark, X.numbers("t"), t="Paid $ 1,200.50 and 5% on the 3rd; v1.2 x7") == ["$1200.50", "5%", "3rd"]
    assert one(spark, X.mask_numbers("t"), t="12 dead, 3,400 hurt") == "<NUM> dead, <NUM> hurt"


@pytest.mark.parametrize("a,b,want", [("x  y", "x y", "whitespace_only"), ("The", "the", "case_only"), ("“a”", '"a"', "quote_style_only"), ("“A”", '"a"', "case_and_quote_style"), ("a", "b", "not_explained_by_existing_normalization")])
def test_mismatch(spark, a, b, want):
    assert one(spark, X.mismatch_category("a", "b"), a=a, b=b) == want


@pytest.mark.parametrize("v,want", [(None, "unknown"), ("Model A", "a"), ("tie (bothbad)", "both_bad"), ("both are bad", "both_bad"), ("b", "b"), ("", "unknown"), ("other", "other")])
def test_winner(spark, v, want):
    assert one(spark, X.normalise_winner("v"), v=v) == want


def test_boundary_and_boilerplate(spark):
    row = {"before": "Mr.", "after": "", "a": "x y", "b": "z"}
    assert one(spark, X.boundary_artifact("before", "after", "a", "b"), **row)
    assert not one(spark, X.boundary_artifact("before", "after", "a", "b"), **(row | {"before": "Fine."}))
    assert one(spark, X.boilerplate("a", "b"), a="Sign UP for more", b="")


def test_ratio_matches_difflib(spark):
    pairs = [("the cat sat", "the cat sat down"), ("", ""), ("abc", "xyz"), ("hello world", "world hello")]
    got = spark.createDataFrame(pairs, "a string, b string").select(A.similarity_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio() for a, b in pairs]


def versions(spark):
    rows = []
    for lineage, texts in {
        "revised": [["An opening line stays here.", "The deal may close on Monday now.", "The end is as it was."], ["An opening line stays here.", "The deal will close on Monday now.", "The end is as it was."], ["An opening line stays here.", "The deal will close on Tuesday now.", "The end is as it was."]],
        "stable": [["An opening line stays here.", "The deal could close on Monday now.", "The end is as it was."], ["An opening line stays here.", "The deal will close on Monday now.", "The end is as it was."], ["An opening line stays here.", "The deal will close on Monday now.", "The end is as it was."]],
        "ambiguous": [["An opening line stays here.", "One sentence that is split later on."], ["An opening line stays here.", "One sentence that is here.", "Split later on into two."], ["An opening line stays here.", "One sentence that is here.", "Split later on into two."]],
        "short": [["Only one version is here."]],
    }.items():
        rows += [Row(lineage_id=f"s::{lineage}", source="s", article_id=lineage, version_id=str(i + 9), sentences=t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows)


def test_episodes(spark):
    replaced = A.replacements(versions(spark), A.version_order(None, "version_id"))
    assert {r.outcome: r.n for r in U.funnel(replaced).collect()} == {"accepted": 2, "ambiguous_replacement": 1}
    rows = {r.article_id: r for r in A.episodes(replaced).collect()}
    assert rows["revised"].future_revised and not rows["stable"].future_revised
    # version "10" comes after "9"
    assert rows["stable"].episode_id == "s::stable::9->10::1" and rows["stable"].context_before == "An opening line stays here."
    for r in rows.values():
        assert (r.candidate_a if r.selected_index == 0 else r.candidate_b) == "The deal will close on Monday now."


def plain_blocks(one, two, three):
    """Outcome, index and future of each replaced block, by a plain loop."""
    normal = lambda s: " ".join(s.split()).lower()
    future = {}
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=[*map(normal, two)], b=[*map(normal, three)], autojunk=False).get_opcodes():
        for i in range(i1, i2):
            keeps = tag == "equal" or (tag == "replace" and i2 - i1 == j2 - j1)
            future[i] = three[j1 + i - i1] if keeps else None
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=[*map(normal, one)], b=[*map(normal, two)], autojunk=False).get_opcodes():
        if tag == "replace":
            if (i2 - i1, j2 - j1) != (1, 1):
                yield "ambiguous_replacement", j1, None
                continue
            valid = [20 <= len(s) <= 500 and len(s.split()) >= 3 for s in (one[i1], two[j1])]
            ratio = difflib.SequenceMatcher(a=normal(one[i1]), b=normal(two[j1]), autojunk=False).ratio()
            reason = "invalid_rejected_sentence" if not valid[0] else "invalid_selected_sentence" if not valid[1] else "similarity_below_min" if ratio < 0.15 else "similarity_above_max" if ratio > 0.98 else "accepted"
            yield reason, j1, future[j1]


def test_alignment_of_any_edits_by_a_plain_loop(spark):
    """Versions with insertions, deletions, moved, repeated and changed sentences."""
    rng = random.Random(9)
    fresh = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(rng.randint(1, 9)))

    def edited(old):
        new = list(old)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(new) + 1)
            kind = rng.choice(["insert", "delete", "move", "repeat", "change", "change", "change"])
            if kind == "insert" or not new:
                new.insert(at, fresh())
            elif kind == "delete":
                new.pop(at % len(new))
            elif kind == "move":
                new.insert(at % len(new), new.pop(rng.randrange(len(new))))
            elif kind == "repeat":
                new.insert(at, rng.choice(new))
            else:
                k = at % len(new)
                new[k] = new[k] + " " + fresh()
        return new or [fresh()]

    rows, want = [], []
    for k in range(120):
        texts = [[fresh() for _ in range(rng.randint(1, 8))]]
        texts += [edited(texts[0])]
        texts += [edited(texts[1])]
        rows += [Row(lineage_id=f"l{k}", source="s", article_id=str(k), version_id=str(i + 9), sentences=t) for i, t in enumerate(texts)]
        want += [(f"l{k}", *x) for x in plain_blocks(*texts)]
    got = A.replacements(spark.createDataFrame(rows), A.version_order(None, "version_id"))
    got = [(r.lineage_id, r.reason or "accepted", r.selected_sentence_index, r.v2_sentence if r.one else None) for r in got.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({w[1] for w in want}) >= 4


def test_first_episode_wins_and_limit(spark):
    replaced = A.replacements(versions(spark), A.version_order(None, "version_id"))
    again = replaced.withColumn("nth", F.col("nth") + 1).withColumn("v2_sentence", F.lit("other"))
    assert A.episodes(again.unionByName(replaced)).collect() == A.episodes(replaced).collect()
    assert [r.article_id for r in A.episodes(replaced, most=1).collect()] == ["revised"]


def test_extraction_audit(spark):
    v = versions(spark).unionByName(spark.createDataFrame([Row(lineage_id="s::empty", source="s", article_id="empty", version_id=str(i), sentences=["A line of some words."] if i else []) for i in range(3)], versions(spark).schema))
    order = A.version_order(None, "version_id")
    replaced = A.replacements(v, order)
    r = U.extraction_audit(v, order, replaced, A.episodes(replaced)).first()
    assert (r.articles_seen, r.too_few_versions, r.empty_version, r.version_windows_seen) == (5, 1, 1, 4)
    assert (r.replacement_opcodes_seen, r.accepted_examples, r.ambiguous_replacement, r.future_revised_examples) == (3, 2, 1, 1)


def test_temporal_pairs_ignore_punctuation(spark):
    rows = [Row(lineage_id="x", source="s", article_id="x", version_id=str(i), sentences=t) for i, t in enumerate([["The first line, as it was.", "A second line of the text here."], ["The first line -- as it was!", "A second line of the story here."]])]
    got = A.temporal_pairs(spark.createDataFrame(rows), A.version_order(None, "version_id"), spark.createDataFrame([], "lineage_id string")).collect()
    assert [r.temporal_pair_id for r in got] == ["x::0->1::1::temporal"]
    with pytest.raises(ValueError, match="fewer than 2"):
        A.temporal_pairs(spark.createDataFrame(rows), A.version_order(None, "version_id"), spark.createDataFrame([], "lineage_id string"), target=2)


def test_version_order_of_long_digits(spark):
    ids = ["9", "v2", "10", "1" + "0" * 50, "010", "2" + "0" * 49, "v10"]
    df = spark.createDataFrame([(i,) for i in ids], "v string")
    got = [r.v for r in df.orderBy(*A.version_order(None, "v"), "v").collect()]
    assert got == ["9", "010", "10", "2" + "0" * 49, "1" + "0" * 50, "v2", "v10"]


def test_no_machine_local_intermediates(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(type("Session", (), {"sparkContext": Context})())
    df = staging.written(spark.range(3), "kept")
    assert df.count() == 3 and df._palimpsest_path in staging._kept
    staging.drop(df)
    assert df._palimpsest_path not in staging._kept


def test_future_map_marks_removed(spark):
    df = spark.createDataFrame([(["a b", "c d", "e f"], ["a b", "e f"])], "m array<string>, f array<string>")
    assert df.select(A.future_map("m", "f").alias("x")).first().x == {0: "a b", 1: None, 2: "e f"}


def test_numeric_flags(spark):
    rows = [("e1", "l1", "5 dead", "6 dead", True), ("e2", "l1", "7 dead in May", "8 dead in May", False), ("e3", "l2", "no figures", "none here", False)]
    e = spark.createDataFrame(rows, "episode_id string, lineage_id string, candidate_a string, candidate_b string, future_revised boolean")
    got = {r.episode_id: r for r in U.numeric_flags(e).collect()}
    assert got["e1"].number_only_edit and got["e1"].casualty_count_update and got["e1"].repeated_casualty_trajectory
    assert got["e2"].date_or_update_edit and not got["e3"].contains_number
    summary = {r.category: r for r in U.category_summary(U.numeric_flags(e)).collect()}
    assert summary["number_changed"].episodes == 2 and summary["number_changed"].risk_ratio is None and summary["sports_numeric_edit"].revised_rate is None


def test_wilson_none_for_no_rows(spark):
    df = spark.createDataFrame([(0, 0), (5, 10)], "s int, n int")
    got = df.select(*[c.alias(n) for c, n in zip(X.wilson("s", "n"), "lu", strict=True)]).collect()
    assert got[0].l is None and got[1].l == pytest.approx(0.2366, abs=1e-4)


def test_ranked_is_global_rank(spark):
    df = spark.range(200).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = [r.id for r in S.hash_ranked(df, F.col("h")).orderBy("nth").collect()]
    assert got == [r.id for r in df.orderBy("h").collect()]
