"""Corpus operators against brute force, exact round trips and odd rows."""

import collections
import io
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import counts, language, lmscore, neardup, packing, pieces, toxicity, vectors, warc
from palimpsest.llm.common import components, prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "   \n\t ", "x", "▁a ▁", "日本語 テキスト 😀", "a" * 30_000, "<|endoftext|> It's 12.5% <s>", "İstanbul ﬁ ½ é é", "word " * 3000]


def words(rng, kind, n):
    syllables = {"en": ["the", "ing", "er", "and", "tion", "st"], "de": ["sch", "ung", "der", "ein", "ich", "heit"], "fr": ["eau", "que", "les", "oir", "ment", "é"]}[kind]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = [(i, words(rng, k, rng.randint(20, 80)), k, f"s{i % 3}", 1) for i, k in enumerate(["en", "de", "fr"] * 50)]
    rows += [(1000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(ODD)]
    rows += [(3, rows[3][1], "en", "s0", 1), (None, "no key here", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- pieces


def test_pieces_round_trip_and_repeat(spark, docs, empty):
    one, two = ({(r.doc_id, tuple(r.ids or ())) for r in pieces.encode(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs)).collect()) == want
    assert all(r.lossless for r in pieces.encode(docs, digest=True).where("n_pieces is not null").collect())
    assert pieces.encode(empty).count() == 0


def test_pieces_follow_the_lattice():
    model = pieces.Lattices(pieces.model_path(), 0.5)

    def segmentations(w):
        if not w:
            yield (), 1.0
        for k in range(1, len(w) + 1):
            if w[:k] in model.id:
                for rest, p in segmentations(w[k:]):
                    yield (model.id[w[:k]], *rest), p * model.weight[w[:k]]

    every = dict(segmentations("▁thing"))
    total, n = sum(every.values()), 30_000
    ids, starts = model.sample(["thing"] * n, pieces.seeds_of(list(range(n)), 3))
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(starts))
    assert all(abs(got[k] / n - p / total) < 0.012 for k, p in every.items())


def test_whole_rows_follow_the_lattice():
    """Draws of a row of several words, each in proportion to its weight."""
    model = pieces.Lattices(pieces.model_path(), 0.5)

    def segmentations(w):
        if not w:
            yield (), 1.0
        for k in range(1, len(w) + 1):
            if w[:k] in model.id:
                for rest, p in segmentations(w[k:]):
                    yield (model.id[w[:k]], *rest), p * model.weight[w[:k]]

    one, two = (dict(segmentations(w)) for w in ("▁on", "▁it"))
    every = {a + b: p * q for a, p in one.items() for b, q in two.items()}
    total, n = sum(every.values()), 30_000
    ids, starts = model.sample(["on it"] * n, pieces.seeds_of(list(range(n)), 5))
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(starts))
    assert set(got) <= set(every) and all(abs(got[k] / n - p / total) < 0.012 for k, p in every.items())


def test_very_long_words_take_time_in_proportion():
    model = pieces.Lattices(pieces.model_path(), 1.0)
    text = "語" * 300_000 + "thing" * 20_000
    began = time.time()
    ids, starts = model.sample([text], pieces.seeds_of([1], 1))
    assert model.decode(ids.tolist()).decode() == text and time.time() - began < 60


def test_long_words_match_short_ones():
    model = pieces.Lattices(pieces.model_path(), 1.0)
    text = "thinginthe" * 3
    seeds = pieces.seeds_of(list(range(50)), 1)
    a = model.sample([text] * 50, seeds)[0].tolist()
    model.forget()
    old, pieces.SHORT = pieces.SHORT, 5
    try:
        assert model.sample([text] * 50, seeds)[0].tolist() == a
    finally:
        pieces.SHORT = old


# --- language


def test_code_lengths_are_those_of_the_trees():
    texts = {"x": [b"abracadabra" * 4], "y": [b"banana bandana" * 4]}
    trees = language.train(texts, 2)
    data = np.frombuffer(b"abra", np.uint8)
    total = trees.bits(data, np.array([0, 4]))[0]
    # after any context the 256 bytes' probabilities sum to one
    for context in (b"", b"a", b"br", b"ana", b"zz", b"\xff", b"band"):
        every = np.frombuffer(b"".join(context + bytes([b]) for b in range(256)), np.uint8)
        size = len(context) + 1
        before = trees.bits(np.frombuffer(context, np.uint8), np.array([0, len(context)]))
        after = trees.bits(every, np.arange(0, 256 * size + 1, size))
        assert np.allclose(np.exp2(before - after).sum(0), 1, atol=1e-6)
    assert total[0] < total[1]


def test_code_lengths_by_recursion():
    """Partial matching with escapes as it is defined, a symbol at a time."""
    texts = {"x": [b"abracadabra" * 5, b"abacus"], "y": [b"banana bandana" * 4]}
    trees = language.train(texts, 3)
    known = sorted({b for ts in texts.values() for t in ts for b in t})

    def counts_of(name):
        found = collections.defaultdict(collections.Counter)
        for t in texts[name]:
            for i, b in enumerate(t):
                for k in range(min(i, 3) + 1):
                    found[t[i - k : i]][b] += 1
        return {c: n for c, n in found.items() if not c or sum(n.values()) >= language.LEAST}

    def probabilities(counts, context):
        """Of all 256 bytes."""
        below = np.full(256, 1 / 256) if not context else probabilities(counts, context[1:])
        seen = counts.get(context)
        if not seen:
            return below
        left = sum(below[b] for b in range(256) if b not in seen)
        bottom = sum(seen.values()) + (len(seen) if left > 0 else 0)
        return np.array([seen[b] / bottom if b in seen else below[b] / left * len(seen) / bottom for b in range(256)])

    for text in (b"abra bandanazq", b"", b"cab\xff" * 3, b"banana"):
        got = trees.bits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        for at, name in enumerate(trees.names):
            counts = counts_of(name)
            want = -sum(np.log2(probabilities(counts, text[max(0, i - 3) : i])[b]) for i, b in enumerate(text))
            assert got[at] == pytest.approx(want, rel=3e-7, abs=1e-6)
    assert len(known) > 5


def test_models_grow_with_the_sum_of_their_trees(monkeypatch):
    """40 languages take what their trees take alone; a memory too small for one block's code lengths changes nothing."""
    rng = random.Random(3)
    texts = {}
    for k in range(40):
        letters = [chr(0x100 + 20 * k + i) for i in range(20)]
        texts[f"l{k:02}"] = [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(400)).encode() for _ in range(3)]
    alone = sum(language.train({n: t}).nbytes for n, t in texts.items())
    trees = language.train(texts)
    assert trees.nbytes == alone and trees.cost.size <= language.REMEMBERED
    data = b"".join(t[0] for t in texts.values())
    starts = np.cumsum([0] + [len(t[0]) for t in texts.values()])
    got = trees.bits(np.frombuffer(data, np.uint8), starts)
    assert (got.argmin(1) == np.arange(40)).all()
    monkeypatch.setattr(language, "REMEMBERED", 1 << 10)
    trees.forget()
    assert np.array_equal(trees.bits(np.frombuffer(data, np.uint8), starts), got)


def test_ties_and_languages_of_too_long_texts(spark, monkeypatch):
    same = [(i, "abc def ghi " * 3, "b" if i % 2 else "a") for i in range(40)]
    docs = spark.createDataFrame(same + [(100 + i, "xyz " * 100, "long") for i in range(9)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "BYTES", 200)
    out = language.identify(docs).collect()
    assert {r.lang_pred for r in out} == {"a"} and {r.score for r in out if r.doc_id < 100} == {0.5}


def test_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    monkeypatch.setattr(language, "DOCS", 5)
    monkeypatch.setattr(language, "BYTES", 100)
    rows = [(i, "ab" * 12, "x") for i in range(1, 60)] + [(100 + i, "z" * 101, "long") for i in range(9)] + [(7, "ab" * 12, "x")] * 3
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"x"} and 0 < len(got["x"]) <= 4


def test_languages(spark, docs, empty):
    out = language.identify(docs).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 150 and r.doc_id != 3}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {r.held_out for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert language.identify(empty).count() == 0
    clash = docs.withColumn("language", F.lit(1)).withColumn("score", F.lit("x"))
    assert language.identify(clash).columns == ["doc_id", "held_out", "lang_pred", "score"]
    kept = language.keep_known_languages(spark, clash, "")
    assert kept.columns == clash.columns and kept.count() < clash.count() and kept.where("doc_id < 150").count() == 151


# --- counts


def test_edits_count_like_whole_texts(spark, docs, empty):
    counter = counts.Counter(counts.ranks_path(), counts.pattern())
    rng, parts = random.Random(2), [" ", "  ", "\n", "a", "re", "'", "'r", "e", "12", "!?", "é", " x", "\t\n "]
    for _ in range(400):
        doc = counts.Document("".join(rng.choice(parts) for _ in range(rng.randint(0, 200))), counter)
        for _ in range(4):
            at = rng.randint(0, len(doc.text) + 2)
            doc.edit(at, at + rng.choice([0, 1, 3, 30]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))))
            assert doc.tree.total == len(counter.encoding.encode_ordinary(doc.text))
    out = {r.doc_id: r for r in counts.edited_counts(counts.with_standard_edits(docs)).collect()}
    assert out[1001].tokens_after is None and out[1000].tokens_before == 0
    assert out[1009].n_encoded < out[1009].n_pieces / 20
    assert counts.edited_counts(counts.with_standard_edits(empty)).count() == 0


# --- language-model scores


class Bigrams:
    """The two models by plain counters of words and pairs of words."""

    def __init__(self, rows, named):
        self.one, self.after, self.two = ([collections.Counter(), collections.Counter()] for _ in range(3))
        for i, ws in rows:
            for a, b in zip([None, *ws], ws, strict=False):
                for k in (0, 1) if i in named else (1,):
                    self.one[k][b] += 1
                    self.after[k][a] += 1
                    self.two[k][a, b] += 1

    def p(self, k, a, b):
        p = (self.one[k][b] + 0.5) / (sum(self.one[k].values()) + 0.5 * (len(self.one[1]) + 1))
        return (self.two[k][a, b] + lmscore.MASS * p) / (self.after[k][a] + lmscore.MASS)


@pytest.mark.parametrize("block", [200, 1 << 23])
def test_scores_by_brute_force(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    clash = docs.select("*", F.lit(1).alias("block"), F.lit("x").alias("words"), F.lit(2).alias("part"), F.lit(True).alias("named"))
    got = lmscore.cross_entropy_difference(clash, targets.unionAll(targets).withColumn("n", F.lit(1)))
    assert got.count() == docs.count()
    out = {(r.doc_id, r.words): r for r in got.collect()}
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
    model = Bigrams(rows, {r.doc_id for r in targets.collect()})
    for k in (0, 1):
        for a in list(model.after[1])[:200]:
            assert sum(model.p(k, a, b) for b in [*model.one[1], "never seen"]) == pytest.approx(1, abs=1e-9)
    for i, ws in rows:
        r = out[i, len(ws)]
        if not ws:
            assert r.words == 0 and r.target_loss is r.background_loss is r.difference is None
            continue
        want = [sum(-math.log(model.p(k, a, b)) for a, b in zip([None, *ws[:300]], ws[:300], strict=False)) / len(ws) for k in (0, 1)]
        if len(ws) <= 300:
            assert r.target_loss == pytest.approx(want[0]) and r.background_loss == pytest.approx(want[1]) and r.difference == pytest.approx(want[0] - want[1])
    assert lmscore.cross_entropy_difference(empty, targets).count() == 0
    assert lmscore.cross_entropy_difference(docs, targets.where("false")).count() == docs.count()


def test_losses_are_not_below_the_entropy_of_the_source(spark):
    p = 1 / np.arange(1, 61)
    p /= p.sum()
    words_ = np.random.default_rng(3).choice([f"w{i}" for i in range(60)], (200, 1000), p=p)
    rows = [(i, " ".join(ws)) for i, ws in enumerate(words_)]
    out = lmscore.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(100).withColumnRenamed("id", "doc_id"))
    losses = out.agg(F.avg("target_loss"), F.avg("background_loss")).first()
    entropy = -(p * np.log(p)).sum()
    assert all(entropy - 0.02 < x < entropy + 0.1 for x in losses)


def test_scores_keep_rare_words_apart(spark):
    # more words than any fixed vocabulary of 2 ** 15: the last ones differ in how often they come up
    rows = [(i, " ".join(f"w{i}-{k} w{i}-{k}" for k in range(1000))) for i in range(40)] + [(100, "rare one"), (101, "other"), (102, "other")]
    out = {r.doc_id: r for r in lmscore.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    size, words = 40_003, 80_004
    for i, n in ((100, None), (101, 2)):
        p = ((n or 1) + 0.5) / (words + 0.5 * (size + 1))
        start = -math.log(((n or 1) + lmscore.MASS * p) / (43 + lmscore.MASS))
        after = -math.log((1 + lmscore.MASS * p) / (1 + lmscore.MASS))
        assert out[i].background_loss == pytest.approx(start if n else (start + after) / 2)


# --- packing


def check_pieces(rows, docs, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END], "<u4"))
    left = {k: collections.Counter(len(x) for x in v) for k, v in ids.items()}
    covered = collections.Counter()
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {k: sum(n * c for n, c in v.items()) for k, v in left.items()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0


def test_packing(spark, docs, empty):
    for length in (256, 4096):
        check_pieces(packing.pack(docs, length=length).collect(), docs, length)
    assert packing.pack(empty).count() == 0


def test_packing_in_many_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 500)
    check_pieces(packing.pack(docs, length=64).collect(), docs, 64)


def test_small_cache_gives_the_same_ids(monkeypatch):
    texts = [t for t in ODD if t] + ["a b c d e f g"] * 3
    whole = packing.ChunkIds(packing.tokenizer_path()).encode(texts)[0].tolist()
    monkeypatch.setattr(packing, "KEPT", 5)
    assert packing.ChunkIds(packing.tokenizer_path()).encode(texts)[0].tolist() == whole


def test_hilbert_neighbours_touch():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- near duplicates


def near_rows():
    rng = random.Random(4)
    rows, base = [], [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows.append((0, " ".join(base)))
    for i in range(1, 80):  # near copies: two words changed each
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"c{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    for i in range(60):  # a shared passage in otherwise different texts
        rows.append((200 + i, " ".join([f"u{i}-{k}" for k in range(150)] + base[:60])))
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "a b"), (305, "a b"), (306, "word " * 5000)]
    return rows


def test_near_duplicates(spark, empty):
    rows = near_rows()
    out = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t}
    for i in range(80):
        if len(sets[0] & sets[i]) / len(sets[0] | sets[i]) >= 0.85:
            assert out[i].class_id == 0
    assert all(out[100 + i].class_id == 0 for i in range(5))
    assert all(out[200 + i].class_id == 200 + i and out[200 + i].kept for i in range(60))
    assert out[300].class_id == 300 and out[301].class_id == 301 and out[303].class_id == 302 and out[305].class_id == 304
    assert neardup.near_duplicates(empty).count() == 0


def paired_rows(n):
    """n pairs of texts, about 0.82 alike within a pair and 0.7 across, so that bands hold most of them at once."""
    core = [f"c{k}" for k in range(204)]
    text = lambda p, m: core + [f"p{p}-{k}" for k in range(12)] + [f"m{p}-{m}-{k}" for k in range(20)]
    return [(2 * p + m, " ".join(text(p, m))) for p in range(n) for m in (0, 1)]


def similarities(rows):
    """Weighted Jaccard similarity of all texts, by one row of shingle counts each."""
    found = [collections.Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in rows]
    at = {s: i for i, s in enumerate({s for f in found for s in f})}
    x = np.zeros((len(rows), len(at)), np.float32)
    for i, f in enumerate(found):
        x[i, [at[s] for s in f]] = list(f.values())
    n, df = len(rows), (x > 0).sum(0)
    x *= 1 + neardup.SPREAD * np.log((n + 1) / (df + 1)) / np.log(n + 2)
    low = np.stack([np.minimum(x, r).sum(1) for r in x])
    return low / (x.sum(1)[:, None] + x.sum(1)[None] - low)


def check_pairs(spark, n):
    rows = paired_rows(n)
    near = similarities(rows)
    assert all(0.8 < near[2 * p, 2 * p + 1] < 0.84 for p in range(n)) and (np.triu(near, 1) >= 0.78).sum() == n
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i - i % 2 for i in range(2 * n)}


def test_pairs_unlike_the_hub_of_their_buckets(spark):
    check_pairs(spark, 100)


def test_pairs_of_a_large_family_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 64)
    check_pairs(spark, 300)


def brute_classes(rows):
    """Classes by all pairs' weighted Jaccard similarity."""
    near = similarities(rows) >= neardup.SIMILAR
    label = list(range(len(rows)))
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        changed, label = new != label, new
    return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}


def test_classes_of_a_crowd_by_brute_force(spark, monkeypatch):
    """A crowd of 500 about one text that is not among them, with links of 0.8 and up in it, and texts just below."""
    monkeypatch.setattr(neardup, "TILE", 100)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(150)] = f"c{i}-{rng.random()}"
        rows.append((i, " ".join(w)))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 20
    assert all(got[i] == want[i] for i in got)


@pytest.mark.parametrize("changed, low, high", [(6, 0.8, 0.84), (4, 0.84, 0.89), (2, 0.9, 0.95)])
def test_recall_of_pairs(spark, changed, low, high):
    rng = random.Random(changed)
    rows = []
    for i in range(300):
        w = [f"{i}-{rng.random()}" for _ in range(280)]
        v = list(w)
        for k in range(changed):
            v[k * 40 + 20] = f"x{i}-{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    near = similarities(rows)
    assert all(low <= near[2 * i, 2 * i + 1] < high for i in range(300))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 297


def test_texts_with_one_doc_id(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(5, one), (5, two), (1, two + " end"), (7, one), (None, one), (None, "n n n n n"), (None, "n n n n n"), (None, "m m m m m m")]
    out = collections.Counter((r.doc_id, r.class_id, r.copies, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == {(5, 5, 3, True): 1, (5, 1, 1, False): 1, (1, 1, 1, True): 1, (7, 5, 3, False): 1, (None, 5, 3, False): 1, (None, None, 2, True): 2, (None, None, 1, True): 1}
    kept = neardup.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.rand(3)), "")
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == {(5, one): 1, (1, two + " end"): 1, (None, "n n n n n"): 1, (None, "m m m m m m"): 1}


def test_near_duplicate_stage_keeps_one_row(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "p q r s t u", "n"), (4, None, "m"), (4, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("class_id", F.lit(0))
    kept = neardup.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "p q r s t u"), (1, "a b c d e f"), (4, ""), (4, "")]


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 400, np.uint64)
    a, b = h[:300], h[100:]
    wa, wb = np.linspace(1, 3, 300), np.linspace(1, 3, 300)
    weight = collections.defaultdict(lambda: [0, 0])
    for k, (x, w) in enumerate(((a, wa), (b, wb))):
        for key, v in zip(x, w, strict=True):
            weight[key][k] = v
    want = sum(min(v) for v in weight.values()) / sum(max(v) for v in weight.values())
    sampler, hits = neardup.Sampler(), []
    for shift in range(12):
        mixed = [neardup.mix(x + np.uint64(shift)) for x in (a, b)]
        codes = [sampler.samples(np.zeros(300, int), x[np.argsort(x)], w[np.argsort(x)], 1)[0] for x, w in zip(mixed, (wa, wb), strict=True)]
        hits.append((codes[0] == codes[1]).mean())
    assert np.mean(hits) == pytest.approx(want, abs=0.06)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100


# --- vectors


def vector_rows():
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).tolist(), int(i % 3)) for i in range(300)]
    rows += [(400 + i, rows[i][1], 0) for i in range(50)] + [(500 + i, (np.array(rows[0][1]) * (1 + i)).tolist(), 0) for i in range(20)]
    rows += [(600, None, 0), (601, [1.0, None] * 4, 0), (602, [float("nan")] * 8, 0), (603, [0.0] * 8, 0), (650, [], 0), (700, [1.0, 2.0], 1), (750, [3.0, 1.0], 1), (10, rows[10][1], 1), (None, rows[0][1], 0), (800, rows[0][1], None)]
    rows += [(850, [1e9] * 8, 2), (900, [-1e9, 3.0] * 4, 2), (901, [1e9, 1.0] * 4, 2)]  # components whose squares are beyond 64 bits
    rows += [(70, rows[0][1], 0), (70, (np.array(rows[0][1]) * 1.01).tolist(), 0), (70, rows[1][1], 1), (71, rows[0][1], 0)]  # an id with several vectors
    return rows


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FIT", 20)
    monkeypatch.setattr(vectors, "INDEX_ROWS", 16)
    rows = vector_rows()
    got = collections.defaultdict(list)
    for r in vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("dim", "v", "norm", "tile", "pivot", "score", "rank")})).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in {i for i, _ in fine if i % 50 == 0}:
        every = {(-clip(sum(a * b for a, b in zip(w, v, strict=True))), i) for j, w in fine if j == q for i, v in fine if i != q and len(v) == len(w)}
        assert got[q] == [(i, -s) for s, i in sorted(every)[:5]]
    assert vectors.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_keeps_rows_apart(spark, monkeypatch):
    """Two different queries of one id, equal candidates, and rows that share the query's id."""
    monkeypatch.setattr(vectors, "FIT", 8)
    monkeypatch.setattr(vectors, "INDEX_ROWS", 3)
    rng = np.random.default_rng(9)
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (3, [0.1, 0.1])] + [(int(i), rng.standard_normal(2).tolist()) for i in rng.integers(60, 120, 40)]
    got = collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    want = collections.Counter()
    for q, (i, a) in enumerate(v):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for c, (j, b) in enumerate(v) if c != q)[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert got == want


def test_links_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "JOIN_ROWS", 32)
    rows = vector_rows()
    out = {r.vec_id: r for r in vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("dim", "v", "several", "tile", "block", "n_links", "kept")}), 0.8).collect()}
    fine = sorted({(i, y, tuple(v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    near, union = collections.defaultdict(set), {i: i for i, _, _ in fine}

    def root(i):
        while union[i] != i:
            i = union[i]
        return i

    for (i, y, v), (j, z, w) in itertools.combinations(fine, 2):
        if y == z and len(v) == len(w) and i != j and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.8:
            near[i].add(j)
            near[j].add(i)
            union[max(root(i), root(j))] = min(root(i), root(j))
    for i in {r[0] for r in rows} - {None}:
        assert out[i].n_links == len(near[i]) and out[i].component_id == (root(i) if i in union else i) and out[i].kept == (out[i].component_id == i)
    assert vectors.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- toxicity


def test_gradients_are_numeric_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, np.ones(toxicity.CHAR_BUCKETS + 1, bool), 1)
    own, parts = net.features(["a", "b", "cde"])
    tok, mask = np.array([[0, 1], [1, 2], [2, 0]]), np.array([[1, 1], [1, 1], [1, 0]], np.float32)
    label, weight = np.array([1, 0], np.float32), np.ones(2, np.float32)
    _, g = net.gradients(own, parts, tok, mask, label, weight)
    for name in ("hf", "xb", "attend", "out", "cf", "word"):
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].ravel()))[:3]:
            keep, ends = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = keep + step
                ends.append(net.gradients(own, parts, tok, mask, label, weight)[0])
            flat[i] = keep
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[name].ravel()[i], rel=0.05, abs=1e-3)


def test_scores_by_a_plain_forward_pass():
    """Every window a word at a time, by the formulas of gated units and attention."""
    net = toxicity.Network({"a": 1, "b": 2}, np.ones(toxicity.CHAR_BUCKETS + 1, bool), 1)
    net.shift = 0.3
    vocabulary = ["a", "b", "cde", "fgh", "toxic"]
    vec = net.vectors(*net.features(vocabulary)).astype(float)
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def logit(words):
        states = {}
        for way in "fb":
            now, out = np.zeros(h), {}
            for i in range(len(words)) if way == "f" else reversed(range(len(words))):
                x, u = vec[words[i]] @ p[f"x{way}"] + p[f"c{way}"], now @ p[f"h{way}"]
                z, r = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                now = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * now
                out[i] = now
            states[way] = out
        s = np.array([np.concatenate([states["f"][i], states["b"][i]]) for i in range(len(words))])
        a = np.exp(s @ p["attend"])
        return (a / a.sum()) @ (s @ p["out"]) + p["bias"][0]

    rng = random.Random(2)
    texts = [[rng.randrange(5) for _ in range(n)] for n in (1, 5, 64, 65, 96, 97, 200)] + [[]]
    got = net.scores(texts, vec.astype(np.float32))
    for t, score in zip(texts, got, strict=True):
        starts = sorted({min(s, max(0, len(t) - toxicity.WINDOW)) for s in range(0, max(1, len(t) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)})
        want = max((sigmoid(logit(t[s : s + toxicity.WINDOW]) + net.shift) for s in starts), default=0) if t else 0
        assert score == pytest.approx(want, abs=1e-5)


def test_every_passage_is_whole_in_a_window():
    for size in range(1, 400):
        count = max(1, -(-(size - toxicity.WINDOW) // toxicity.STRIDE) + 1)
        starts = [min(k * toxicity.STRIDE, max(size - toxicity.WINDOW, 0)) for k in range(count)]
        assert all(any(s <= at and at + 32 <= s + toxicity.WINDOW for s in starts) for at in range(max(0, size - 31)))


def toxic_tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        ws = words(rng, "en", rng.randint(10, 150)).split()
        y = i % 4 == 0
        if y:
            for _ in range(max(1, len(ws) // 40)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grubble", "snorkface", "dimwort"]))
        rows.append((i, " ".join(ws), "en", "s", 1))
        labels.append((i, 1, int(y)))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    labels += [(None, None, None), (0, 1, 1), (9999, 0, 1), (4, 1, 0), (4, None, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = toxic_tables(spark)
    clash = docs.withColumns({c: F.lit("x") for c in ("score", "toxic", "at", "held_out", "predicted")})
    out = {r.doc_id: r for r in toxicity.score_documents(clash, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [r for i, r in out.items() if r.held_out and i < 500]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.9
    assert out[1000].score == out[1001].score == 0
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, labels.where("false")).collect()} == {0.0}


# --- archives


def test_records_in_any_blocks(monkeypatch):
    rng = random.Random(8)
    payloads = [b"", b"x", bytes(rng.randrange(256) for _ in range(5000)), b"\r\n\r\n" * 50, b"z" * 2_000_000]
    raw = b"".join(warc.record(str(i), f"http://a/{i} \n", p, warc.base32_sha1(p), None, False) for i, p in enumerate(payloads))
    raw += warc.record("9", None, b"abc", warc.base32_sha1(b"abc"), "2", True)
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(warc, "BLOCK", block)
        stream = io.BytesIO(raw if block > 1 else raw[: raw.index(b"\x1f\x8b", 300)])
        got = list(warc.read_records(stream))
        assert got[:2] == [(str(i), len(p), warc.base32_sha1(p), "response", None) for i, p in enumerate(payloads[: len(got)])][:2]
    assert got[-1] == ("9", 3, warc.base32_sha1(b"abc"), "revisit", "2") and [g[1] for g in got[:-1]] == [len(p) for p in payloads]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[:-20])))
    bad = warc.record("1", None, b"abc", warc.base32_sha1(b"abd"), None, False)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad)))


def test_archives(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (4, "u", None), (2, "u", ""), (9, "u", "only"), (3, "v", "same"), (None, "w", "same"), (None, None, "nul\x00é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = sorted((r.page_id or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect())
    digest = lambda t: warc.base32_sha1((t or "").encode())
    first = {digest(None): 2, digest("same"): 3}
    want = []
    for i, _, t in rows:
        revisit = digest(t) in first and i != first[digest(t)]
        want.append(("" if i is None else str(i), len((t or "").encode()), digest(t), "revisit" if revisit else "response", str(first[digest(t)]) if revisit else None))
    assert got == sorted(want, key=lambda x: tuple("" if v is None else v for v in x)) or collections.Counter(got) == collections.Counter(want)
    assert {r.record_type for r in warc.read(warc.write(pages, 100)).collect()} == {"response"}
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_ids_of_any_characters(spark):
    ids = ["", None, "a\nb", "a\r\n\r\nb", "50%2F", "é😀 :>", "same", "same"]
    pages = spark.createDataFrame([(x, None, "p" if x != "same" else "q") for x in ids], "page_id string, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect()]
    first = min(x for x in ids if x is not None and x != "same")
    want = [(x, "response", None) if x in ("same", first) else (x, "revisit", first) for x in ids]
    assert collections.Counter(got) == collections.Counter(want)
    raw = [warc.record("same", None, b"", warc.base32_sha1(b""), None, False, str(k)) for k in range(2)]
    heads = [zlib.decompress(x, 31).split(b"\r\n")[2] for x in raw]
    assert heads[0].startswith(b"WARC-Record-ID") and heads[0] != heads[1]


# --- pipeline


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    copies = docs.where("doc_id < 20 and doc_id % 4 = 1").withColumn("doc_id", F.col("doc_id") + 2000)
    docs = docs.unionByName(copies).withColumn("score", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append((name, at.count()))
        if name != "packing":
            assert at.columns == docs.columns
    kept = {r.doc_id for r in at.collect()}
    assert not any(i >= 2000 for i in kept) and {i for i in range(500) if i % 4} <= kept
    assert seen[0][1] < docs.count() and [n for n, _ in seen] == ["toxicity", "language_id", "near_duplicates", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1][1]


def test_pipeline_of_no_documents(spark, tmp_path, empty):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


