"""Fingerprints against a walk told step by step."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fingerprints as P
from palimpsest.llm.common import prepare

DOCS = "doc_id long, text string, lang string"
ODD = ["", None, "x", "ab", "abc", "   \n\t ", "日本語 テキスト 😀" * 5, "a" * 40_000, "word " * 3000, "é" * 7]


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def plain(text):
    """The fingerprint's parts, a step at a time."""
    codes = P._codes([text])[1]
    shared, level = P.walks(), P.level_of(len(text))
    stay = shared.stay.reshape(P.PERIOD, P.WALKS, 256)
    steps, symbols = [], []
    for w in range(P.WALKS):
        places = []
        for i, c in enumerate(codes):
            places += [i] * int(stay[len(places) % P.PERIOD, w, c])
        at = shared.sampled(level, len(places))
        points = np.array([ord(c) for c in text], np.uint32)
        place = np.array([places[s] for s in at], np.int64)
        size = np.full(len(at), len(text))
        symbols.append(P._symbols(points, place, size, np.zeros(len(at), np.int64), size, np.zeros(len(at), np.int64), at) if len(at) else np.zeros(0, np.uint8))
        steps.append(len(places))
    return str(P.Print(level, steps, symbols))


def edited(a, b):
    third = len(a) // 3
    return a[: len(a) - third] + b[:third]


def test_walks_by_steps_and_edits_by_whole_texts():
    rng = random.Random(1)
    texts = [words(rng, rng.choice([1, 3, 40, 700])) for _ in range(30)] + [t or "" for t in ODD]
    got, changed, now = P.fingerprinted(texts, len(texts) - 1)
    assert [str(p) for p in got] == [plain(t) for t in texts]
    assert now == [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    assert [str(p) for p in changed] == [plain(t) for t in now]
    assert all(str(P.Print.of(str(p))) == str(p) for p in got)


def test_stays_are_those_of_random_bits():
    stay = P.walks().stay.reshape(P.PERIOD, P.WALKS, 256)
    after = np.roll(stay, -1, 0)
    assert ((stay == 1) | (stay == after + 1)).all() and abs((stay == 1).mean() - 0.5) < 0.01


def test_likeness_follows_edits():
    rng = random.Random(2)
    for n in (60, 400, 3000):
        base = words(rng, n)
        other = words(rng, n)
        near = list(base)
        for _ in range(max(1, n // 100)):
            near.insert(rng.randrange(len(near)), "z")
        a, b, c, d = (p for p in P.fingerprinted([base, "".join(near), edited(base, other), other], 0)[0])
        assert P.likeness(a, a) == 1 and P.likeness(a, b) > 0.5 and 0.5 < P.likeness(a, c) < 0.8 and P.likeness(a, d) < 0.15
        assert P.likeness(b, a) == P.likeness(a, b)
    empty, small = P.fingerprinted(["", "x"], 0)[0]
    assert P.likeness(empty, empty) == 1 and P.likeness(empty, small) == 0


@pytest.mark.parametrize("group", [200, P.GROUP_CHARS])
def test_query_by_brute_force(spark, monkeypatch, group):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 60)), "en") for i in range(60)] + [(100 + i, t, None) for i, t in enumerate(ODD)]
    rows += [(7, rows[7][1], "en"), (None, "no key", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("fingerprint", "part", "edge", "after", "n_chars")}).repartition(5)
    # tasks read the module anew, so the bound is set where they see it
    run = P._rows
    monkeypatch.setattr(P, "GROUP_CHARS", group)
    out = P.edited_fingerprints(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(out) == len(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in out)
    want = []
    for k, (key, text, _) in enumerate(ordered):
        a, b = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n, sha, fp, efp, near, following = run([a, b], 1)[0]
        assert sha == hashlib.sha256(edited(a, b).encode()).hexdigest()
        want.append((key is None, key or 0, n, sha, fp, efp, near, following))
    assert got == sorted(want)


def test_single_document_and_none(spark):
    docs = spark.createDataFrame([(1, "abcdef", "x")], DOCS)
    (r,) = P.edited_fingerprints(docs).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1
    assert P.edited_fingerprints(docs.where("false")).count() == 0


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        base = words(rng, rng.choice([30, 200, 900]))
        for m in range(4):
            text = list(base)
            if m:
                text.insert(len(text) - 5 * m, "Q")
            rows.append((10 * k + m, "".join(text), "en"))
            want[10 * k + m] = 10 * k
    # a large group of equal texts, and one of texts that differ near their end
    rows += [(1000 + i, rows[0][1], "en") for i in range(300)]
    big = words(rng, 150)
    rows += [(2000 + i, big + str(i), "en") for i in range(700)]
    want |= {1000 + i: 0 for i in range(300)} | {2000 + i: 2000 for i in range(700)}
    rows += [(5000, None, None), (5001, "", None), (None, rows[4][1], None)]
    want |= {5000: 5000, 5001: 5000, None: rows[4][0]}
    docs = spark.createDataFrame(rows, DOCS)
    prints = P.edited_fingerprints(docs).select("doc_id", "fingerprint")
    got = {r.doc_id: r.class_id for r in P.near_duplicates(prints.withColumn("n", F.lit(1))).collect()}
    assert got == want
    assert P.near_duplicates(prints.where("false")).count() == 0
