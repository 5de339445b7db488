"""The conversation trie against a plain dictionary of beginnings."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import trie
from palimpsest.llm.common import prepare

KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(set)
    for key in members:
        if key:
            children[key[:-1]].add(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    out = []
    for key, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(key))
        out.append((min(ms), len(key), min(members[key[:-1]]) if key else None, len(ms), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def compared(spark, rows):
    table = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("n", "node", "class", "digest", "pos", "members")}).repartition(3)
    out = trie.conversation_trie(table)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {k for n, k in out.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 260, 3), 1000, 1100, 1105, -7, -100, -205, 70_000, 140_007, 140_107]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é😀", "", None])))
    rows += [(5, None, None, "first"), (5, None, "user", None), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (None, 0, "user", "x")]
    compared(spark, rows)


def test_copies_prefixes_and_long_shared_beginnings(spark):
    """Sequences that differ after more turns than a round takes, one that is the beginning of another, and copies."""
    rows = []
    for c in (200, 300, 400, 70_000, 140_000):
        rows += [(c, t, "user", f"t{t}") for t in range(20)]
    rows += [(500, t, "user", f"t{t}" if t < 19 else "other") for t in range(25)]
    rows += [(600, t, "user", f"t{t}") for t in range(11)]
    rows += [(700, t, "user", f"t{t}" if t else "start") for t in range(30)]
    rows += [(800 + 100 * k, 0, "user", "common") for k in range(50)]
    compared(spark, rows)


def test_only_one_sequence_and_none(spark):
    compared(spark, [(c, t, "u", "x" * t) for c in (100, 200, 300) for t in range(3)])
    # nothing is left of a conversation whose own turns are all replaced by none
    alone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 >= 2)
    compared(spark, [(alone, 0, "u", "x"), (alone, 1, "u", "y")])
    compared(spark, [(alone, 0, "u", "x"), (300, 0, "u", "x")])
    assert trie.conversation_trie(spark.createDataFrame([], KIND)).count() == 0


def test_long_conversation_is_numbered_in_segments(spark):
    rows = [(200, t, "u", "x") for t in range(9000)] + [(300, t, "u", "x") for t in range(9000)] + [(200, None, "u", "y")]
    table = spark.createDataFrame(rows, KIND)
    got = trie.numbered(table).groupBy("conv_id").agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).collect()
    assert {tuple(r) for r in got} == {(200, 9001, 9001, 9001), (300, 9000, 9000, 9000)}
    twice = spark.createDataFrame([(c, t, "u", "x") for c in (200, 300) for t in range(9000)], KIND)
    out = trie.conversation_trie(twice).where("depth in (0, 4096, 9000)").orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.saved_tokens, r.n_children) for r in out] == [(0, 2, 9000, 1), (4096, 2, 4905, 1), (9000, 2, 1, 0)]
