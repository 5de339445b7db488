"""Prefix trie of conversations by partition refinement.

Conversations with equal turns are one sequence with a count, told by their number of turns and 128 bits of hashes of (place,
digest of the turn). All sequences start in one class. A round takes the next STRIDE turns of the sequences of active classes
and splits each class turn by turn: a class of a turn is the digest of its class before and of the turn. Classes of one
sequence retire: the rest of that sequence is a unary chain, emitted from its turns without further rounds. Classes of two or
more stay active while they have turns left, so rounds end with the longest beginning that two different sequences share.

A node is known by its smallest member and its depth. The nodes that a sequence is the smallest member of end its own path, so
folding back needs no further rounds: along its path each sequence sums, from the end, what the nodes that it owns save and what
its chain saves, and a node adds up these sums of its members.

Hot groups: a conversation is numbered in segments of its turns; frequent classes and long conversations meet their rows by
checked broadcast (join_hot); members' ids are joined in chunks of 65,536 possible ids, and groups of several chunks pass
through the hash as a stream.

Cases: rows without conv_id are left out; a null turn comes first, equal turn numbers go by the digest of role and text; null
role or text is empty; a conversation of which nothing is left after rebuilding is a member of the root alone; c % 100 has the
sign of c; repeated rows are turns of their own; other columns are not looked at; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import drop, join_hot, prepare, table, written

#: Turns that a round splits classes by; bits of the turn numbers of a segment, and of the ids of a chunk.
STRIDE, SEGMENT, CHUNK = 8, 12, 16
EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and size (code points of the text) of every turn, numbered in segments of turn numbers, so
    that no task sorts a whole conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.floor(F.col("turn") / (1 << SEGMENT)), F.lit(-(1 << 62))).alias("segment"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.length(text).cast("long").alias("size"),
    )
    parts = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = rows.withColumn("nth", F.row_number().over(order))
    return rows.join(parts, (F.col("conv_id") == F.col("_c")) & (F.col("segment") == F.col("_s"))).select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, pos, digest, size) with the first h turns of conversation c - c % 100 in place of a conversation's own first
    h, h = crc32(c) % 6; and every conv_id, also of those without turns."""
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string").cast("binary")) % 6
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", shared.alias("h"), (c - c % 100).alias("base"))
    bases = turns.where((c % 100 == 0) & (F.col("pos") <= 5))
    counts = bases.groupBy(c.alias("of")).agg(F.count("*").alias("there"))
    convs = written(own.join(counts, F.col("base") == F.col("of"), "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "conversations")
    first = bases.select(c.alias("of"), "pos", "digest", "size")
    taken = convs.join(first, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("h"))).select("conv_id", "pos", "digest", "size")
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = join_hot(turns, convs.select("conv_id", "n", "h", "taken"), "conv_id", total).where(F.col("pos") > F.col("h"))
    return taken.unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size")), convs.select("conv_id")


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct conversations: conv_id (the smallest member), n_turns, members, ends (SHA-256 of the joined ids of members)."""
    places = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bit_xor(F.xxhash64("pos", "digest")).alias("one"), F.bit_xor(F.xxhash64("digest", F.lit("-"), "pos")).alias("two"))
    places = places.withColumnRenamed("conv_id", "of")
    whole = convs.join(places, F.col("conv_id") == F.col("of"), "left").select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_turns", "one", "two")])
    group = ["n_turns", "one", "two"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = written(whole.groupBy(*group, F.floor(F.col("conv_id") / (1 << CHUNK)).alias("chunk")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")), "members")
    groups = chunks.groupBy(*group).agg(F.sum("n").alias("members"), F.min("least").alias("conv_id"), F.count("*").alias("chunks"), F.sha2(F.first("ids"), 256).alias("ends"))
    wide = groups.where("chunks > 1").select(*[F.col(g).alias(f"_{g}") for g in group])
    streamed = chunks.join(wide, (F.col("n_turns") == F.col("_n_turns")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")))
    streamed = streamed.select(*group, "chunk", "ids").repartition(*group).sortWithinPartitions(*group, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def made():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in held], pa.array([state.hexdigest()])], ["_n_turns", "_one", "_two", "streamed"])

        for batch in batches:
            for *key, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held:
                    if held is not None:
                        yield made()
                    held, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
        if held is not None:
            yield made()

    long = streamed.mapInArrow(run, "_n_turns long, _one long, _two long, streamed string")
    out = groups.join(long, (F.col("n_turns") == F.col("_n_turns")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left")
    return written(out.select("conv_id", "n_turns", "members", F.coalesce("streamed", "ends").alias("ends")), "sequences")


def refined(turns: DataFrame) -> DataFrame:
    """The classes of two or more sequences on the path of each: conv_id (the sequence), pos, size, members, n_turns, node (the
    class's smallest member), n_convs. turns(conv_id, pos from 0, digest, size, members, n_turns) of distinct sequences."""
    lo, active, out = 0, None, None
    while True:
        block = turns.where(F.col("pos").between(lo, lo + STRIDE - 1))
        if active is None:
            block = block.withColumn("class", F.lit(""))
        else:
            block = block.join(active.select(F.col("conv_id").alias("_c"), "class"), F.col("conv_id") == F.col("_c")).drop("_c")
        block = block.groupBy("conv_id", "members", "n_turns", "class").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("at"))
        split = F.transform("at", lambda x, i: F.struct(x["pos"].alias("pos"), x["size"].alias("size"), _digest(F.col("class"), F.array_join(F.slice(F.col("at")["digest"], F.lit(1), i + 1), "")).alias("class")))
        block = written(block.select("conv_id", "members", "n_turns", F.inline(split)), "block")
        classes = written(block.groupBy("class").agg(F.count("*").alias("n"), F.min("conv_id").alias("node"), F.sum("members").alias("n_convs")), "classes")
        # classes of one sequence retire
        classes_of_several = classes.where("n > 1")
        shared = written(join_hot(block, classes_of_several, "class", max(1, block.count())).where(F.col("node").isNotNull()), "shared")
        drop(block, classes)
        out = shared.drop("class") if out is None else out.unionByName(shared.drop("class"))
        lo += STRIDE
        active = shared.where((F.col("pos") == lo - 1) & (F.col("n_turns") >= lo)).select("conv_id", "class")
        if active.limit(1).count() == 0:
            return out


def _from_the_end(rows: DataFrame, value: str) -> DataFrame:
    """Sum of value over this and later places of each conv_id as `after`, in segments of places."""
    rows = rows.withColumn("_segment", F.floor(F.col("pos") / (1 << SEGMENT)))
    parts = rows.groupBy(F.col("conv_id").alias("_c"), F.col("_segment").alias("_s")).agg(F.sum(value).alias("_sum"))
    later = F.sum("_sum").over(Window.partitionBy("_c").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_c", "_s", F.coalesce(later, F.lit(0)).alias("_later"))
    inner = F.sum(value).over(Window.partitionBy("conv_id", "_segment").orderBy(F.desc("pos")))
    rows = rows.withColumn("_inner", inner).join(parts, (F.col("conv_id") == F.col("_c")) & (F.col("_segment") == F.col("_s")))
    return rows.withColumn("after", F.col("_inner") + F.col("_later")).drop("_segment", "_c", "_s", "_inner", "_later")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie of
    turns(conv_id, pos from 1, digest, size); convs has every conv_id."""
    turns = written(turns, "turns")
    seqs = sequences(turns, convs)
    total = max(1, turns.count())
    own = join_hot(turns, seqs.select("conv_id", F.col("n_turns").alias("n"), "members", "n_turns"), "conv_id", total).where(F.col("members").isNotNull())
    roots = seqs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("size"), "members", "n_turns")
    own = written(own.unionByName(roots), "sequence_turns")
    shared = written(refined(own), "paths")
    # where each sequence leaves the classes that it shares, and the node that its chain hangs on
    leaves = shared.groupBy(F.col("conv_id").alias("_c")).agg((F.max("pos") + 1).alias("chain"), F.max_by("node", "pos").alias("parent"))
    seqs = written(seqs.join(leaves, F.col("conv_id") == F.col("_c"), "left").select("conv_id", "n_turns", "members", "ends", F.coalesce("chain", F.lit(0)).cast("long").alias("chain"), "parent"), "leaves")

    chains = join_hot(own.select("conv_id", "pos", "size"), seqs.withColumn("n", F.col("n_turns") + 1), "conv_id", total + 1).where(F.col("pos") >= F.col("chain"))
    chains = chains.withColumn("saves", (F.col("members") - 1) * F.col("size"))
    saving = written(_from_the_end(chains.where("members > 1"), "saves"), "chains")
    chains = chains.where("members = 1").withColumn("after", F.lit(0).cast("long")).unionByName(saving)
    chains = chains.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == 0, None).when(F.col("pos") == F.col("chain"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("after").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("n_turns"), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )

    # fold back: what a sequence's own nodes and its chain save, summed from the end of its path, is added at each node
    saved = saving.where(F.col("pos") == F.col("chain")).select(F.col("conv_id").alias("_c"), F.col("after").alias("chain_saves"))
    ends = seqs.join(saved, F.col("conv_id") == F.col("_c"), "left").select(F.col("conv_id").alias("_of"), "ends", (F.col("chain") <= F.col("n_turns")).cast("long").alias("leaf"), F.coalesce("chain_saves", F.lit(0)).alias("chain_saves"))
    paths = _from_the_end(shared.withColumn("owned", F.when(F.col("node") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("size")).otherwise(0)), "owned")
    paths = paths.withColumn("up", F.lag("node").over(Window.partitionBy("conv_id").orderBy("pos"))).join(ends, F.col("conv_id") == F.col("_of"))
    nodes = paths.groupBy("node", "pos").agg(
        F.max("up").alias("up"), F.max("n_convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("after") + F.col("chain_saves")).alias("saved_tokens"),
        F.max(F.when(F.col("pos") == F.col("n_turns"), F.col("ends"))).alias("ends"),
    )
    nodes = written(nodes, "nodes")
    below = nodes.where("pos > 0").select("up", (F.col("pos") - 1).alias("at")).unionByName(seqs.where("chain > 0 and chain <= n_turns").select(F.col("parent").alias("up"), (F.col("chain") - 1).alias("at")))
    below = below.groupBy("up", "at").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "_up")
    inner = nodes.join(below, (F.col("node") == F.col("_up")) & (F.col("pos") == F.col("at")), "left").select(
        F.col("node").alias("conv_id"), F.col("pos").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return inner.unionByName(chains)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as rebuilt() shares their first turns."""
    prepare(conversations.sparkSession)
    return prefix_trie(*rebuilt(written(numbered(conversations), "numbered")))


def op11_conversation_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos, digest, length(text) AS size FROM t),
ids AS (SELECT DISTINCT c, c - c % 100 AS base, c::VARCHAR AS s FROM n),
h AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::UBIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))),
             4294967295::UBIGINT) % 6 AS h FROM ids),
k AS (SELECT h.c, h.base, h.h::BIGINT AS h, count(n.pos) AS taken FROM h LEFT JOIN n ON n.c = h.base AND n.pos <= h.h GROUP BY ALL),
r AS (SELECT c, 0 AS pos, '' AS digest, 0 AS size FROM k
      UNION ALL SELECT k.c, n.pos, n.digest, n.size FROM k JOIN n ON n.c = k.base AND n.pos <= k.h
      UNION ALL SELECT n.c, n.pos - k.h + k.taken, n.digest, n.size FROM n JOIN k USING (c) WHERE n.pos > k.h),
p AS (SELECT c, pos, size, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS key, max(pos) OVER (PARTITION BY c) AS turns FROM r),
q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY pos) AS up FROM p),
node AS (SELECT key, any_value(up) AS up, min(c) AS conv_id, any_value(pos) AS depth, count(*) AS n_convs, any_value(size) AS size,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (pos = turns), '')) AS ends_sha256 FROM q GROUP BY key),
child AS (SELECT up, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT DISTINCT a.key AS top, d.key FROM p a JOIN p d ON a.c = d.c AND a.pos <= d.pos),
total AS (SELECT top, count(*) FILTER (child.up IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
          FROM under JOIN node ON node.key = under.key LEFT JOIN child ON child.up = under.key GROUP BY top)
SELECT node.conv_id, node.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n_children, 0)::BIGINT AS n_children,
       total.n_leaves, total.saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN total ON total.top = node.key LEFT JOIN child ON child.up = node.key LEFT JOIN node parent ON parent.key = node.up
"""
