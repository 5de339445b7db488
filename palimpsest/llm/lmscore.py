"""Language-model scoring by cross-entropy difference.

Two bigram models, of target texts and of all (background) texts, share one vocabulary: every word of the background and
one unseen word. Both have the same form: add-half unigrams, and Dirichlet-smoothed bigrams
p(w|h) = (c(h, w) + MASS * p(w)) / (c(h) + MASS), with c(h, w) the count of that very pair of words in all documents, so
the probabilities after any history sum to 1. A document's score is the mean over its words of target loss minus
background loss, in nats: the lower, the more it is like the target.

Words are lower-cased and white-space separated; a document's first word follows a start mark. Documents are laid out in
blocks of about BLOCK characters, written once. A block asks for the corpus counts of its distinct words and pairs: each
goes by its 64-bit hash to one of many ranges of hashes, where the counts of all blocks are added up and sent back in the
order in which they were asked. So what a model holds grows with the corpus, nothing is sampled, dropped or put in tables
of a fixed size, no task or driver holds a model, and a word that is everywhere costs one entry for each block. (Two of
10^9 different pairs share a hash with a chance of about 3 %.)

Cases: null and empty texts have 0 words and null losses; without target texts, target counts are 0 and the target
model is uniform; rows that repeat a doc_id or a text count and are scored each; label rows that repeat a doc_id make it
a target if any does; a null doc_id is never a target; very long texts are a block each; columns other than doc_id and
text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batch_rows, bucketed, join_hot, prepare, table, written

MASS = 200.0
#: Characters and rows after which a block ends.
BLOCK, BLOCK_ROWS = 8 << 20, 1 << 16
#: Words of the corpus for each range of hashes, and ranges for each shuffle partition at least.
RANGE_WORDS, RANGES = 2_000_000, 4


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers below 2**64 by planes of bytes, compressed."""
    raw = np.stack([c.astype("<u8") for c in columns])
    return zlib.compress(raw.view(np.uint8).reshape(*raw.shape, 8).transpose(0, 2, 1).tobytes(), 1)


def unpacked(blob: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<u8")[..., 0].astype(np.uint64)


class Block:
    """The distinct words and pairs of some texts, each in order of their hashes. Word 0 is the start mark before sorting."""

    def __init__(self, texts: list[str | None]):
        number, flat, sizes = {"": 0}, [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            flat += words
        for w in flat:
            if w not in number:
                number[w] = len(number)
        self.sizes = np.array(sizes, np.int64)
        word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word, self.word_hash = place[word], hashes[order]
        self.history = np.append(place[0], self.word[:-1])[: len(word)]
        first = np.cumsum(self.sizes) - self.sizes
        self.history[first[self.sizes > 0]] = place[0]
        pair, where = np.unique(self.history * len(order) + self.word, return_inverse=True)
        with np.errstate(over="ignore"):
            h = mixed(mixed(self.word_hash[pair // len(order)]) * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[pair % len(order)])
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair, self.pair_hash = place[where], h[order]
        self.pair_history, self.pair_word = np.divmod(pair[order], max(1, len(self.word_hash)))

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: times in target texts and in all, then the same as a history; of each pair: times in both."""
        of = np.repeat(target.astype(np.float64), self.sizes)
        n = len(self.word_hash)
        one = [np.bincount(x, w, n) for x in (self.word, self.history) for w in (of, None)]
        return np.stack(one).astype(np.int64), np.stack([np.bincount(self.pair, w, len(self.pair_hash)) for w in (of, None)]).astype(np.int64)

    def losses(self, one: np.ndarray, two: np.ndarray, size: int, total: list[int]) -> np.ndarray:
        """Sums over each text's words of the loss under target and background, from the corpus counts of the block's
        words and pairs."""
        out = np.zeros((2, len(self.sizes)))
        some = self.sizes > 0
        first = (np.cumsum(self.sizes) - self.sizes)[some]
        for k in (0, 1):
            # every word but the start mark can come up
            p = (one[k] + 0.5) / (total[k] + 0.5 * (size + 1))
            loss = np.log(one[2 + k][self.pair_history] + MASS) - np.log(two[k] + MASS * p[self.pair_word])
            if len(first):
                out[k, some] = np.add.reduceat(loss[self.pair], first)
        return out


def cuts_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins among sorted hashes."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, doc_ids and texts, which are all of docs(doc_id, text), written in buckets by block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def block():
            one = pa.Table.from_batches(held).combine_chunks()
            columns = [pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in one.columns]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *columns], ["block", "doc_ids", "texts"])

        for batch in batches:
            text = batch.column(1)
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                # at least one text, then as many as end within the block
                base = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, base + BLOCK - size, "right")))
                end = min(end, begin + BLOCK_ROWS - rows, batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                size, rows, begin = size + int(sizes[end - 1] - base), rows + end - begin, end
                if size >= BLOCK or rows >= BLOCK_ROWS or begin < batch.num_rows:
                    yield block()
                    at, held, size, rows = at + 1, [], 0, 0
        if held:
            yield block()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, doc_ids array<{kind}>, texts array<string>")
    return bucketed(rows, "blocks", "block")


def targets_of(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """block and the places in it of documents named by targets(doc_id); only ids are shuffled."""
    each = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).where(F.col("doc_id").isNotNull())
    named = targets.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    many = each.groupBy("doc_id").agg(F.count("*").alias("n")).join(named.hint("merge"), "doc_id").select("doc_id", "n", F.lit(True).alias("named"))
    found = join_hot(each, written(many, "targets"), "doc_id", max(1, each.count())).where("named")
    return found.groupBy("block").agg(F.collect_list("place").alias("places"))


def asked(blocks: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """part (range of hashes), block, and the hashes of the block's words and pairs there with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, places = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                own, target = Block(texts), np.zeros(len(texts), bool)
                target[places or []] = True
                out = [[], [], []]
                kinds = [(h, n, cuts_of(h, ranges)) for h, n in zip((own.word_hash, own.pair_hash), own.counts(target), strict=True)]
                for part in np.flatnonzero((np.diff(kinds[0][2]) > 0) | (np.diff(kinds[1][2]) > 0)).tolist():
                    out[0].append(part)
                    for k, (h, n, cut) in enumerate(kinds):
                        some = slice(cut[part], cut[part + 1])
                        out[1 + k].append(packed(np.diff(h[some], prepend=np.uint64(0)), *n[:, some]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["part", "block", "words", "pairs"])

    rows = blocks.join(targets.hint("merge"), "block", "left").select("block", "texts", "places")
    return rows.mapInArrow(run, "part int, block long, words binary, pairs binary")


def answered(questions: DataFrame) -> DataFrame:
    """The rows of asked() with corpus counts instead, and on one row of each range how many different words are there,
    and how often words come up there in target and all texts."""

    def added(blobs: list[bytes], columns: int) -> tuple[list[bytes], np.ndarray]:
        parts = [unpacked(b, columns + 1) for b in blobs]
        cut = np.cumsum([0] + [p.shape[1] for p in parts])
        with np.errstate(over="ignore"):
            hashes = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        every, where = np.unique(hashes, return_inverse=True)
        sums = np.stack([np.bincount(where, np.concatenate([p[1 + k] for p in parts]).astype(np.float64), len(every)) for k in range(columns)]).astype(np.int64)
        return [packed(*sums[:, where[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)], sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            words, sums = added([x[1] for x in held], 4)
            pairs, _ = added([x[2] for x in held], 2)
            fresh = [[int((sums[1] > 0).sum())], [int(sums[0].sum())], [int(sums[1].sum())]]
            n = len(held)
            for lo in range(0, n, 256):
                hi = min(n, lo + 256)
                columns = [pa.array([now] * (hi - lo), pa.int32()), pa.array([x[0] for x in held[lo:hi]], pa.int64()), pa.array(words[lo:hi], pa.binary()), pa.array(pairs[lo:hi], pa.binary())]
                columns += [pa.array((x if lo == 0 else [0]) + [0] * (hi - lo - 1), pa.int64()) for x in fresh]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "words", "pairs", "size", "total_0", "total_1"])

        for batch in batches:
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from close()
                    held = []
                now = part
                held.append(rest)
        if held:
            yield from close()

    spread = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = questions.repartition(spread, "part").sortWithinPartitions("part", "block")
    return written(rows.mapInArrow(run, "part int, block long, words binary, pairs binary, size long, total_0 long, total_1 long"), "answers")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, words, target_loss, background_loss, difference for every row of docs(doc_id, text); targets(doc_id)
    names the documents of the target."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = blocks_of(docs)
    # about six characters a word
    words = (blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.length(t), F.lit(0))))).first()[0] or 0) // 6
    ranges = int(max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // RANGE_WORDS)))
    with batch_rows(spark, 4):
        answers = answered(asked(blocks, targets_of(blocks, targets), ranges))
    size, *total = (x or 0 for x in answers.agg(F.sum("size"), F.sum("total_0"), F.sum("total_1")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Block(batch.column(2)[i].as_py())
                replies = sorted(batch.column(3)[i].as_py(), key=lambda x: x["part"])
                one, two = (np.concatenate([np.zeros((n, 0), np.uint64), *[unpacked(x[name], n) for x in replies]], 1).astype(np.float64) for name, n in (("words", 4), ("pairs", 2)))
                sums = own.losses(one, two, size, total)
                none = own.sizes == 0
                with np.errstate(invalid="ignore"):
                    mean = [pa.array(s / own.sizes, mask=none) for s in (*sums, sums[0] - sums[1])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(own.sizes), *mean], ["doc_id", "words", "target_loss", "background_loss", "difference"])

    replies = answers.groupBy("block").agg(F.collect_list(F.struct("part", "words", "pairs")).alias("replies"))
    rows = blocks.join(replies.hint("merge"), "block").select("block", "doc_ids", "texts", "replies")
    return rows.mapInArrow(run, f"doc_id {kind}, words long, target_loss double, background_loss double, difference double")


def op4_cross_entropy_difference(spark, sf_dir):
    found = cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return found.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])


#: The same model from real strings. White space and lower case as far as the tables go: letters of Latin script.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, d.doc_id, coalesce(d.text, '') AS text, q.doc_id IS NOT NULL AS target
           FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) q ON d.doc_id = q.doc_id),
w AS (SELECT row, target, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT row, target, unnest(ws) AS word, unnest(list_prepend('', ws)[1:len(ws)]) AS history FROM w),
two AS (SELECT history, word, count(*) FILTER (target) AS n0, count(*) AS n1 FROM t GROUP BY history, word),
one AS (SELECT word, sum(n0) AS n0, sum(n1) AS n1 FROM two GROUP BY word),
after AS (SELECT history, sum(n0) AS n0, sum(n1) AS n1 FROM two GROUP BY history),
total AS (SELECT count(*) AS size, sum(n0) AS n0, sum(n1) AS n1 FROM one),
loss AS (SELECT two.history, two.word,
                -ln((two.n0 + 200 * (one.n0 + 0.5::DOUBLE) / (total.n0 + 0.5::DOUBLE * (size + 1))) / (after.n0 + 200)) AS l0,
                -ln((two.n1 + 200 * (one.n1 + 0.5::DOUBLE) / (total.n1 + 0.5::DOUBLE * (size + 1))) / (after.n1 + 200)) AS l1
         FROM two JOIN one USING (word) JOIN after ON two.history = after.history CROSS JOIN total),
s AS (SELECT row, count(*) AS words, avg(l0) AS l0, avg(l1) AS l1 FROM t JOIN loss ON t.history = loss.history AND t.word = loss.word GROUP BY row)
SELECT doc_id, coalesce(words, 0)::BIGINT AS words, round(l0, 6) AS target_loss, round(l1, 6) AS background_loss, round(l0 - l1, 6) AS difference
FROM d LEFT JOIN s ON d.row = s.row
"""
