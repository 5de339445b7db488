"""Language identification by partial matching over bytes.

Each language has a context tree over the bytes of a bounded sample of its labelled documents. A node's
distribution gives its symbols count / (total + distinct) and leaves distinct / (total + distinct) for escape to the
node that drops the oldest byte, whose distribution is renormalised over the symbols not seen here; the root escapes to
256 equally likely bytes. Statistics are frozen, so every (context, byte) has a fixed exact code length: what escaping from a
context costs, renormalisation included, is one number of the context, so a tree holds its contexts, their escapes and the
bytes seen after them, and no more. A code length is the sum of the escapes from the longest known context down and of the
byte where it was seen. The model is one such tree a language, so it grows with the sum of the trees; workers remember
code lengths of (context, byte) under all languages in a table of REMEMBERED numbers and forget all when it is full.

Remembered code lengths have 24 bits, sums are doubles: a text's code length is exact to a few parts in 10^8.

Cases: text null or without a letter gives `und` with score 0; no labelled document gives `und` everywhere; the score
is the posterior of the chosen language under equal priors; ties go to the alphabetically first language; a
language none of whose labelled texts has up to BYTES bytes is not learned; rows that repeat a doc_id are rows like any
other, a null doc_id is never learned from; very long texts are coded whole; columns of other names stay out of the way;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import Shared, held_out, learnable, prepare, table

ORDER = 4
#: Contexts seen less often than this in a language's sample are not kept.
LEAST = 3
#: The bound of the training sample: documents and bytes for each language.
DOCS, BYTES = 600, 1_000_000
#: Code lengths that a worker remembers, over all languages.
REMEMBERED = 1 << 22


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among ascending keys, and whether the wanted keys are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


@dataclass
class Tree:
    """One language's contexts by order. A context is a number of 9-bit digits (byte + 1, nearest byte first), so that a shift
    drops its oldest byte. For each order: contexts ascending with what escaping from them costs, and (context, byte) pairs
    ascending with what the byte costs there, in bits."""

    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    pairs: list[np.ndarray]
    costs: list[np.ndarray]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for part in (self.contexts, self.escapes, self.pairs, self.costs) for x in part)

    def bits(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code lengths of bytes after contexts of the whole order: escapes are followed from the longest known context down."""
        order, out = len(self.contexts) - 1, np.zeros(len(byte))
        open_ = np.arange(len(byte))
        for k in range(order, -1, -1):
            at = context[open_] >> (9 * (order - k))
            place, hit = _found(self.pairs[k], at << 8 | byte[open_])
            out[open_[hit]] += self.costs[k][place[hit]]
            open_, at = open_[~hit], at[~hit]
            place, hit = _found(self.contexts[k], at)
            out[open_[hit]] += self.escapes[k][place[hit]]
        out[open_] += 8.0
        return out


class Trees:
    """The trees of all languages, and a bounded memory of code lengths of (context, byte) under all of them: a text's bytes meet it
    at once, and only what it does not have yet goes through the trees, a language at a time."""

    def __init__(self, names: list[str], trees: list[Tree], order: int):
        self.names, self.trees, self.order = names, trees, order
        self.forget()

    def __getstate__(self):
        return self.names, self.trees, self.order

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.trees)

    def forget(self) -> None:
        size = max(10, (REMEMBERED // max(1, len(self.names))).bit_length() - 1)
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.key = np.full(1 << size, -1, np.int64)
        self.cost = np.zeros((1 << size, len(self.names)), np.float32)
        self.used = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _places(self, key: np.ndarray) -> np.ndarray:
        """The places of remembered keys, the free place where their search ends for others."""
        slot = self._slot(key)
        found = self.key[slot]
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.key[slot[open_]]
            open_ = open_[(found != key[open_]) & (found != -1)]
        return slot

    def _remember(self, key: np.ndarray) -> None:
        if self.used + len(key) > len(self.key) // 2:
            self.forget()
        context, byte = key >> 8, key & 255
        costs = np.stack([t.bits(context, byte) for t in self.trees], 1).astype(np.float32)
        self.used += len(key)
        left = np.arange(len(key))
        while len(left):
            slot = self._places(key[left])
            # of keys that end at one free place the first takes it
            _, first = np.unique(slot, return_index=True)
            self.key[slot[first]], self.cost[slot[first]] = key[left[first]], costs[left[first]]
            left = np.delete(left, first)

    def _codes(self, key: np.ndarray) -> np.ndarray:
        slot = self._places(key)
        if (new := self.key[slot] != key).any():
            self._remember(np.unique(key[new]))
            slot = self._places(key)
            if (new := self.key[slot] != key).any():  # all was forgotten on the way
                self._remember(np.unique(key[new]))
                slot = self._places(key)
        return self.cost[slot]

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each text under each language; starts has one more entry than there are texts."""
        out, begin, end = np.zeros((len(starts) - 1, len(self.names))), int(starts[0]), int(starts[-1])
        # what one block needs is remembered at once
        block = min(1 << 18, len(self.key) // 4)
        for lo in range(begin, end, block):
            hi = min(lo + block, end)
            back = max(begin, lo - self.order)
            digit = data[back:hi].astype(np.int64) + 1
            first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
            cuts = starts[first:last]
            key = np.zeros(hi - lo, np.int64)
            for k in range(1, self.order + 1):
                # 0 stands before a text's first byte
                prev = np.zeros(hi - lo, np.int64)
                skip = max(0, k - (lo - back))
                prev[skip:] = digit[lo - back + skip - k : len(digit) - k]
                for j in range(k):
                    at = cuts + j
                    prev[at[(at >= lo) & (at < hi)] - lo] = 0
                key <<= 9
                key |= prev
            key <<= 8
            key |= digit[lo - back :] - 1
            inner = np.clip(cuts - lo, 0, None)
            keep = np.append(np.diff(np.append(inner, hi - lo)) > 0, False)[: len(inner)]
            out[first:last][keep] += np.add.reduceat(self._codes(key), inner[keep], axis=0, dtype=np.float64)
        return out


def grown(texts: list[bytes], order: int) -> Tree:
    """The context tree of whole texts."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tree, context = Tree([], [], [], []), np.zeros(len(data), np.int64)
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(order + 1):
        if k:
            context[k:] = context[k:] << 9 | (data[:-k] + 1)
        ok = inside >= k
        pair, n = np.unique(context[ok] << 8 | data[ok], return_counts=True)
        ctx, row = np.unique(pair >> 8, return_inverse=True)
        keep = np.bincount(row, n, len(ctx)) >= (LEAST if k else 1)
        some = keep[row]
        pair, n, row, ctx = pair[some], n[some], (np.cumsum(keep) - 1)[row[some]], ctx[keep]
        total, distinct = np.bincount(row, n, len(ctx)), np.bincount(row, minlength=len(ctx))
        if below is None:
            left = (256 - distinct) / 256
        else:
            # whatever is seen here is seen after the shorter context too
            seen = below[1][np.searchsorted(below[0], (pair >> 17) << 8 | (pair & 255))]
            left = 1 - np.bincount(row, seen, len(ctx))
        more = left > 1e-12
        bottom = total + np.where(more, distinct, 0)
        share = n / bottom[row]
        below = pair, share
        tree.contexts.append(ctx), tree.pairs.append(pair), tree.costs.append(-np.log2(share))
        tree.escapes.append(np.where(more, np.log2(np.where(more, left, 1)) - np.log2(distinct / bottom), 0.0))
    return tree


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Trees:
    """One tree for each language from whole texts."""
    names = sorted(samples)
    return Trees(names, [grown(samples[n], order) for n in names], order)


def sample(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, list[bytes]]:
    """Whole texts for each language, in order of a hash of the key: the first DOCS texts that have BYTES bytes together.
    Bounds are applied before texts are collected."""
    size = F.octet_length(F.col(text))
    rows = docs.where(learnable(key) & F.col(lang).isNotNull() & (size <= BYTES))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.5 * DOCS / n + 20 / n))])
    at = (F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 11) / float(1 << 53)).alias("at")
    picked = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), at, F.col(key).cast("string").alias("key"), size.alias("size"))
    picked = picked.where(F.col("at") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    # repeated keys may pass together, so their number is bounded in Spark; a window holds sizes and digests, no texts
    slim = picked.select("lang", "at", "key", "size", F.md5("text").alias("digest"))
    w = Window.partitionBy("lang").orderBy("at", "key", "digest")
    slim = slim.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= DOCS).withColumn("used", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = {(r["lang"], r["key"], r["digest"]): r["nth"] for r in slim.where(F.col("used") <= BYTES).collect()}
    chosen = docs.sparkSession.createDataFrame([(*k, n) for k, n in kept.items()], "lang string, key string, digest string, nth int")
    full = picked.withColumn("digest", F.md5("text")).join(F.broadcast(chosen), ["lang", "key", "digest"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(full.collect(), key=lambda r: (r["lang"], r["nth"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def with_language(docs: DataFrame, trees: Trees | None, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred, score, bits_per_byte (null where nothing is coded)."""
    kind = "struct<lang_pred:string,score:double,bits_per_byte:double>"
    if trees is None:
        return docs.withColumn(into, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte")))
    shared = Shared(docs.sparkSession, trees)

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            starts = np.frombuffer(batch.buffers()[1], np.int32 if pa.types.is_string(batch.type) else np.int64)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
            raw = batch.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            bits = model.bits(data, starts)
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            score = 1 / np.exp2(least[:, None] - bits).sum(1)
            size = np.maximum(np.diff(starts), 1)
            yield pa.StructArray.from_arrays([pa.array(np.array(model.names, object)[best], pa.string()), pa.array(score), pa.array(least / size)], ["lang_pred", "score", "bits_per_byte"])

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn(into, predict(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(
        into,
        F.struct(
            F.when(spoken, F.col(into)["lang_pred"]).otherwise("und").alias("lang_pred"),
            F.when(spoken, F.col(into)["score"]).otherwise(0.0).alias("score"),
            F.when(spoken, F.col(into)["bits_per_byte"]).alias("bits_per_byte"),
        ),
    )


def learn(docs: DataFrame) -> Trees | None:
    found = sample(docs)
    return train(found) if found else None


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    prepare(docs.sparkSession)
    trees = learn(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    out = with_language(rows, trees)
    return out.select("doc_id", "held_out", F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def keep_known_languages(spark, docs: DataFrame, sf_dir: str, most_bits: float = 8.0) -> DataFrame:
    """Pipeline stage: documents without a letter, or that no language codes better than most_bits a byte, go."""
    prepare(spark)
    trees = learn(docs)
    out = with_language(docs.withColumn("\u0001text", F.col("text")), trees, "\u0001text", "\u0001language")
    known = (F.col("\u0001language")["lang_pred"] != "und") & (F.coalesce(F.col("\u0001language")["bits_per_byte"], F.lit(0.0)) <= most_bits)
    return out.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])
