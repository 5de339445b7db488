"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are WORDS consecutive words (white space apart), or all words of a shorter text. A shingle's weight is its
count in the text times idf = 1 + SPREAD * ln((N + 1) / (df + 1)) / ln(N + 1), with df counted over all documents in
BUCKETS hashed buckets (as hashed TF-IDF does, so the table has a fixed size); the small SPREAD keeps weighted Jaccard
similarity near the plain one, which matters where a large group of copies makes its own shingles frequent.
SAMPLES consistent samples of each text are banded; texts that share a band become candidates if their samples agree
often enough, and a pair is a link only if its exact weighted Jaccard similarity is at least SIMILAR. Classes are the
connected components of links; exact copies share a class by their digest before any of this.

Texts are known by the digest of their bytes, so rows that repeat a doc_id with another text are other texts. Within a
band every member meets the band's hub (the text with most exact copies, then smallest digest). Buckets of up to GROUP
texts also give all their pairs. Once these are verified, in larger buckets every pair of texts that are still in
different classes is compared, in tiles of up to TILE by TILE texts and about TILE_BYTES by TILE_BYTES: a task verifies
its tile's pairs itself and returns a spanning forest of the links, at most one for each text, so no pairs are sent on
and no task holds a large group. So two texts of a bucket of any size end in one class, or their pair was compared.

Cases: a null text is a class of its own; empty texts are exact copies of each other; texts of up to WORDS words are one
shingle; the class's id is its smallest doc_id that is not null, and null where all are; the operator marks every row
that has this doc_id as kept, the pipeline stage keeps one row of a class (of rows with this doc_id that with the smallest
digest, of equal texts any one whose other columns come first by their hash); columns of any names may stand beside
doc_id and text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Shared, batch_rows, components, join_hot, prepare, table, written

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
BUCKETS, SPREAD = 1 << 20, 0.25
#: Texts of a bucket that meet each other at once; texts, and bytes of texts, on each side of a larger bucket's tile.
GROUP, TILE, TILE_BYTES = 48, 512, 4 << 20
#: Columns of a tile's matrix of shingles that are multiplied at once.
WIDE = 4096
#: Agreeing samples that a candidate needs: at similarity 0.8 fewer come up once in 12,000 pairs.
AGREE = int(0.6 * SAMPLES)
CHUNK = 1 << 14
ROW_BITS = 14

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACE = 1 << 12
_odd = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(n - 1, _odd, np.uint64))
    return out


_bytes_hash = mix(np.arange(1, 257, dtype=np.uint64) * _M)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and the number of each text's first word."""
    space = data <= 32
    begin = ~space
    begin[1:] &= space[:-1] | False
    inner = starts[(starts > 0) & (starts < len(data))]
    begin[inner] = ~space[inner]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    number = np.searchsorted(at, starts)
    # each word's bytes by their place in the word
    word = np.cumsum(begin) - 1
    place = np.arange(len(data)) - at[np.maximum(word, 0)]
    value = _bytes_hash[data] * _powers(int(place.max()) + 1 if len(place) else 1)[np.maximum(place, 0)]
    value[space] = 0
    return mix(np.add.reduceat(value, at)), number


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, shingle hash and count, sorted by text and hash."""
    words, first = word_hashes(data, starts)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    h = np.zeros(len(of), np.uint64)
    last = first[1:][of] if len(of) else at
    for k in range(WORDS):
        inside = at + k < last
        h = h * np.uint64(0x100000001B3) + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(k + 1)) if len(of) else h
        h ^= h >> np.uint64(29)
    h = mix(h)
    order = np.lexsort([h, of])
    of, h = of[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    return of[place], h[place], np.diff(np.append(place, len(h)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and starts of an Arrow string array without nulls."""
    kind = np.int32 if pa.types.is_string(array.type) else np.int64
    starts = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each hashed shingle bucket, and documents: sums of fixed-size tables, one from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, starts = _raw(batch.column(0))
            _, h, _ = shingles(data, starts)
            total += np.bincount(bucket(h), minlength=BUCKETS)
            n += batch.num_rows
        if n:
            parts = [zlib.compress(total[i : i + CHUNK].astype("<i8").tobytes(), 1) for i in range(0, BUCKETS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (len(parts) - 1), pa.int64())], ["chunk", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for c, raw, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got = np.frombuffer(zlib.decompress(raw), "<i8")
                held[c] = [held[c][0] + got, held[c][1] + n] if c in held else [got, n]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v[0].tobytes(), 1) for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())], ["chunk", "counts", "n"])

    kind = "chunk int, counts binary, n long"
    parts = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(count, kind)
    sums = parts.repartition(min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk").mapInArrow(add, kind)
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in sums.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        n += r["n"]
    return out, n


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + SPREAD * np.log((n + 1) / (df + 1)) / np.log(n + 2)).clip(1).astype(np.float32)


class Sampler:
    """SAMPLES consistent weighted samples: for weight S, t = floor(ln S / r + b), ln a = ln c - r (t + 1 - b) with r, c
    gamma(2, 1) and b uniform; the shingle with the least a is the sample, together with its t. r, c and b come from three
    tables by three parts of the shingle's hash."""

    def __init__(self):
        rng = np.random.default_rng(20)
        shape = (1 << ROW_BITS, SAMPLES)
        self.r = (-np.log(rng.random(shape, np.float32) * rng.random(shape, np.float32) + 1e-30)).astype(np.float32) + 1e-6
        self.c = np.log(-np.log(rng.random(shape, np.float32) * rng.random(shape, np.float32) + 1e-30) + 1e-30).astype(np.float32)
        self.b = rng.random(shape, np.float32)

    def samples(self, of: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, block: int = 1 << 13) -> np.ndarray:
        """A 64-bit code (shingle and t) for each of n texts and each sample; 0 where a text has no shingle."""
        out = np.zeros((n, SAMPLES), np.uint64)
        least = np.full((n, SAMPLES), np.inf, np.float32)
        mask = np.uint64((1 << ROW_BITS) - 1)
        log = np.log(weight).astype(np.float32)
        for lo in range(0, len(h), block):
            x = h[lo : lo + block]
            r = self.r[(x & mask).astype(np.int64)]
            b = self.b[((x >> np.uint64(ROW_BITS)) & mask).astype(np.int64)]
            t = np.floor(log[lo : lo + block, None] / r + b)
            a = self.c[((x >> np.uint64(2 * ROW_BITS)) & mask).astype(np.int64)] - r * (t + 1 - b)
            d = of[lo : lo + block]
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            low = np.minimum.reduceat(a, first, axis=0)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(d))))
            i, k = np.nonzero(a == low[row])
            doc = d[first][row[i]]
            code = mix(x[i] + t[i, k].astype(np.int64).astype(np.uint64) * _M) | np.uint64(1)
            # of equal values the one with the smaller code, whatever the order
            better = (a[i, k] < least[doc, k]) | ((a[i, k] == least[doc, k]) & (code < out[doc, k]))
            i, k, doc, code = i[better], k[better], doc[better], code[better]
            order = np.argsort(code, kind="stable")[::-1]
            least[doc[order], k[order]] = a[i[order], k[order]]
            out[doc[order], k[order]] = code[order]
        return out


def signatures(docs: DataFrame, idf: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest of the text, its band keys and one byte of each sample."""
    kind = docs.schema[key].dataType.simpleString()
    shared = Shared(docs.sparkSession, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = shared.value, Sampler()
        for batch in batches:
            data, starts = _raw(batch.column(1))
            of, h, n = shingles(data, starts)
            code = sampler.samples(of, h, n * weights[bucket(h)].astype(np.float64), batch.num_rows)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            for b in range(BANDS):
                x = np.full(batch.num_rows, b + 1, np.uint64)
                for r in range(ROWS):
                    x = mix(x * _M + code[:, b * ROWS + r])
                keys[:, b] = x
            raw = data.tobytes()
            digest = [hashlib.md5(raw[i:j], usedforsecurity=False).hexdigest() for i, j in zip(starts[:-1], starts[1:], strict=True)]
            some = code[:, 0] > 0
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(some, BANDS, 0))), pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
            small = (code >> np.uint64(40)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), bands, pa.array([x.tobytes() for x in small], pa.binary())], ["doc_id", "digest", "bands", "samples"])

    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, digest string, bands array<long>, samples binary")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of group lists that agree in enough samples; a is the list's head, or the smaller id."""
    for batch in batches:
        ids, packed, heads = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        out_a, out_b = [], []
        for g in range(batch.num_rows):
            own, x = ids[g].as_py(), np.frombuffer(b"".join(packed[g].as_py()), np.uint8).reshape(-1, SAMPLES)
            if heads[g]:
                i, j = np.zeros(len(own) - 1, np.int64), np.arange(1, len(own))
            else:
                i, j = np.triu_indices(len(own), 1)
            ok = (x[i] == x[j]).sum(1) >= AGREE
            for p, q in zip(i[ok], j[ok], strict=True):
                if own[p] != own[q]:
                    swap = not heads[g] and own[q] < own[p]
                    out_a.append(own[q] if swap else own[p])
                    out_b.append(own[p] if swap else own[q])
        kind = ids.type.value_type
        yield pa.RecordBatch.from_arrays([pa.array(out_a, kind), pa.array(out_b, kind)], ["a", "b"])


def _forest(one: np.ndarray, two: np.ndarray) -> list[int]:
    """Of pairs of classes, in their order, those that join two groups of classes not joined yet."""
    up: dict = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            out.append(k)
    return out


def elements(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and weight of the elements of texts, and each text's sum of weights: a shingle that comes up n times is n
    elements, so that weighted Jaccard similarity is that of sets of elements."""
    of, h, n = shingles(*_raw(texts))
    w = weights[bucket(h)].astype(np.float64)
    total = np.bincount(of, n * w, len(texts))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        key = np.repeat(h, n) + nth.astype(np.uint64) * _M
    return np.repeat(of, n), key, np.repeat(w, n), total


def similarity_matrix(texts: pa.Array, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarity of the texts at left with those at right."""
    of, key, w, total = elements(texts, weights)
    key, where, many = np.unique(key, return_inverse=True, return_counts=True)
    # elements of one text only are in no intersection
    number = np.cumsum(many > 1) - 1
    some = many[where] > 1
    of, column, w = of[some], number[where[some]], w[some]
    order = np.argsort(column, kind="stable")
    of, column, w = of[order], column[order], w[order]
    row = [np.full(len(texts), -1), np.full(len(texts), -1)]
    row[0][left], row[1][right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        a, b = np.searchsorted(column, [lo, lo + WIDE])
        side = []
        for k, n in ((0, len(left)), (1, len(right))):
            x = np.zeros((n, WIDE))
            at = row[k][of[a:b]]
            mine = at >= 0
            x[at[mine], column[a:b][mine] - lo] = w[a:b][mine] if k else 1
            side.append(x)
        both += side[0] @ side[1].T
    every = total[left][:, None] + total[right][None] - both
    return np.where(every > 0, both / np.where(every > 0, every, 1), 0.0)


def _tiles(shared: Shared):
    """Links (a, b) of tiles between texts of different labels: a spanning forest of each tile's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for g in range(batch.num_rows):
                own, label, right, packed = (batch.column(i)[g].as_py() for i in range(4))
                right = np.array(right, bool)
                label = np.unique(np.array(label, object), return_inverse=True)[1]
                x = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, SAMPLES)
                one = np.flatnonzero(~right)
                two = np.flatnonzero(right) if right.any() else one
                same = np.zeros((len(one), len(two)), np.uint8)
                for k in range(SAMPLES):
                    same += x[one, k][:, None] == x[two, k][None]
                near = (same >= AGREE) & (label[one][:, None] != label[two][None])
                some, others = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                picked = np.unique(np.concatenate([one[some], two[others]]))
                texts = batch.column(4)[g].values.take(pa.array(picked))
                sim = similarity_matrix(texts, np.searchsorted(picked, one[some]), np.searchsorted(picked, two[others]), shared.value)
                i, j = np.nonzero(near[np.ix_(some, others)] & (sim >= SIMILAR))
                order = np.argsort(-sim[i, j], kind="stable")
                i, j = one[some[i[order]]], two[others[j[order]]]
                for k in _forest(label[i], label[j]):
                    out_a.append(own[i[k]])
                    out_b.append(own[j[k]])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return run


def _met(rows: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows(id, copies, b, key): hub lists of two and lists of small buckets, with samples; and key, id and samples of
    the members of buckets larger than GROUP."""
    rank = F.struct((-F.col("copies")).alias("copies"), F.col("id").alias("id"))
    top = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(rank)["id"].alias("hub")).where("n > 1")
    samples = reps.select(F.col("id").alias("of"), "samples")
    top = written(top.join(samples, F.col("hub") == F.col("of")).select(F.col("key").cast("string").alias("key"), "n", F.col("n").alias("size"), "hub", F.col("samples").alias("hub_samples")), "hubs")
    members = join_hot(rows.withColumn("key", F.col("key").cast("string")), top, "key", max(1, rows.count())).where(F.col("hub").isNotNull())
    members = written(members.join(samples, F.col("id") == F.col("of")).drop("of"), "members")
    stars = members.where("id <> hub").select(F.array("hub", "id").alias("ids"), F.array("hub_samples", "samples").alias("packed"), F.lit(True).alias("head"))
    small = members.where(F.col("size").between(3, GROUP)).groupBy("key").agg(F.collect_list("id").alias("ids"), F.collect_list("samples").alias("packed"))
    return stars.unionByName(small.select("ids", "packed", F.lit(False).alias("head"))), members.where(F.col("size") > GROUP).select("key", "id", "samples")


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of reps(id, copies, bands, samples) that share a band, one of them the hub or the bucket small, and agree in
    enough samples; and key, id and samples of the members of large buckets."""
    rows = written(reps.select("id", "copies", F.posexplode("bands").alias("b", "key")), "bands")
    found, large = _met(rows, reps)
    return found.mapInArrow(_agreeing, "a binary, b binary").distinct(), large


def texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """id and text for each of ids(id), from one of the rows that have reps' doc_id and digest."""
    wanted = ids.hint("merge").join(reps.select("id", "first"), "id")
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("own"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("text"))
    found = own.join(wanted.hint("merge"), (F.col("digest") == F.col("id")) & F.col("own").eqNullSafe(F.col("first"))).select("id", "text")
    return written(found.dropDuplicates(["id"]), "texts")


def crowded(large: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, idf: np.ndarray, text: str, key: str) -> DataFrame:
    """Links between members of one of the large buckets that have different labels(node, label), as many as join the
    classes of each tile."""
    own = large.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "samples", F.coalesce("label", "id").alias("label"))
    own = written(own, "crowded")
    each = own.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    mixed = written(mixed.select("key", "n", F.col("top.label").alias("most")), "mixed")
    rows = join_hot(own, mixed, "key", max(1, own.count())).where(F.col("most").isNotNull())
    texts = texts_of(rows.select("id").distinct(), reps, docs, text, key)
    rows = rows.join(texts.withColumnRenamed("id", "of").hint("merge"), F.col("id") == F.col("of")).withColumn("major", F.col("label") == F.col("most"))
    size = F.octet_length("text")
    # texts of the largest class meet only those of other classes: blocks of these come first
    sums = rows.groupBy("key").agg(*[f(F.when(c, size).otherwise(0)).alias(n) for f, c, n in ((F.sum, F.col("major"), "major_bytes"), (F.sum, ~F.col("major"), "rest_bytes"))], F.sum(F.col("major").cast("long")).alias("majors"), F.count("*").alias("n"))
    blocks = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")
    rest = blocks(F.col("n") - F.col("majors"), F.col("rest_bytes"))
    sums = written(sums.select("key", "n", rest.alias("rest"), (rest + blocks(F.col("majors"), F.col("major_bytes"))).alias("all")), "tiles")
    rows = join_hot(rows.select("key", "id", "label", "samples", "major", "text"), sums, "key", max(1, own.count()))
    block = F.when(F.col("major"), F.col("rest") + F.pmod(F.xxhash64("id"), F.col("all") - F.col("rest"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    rows = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("major"), F.col("rest")).otherwise(F.col("all")) - 1)))
    tiles = rows.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = tiles.agg(F.collect_list("id").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list(F.col("own") > F.col("other")).alias("right"), F.collect_list("samples").alias("packed"), F.collect_list("text").alias("texts"))
    return tiles.select("ids", "labels", "right", "packed", "texts").mapInArrow(_tiles(Shared(docs.sparkSession, idf)), "a binary, b binary")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, idf: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pairs (a, b) with exact weighted Jaccard similarity of at least SIMILAR, and it. A hub is the a of its pairs, and
    a's texts are dealt out by a salt, so no task gets all pairs of a hub."""
    shared = Shared(docs.sparkSession, idf)
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), reps, docs, text, key)
    left = pairs.select(F.col("a").alias("la"), F.col("salt").alias("ls")).distinct().join(texts, F.col("la") == F.col("id")).select("la", "ls", F.col("text").alias("left"))
    rows = pairs.join(texts, F.col("b") == F.col("id")).select("a", "b", "salt", F.col("text").alias("right"))
    rows = rows.join(left, (F.col("a") == F.col("la")) & (F.col("salt") == F.col("ls"))).select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            one, two = (shingles(*_raw(batch.column(i))) for i in (2, 3))
            sim = np.zeros(batch.num_rows)
            cut = [np.searchsorted(x[0], np.arange(batch.num_rows + 1)) for x in (one, two)]
            for k in range(batch.num_rows):
                (h, n), (g, m) = ((x[1][c[k] : c[k + 1]], x[2][c[k] : c[k + 1]]) for x, c in zip((one, two), cut, strict=True))
                at = np.minimum(np.searchsorted(g, h), max(len(g) - 1, 0))
                both = g[at] == h if len(g) else np.zeros(len(h), bool)
                shared_weight = (np.minimum(n[both], m[at[both]]) * weights[bucket(h[both])]).sum(dtype=np.float64)
                total = (n * weights[bucket(h)]).sum(dtype=np.float64) + (m * weights[bucket(g)]).sum(dtype=np.float64) - shared_weight
                sim[k] = shared_weight / total if total else 0.0
            ok = pa.array(sim >= SIMILAR)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(sim).filter(ok)], ["a", "b", "similarity"])

    return rows.mapInArrow(run, "a binary, b binary, similarity double")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, class_id (smallest doc_id of the class), top (digest of the smallest text with that doc_id), copies
    (rows with this very text) for each row of docs with a text."""
    prepare(docs.sparkSession)
    df, n = document_frequency(docs, text)
    idf = idf_table(df, n)
    signed = written(signatures(docs, idf, text, key), "signatures")
    reps = written(signed.groupBy(F.unhex("digest").alias("id")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("samples").alias("samples")), "reps")
    found, large = candidates(reps.where(F.size("bands") > 0))
    pairs, large = written(found, "pairs"), written(large, "large")
    with batch_rows(docs.sparkSession, 64):
        links = written(verified(pairs, reps, docs, idf, text, key), "links")
    labels = components(links)
    if not large.isEmpty():
        with batch_rows(docs.sparkSession, 2):
            more = written(crowded(large, labels, reps, docs, idf, text, key), "links")
        if not more.isEmpty():
            labels = components(links.select("a", "b").unionByName(more))
    named = written(reps.join(labels, F.col("id") == F.col("node"), "left").select("id", "first", "copies", F.coalesce("label", "id").alias("label")), "classes")
    # null is larger than any doc_id
    least = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("class_id"), F.col("id").alias("top")))
    tops = named.groupBy("label").agg(F.count("*").alias("n"), least.alias("least")).select("label", "n", "least.class_id", F.lower(F.hex("least.top")).alias("top"))
    named = join_hot(named, tops, "label", max(1, named.count()))
    named = named.select(F.lower(F.hex("id")).alias("digest"), F.col("copies").alias("n"), "class_id", "top", "copies")
    return join_hot(signed.select("doc_id", "digest"), written(named, "named"), "digest", max(1, n))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies, kept for every row of docs(doc_id, text)."""
    found = classes(docs)
    null = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    return found.select("doc_id", "class_id", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")).unionByName(null)


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays, that with its smallest doc_id; null texts stay."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    found = classes(docs)
    found = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("top")))
    found = written(found.groupBy(F.col("doc_id").alias("\u0001id"), F.col("digest").alias("\u0001digest")).agg(F.count("*").alias("\u0001n")), "kept")
    rows = docs.withColumn("\u0001own", F.md5(F.col("text").cast("binary")))
    kept = rows.join(found, F.col("doc_id").eqNullSafe(F.col("\u0001id")) & (F.col("\u0001own") == F.col("\u0001digest")))
    # rows that repeat doc_id and text: the first by a hash of all columns, found by an aggregate that combines before its shuffle
    many = kept.where(F.col("\u0001n") > 1).withColumn("\u0001hash", F.xxhash64(F.to_json(F.struct(*own))))
    first = many.groupBy("\u0001own", "\u0001id").agg(F.min("\u0001hash").alias("\u0001least")).select(F.col("\u0001own").alias("\u0001o"), F.col("\u0001id").alias("\u0001i"), "\u0001least")
    same = (F.col("\u0001own") == F.col("\u0001o")) & F.col("\u0001id").eqNullSafe(F.col("\u0001i")) & (F.col("\u0001hash") == F.col("\u0001least"))
    many = many.join(first, same).dropDuplicates(["\u0001own", "\u0001id"])
    return kept.where(F.col("\u0001n") == 1).select(*own).unionByName(many.select(*own)).unionByName(docs.where(F.col("text").isNull()).select(*own))
