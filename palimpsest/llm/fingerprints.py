"""Document fingerprints by a randomised edit embedding: shared random walks over characters, bit-sampled.

A walk reads a text left to right. At step j it writes the character at its place and moves on if the shared random bit of
(j, character) is one, so equal stretches that come into step stay in step, and the edit distance of two texts becomes the Hamming
distance of what their walks write. The bits repeat after PERIOD steps. A text of n characters takes about 2 n steps. What is
kept of a walk are SYMBOL bits at sampled steps: a hash of the step and of the three characters from the walk's place on.
Steps are sampled by the zeros at the end of their hash, `level` of them for a text: the fewest with which at most SAMPLES
steps are expected, so the steps of a longer text's fingerprint are among those of a shorter one's, and any two fingerprints
compare over the steps of the coarser level. Likeness is the share of agreeing samples, less what agrees by chance, over
the longer walk; of WALKS independent walks the best counts, as a walk may need long to come into step again.

The edited text of a document ends in its last third replaced by the beginning of the next document. Documents are dealt into
ranges of (doc_id descending, hash of the text, number of the row); each task walks its own texts, resuming at the cut for the
edited ones, and looks one text ahead. Only the two texts at the edges of each range travel once more.

near_duplicates() goes on: BANDS groups of sampled symbols of a level give bucket keys (a text also has those of the next
coarser level, so that lengths on either side of a level's edge meet), equal fingerprints are one node, pairs that share a
bucket are verified by the likeness of their whole fingerprints, and classes are connected components.

Cases: a null text is an empty one; equal texts have equal fingerprints; an empty text's likeness is 1 to an empty
one and 0 to others; rows that repeat a doc_id are documents of their own, in the order of a hash of their text (equal rows
are interchangeable); null doc_ids come last; a single document is its own next one; very long texts are walked whole;
columns other than doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batch_rows, components, join_hot, prepare, table, written

#: Walks, steps after which their bits repeat (a power of two), sampled steps of a walk at most as expected, bits of a sample.
WALKS, PERIOD, SAMPLES, SYMBOL = 2, 4096, 256, 4
#: Characters that a task walks at once.
GROUP_CHARS = 8_000_000
#: Near duplicates: bands of so many samples for each walk and level, and the least likeness. At a likeness of 0.8 a pair shares
#: none of 24 bands once in 140.
BANDS, WIDTH, NEAR = 12, 8, 0.7
#: Fingerprints on each side of a tile of a large bucket.
TILE = 256
_CHANCE = 1 / (1 << SYMBOL)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Walks:
    """The shared random choices: steps that a walk stays on a character, and sampled steps by level."""

    def __init__(self):
        bits = np.random.default_rng(12).random((PERIOD, WALKS, 256)) < 0.5
        bits[0] |= ~bits.any(0)
        stay = np.ones((2 * PERIOD, WALKS, 256), np.int64)
        for j in range(2 * PERIOD - 2, -1, -1):
            stay[j] = np.where(bits[j % PERIOD], 1, stay[j + 1] + 1)
        self.stay = stay[:PERIOD].astype(np.int16).reshape(-1)
        self.until, self.by_level = 0, [np.zeros(0, np.int64)]
        self.within: dict[tuple[int, int], np.ndarray] = {}

    def sampled(self, level: int, steps: int) -> np.ndarray:
        """The sampled steps below `steps` of a level, ascending."""
        if steps > self.until:
            most = max(1 << 18, self.until)
            while most < steps:
                most *= 2
            at = np.arange(self.until, most, dtype=np.int64)
            new = [at]
            h = _mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
            while len(new[-1]):
                odd = (h & np.uint64(1)) == 0
                h = h[odd] >> np.uint64(1)
                new.append(new[-1][odd])
            self.by_level += [np.zeros(0, np.int64)] * (len(new) - len(self.by_level))
            self.by_level = [np.concatenate([a, new[k]]) if k < len(new) else a for k, a in enumerate(self.by_level)]
            self.until = most
            self.within.clear()
        found = self.by_level[level] if level < len(self.by_level) else self.by_level[-1][:0]
        return found[: np.searchsorted(found, steps)]

    def among(self, level: int, coarser: int, steps: int) -> np.ndarray:
        """Which of a level's sampled steps are sampled at a coarser level, up to `steps` at least."""
        own = self.sampled(level, steps)
        if (level, coarser) not in self.within:
            self.within[level, coarser] = np.isin(self.by_level[level], self.sampled(coarser, self.until), assume_unique=True)
        return self.within[level, coarser][: len(own)]


_walks: list[Walks] = []


def walks() -> Walks:
    if not _walks:
        _walks.append(Walks())
    return _walks[0]


def level_of(n: int) -> int:
    level = 0
    while 2 * n >> level > SAMPLES:
        level += 1
    return level


@dataclass
class Print:
    """A fingerprint: its level, and for each walk the steps it took and the symbols at the level's sampled steps."""

    level: int
    steps: list[int]
    symbols: list[np.ndarray]

    def __str__(self) -> str:
        return "-".join([f"{self.level:x}", *(f"{s:x}" for s in self.steps), b"".join(_DIGITS[x].tobytes() for x in self.symbols).decode()])

    @staticmethod
    def of(text: str) -> Print:
        level, *steps, digits = text.split("-")
        level, steps = int(level, 16), [int(s, 16) for s in steps]
        raw = np.frombuffer(digits.encode(), np.uint8)
        raw = np.where(raw >= 97, raw - 87, raw - 48)
        cuts = np.cumsum([0] + [len(walks().sampled(level, s)) for s in steps])
        return Print(level, steps, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def at(self, level: int) -> list[np.ndarray]:
        """The symbols at the sampled steps of a coarser level."""
        if level == self.level:
            return self.symbols
        return [x[walks().among(self.level, level, s)[: len(x)]] for x, s in zip(self.symbols, self.steps, strict=True)]


def likeness(a: Print, b: Print) -> float:
    """The share of the longer walk's samples that agree, corrected for chance; the best of the walks; 0 to 1."""
    if a.steps == b.steps and a.level == b.level and all(np.array_equal(x, y) for x, y in zip(a.symbols, b.symbols, strict=True)):
        return 1.0
    best, level = 0.0, max(a.level, b.level)
    for x, y in zip(a.at(level), b.at(level), strict=True):
        both, most = min(len(x), len(y)), max(len(x), len(y))
        if most:
            unlike = int((x[:both] != y[:both]).sum())
            best = max(best, (both - unlike / (1 - _CHANCE)) / most)
    return best


class Group:
    """Texts walked together: arrival steps of every walk at every character, laid out by character so that a step of all
    texts is one slice."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None):
        """codes: walk classes of all characters; text k is codes[starts[k] : starts[k] + sizes[k]]; begin: arrival (k, WALKS)."""
        n = len(sizes)
        self.order = np.argsort(-sizes, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        longest = int(sizes.max(initial=0))
        ordered = sizes[self.order]
        # texts longer than i, for each character place i
        active = n - np.searchsorted(ordered[::-1], np.arange(longest), "right")
        self.offset = np.concatenate([[0], np.cumsum(active * WALKS)]).astype(np.int64)
        laid = np.empty(int(self.offset[-1]), np.uint16)
        for lo in range(0, n, 4096):
            part = ordered[lo : lo + 4096]
            total = int(part.sum())
            place = np.arange(total) - np.repeat(np.cumsum(part) - part, part)
            at = self.offset[place] + np.repeat(np.arange(lo, lo + len(part)), part) * WALKS
            code = codes[np.repeat(starts[self.order[lo : lo + 4096]], part) + place].astype(np.uint16)
            for w in range(WALKS):
                laid[at + w] = code | (w << 8)
        stay = walks().stay
        j = np.zeros(n * WALKS, np.int64) if begin is None else begin[self.order].ravel().astype(np.int64)
        self.begin, self.sizes = np.zeros((n, WALKS), np.int64) if begin is None else begin, sizes
        self.after = np.empty(len(laid), np.int32 if longest < 1 << 29 else np.int64)
        shift = np.int64(8 + WALKS.bit_length() - 1)
        for o, stop in zip(self.offset[:-1].tolist(), self.offset[1:].tolist(), strict=True):
            now = j[: stop - o]
            at = now & (PERIOD - 1)
            at <<= shift
            at |= laid[o:stop]
            now += stay.take(at)
            self.after[o:stop] = now
        self.steps = np.empty((n, WALKS), np.int64)
        self.steps[self.order] = j.reshape(n, WALKS)

    def arrival(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Steps (k, WALKS) at which walks arrive at character `place` of texts `which`."""
        before = np.maximum(place - 1, 0)
        some = place > 0
        out = self.begin[which].copy()
        for w in range(WALKS):
            out[some, w] = self.after[self.offset[before[some]] + self.rank[which[some]] * WALKS + w]
        return out

    def place(self, which: np.ndarray, walk: int, step: np.ndarray) -> np.ndarray:
        """The character place that a walk is at at a step, by binary search among arrivals."""
        last = self.sizes[which].astype(np.int64)
        lo, hi, last = np.zeros(len(which), np.int64), last.copy(), np.maximum(last - 1, 0)
        base = self.rank[which] * WALKS + walk
        some = self.sizes[which] > 0
        for _ in range(int(self.sizes.max(initial=0)).bit_length()):
            mid = np.minimum((lo + hi) >> 1, last)
            up = some & (self.after[np.where(some, self.offset[mid] + base, 0)] <= step) if len(self.after) else some
            lo = np.where(up, mid + 1, lo)
            hi = np.where(up, hi, np.minimum(hi, mid))
        return lo


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, the class of each that walks read, and the texts' sizes."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    classes = _mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(255)
    code = classes[points & 255].astype(np.uint8) ^ (points >> 8).astype(np.uint8)
    return points, code, np.array([len(t) for t in texts], np.int64)


def _symbols(points: np.ndarray, place: np.ndarray, cut: np.ndarray, first: np.ndarray, size: np.ndarray, second: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Samples at steps: of the three characters from `place` on of a text that is points[first:] up to cut and points[second:]
    from there to size."""
    h = step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(3):
        p = place + k
        at = np.where(p < cut, first + p, second + p - cut)
        char = np.where(p < size, points[np.minimum(np.where(p < size, at, 0), max(len(points) - 1, 0))].astype(np.uint64) + np.uint64(1), np.uint64(0))
        h = _mix(h ^ (char * np.uint64(0xD6E8FEB86659FD93 + 2 * k)))
    return (h >> np.uint64(64 - SYMBOL)).astype(np.uint8)


def _prints(levels: np.ndarray, steps: np.ndarray, sample) -> list[Print]:
    """Prints of texts from sample(which, walk, step), by level."""
    out = [Print(int(a), [int(x) for x in s], [None] * WALKS) for a, s in zip(levels, steps, strict=True)]
    for level in np.unique(levels):
        which = np.flatnonzero(levels == level)
        for w in range(WALKS):
            known = walks().sampled(int(level), int(steps[which, w].max()))
            count = np.searchsorted(known, steps[which, w])
            own = np.repeat(which, count)
            step = known[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)]
            got = sample(own, w, step)
            for k, x in zip(which, np.split(got, np.cumsum(count)[:-1]), strict=True):
                out[k].symbols[w] = x
    return out


def fingerprinted(texts: list[str], following: int) -> tuple[list[Print], list[Print], list[str]]:
    """Prints of texts, and prints and texts of the first `following` of them as edited by the text after each."""
    points, codes, sizes = _codes(texts)
    starts = np.cumsum(sizes) - sizes
    group = Group(codes, starts, sizes)
    whole = lambda own, w, step: _symbols(points, group.place(own, w, step), sizes[own], starts[own], sizes[own], starts[own], step)
    levels = np.array([level_of(int(n)) for n in sizes], np.int64)
    plain = _prints(levels, group.steps, whole) if len(texts) else []
    which = np.arange(following)
    third = sizes[:following] // 3
    cut = sizes[:following] - third
    tail = np.minimum(third, sizes[1 : following + 1])
    begin = group.arrival(which, cut)
    rest = Group(codes, starts[1 : following + 1], tail, begin)
    size = cut + tail

    def edited(own, w, step):
        late = step >= begin[own, w]
        place = np.empty(len(own), np.int64)
        place[~late] = group.place(own[~late], w, step[~late])
        place[late] = cut[own[late]] + rest.place(own[late], w, step[late])
        return _symbols(points, place, cut[own], starts[own], size[own], starts[own + 1], step)

    changed = _prints(np.array([level_of(int(n)) for n in size], np.int64), rest.steps, edited) if following else []
    return plain, changed, [a[:c] + b[:t] for a, b, c, t in zip(texts, texts[1:], cut.tolist(), tail.tolist(), strict=False)]


def _rows(texts: list[str], following: int) -> list[tuple]:
    """n_chars, edited_sha256, both fingerprints and both likenesses of the first `following` texts."""
    plain, changed, edited = fingerprinted(texts, following)
    return [(len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest(), str(plain[k]), str(changed[k]), likeness(plain[k], changed[k]), likeness(plain[k], plain[k + 1])) for k in range(following)]


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprints for each row of docs(doc_id, text), see above."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key_kind = None

        def made(ids: list, found: list[tuple], edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
            n = len(ids)
            values = [pa.array([r[i] for r in found], k) if found else pa.nulls(n, k) for i, k in enumerate(_KINDS)]
            return pa.RecordBatch.from_arrays([pa.array(ids, key_kind), *values, pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())], ["doc_id", *_NAMES, "edge", "part", "text"])

        ids, texts, held, first = [], [], 0, True
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first:
                    yield made([key], [], "first", text)
                    first = False
                ids.append(key)
                texts.append(text)
                held += len(text)
                if held > GROUP_CHARS and len(ids) > 1:
                    # the last one waits for its next one
                    yield made(ids[:-1], _rows(texts, len(ids) - 1))
                    ids, texts, held = ids[-1:], texts[-1:], len(text)
        if len(ids) > 1:
            yield made(ids[:-1], _rows(texts, len(ids) - 1))
        if ids:
            yield made(ids[-1:], [], "last", texts[-1])

    out = written(rows.mapInArrow(run, f"doc_id {kind}, {_SQL}, edge string, part int, text string"), "fingerprints")
    edges = out.where(F.col("edge").isNotNull()).select("doc_id", "edge", "part", "text")
    # numbers of the ranges that have rows: as many as tasks
    parts = sorted(r[0] for r in edges.where("edge = 'first'").select("part").collect())
    follow = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    after = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = edges.where("edge = 'last'").join(F.broadcast(follow), "part").join(after, "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_rows([a, b], 1)[0] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in found], k) for i, k in enumerate(_KINDS)]], ["doc_id", *_NAMES])

    return out.where(F.col("edge").isNull()).select("doc_id", *_NAMES).unionByName(pairs.mapInArrow(close, f"doc_id {kind}, {_SQL}"))


def _banded(level: int) -> np.ndarray:
    """The sampled steps of each band of a level (BANDS, WIDTH), by number: among those that the shortest texts of the level reach."""
    known = walks().sampled(level, 120 << level)
    order = np.random.default_rng(level).permutation(max(len(known), BANDS * WIDTH))[: BANDS * WIDTH]
    return order.reshape(BANDS, WIDTH)


def near_duplicates(prints: DataFrame, least: float = NEAR) -> DataFrame:
    """doc_id and class_id of every row of prints(doc_id, fingerprint): class_id is the smallest doc_id of its class (null where
    the class has none, or the fingerprint is null). Buckets of any size are compared whole, in tiles of about TILE by TILE
    fingerprints whose tasks return a spanning set of links."""
    spark = prepare(prints.sparkSession)
    own = prints.select("doc_id", "fingerprint").where(F.col("fingerprint").isNotNull())
    nodes = written(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.md5("fingerprint")), "nodes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = Print.of(text)
                for level in (p.level, p.level + 1):
                    groups = _banded(level)
                    for w, x in enumerate(p.at(level)):
                        # a step that the walk does not reach has a symbol of its own
                        padded = np.append(x, np.full(max(0, int(groups.max()) + 1 - len(x)), 255, np.uint8))
                        rows += [(node, f"{level}.{w}.{b}.{key.tobytes().hex()}") for b, key in enumerate(padded[groups])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["node", "bucket"])

    dealt = written(nodes.select("node", "fingerprint").mapInArrow(bands, "node string, bucket string"), "bands")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE)), "buckets")
    members = join_hot(dealt, sizes, "bucket", max(1, dealt.count())).where(F.col("tiles").isNotNull())
    members = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).join(nodes.select("node", "fingerprint"), "node")
    tiles = written(members.groupBy("bucket", "tiles", "tile").agg(F.collect_list(F.struct("node", "fingerprint")).alias("texts")), "tiles")
    pairs = tiles.select("bucket", "tile", F.col("texts").alias("left"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("other"))
    pairs = pairs.join(tiles.select("bucket", F.col("tile").alias("other"), F.col("texts").alias("right")), ["bucket", "other"]).select("bucket", "left", "right")

    def rows_of(side: list[dict], level: int):
        found = [Print.of(t["fingerprint"]) for t in side]
        at = [p.at(level) for p in found]
        whole = []
        for w in range(WALKS):
            x = np.full((len(at), max(len(a[w]) for a in at)), 255, np.uint8)
            for k, a in enumerate(at):
                x[k, : len(a[w])] = a[w]
            whole.append((x, np.array([len(a[w]) for a in at])))
        return [t["node"] for t in side], np.array([p.level for p in found]), whole

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                level = int(bucket.split(".")[0])
                (names, la, a), (others, lb, b) = rows_of(left, level), rows_of(right, level)
                best = np.zeros((len(names), len(others)))
                for (x, nx), (y, ny) in zip(a, b, strict=True):
                    width = min(x.shape[1], y.shape[1])
                    same = np.array([(row[:width] == y[:, :width]).sum(1) - ((row[:width] == 255) & (y[:, :width] == 255)).sum(1) for row in x]).reshape(best.shape)
                    both, most = np.minimum(nx[:, None], ny), np.maximum(nx[:, None], ny)
                    best = np.maximum(best, (both - (both - same) / (1 - _CHANCE)) / np.maximum(most, 1))
                # two texts of a finer level meet in buckets of their own level
                i, j = np.nonzero((best >= least) & (np.maximum(la[:, None], lb) == level))
                label = {n: n for n in [*names, *others]}

                def root(n, label=label):
                    while label[n] != n:
                        label[n] = label[label[n]]
                        n = label[n]
                    return n

                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    u, v = root(names[p]), root(others[q])
                    if u != v:
                        label[max(u, v)] = min(u, v)
                        out.append((names[p], others[q]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], ["a", "b"])

    with batch_rows(spark, 4):
        links = written(pairs.mapInArrow(verify, "a string, b string").distinct(), "links")
    labels = written(nodes.select("node", "first", "fingerprint", "n").join(components(links).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node")), "labels")
    classes = labels.groupBy("label").agg(F.min("first").alias("class_id"), F.count("*").alias("n"))
    named = join_hot(labels.select("fingerprint", "label", F.col("n").alias("copies")), classes, "label", max(1, labels.count())).select("fingerprint", "class_id", F.col("copies").alias("n"))
    return join_hot(prints.select("doc_id", "fingerprint"), named, "fingerprint", max(1, prints.count())).select("doc_id", "class_id")


def op12_document_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
