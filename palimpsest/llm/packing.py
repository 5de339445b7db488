"""Packing along a space-filling curve.

A document's vector is the sum over its words of hashed random directions; projected to DIMS dimensions and mapped to
its rank in the normal distribution, it gets a Hilbert key of DIMS * BITS bits. Documents are put in order of
key, cut into ranges at quantiles of that order, and laid end to end: sequence k holds the tokens
k * LENGTH up to (k + 1) * LENGTH, so neighbours on the curve share sequences and only the last one is not full. The
last run is cut at powers of two, which need no padding.

Token ids are those of the tokenizer for the whole text, then the end id. White-space-separated chunks are independent
under this tokenizer, so a worker keeps the ids of chunks; a chunk outside of plain Latin text goes through the
tokenizer itself. Ids travel through one shuffle, with two bytes each where the vocabulary allows.

Cases: a null text is an empty one (only the end id); rows of one doc_id are separate documents, told apart by
their order on the curve; an empty table gives no piece; a null doc_id is a document like any other; very long texts are
cut at sequences; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Shared, prepare, table, written

LENGTH, END = 4096, 2
DIMS, BITS = 4, 12
#: Chunks whose ids a worker keeps, about how many ids go to one range, and the most ranges. A range is sorted and read as a
#: stream, so ranges may grow without bound on memory when there are many; the number of ranges bounds what is broadcast.
KEPT, RANGE_TOKENS, RANGES = 600_000, 4_000_000, 1 << 16

_split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: visible Latin-1 bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds:
    """Ids of white-space-separated chunks as one growing array with starts; forgets all when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.wide = self.tokenizer.model, self.tokenizer.get_vocab_size() > 1 << 16
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def word(self, w: str) -> list[int]:
        return [t.id for t in self.model.tokenize(w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())))]

    def chunk(self, c: str, low: str) -> list[int]:
        if "<|" in c or (not c.isascii() and (max(c) > "ɏ" or not unicodedata.is_normalized("NFC", c) or len(low) != len(c))) or not c.isprintable():
            return self.tokenizer.encode(c, add_special_tokens=False).ids
        return [i for w in _split.findall(low) for i in self.word(w)]

    def learn(self, chunks: list[str]) -> None:
        """Plain words are kept once for all their capital forms."""
        ids: list[int] = []
        start, size = [], []
        for c in chunks:
            low = c.lower()
            plain = low.isascii() and low.isalpha()
            at = self.words.get(low) if plain else None
            if at is None:
                new = self.word(low) if plain else self.chunk(c, low)
                at = (self.used + len(ids)) << 20 | len(new) if len(new) < 1 << 20 else None
                begin, many = self.used + len(ids), len(new)
                if plain and at is not None:
                    self.words[low] = at
                ids += new
            else:
                begin, many = at >> 20, at & 0xFFFFF
            start.append(begin)
            size.append(many)
        k = len(self.number)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(chunks) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + len(chunks)], self.size[k : k + len(chunks)] = start, size
        self.number.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids with END after each text, the texts' starts, all chunk numbers, and their texts' starts."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parts).difference(self.number)
        if len(self.number) + len(new) > KEPT:
            self.forget()
            new = set().union(*parts)
            if len(new) > KEPT:  # one batch with more chunks than are kept: for it alone they are kept
                return self.plain(parts)
        self.learn(list(new))
        get = self.number.__getitem__
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter((i for p in parts for i in map(get, p)), np.int64, int(count.sum()))
        ends = np.cumsum(count)
        size = self.size[at]
        size_with_end = size.copy()
        size_with_end[ends - 1] += 1
        stop = np.cumsum(size_with_end)
        total = int(stop[-1]) if len(stop) else 0
        begin = stop - size_with_end
        # the source of id j of chunk c is start[c] + j
        src = np.arange(total) + np.repeat(self.start[at] - begin, size_with_end)
        ids = self.flat[np.minimum(src, len(self.flat) - 1)]
        starts = np.concatenate([[0], stop[ends - 1]]) if len(ends) else np.zeros(1, np.int64)
        ids[starts[1:] - 1] = END
        return ids, starts, at, np.concatenate([[0], ends])

    def plain(self, parts: list[list[str]]):
        rows = [np.array([i for c in p for i in self.chunk(c, c.lower())] + [END], np.uint32) for p in parts]
        self.forget()
        starts = np.cumsum([0] + [len(r) for r in rows])
        at = np.array([zlib.crc32(c.encode()) for p in parts for c in p], np.int64)
        return np.concatenate(rows), starts, at, np.cumsum([0] + [len(p) for p in parts])


def directions(ids: np.ndarray) -> np.ndarray:
    """A direction of signs in DIMS dimensions for each id, from a hash of the id."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed[:, None] >> (np.arange(DIMS, dtype=np.uint64) + np.uint64(40))) & np.uint64(1)).astype(np.float32) * 2 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (n, dims) with coordinates below 2**bits (Skilling's transpose form)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, starts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its hashed id counts."""
    total = np.add.reduceat(signs[ids], starts[:-1], axis=0, dtype=np.float64) if len(starts) > 1 else np.zeros((0, DIMS))
    size = np.maximum(np.diff(starts), 1)
    # a share of signs, scaled to spread documents over the cube
    unit = 0.5 + 0.5 * np.tanh(4 * total / size[:, None])
    return hilbert(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n, ids (little-endian bytes of two or four each) and place of docs(doc_id, text). place is the key's
    upper 36 bits and 16 bits of a hash of the row, so that equal documents can be cut apart; a double holds it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(path)
        signs = directions(np.arange(known.tokenizer.get_vocab_size()))
        unit = np.dtype("<u4" if known.wide else "<u2")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            ids, starts, _, _ = known.encode(texts)
            raw = pa.py_buffer(ids.astype(unit).tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((starts * unit.itemsize).astype(np.int64).tobytes()), raw]).cast(pa.binary())
            key = curve_keys(ids, starts, signs)
            tie = (np.arange(row, row + len(texts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(np.diff(starts)), packed, pa.array(np.full(len(texts), unit.itemsize, np.int32)), pa.array((key >> (DIMS * BITS - 36)) << 16 | tie)], ["doc_id", "key", "n", "ids", "unit", "place"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, key long, n long, ids binary, unit int, place long")


def pieces_of(starts: np.ndarray, sizes: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut runs at global places starts (each of so many tokens) at multiples of length, and the last partial sequence
    at powers of two; gives for each piece its run, its place and its size."""
    full = total // length * length
    tail, at = [], full
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - full) >> bit & 1:
            tail.append(at)
            at += 1 << bit
    tail = np.array(tail + [total], np.int64)
    out_run, out_at = [], []
    first, last = starts // length, (starts + sizes - 1) // length
    count = np.where(sizes > 0, last - first + 1, 0)
    run = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    place = np.maximum(starts[run], (first[run] + nth) * length)
    out_run.append(run), out_at.append(place)
    for cut in tail[1:-1]:
        inside = np.flatnonzero((starts < cut) & (cut < starts + sizes))
        out_run.append(inside), out_at.append(np.full(len(inside), cut))
    run, place = np.concatenate(out_run), np.concatenate(out_at)
    order = np.lexsort([place, run])
    run, place = run[order], place[order]
    stop = np.append(place[1:], 0)
    ends = (starts + sizes)[run]
    same = np.append(run[1:] == run[:-1], False)
    return run, place, np.where(same, stop, ends) - place


def sequence_of(place: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of a global place, and its offset there."""
    full = total // length * length
    cuts, at = [], full
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - full) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    cuts = np.array(cuts or [full], np.int64)
    late = np.searchsorted(cuts, place, "right") - 1
    seq = np.where(place < full, place // length, full // length + late)
    return seq, np.where(place < full, place % length, place - cuts[np.maximum(late, 0)])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece of docs(doc_id, text) in sequences of at most length tokens."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(tokenized(docs, path or tokenizer_path()), "ids")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges = int(max(1, min(-(-total // RANGE_TOKENS), max(1, count // 8), RANGES)))
    bounds = rows.approxQuantile("place", [i / ranges for i in range(1, ranges)], max(0.2 / ranges, 1e-5)) if ranges > 1 else []
    bounds = np.array(sorted({int(b) for b in bounds}), np.int64)
    edges = Shared(spark, bounds)

    @F.arrow_udf("int")
    def part_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for place in batches:
            yield pa.array(np.searchsorted(edges.value, place.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("part", part_of("place"))
    sums = np.zeros(len(bounds) + 1, np.int64)
    for r in rows.groupBy("part").agg(F.sum("n")).collect():
        sums[r[0]] = r[1]
    total = int(sums.sum())
    first = Shared(spark, np.cumsum(sums) - sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, start = None, 0, first.value
        for batch in batches:
            parts = batch.column(1).to_numpy()
            n = batch.column(2).to_numpy()
            if not len(n):
                continue
            places = np.empty(len(n), np.int64)
            for lo in np.flatnonzero(np.append(True, parts[1:] != parts[:-1])):
                hi = lo + np.argmax(np.append(parts[lo:] != parts[lo], True))
                if parts[lo] != now:
                    now, at = parts[lo], start[int(parts[lo])]
                sizes = n[lo:hi]
                places[lo:hi] = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
            piece, where, size = pieces_of(places, n, total, length)
            seq, offset = sequence_of(where, total, length)
            raw, unit = batch.column(3), batch.column(4).to_numpy()
            crc = np.empty(len(piece), np.int64)
            held, ids = -1, None
            for k, (p, begin, many) in enumerate(zip(piece, where - places[piece], size, strict=True)):
                if p != held:
                    held, ids = p, np.frombuffer(raw[int(p)].as_buffer(), "<u2" if unit[p] == 2 else "<u4").astype("<u4")
                crc[k] = zlib.crc32(ids[begin : begin + many])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(piece)), pa.array(where - places[piece]), pa.array(size), pa.array(crc), pa.array(n[piece]), pa.array(seq), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    # a task for each range, not a hash of it: no two ranges meet
    ordered = rows.repartitionById(len(sums), "part").sortWithinPartitions("part", "key", "place", "doc_id", "ids")
    return ordered.select("doc_id", "part", "n", "ids", "unit").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def pack_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that were kept."""
    return pack(docs)
