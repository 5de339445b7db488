"""Sampled segmentation into pieces, and decoding.

A text is a sequence of words, each with the space before it (the first has one too); no piece crosses words, so the
lattice of a text is a chain of word lattices. Over a word, forward filtering sums the weights of all segmentations up
to every character; backward sampling then draws the last piece, the one before it, and so on, each in proportion to
what leads there. Every draw is a hash of (seed, row key, word number, draw number), so a row's segmentation does not
depend on partitions, batches or retries.

A piece's log weight is -theta * ln(2 + merge rank); a character that is no piece becomes its bytes' pieces, each with
the weight of the last rank. Decoding joins the pieces' bytes and takes off the first space; it is lossless, also for
texts that hold the space mark U+2581 itself, which always goes by its bytes.

Cases: a null text has null ids; an empty one is the single piece of a space; rows of one key with equal texts get
equal ids, a null key counts as the text None; pieces with a space mark inside are left out of the lattice; a very long
word takes time in proportion to its length; columns other than the key and text are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import prepare, table

MARK = "▁"
#: Words of up to this length have their lattices built together.
SHORT = 40
#: Words whose lattices a worker keeps.
KEPT = 250_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def uniform(seed: np.ndarray, word: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers below 1 from hashes."""
    h = seed + word.astype(np.uint64) * _C[0] + np.uint64((draw + 1) * int(_C[3]) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * _C[1]
    h = (h ^ (h >> np.uint64(27))) * _C[2]
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattices:
    """Word lattices after forward filtering, laid out flat: a node for each character end, with its incoming edges."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes, self.weight, self.byte_id = [b""] * size, {}, [0] * 256
        self.id: dict[str, int] = {}
        longest = max(-model.get_score(i) for i in range(size) if model.get_score(i) > -1e8)
        self.byte_weight = (2 + longest) ** -theta
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i)) and MARK not in piece[1:]:
                self.bytes[i] = piece.replace(MARK, " ").encode()
                self.id[piece] = i
                self.weight[piece] = (2 - model.get_score(i)) ** -theta
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        # the same as a trie: (node, character) to the next node, in order; the piece of each node or -1
        node = {"": 0} | {p: i + 1 for i, p in enumerate(sorted(self.prefixes))}
        key = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.int64)
        order = np.argsort(key)
        self.step_key, self.step_to = key[order], np.array([node[p] for p in node if p], np.int64)[order]
        self.piece_at, self.weight_of = np.full(len(node), -1, np.int32), np.zeros(size)
        for p, i in self.id.items():
            self.piece_at[node[p]], self.weight_of[i] = i, self.weight[p]
        self.size, self.longest = size, max(map(len, self.id))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.last_node, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.cdf, self.source, self.first, self.many = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)
        self.nodes = 0
        self.flat = np.arange(self.size, dtype=np.int32)

    def build(self, word: str, cdf: list, source: list, seqs: list, base: int) -> int:
        """Append the word's nodes and edges; gives its number of nodes (ends 0 to len)."""
        get, prefixes = self.weight.get, self.prefixes
        n = len(word)
        wide = self.longest
        into: list[list] = [[] for _ in range(n + 1)]
        alpha = [1.0] + [0.0] * n
        for i in range(n):
            if i:
                s = 0.0
                for _, w, _ in into[i]:
                    s += w
                alpha[i] = s
                if s < 1e-200:  # keep sums of very long words in range; a node's ratios are what counts, and no edge is longer than wide
                    scale = 1e200
                    for j in range(i + 1, min(n, i + wide) + 1):
                        into[j] = [(a, w * scale, p) for a, w, p in into[j]]
                    alpha[i] *= scale
            a = alpha[i]
            if i and word[i] == MARK:
                alone = True
            else:
                j = i + 1
                part = word[i:j]
                alone = part not in self.id
                while part in prefixes:
                    w = get(part)
                    if w is not None:
                        into[j].append((i, a * w, part))
                    j += 1
                    if j > n or (word[j - 1] == MARK):
                        break
                    part = word[i:j]
            if alone:
                raw = word[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, a * self.byte_weight ** len(raw), raw))
        for j in range(1, n + 1):
            total = 0.0
            for _, w, _ in into[j]:
                total += w
            run, node = 0.0, base + j
            for i, w, p in into[j]:
                run += w
                cdf.append(node + run / total)
                source.append(base + i)
                seqs.append(p)
            cdf[-1] = node + 1.0
        return n + 1

    def learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= SHORT]
        long = [w for w in words if len(w) > SHORT]
        for part in [short[i : i + 20_000] for i in range(0, len(short), 20_000)]:
            self.add(part, *self.build_many(part))
        if long:
            cdf, source, seqs, last, nodes = [], [], [], [], self.nodes
            for w in long:
                nodes += self.build(w, cdf, source, seqs, nodes)
                last.append(nodes - 1)
            first, many, extra = [], [], []
            for s in seqs:
                first.append(self.id[s] if isinstance(s, str) else len(self.flat) + len(extra))
                many.append(1 if isinstance(s, str) else len(s))
                extra += [] if isinstance(s, str) else [self.byte_id[b] for b in s]
            self.add(long, np.array(last), np.array(cdf), np.array(source), np.array(first), np.array(many), np.array(extra, np.int32), nodes)

    def add(self, words, last, cdf, source, first, many, extra, nodes) -> None:
        k = len(self.number)
        self.number.update(zip(words, range(k, k + len(words)), strict=True))
        for name, x in (("last_node", last), ("cdf", cdf), ("source", source), ("first", first), ("many", many), ("flat", extra)):
            own = getattr(self, name)
            setattr(self, name, np.concatenate([own, x.astype(own.dtype)]))
        begin = np.zeros(nodes - self.nodes, np.int32)
        at = np.ceil(cdf).astype(np.int64) - 1 - self.nodes
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        begin[at[head]] = head + len(self.cdf) - len(cdf)
        self.begin = np.concatenate([self.begin, begin])
        self.nodes = nodes

    def edge(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The incoming edge of each node that u falls into."""
        goal = node + u
        edge = self.begin[node]
        late = np.flatnonzero(self.cdf[edge] <= goal)
        while len(late):
            edge[late] += 1
            late = late[self.cdf[edge[late]] <= goal[late]]
        return edge

    def build_many(self, words: list[str]):
        """What build() makes, for many short words at once."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max(initial=1))
        code = np.zeros((len(words), wide), np.int64)
        inside = np.arange(wide) < n[:, None]
        code[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        code[:, 1:][code[:, 1:] == ord(MARK)] = 0x1FFFFF  # a mark within a word is no piece
        w, i = np.nonzero(inside)
        at, node, found = np.arange(len(w)), np.zeros(len(w), np.int64), []
        alone = np.ones(len(w), bool)
        for depth in range(wide):
            j = i[at] + depth
            ok = j < n[w[at]]
            at, node, j = at[ok], node[ok], j[ok]
            key = node << 21 | code[w[at], j]
            to = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            ok = self.step_key[to] == key
            at, node = at[ok], self.step_to[to[ok]]
            if not len(at):
                break
            piece = self.piece_at[node]
            whole = piece >= 0
            if depth == 0:
                alone[at[whole]] = False
            found.append((w[at[whole]], i[at[whole]], i[at[whole]] + depth + 1, piece[whole], self.weight_of[piece[whole]]))
        extra: list[int] = []
        odd = np.flatnonzero(alone)
        raw = [words[w[x]][i[x]].encode("utf-8", "surrogatepass") for x in odd]
        starts = np.cumsum([0] + [len(r) for r in raw])[:-1] + len(self.flat)
        for r in raw:
            extra += [self.byte_id[b] for b in r]
        found.append((w[odd], i[odd], i[odd] + 1, starts.astype(np.int32) if len(odd) else np.zeros(0, np.int32), self.byte_weight ** np.array([len(r) for r in raw], np.float64)))
        many = np.concatenate([np.ones(sum(len(f[0]) for f in found[:-1]), np.int64), np.array([len(r) for r in raw], np.int64)])
        w, i, j, first, weight = (np.concatenate([f[k] for f in found]) for k in range(5))
        alpha = np.zeros((len(words), wide + 1))
        alpha[:, 0] = 1
        order = np.argsort(i, kind="stable")
        cut = np.searchsorted(i[order], np.arange(wide + 1))
        value = np.zeros(len(w))
        for k in range(wide):
            e = order[cut[k] : cut[k + 1]]
            value[e] = alpha[w[e], k] * weight[e]
            np.add.at(alpha, (w[e], j[e]), value[e])
        base = self.nodes + np.cumsum(n + 1) - (n + 1)
        order = np.argsort((w * (wide + 1) + j) * (wide + 1) + i, kind="stable")
        w, i, j, first, many, share = w[order], i[order], j[order], first[order], many[order], (value / alpha[w, j])[order]
        head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (j[1:] != j[:-1])))
        run = np.cumsum(share)
        run -= np.repeat(run[head] - share[head], np.diff(np.append(head, len(w))))
        node = base[w] + j
        cdf = node + np.minimum(run, 1.0)
        cdf[np.append(head[1:], len(w)) - 1] = node[np.append(head[1:], len(w)) - 1] + 1.0
        return base + n, cdf, base[w] + i, first, many, np.array(extra, np.int32), int(self.nodes + (n + 1).sum())

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and their starts."""
        parts = [[MARK + w for w in t.split(" ")] for t in texts]
        new = set().union(*parts).difference(self.number)
        if len(self.number) + len(new) > KEPT:
            self.forget()
            new = set().union(*parts)
        self.learn(list(new))
        get = self.number.__getitem__
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(count)
        word = np.fromiter((i for p in parts for i in map(get, p)), np.int64, int(count.sum()))
        nth = np.arange(len(word)) - np.repeat(ends - count, count)
        seed = np.repeat(seeds, count)
        node = self.last_node[word]
        first_node = np.append(0, self.last_node + 1)[word]
        live = np.arange(len(word))
        steps, size, draw = [], np.zeros(len(word), np.int64), 0
        while len(live):
            edge = self.edge(node, uniform(seed, nth, draw))
            size[live] += self.many[edge]
            steps.append((live, edge, size[live]))
            node = self.source[edge].astype(np.int64)
            more = node > first_node
            if not more.all():
                live, node, first_node, seed, nth = live[more], node[more], first_node[more], seed[more], nth[more]
            draw += 1
        stop = np.cumsum(size)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for at, edge, done in steps:
            place, many = stop[at] - done, self.many[edge]
            ids[place] = self.flat[self.first[edge]]
            wide = np.flatnonzero(many > 1)
            for t in range(1, int(many.max())):
                some = wide[many[wide] > t]
                ids[place[some] + t] = self.flat[self.first[edge[some]] + t]
        return ids, np.concatenate([[0], stop[ends - 1]]) if len(ends) else np.zeros(1, np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def seeds_of(keys: list, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}\x1f{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)


def encode(docs: DataFrame, seed: int = 17, theta: float = 1.0, path: str | None = None, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of docs(doc_id, text); with digest, instead of ids their number, CRC-32 (as
    unsigned little-endian 32-bit numbers) and whether they decode to the text."""
    prepare(docs.sparkSession)
    path = path or model_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattices(path, theta)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            some = [t for t in texts if t is not None]
            where = [i for i, t in enumerate(texts) if t is not None]
            ids, starts = model.sample(some, seeds_of([str(k) for k, t in zip(keys.to_pylist(), texts, strict=True) if t is not None], seed))
            if not digest:
                out: list = [None] * len(texts)
                for i, a, b in zip(where, starts[:-1], starts[1:], strict=True):
                    out[i] = ids[a:b]
                yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])
                continue
            n, crc, same = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            raw, every = ids.astype("<u4"), ids.tolist()
            for i, t, a, b in zip(where, some, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                n[i], crc[i], same[i] = b - a, zlib.crc32(raw[a:b]), model.decode(every[a:b]) == t.encode()
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    rows = docs.select(F.col(key).alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, " + ("n_pieces long, ids_crc32 long, lossless boolean" if digest else "ids array<int>"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows(doc_id, ids)."""
    path = path or model_path()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattices(path, 1.0)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op1_sampled_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), digest=True)
