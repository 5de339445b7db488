"""Edit-aware token counts.

A document is cut into pre-tokens (the pieces within which byte-pair merges happen), and these into leaves of a
segment tree whose nodes hold sums of characters and tokens. An edit replaces characters [start, stop) by a text: only
leaves from CONTEXT characters before it up to where the new pre-tokens fall in step with the old ones again are encoded
anew, and only sums above them change. Counts equal those of encoding the whole edited text.

Why CONTEXT is enough: the pattern has no look-behind, and a pre-token depends on at most two characters past its end
(a contraction's two letters; the white-space rule looks at one), so a pre-token that ends three or more characters
before the edit stays. Matching goes left to right without memory, so once a new boundary meets an old one behind the
edit, the rest stays.

Cases: a null text or one that is edited nowhere keeps its count (null text: null counts); edits apply one after the
other, each to the text so far, with places clipped to it; null edits are none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import prepare, table

#: Pre-tokens of a leaf, characters of left context, and pre-tokens whose counts a worker keeps.
LEAF, CONTEXT, KEPT = 32, 4, 500_000


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str, split: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(split)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > KEPT:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = len(self.encoding._encode_single_piece(p))
            return list(map(known.__getitem__, parts))


class Tree:
    """Sums of characters and tokens over leaves of pre-tokens (lists of lengths and counts)."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        n = len(lengths)
        leaves = max(1, -(-n // LEAF))
        self.leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, max(n, 1), LEAF)]
        self.wide = 1 << (leaves - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.wide, np.int64), np.zeros(2 * self.wide, np.int64)
        if n:
            edges = np.arange(0, n, LEAF)
            self.chars[self.wide : self.wide + leaves] = np.add.reduceat(np.array(lengths), edges)
            self.tokens[self.wide : self.wide + leaves] = np.add.reduceat(np.array(tokens), edges)
        half = self.wide
        while half > 1:
            for sums in (self.chars, self.tokens):
                sums[half // 2 : half] = sums[half : 2 * half : 2] + sums[half + 1 : 2 * half : 2]
            half //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character place (the last one for the text's end), and where it begins."""
        node, begin = 1, 0
        place = min(place, max(0, int(self.chars[1]) - 1))
        while node < self.wide:
            node *= 2
            if place - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return min(node - self.wide, len(self.leaves) - 1), begin

    def set_leaf(self, i: int, lengths: list[int], tokens: list[int]) -> None:
        self.leaves[i] = (lengths, tokens)
        node = self.wide + i
        self.chars[node], self.tokens[node] = sum(lengths), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


class Document:
    """A text with its tree; edit() keeps both and counts the pre-tokens that it encodes."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        parts = counter.split.findall(text)
        self.pieces, self.encoded = len(parts), 0
        self.tree = Tree(list(map(len, parts)), counter.counts(parts))

    def edit(self, start: int, stop: int, insert: str) -> None:
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        new = self.text[:start] + insert + self.text[stop:]
        shift = len(insert) - (stop - start)
        first, begin = self.tree.leaf_at(max(0, start - CONTEXT))
        lengths = self.tree.leaves[first][0]
        k = 0
        while k < len(lengths) and begin + lengths[k] < start - CONTEXT + 1:
            begin += lengths[k]
            k += 1
        kept_lengths, kept_tokens = lengths[:k], self.tree.leaves[first][1][:k]
        # old boundaries from here on, by leaf, so that the new ones can meet them
        leaf, at, old = first, k, begin
        made: list[str] = []
        place = begin
        found = self.counter.split.finditer(new, begin)
        met = False
        while True:
            while old < place - shift or old < stop:  # go along the old boundaries up to the new one
                if at >= len(self.tree.leaves[leaf][0]):
                    if leaf + 1 >= len(self.tree.leaves):
                        break
                    leaf, at = leaf + 1, 0
                    continue
                old += self.tree.leaves[leaf][0][at]
                at += 1
            if place >= start + len(insert) and old == place - shift and old >= stop:
                met = True
                break
            m = next(found, None)
            if m is None:
                break
            made.append(m[0])
            place = m.end()
        tail = (self.tree.leaves[leaf][0][at:], self.tree.leaves[leaf][1][at:]) if met else ([], [])
        last = leaf if met else len(self.tree.leaves) - 1
        for i in range(first + 1, last + 1):
            self.tree.set_leaf(i, [], [])
        self.tree.set_leaf(first, kept_lengths + list(map(len, made)) + tail[0], kept_tokens + self.counter.counts(made) + tail[1])
        self.text = new
        self.encoded += len(made)


def edited_counts(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """doc_id, n_pieces, tokens_before, tokens_after, n_encoded (pre-tokens encoded again) for docs(doc_id, text, edits)
    with edits an array of (start, stop, insert) structures."""
    prepare(docs.sparkSession)
    path, split = path or ranks_path(), split or pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, split)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                doc = Document(text, counter)
                before = doc.tree.total
                for e in edits or []:
                    if e is not None and e["start"] is not None:
                        doc.edit(e["start"], e["stop"] if e["stop"] is not None else e["start"], e["insert"] or "")
                rows.append((doc.pieces, before, doc.tree.total, doc.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]], ["doc_id", "n_pieces", "tokens_before", "tokens_after", "n_encoded"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, n_pieces long, tokens_before long, tokens_after long, n_encoded long")


def with_standard_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document, at places that depend on its length: a replacement, an insertion, a deletion."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edit = lambda start, stop, insert: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(insert).alias("insert"))
    return docs.select("doc_id", "text", F.array(edit(third, third + 5, "amended "), edit(2 * third, 2 * third, " isn't updated"), edit(F.floor(n / 2), F.floor(n / 2) + 12, "")).alias("edits"))


def op3_edited_token_counts(spark, sf_dir):
    return edited_counts(with_standard_edits(table(spark, sf_dir, "documents")))
