"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text is lower-cased and cut into words at white space; a word enters as [its own vector, mean vector of its hashed
character 3- and 4-grams]. Windows of WINDOW words overlap by WINDOW - STRIDE; in each, forward and backward gated
units run over the words, attention pools their states and a linear layer gives a logit. A text's score is that of its
highest window, over all windows of the whole text. Training is multiple-instance: first every window has its text's
label, then only the highest windows of a toxic text count as toxic, while all windows of a clean text stay clean.

Labels are read only where crc32(doc_id as text) mod 5 is not 0. The training sample is bounded by SAMPLE (texts of
each label, in order of a hash of doc_id) and WORDS (words of each label, long ones counted in parts).

Cases: a text that is null or has no word has score 0; without labels of both kinds every score is 0; rows of one
doc_id are scored one by one, and a null doc_id is scored but never learned from; columns of other names stay out of the
way; an empty table gives no rows; words longer than LONGEST characters are cut into pieces of that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import Shared, drop, held_out, learnable, prepare, table, written

#: Words of a window, the step between windows, and the step between windows of the training sample.
WINDOW, STRIDE, SAMPLE_STRIDE = 64, 32, 56
LONGEST = 24
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 12, 1 << 13
#: The bound of the training sample: texts, and words, of either label.
SAMPLE, WORDS = {1: 1500, 0: 5000}, {1: 250_000, 0: 1_000_000}
#: Words and character buckets in fewer sample texts than this have no vector of their own.
LEAST = 4
#: Epochs in all, and those at first in which every window has its text's label.
#: A small sample gets more epochs, so that there are STEPS steps or so.
EPOCHS, FLAT, BATCH, RATE, DECAY, STEPS = 8, 1, 128, 1e-2, 1e-5, 400
FLAT_CLEAN = 8000
#: Words whose vectors a worker keeps.
KEPT = 400_000

_outer = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str | None) -> list[str]:
    found = text.lower().split() if text else []
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def bare(word: str) -> str:
    return word if word.isalpha() else _outer.sub("", word)


def summed(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of x by place."""
    out = np.zeros((n, x.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        place = at[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out[place[first]] = np.add.reduceat(x[order], first, axis=0)
    return out


def grams(words: list[str]) -> np.ndarray:
    """Hashed character 3- and 4-grams of each <word>: bucket numbers from 1, 0 where there is none."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    wide = int(size.max(initial=2))
    code = np.zeros((len(words), max(4, wide)), np.uint64)
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
    code[np.arange(code.shape[1]) < size[:, None]] = flat
    three = (code[:, :-2] * np.uint64(1_000_003) + code[:, 1:-1]) * np.uint64(1_000_003) + code[:, 2:]
    four = three[:, :-1] * np.uint64(1_000_003) + code[:, 3:] + np.uint64(7)
    found = np.concatenate([three, four], 1) * np.uint64(0x9E3779B97F4A7C15)
    found = (found >> np.uint64(51)).astype(np.int64) % CHAR_BUCKETS + 1
    ok = np.concatenate([np.arange(three.shape[1]) < size[:, None] - 2, np.arange(four.shape[1]) < size[:, None] - 3], 1)
    return np.where(ok, found, 0)


def gram_table(words: list[str]) -> np.ndarray:
    """grams() of many words, a part at a time, in a compact table."""
    out = np.zeros((len(words), 2 * LONGEST - 1), np.int16)
    for k in range(0, len(words), 4096):
        part = grams(words[k : k + 4096])
        out[k : k + len(part), : part.shape[1]] = part
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    def __init__(self, words: dict[str, int], known: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words, self.known, self.shift = words, known, 0.0
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {"word": normal(len(words) + 1, WORD_DIM, by=0.3), "char": normal(CHAR_BUCKETS + 1, CHAR_DIM, by=0.6)}
        for way in "fb":
            self.p |= {f"x{way}": normal(d, 3 * h, by=d**-0.5), f"h{way}": normal(h, 3 * h, by=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"attend": normal(2 * h, by=0.3), "out": normal(2 * h, by=0.3), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.p["char"][0] = 0

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        parts = gram_table(words)
        parts[~self.known[parts]] = 0
        return own, parts

    def vectors(self, own: np.ndarray, parts: np.ndarray) -> np.ndarray:
        out = np.empty((len(own), WORD_DIM + CHAR_DIM), np.float32)
        for k in range(0, len(own), 4096):
            some = parts[k : k + 4096]
            per = 2 / np.maximum((some > 0).sum(1), 1)
            out[k : k + 4096, :WORD_DIM] = self.p["word"][own[k : k + 4096]]
            out[k : k + 4096, WORD_DIM:] = self.p["char"][some].sum(1) * per[:, None]
        return out

    def run(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from projected inputs (time, window, 3 * hidden); mask (time, window)."""
        t, b, _ = xf.shape
        h = HIDDEN
        states = np.empty((t, b, 2 * h), np.float32)
        saved = {}
        for way, x in (("f", xf), ("b", xb)):
            wh, at = self.p[f"h{way}"], slice(0, h) if way == "f" else slice(h, 2 * h)
            now = np.zeros((b, h), np.float32)
            gates, cand, inner, before = ([], [], [], [])
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                lin = now @ wh
                g = sigmoid(x[i, :, : 2 * h] + lin[:, : 2 * h])
                n = np.tanh(x[i, :, 2 * h :] + g[:, h:] * lin[:, 2 * h :])
                z = g[:, :h]
                if keep:
                    gates.append(g), cand.append(n), inner.append(lin[:, 2 * h :]), before.append(now)
                now = (n + z * (now - n)) * mask[i][:, None] + now * (1 - mask[i][:, None]) if mask is not None else n + z * (now - n)
                states[i, :, at] = now
            saved[way] = (gates, cand, inner, before)
        e = states @ self.p["attend"]
        if mask is not None:
            e = np.where(mask > 0, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        v = states @ self.p["out"]
        logit = (a * v).sum(0) + self.p["bias"]
        return (logit, states, a, v, saved) if keep else logit

    def gradients(self, own, parts, tok, mask, label, weight):
        """tok and mask (time, window); own and parts by word; gives the loss and gradients by name."""
        p, h, (t, b) = self.p, HIDDEN, tok.shape
        word, back = np.unique(tok.ravel(), return_inverse=True)
        at, bag = own[word], parts[word]
        some = bag > 0
        per = (2 / np.maximum(some.sum(1), 1)).astype(np.float32)
        vec = np.concatenate([p["word"][at], p["char"][bag].sum(1) * per[:, None]], 1)
        flat = vec[back]
        xs = {way: (vec @ p[f"x{way}"] + p[f"c{way}"])[back].reshape(t, b, 3 * h) for way in "fb"}
        logit, states, a, v, saved = self.run(xs["f"], xs["b"], mask, True)
        prob = sigmoid(logit)
        d = ((prob - label) * weight / b).astype(np.float32)
        g = {"bias": d.sum(keepdims=True), "out": ((a * d)[:, :, None] * states).sum((0, 1))}
        de = a * (v - (a * v).sum(0)) * d
        g["attend"] = (de[:, :, None] * states).sum((0, 1))
        ds = (a * d)[:, :, None] * p["out"] + de[:, :, None] * p["attend"]
        dx = np.zeros_like(flat)
        for way in "fb":
            wh, half = p[f"h{way}"], slice(0, h) if way == "f" else slice(h, 2 * h)
            gates, cand, inner, before = saved[way]
            dwh, dnow = np.zeros_like(wh), np.zeros((b, h), np.float32)
            dxs = np.empty((t, b, 3 * h), np.float32)
            order = range(t) if way == "f" else range(t - 1, -1, -1)
            for k in range(t - 1, -1, -1):
                i = order[k]
                m = mask[i][:, None]
                dnow = dnow + ds[i, :, half]
                live = dnow * m
                z, r = gates[k][:, :h], gates[k][:, h:]
                dn = live * (1 - z) * (1 - cand[k] ** 2)
                dlin = np.concatenate([live * (before[k] - cand[k]) * z * (1 - z), dn * inner[k] * r * (1 - r), dn * r], 1)
                dxs[i, :, : 2 * h], dxs[i, :, 2 * h :] = dlin[:, : 2 * h], dn
                dwh += before[k].T @ dlin
                dnow = dnow * (1 - m) + live * z + dlin @ wh.T
            dxs = dxs.reshape(t * b, -1)
            g |= {f"h{way}": dwh, f"x{way}": flat.T @ dxs, f"c{way}": dxs.sum(0)}
            dx += dxs @ p[f"x{way}"].T
        dvec = summed(dx, back, len(word))
        g["word"] = summed(dvec[:, :WORD_DIM], at, len(p["word"]))
        row = np.nonzero(some)[0]
        g["char"] = summed((dvec[:, WORD_DIM:] * per[:, None])[row], bag[some], len(p["char"]))
        g["word"][0] = 0
        loss = -(weight * np.where(label > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).mean()
        return loss, g

    def scores(self, texts: list[list[int]], rows: np.ndarray, block: int = 2048) -> np.ndarray:
        """Highest window's probability of each text; texts hold row numbers of rows (their vectors)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts))
        token = np.fromiter((i for t in texts for i in t), np.int64, int(sizes.sum()))
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        count = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
        of = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = base[of] + np.minimum(nth * STRIDE, np.maximum(sizes[of] - WINDOW, 0))
        length = np.minimum(WINDOW, sizes[of])
        for whole in (True, False):
            pick = np.flatnonzero((length == WINDOW) == whole)
            pick = pick if whole else pick[np.argsort(length[pick], kind="stable")]
            for k in range(0, len(pick), block):
                at = pick[k : k + block]
                t = int(length[at].max())
                steps = np.arange(t)[:, None]
                idx = token[np.minimum(start[at] + steps, start[at] + length[at] - 1)]
                mask = None if whole else (steps < length[at]).astype(np.float32)
                x = rows[idx]
                logit = self.run(x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"], mask)
                np.maximum.at(out, of[at], sigmoid(logit.astype(np.float64) + self.shift))
        return out


def train(texts: list[list[str]], labels: list[int], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    for t in texts:
        for w in set(t):
            seen[w] = seen.get(w, 0) + 1
    common = sorted(w for w, n in seen.items() if n >= LEAST)
    every = sorted(seen)
    parts = gram_table(every)
    number = {w: i for i, w in enumerate(every)}
    used = np.zeros(CHAR_BUCKETS + 1, np.int64)
    for t in texts:
        used[np.unique(parts[[number[w] for w in set(t)]])] += 1
    known = used >= LEAST
    known[0] = False
    net = Network({w: i + 1 for i, w in enumerate(common)}, known, seed)
    own, parts = net.features(every)
    ids = [np.fromiter((number[w] for w in t), np.int64, len(t)) for t in texts]
    windows = [(d, s) for d, t in enumerate(ids) for s in range(0, max(1, len(t) - (WINDOW - SAMPLE_STRIDE)), SAMPLE_STRIDE)]
    of = np.array([d for d, _ in windows])
    label = np.array(labels, np.float32)[of]
    grid = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, (d, s) in enumerate(windows):
        part = ids[d][s : s + WINDOW]
        grid[i, : len(part)], mask[i, : len(part)] = part, 1

    def logits() -> np.ndarray:
        vec = net.vectors(own, parts)
        x = {way: vec @ net.p[f"x{way}"] + net.p[f"c{way}"] for way in "fb"}
        return np.concatenate([net.run(x["f"][grid[k : k + 2048].T], x["b"][grid[k : k + 2048].T], mask[k : k + 2048].T) for k in range(0, len(windows), 2048)])

    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    epochs = min(40, max(EPOCHS, STEPS * BATCH // len(windows)))
    for epoch in range(epochs):
        clean = rng.permutation(np.flatnonzero(label == 0))
        if epoch < max(FLAT, epochs // 5):
            chosen = np.concatenate([np.flatnonzero(label > 0), clean[:FLAT_CLEAN]])
        else:  # of a toxic text only its highest window; of a clean one its two highest; some more clean ones
            order = np.lexsort([-logits(), of])
            nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
            chosen = np.concatenate([order[nth < np.where(label[order] > 0, 1, 2)], clean[: FLAT_CLEAN // 4]])
        share = (label[chosen] > 0).mean()
        weight = np.where(label[chosen] > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            row = chosen[at]
            _, g = net.gradients(own, parts, grid[row].T, mask[row].T, label[row], weight[at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for name, x in g.items():
                m, s = state[name]
                x = x / max(1.0, norm) + (DECAY * net.p[name] if name in ("word", "char") else 0)
                m += 0.1 * (x - m)
                s += 0.01 * (x * x - s)
                net.p[name] -= (RATE * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    p = net.scores(ids, net.vectors(own, parts)).clip(1e-12, 1 - 1e-12)
    net.shift = -threshold(np.log(p / (1 - p)), np.array(labels))
    return net


def threshold(top: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two texts at which the fewest sample texts, kinds weighing alike, are on the wrong side."""
    order = np.argsort(top, kind="stable")
    x, y = top[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum()) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]]) / max(1, (y == 0).sum())
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gap = np.concatenate([[1], np.diff(x), [1]])[best]
    return float(edges[best[gap.argmax()]])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[list[str]], list[int]]:
    """Whole texts with labels, in order of a hash of doc_id: the first within the bounds SAMPLE and WORDS. A doc_id with
    several labels is toxic if any says so; of several texts it gives the smallest. Bounds are applied before texts are
    collected; a word takes two characters at least."""
    at = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("at", at)
    picked = None
    for y, most in SAMPLE.items():
        part = known.where(F.col("toxic") == y).orderBy("at", "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    found = written(found.groupBy("doc_id", "toxic", "at").agg(F.min("text").alias("text")), "sample")
    words = F.regexp_count("text", F.lit(r"\S+")) + F.floor(F.length("text") / LONGEST)
    w = Window.partitionBy("toxic").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = found.select("doc_id", "toxic", "at", words.alias("words"))
    most = F.when(F.col("toxic") == 1, WORDS[1]).otherwise(WORDS[0])
    chosen = sizes.where(F.col("words") <= most).withColumn("used", F.sum("words").over(w)).where(F.col("used") <= most).select("doc_id")
    rows = found.join(F.broadcast(chosen), "doc_id").collect()
    drop(found)
    texts, ys = [], []
    for r in sorted(rows, key=lambda r: (r["at"], r["doc_id"])):
        words = [bare(w) for w in words_of(r["text"])]
        if words:
            texts.append(words)
            ys.append(r["toxic"])
    return texts, ys


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    texts, ys = sample(docs, labels)
    return train(texts, ys) if len(set(ys)) == 2 else None


def with_score(docs: DataFrame, net: Network | None, text: str = "text", into: str = "score") -> DataFrame:
    if net is None:
        return docs.withColumn(into, F.lit(0.0))
    shared = Shared(docs.sparkSession, net)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        number: dict[str, int] = {}
        rows = np.zeros((1 << 14, WORD_DIM + CHAR_DIM), np.float32)
        for batch in batches:
            texts = [words_of(t) for t in batch.to_pylist()]
            new = list(set().union(*texts).difference(number))
            if len(number) + len(new) > KEPT:
                number, new = {}, list(set().union(*texts))
            while len(number) + len(new) > len(rows):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                rows[len(number) : len(number) + len(part)] = model.vectors(*model.features([bare(w) for w in part]))
                number.update(zip(part, range(len(number), len(number) + len(part)), strict=True))
            get = number.__getitem__
            yield pa.array(model.scores([list(map(get, t)) for t in texts], rows))

    return docs.withColumn(into, score(F.coalesce(F.col(text), F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    net = learn(docs, labels)
    out = with_score(docs.select("doc_id", held_out().alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    net = learn(docs, table(spark, sf_dir, "labels"))
    out = with_score(docs.withColumn("\u0001text", F.col("text")), net, "\u0001text", "\u0001score")
    return out.where(F.col("\u0001score") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
