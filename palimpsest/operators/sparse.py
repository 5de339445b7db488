"""Logistic models over long sparse rows: words and pairs of texts, numbers and categories, for many splits and feature sets at once.

A design has a row for each example and split: its role, its label, and the indices and values of its features that are not zero.
Vocabularies, idf, medians, scales and categories come from the training rows of each split, by joins and grouped counts, so there
is no bound on terms or categories but the one that is asked for. Features lie in blocks (a text column, the numbers of a column, a
category column); a feature set is a mask of blocks over the same rows, and all sets of all splits are fitted together: a pass gives
loss and gradient of every open model, from which the driver steps (limited-memory quasi-Newton, or averaged mini-batch steps).
A task holds weights and gradients of the models, never a dense row.

Words are runs of two or more letters, digits or underscores in lower case; terms are words and pairs of neighbours, in at least
`least` training texts, the `terms` most frequent ones of each column (ties in order of the term). A term's value is (1 + ln tf) times
ln((1 + n) / (1 + df)) + 1, and a text's values have length one. Numbers are divided by their training deviation (0 counts as 1),
missing ones are the training median; they are not centred, which an unpenalised intercept makes up for. Each training value of a
category is a feature; others have none.

Cases: null texts are empty; a null label leaves the row out; a split whose training rows have one class is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.audit import quantiles
from palimpsest.operators.logistic import TEST, TRAIN
from palimpsest.operators.selection import before_head
from palimpsest.operators.sums import summed
from palimpsest.sources.staging import written

WORD = r"[\p{L}\p{N}_]{2,}"


@dataclass
class Blocks:
    """Where the features of each split and block begin, and how many each split has."""

    start: dict[tuple[int, str], int]
    size: dict[tuple[int, str], int]

    def width(self, split: int) -> int:
        return max((b + self.size[k] for k, b in self.start.items() if k[0] == split), default=0)

    def allowed(self, split: int, blocks: Sequence[str]) -> np.ndarray:
        out = np.zeros(self.width(split), bool)
        for b in blocks:
            if (split, b) in self.start:
                out[self.start[split, b] : self.start[split, b] + self.size[split, b]] = True
        return out


def terms_of(rows: DataFrame, text: str) -> DataFrame:
    """id, term and tf of every row's words and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    found = rows.select("id", words.alias("w")).select("id", F.explode(F.concat("w", pairs)).alias("term"))
    return found.groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(found: DataFrame, training: DataFrame, terms: int, least: int) -> DataFrame:
    """split, term, nth (from 0) and idf of the terms of each split's training rows(id, split, n)."""
    counted = found.join(training, "id").groupBy("split", "n", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least)
    # a coarse form of the frequency spreads the ranks; terms behind the last rank are left out before they are ranked
    placed = before_head(counted, -F.floor(F.log2(F.col("total").cast("double")) * 8), ["split"], F.lit(1)).where(F.col("_before") < terms)
    nth = F.row_number().over(Window.partitionBy("split", "_head").orderBy(F.desc("total"), "term")) + F.col("_before") - 1
    ranked = placed.withColumn("nth", nth).where(F.col("nth") < terms)
    return ranked.select("split", "term", F.col("nth").cast("int").alias("nth"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def design(rows: DataFrame, splits: DataFrame, texts: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], terms: int = 2000, least: int = 2) -> tuple[DataFrame, Blocks]:
    """id, split, role, y, at (indices) and value of every row(id, label, ...) and split of splits(id, split, role)."""
    rows = written(rows.where("label is not null").select("id", F.col("label").cast("double").alias("y"), *texts, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical]), "rows")
    splits = written(splits.join(rows.select("id"), "id").select("id", F.col("split").cast("int").alias("split"), F.col("role").cast("int").alias("role")), "roles")
    train = splits.where(F.col("role") == TRAIN)
    sizes = train.groupBy("split").agg(F.count("*").alias("n"))
    training = train.join(F.broadcast(sizes), "split").select("id", "split", "n")
    start: dict[tuple[int, str], int] = {}
    size: dict[tuple[int, str], int] = {}
    used = {r[0]: 0 for r in splits.select("split").distinct().collect()}

    def placed(block: str, many: dict[int, int]) -> None:
        for split in used:
            start[split, block], size[split, block] = used[split], many.get(split, 0)
            used[split] += many.get(split, 0)

    parts = []  # (id, split, block, nth, value)
    for text in texts:
        found = written(terms_of(rows, text), "terms")
        words = written(vocabulary(found, training, terms, least), "vocabulary")
        placed(f"text:{text}", {r["split"]: r["n"] for r in words.groupBy("split").agg(F.count("*").alias("n")).collect()})
        values = found.join(words, "term").withColumn("value", (1 + F.ln(F.col("tf").cast("double"))) * F.col("idf"))
        entries = values.groupBy("id", "split").agg(F.collect_list(F.struct("nth", "value")).alias("e"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        parts.append(entries.select("id", "split", F.lit(f"text:{text}").alias("block"), F.transform("e", lambda x: F.struct(x["nth"].alias("nth"), (x["value"] / F.col("norm")).alias("value"))).alias("e")))
    if numeric:
        long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(numeric)])).alias("c")).select("id", "c.*")
        seen = long.join(training.select("id", "split"), "id")
        middle = quantiles(seen, "x", (0.5,), ["split", "i"]).select("split", "i", F.col("q")[0].alias("median"))
        filled = seen.join(F.broadcast(middle), ["split", "i"], "left").withColumn("x", F.coalesce("x", "median", F.lit(0.0)))
        scale = filled.groupBy("split", "i").agg(F.stddev_pop("x").alias("sd"), F.first("median").alias("median"))
        scale = written(scale.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)), "scales")
        values = long.join(splits.select("id", "split"), "id").join(F.broadcast(scale), ["split", "i"], "left").select("id", "split", "i", (F.coalesce("x", "median", F.lit(0.0)) / F.coalesce("sd", F.lit(1.0))).alias("value"))
        for i, c in enumerate(numeric):
            placed(f"number:{c}", dict.fromkeys(used, 1))
            parts.append(values.where(F.col("i") == i).select("id", "split", F.lit(f"number:{c}").alias("block"), F.array(F.struct(F.lit(0).alias("nth"), "value")).alias("e")))
    for c in categorical:
        known = rows.select("id", F.col(c).alias("term")).where("term is not null").join(training, "id").groupBy("split", "term").agg(F.count("*").alias("total"))
        known = before_head(known, F.substring(F.sha2("term", 256), 1, 2), ["split"], F.lit(1))
        known = written(known.select("split", "term", (F.row_number().over(Window.partitionBy("split", "_head").orderBy("term")) + F.col("_before") - 1).cast("int").alias("nth")), "categories")
        placed(f"category:{c}", {r["split"]: r["n"] for r in known.groupBy("split").agg(F.count("*").alias("n")).collect()})
        parts.append(rows.select("id", F.col(c).alias("term")).join(splits.select("id", "split"), "id").join(known, ["split", "term"]).select("id", "split", F.lit(f"category:{c}").alias("block"), F.array(F.struct("nth", F.lit(1.0).alias("value"))).alias("e")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    offsets = rows.sparkSession.createDataFrame([(s, b, o) for (s, b), o in start.items()], "split int, block string, offset int")
    every = every.join(F.broadcast(offsets), ["split", "block"]).select("id", "split", F.transform("e", lambda x: F.struct((x["nth"] + F.col("offset")).alias("at"), x["value"].alias("value"))).alias("e"))
    every = every.groupBy("id", "split").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    out = splits.join(rows.select("id", "y"), "id").join(every, ["id", "split"], "left")
    none = F.array().cast("array<struct<at:int,value:double>>")
    out = out.withColumn("e", F.coalesce("e", none)).select("id", "split", "role", "y", F.col("e")["at"].alias("at"), F.col("e")["value"].alias("value"))
    return written(out, "sparse"), Blocks(start, size)


@dataclass
class Model:
    """Weights of one feature set in one split; the last one is the intercept."""

    split: int
    name: str
    allowed: np.ndarray
    l2: float
    n: int
    weights: np.ndarray
    open: bool = True
    memory: list = field(default_factory=list, repr=False)


def _entries(batch: pa.RecordBatch):
    size = np.asarray(batch.column("at").value_lengths()).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), size), batch.column("at").flatten().to_numpy(), batch.column("value").flatten().to_numpy(zero_copy_only=False)


def _gradients(data: DataFrame, models: list[Model], points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, int]]:
    """Of each model at its point: mean loss with penalty, gradient, and rows, over the training rows of data."""
    # weights outside of a set are 0, so that its models take the entries of a split as they are
    state = [(k, models[k].split, models[k].allowed, np.append(np.where(models[k].allowed, w[:-1], 0), w[-1])) for k, w in points.items()]

    def step(state, batch):
        row, at, value = _entries(batch)
        split, y = batch.column("split").to_numpy(), batch.column("y").to_numpy()
        for s in np.unique(split).tolist():
            rows = split == s
            r, a, v, t = row, at, value, y
            if not rows.all():
                pick = rows[row]
                r, a, v, t = (np.cumsum(rows) - 1)[row[pick]], at[pick], value[pick], y[rows]
            r, a = r.astype(np.intp), a.astype(np.intp)  # once, not in each sum
            for k, _, allowed, w in (x for x in state if x[1] == s):
                z = np.bincount(r, v * w[a], len(t)) + w[-1]
                e = 0.5 + 0.5 * np.tanh(z / 2) - t
                g = np.bincount(a, v * e[r], len(allowed))
                yield k, np.concatenate([[(np.logaddexp(0, z) - t * z).sum(), len(t)], np.where(allowed, g, 0), [e.sum()]])

    found = summed(data.where(F.col("role") == TRAIN).select("split", "y", "at", "value"), state, step)
    out = {}
    for k, w in points.items():
        m = models[k]
        total = found.get(k, np.zeros(len(w) + 2))
        n = max(1.0, total[1])
        free = np.append(w[:-1], 0)
        out[k] = float(total[0] / n + m.l2 / 2 * (free**2).sum()), total[2:] / n + m.l2 * free, int(total[1])
    return out


def models_of(data: DataFrame, blocks: Blocks, sets: dict[str, Sequence[str]], c: float = 1.0) -> list[Model]:
    """A model for each split and feature set (names of blocks), with penalty 1 / (c n)."""
    out = []
    for r in data.where(F.col("role") == TRAIN).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positive")).orderBy("split").collect():
        if r["positive"] in (0, r["n"]):
            raise ValueError(f"the training rows of split {r['split']} have one class alone")
        for name, parts in sets.items():
            w = np.zeros(blocks.width(r["split"]) + 1)
            out.append(Model(r["split"], name, blocks.allowed(r["split"], parts), 1 / (c * r["n"]), r["n"], w))
    return out


def fit(data: DataFrame, models: list[Model], steps: int = 200, done: float = 1e-6, kept: int = 10) -> list[Model]:
    """[M18] Limited-memory quasi-Newton steps for all models at once, halved until the loss falls enough."""
    at = _gradients(data, models, {k: m.weights for k, m in enumerate(models)})
    state = {k: (f, g) for k, (f, g, _) in at.items()}
    trial: dict[int, tuple[np.ndarray, float]] = {}
    for _ in range(steps):
        for k, m in enumerate(models):
            if m.open and k not in trial:
                f, g = state[k]
                if np.abs(g).max() <= done:
                    m.open = False
                    continue
                d, alphas = g.copy(), []
                for s, y, rho in reversed(m.memory):
                    alphas.append(rho * (s @ d))
                    d -= alphas[-1] * y
                if m.memory:
                    s, y, _ = m.memory[-1]
                    d *= (s @ y) / (y @ y)
                for (s, y, rho), a in zip(m.memory, reversed(alphas), strict=True):
                    d += s * (a - rho * (y @ d))
                if d @ g <= 0:
                    d, m.memory = g.copy(), []
                trial[k] = -d, 1.0 if m.memory else min(1.0, 1 / np.abs(g).sum())
        if not trial:
            break
        found = _gradients(data, models, {k: models[k].weights + t * d for k, (d, t) in trial.items()})
        for k, (f, g, _) in found.items():
            m, (d, t), (f0, g0) = models[k], trial[k], state[k]
            if f > f0 + 1e-4 * t * (d @ g0) and t > 1e-10:
                trial[k] = d, t / 2
                continue
            if t <= 1e-10:
                m.open = False
            s, y = t * d, g - g0
            if s @ y > 1e-12:
                m.memory = [*m.memory, (s, y, 1 / (s @ y))][-kept:]
            m.weights, state[k] = m.weights + s, (f, g)
            del trial[k]
    return models


def fit_averaged(data: DataFrame, models: list[Model], epochs: int = 5, batches: int = 8, rate: float = 1.0, seed: int = 17) -> list[Model]:
    """[M17] Mini-batch gradient steps, a batch by a hash of id, with rates that fall as 1 / sqrt(step); weights are the mean over the
    steps of the second half."""
    part = data.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)))
    total, step, counted = [np.zeros_like(m.weights) for m in models], 0, 0
    for epoch in range(epochs):
        for b in range(batches):
            step += 1
            found = _gradients(part.where(F.col("batch") == b), models, {k: m.weights for k, m in enumerate(models)})
            for k, (_, g, n) in found.items():
                if n:
                    models[k].weights = models[k].weights - rate / step**0.5 * g
            if 2 * epoch >= epochs - 1:
                counted += 1
                for k, m in enumerate(models):
                    total[k] += m.weights
    for k, m in enumerate(models):
        m.weights = total[k] / max(1, counted)
    return models


def scored(data: DataFrame, models: list[Model], role: int = TEST) -> DataFrame:
    """id, split, feature_set, label and probability of every row with that role."""
    shared = data.sparkSession.sparkContext.broadcast([(m.split, m.name, m.allowed, m.weights) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, value = _entries(batch)
            split, y = batch.column("split").to_numpy(), batch.column("y").to_numpy()
            for s, name, allowed, w in shared.value:
                rows = np.flatnonzero(split == s)
                if len(rows):
                    pick = (split == s)[row]
                    r, a, v = row[pick], at[pick], value[pick]
                    some = allowed[a]
                    z = np.bincount(r[some], v[some] * w[a[some]], batch.num_rows)[rows] + w[-1]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows)), pa.array(split[rows].astype(np.int32)), pa.array([name] * len(rows), pa.string()), pa.array(y[rows].astype(np.int32)), pa.array(0.5 + 0.5 * np.tanh(z / 2))],
                        ["id", "split", "feature_set", "label", "probability"],
                    )

    kind = data.schema["id"].dataType.simpleString()
    return data.where(F.col("role") == role).select("id", "split", "y", "at", "value").mapInArrow(run, f"id {kind}, split int, feature_set string, label int, probability double")
