"""Features and probes over vector columns: geometry, scaling, regularised logistic probes, trees, a small value network."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import boosting as T
from palimpsest.operators import logistic as G
from palimpsest.operators import sparse as Q
from palimpsest.operators.projections import BASE_CATEGORICAL, BASE_NUMERIC, BASE_TEXT, FeatureSet
from palimpsest.operators.selection import before_head, hash_ranked
from palimpsest.sources.staging import drop, written

GRID = G.GRID


def _sub(a, b) -> Column:
    return F.zip_with(X.col(a), X.col(b), lambda x, y: x - y)


def geometry(context: str, a: str, b: str) -> Column:
    """[M35] Without orientation: context, mean and absolute difference."""
    return F.concat(F.col(context), F.zip_with(a, b, lambda x, y: (x + y) / 2), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def choice_geometry(context: str, selected: str, rejected: str) -> Column:
    """[M35] With orientation: context, selected, rejected and their difference."""
    return F.concat(F.col(context), F.col(selected), F.col(rejected), _sub(selected, rejected))


def antisymmetric(a: str, b: str, context: str) -> Column:
    """[M36] Difference, and difference by context: exchanging candidates changes every sign."""
    return F.concat(_sub(a, b), F.zip_with(_sub(a, b), F.col(context), lambda d, c: d * c))


def scaled(rows: DataFrame, vector: str, train: Column, into: str = "scaled") -> DataFrame:
    """[M24] Each component by the mean and population deviation of training rows; deviations up to 1e-6 count as 1."""
    long = rows.where(train).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = long.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") <= 1e-6, 1.0).otherwise(F.col("s")).alias("s")))).alias("_stats"))
    return rows.crossJoin(F.broadcast(stats)).withColumn(into, F.zip_with(F.col(vector), F.col("_stats"), lambda x, t: (x - t["m"]) / t["s"])).drop("_stats")


def projected(rows: DataFrame, vector: str, train: Column, k: int) -> DataFrame:
    """[M43] Principal components of centred training rows, applied to all."""
    rows = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows.where(train))
    mean = np.array(rows.where(train).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x")).orderBy("i").toPandas().iloc[:, 1])
    shift = (mean @ model.pc.toArray()).tolist()
    return model.transform(rows).withColumn("projected", F.zip_with(vector_to_array("_p"), F.array(*[F.lit(x) for x in shift]), lambda a, b: a - b)).drop("_v", "_p")


def _width(rows: DataFrame, vector: Column) -> int | None:
    found = rows.where(vector.isNotNull()).select(F.size(vector)).first()
    return None if found is None else found[0]


PROBED = "fold int, label int, probability double, l2_lambda double"


def probe(rows: DataFrame, vector: str, label: str, folds: int, grid: tuple[float, ...] = GRID, intercept: bool = True) -> DataFrame:
    """[M24-M27, M39] Per fold: scale on training rows, fit each penalty, choose by validation loss, score the test rows
    once. rows(id, fold_bucket, vector, label); gives id, fold, label, probability, l2_lambda."""
    return probes(rows, {"probe": F.col(vector)}, label, folds, grid, intercept).drop("arm")


def probes(rows: DataFrame, arms: dict[str, Column], label: str, folds: int, grid: tuple[float, ...] = GRID, intercept: bool = True) -> DataFrame:
    """[M25, M44] probe() of every arm (a vector) at once: arm, id, fold, label, probability, l2_lambda. Folds, arms and penalties
    are fitted together in each pass over the rows."""
    widths = {name: _width(rows, v) for name, v in arms.items()}
    if None in widths.values():
        return rows.sparkSession.createDataFrame([], f"arm string, id {rows.schema['id'].dataType.simpleString()}, {PROBED}")
    data = G.folds_design(rows, F.concat(*[v.cast("array<double>") for v in arms.values()]), label, folds)
    every, at = [], 0
    for name, width in widths.items():
        every += [G.Arm(fold, name, tuple(range(at, at + width))) for fold in range(folds)]
        at += width
    scales, models = G.fit(data, every, grid, intercept, "constant")
    return G.scored(data, scales, G.chosen(data, scales, models)).select("arm", "id", F.col("split").alias("fold"), "label", "probability", "l2_lambda")


def boosted_arms(rows: DataFrame, blocks: dict[str, Column], arms: dict[str, tuple[str, ...]], label: str, folds: int, settings: T.Settings = T.Settings()) -> DataFrame:
    """[M45, M46] Second-order boosted trees of every arm (names of blocks, which are vectors) and fold, grown together: id, arm, fold,
    label, probability, rounds. rows(id, fold_bucket, label, ...)."""
    starts, at = {}, 0
    for name, v in blocks.items():
        if (width := _width(rows, v)) is None:
            return rows.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, arm string, fold int, label int, probability double, rounds int")
        starts[name], at = range(at, at + width), at + width
    role = [F.when(F.col("fold_bucket") == f, G.TEST).when(F.col("fold_bucket") == (f + 1) % folds, G.VALIDATION).otherwise(G.TRAIN) for f in range(folds)]
    data, _ = T.binned(rows, F.concat(*[v.cast("array<double>") for v in blocks.values()]), F.col(label), F.array(*[F.lit(f) for f in range(folds)]), F.array(*role))
    every = [G.Arm(f, name, tuple(i for b in parts for i in starts[b])) for name, parts in arms.items() for f in range(folds)]
    return T.scored(data, T.boost(data, every, settings))


def text_models(rows: DataFrame, splits: DataFrame, texts: list[str], numeric: list[str], categorical: list[str], sets: dict[str, tuple[str, ...]] | None = None, c: float = 1.0, terms: int = 2000, averaged: bool = False) -> DataFrame:
    """[M17, M18, M21] TF-IDF of texts, numbers and categories fitted on the training rows of each split, and a logistic model with
    penalty 1 / (c n) for each split and feature set (names of blocks; without sets one of all): id, split, feature_set, label and
    probability of test rows. rows(id, label, ...), splits(id, split, role). averaged takes mini-batch steps instead of quasi-Newton."""
    data, blocks = Q.design(rows, splits, texts, numeric, categorical, terms)
    sets = sets or {"all": tuple(dict.fromkeys(b for _, b in blocks.start))}
    models = Q.models_of(data, blocks, sets, c)
    return Q.scored(data, (Q.fit_averaged if averaged else lambda d, m: Q.fit(d, m, done=1e-4))(data, models))


def feature_set_models(rows: DataFrame, splits: DataFrame, sets: list[FeatureSet], terms: int = 2000, c: float = 1.0) -> DataFrame:
    """[P20, M21] text_models() of feature sets as masks over one design. A set that is shuffled reads the columns with `_shuffled`
    behind their name in place of those that base sets do not have."""
    base = {*BASE_TEXT, *BASE_NUMERIC, *BASE_CATEGORICAL}
    own = lambda f, c: f"{c}_shuffled" if f.shuffled and c not in base else c
    texts = list(dict.fromkeys(own(f, c) for f in sets for c in f.text))
    numeric = list(dict.fromkeys(own(f, c) for f in sets for c in f.numeric))
    categorical = list(dict.fromkeys(c for f in sets for c in f.categorical))
    masks = {f.name: (*[f"text:{own(f, c)}" for c in f.text], *[f"number:{own(f, c)}" for c in f.numeric], *[f"category:{c}" for c in f.categorical]) for f in sets}
    return text_models(rows, splits, texts, numeric, categorical, masks, c, terms)


def four_arms(rows: DataFrame, group: str, target: str, base: list[str], preference: list[str], seed: int = 17, fraction: float = 0.2, key: str = "id", bucket: str | None = None) -> DataFrame:
    """[M19, M20] arm_matrix() of one table and seed: arm, id, lineage_id, label, probability."""
    return arm_matrix(rows.withColumn("condition", F.lit("rows")), group, target, base, preference, [seed], fraction, key, bucket).drop("condition", "seed", "l2_lambda")


def arm_matrix(rows: DataFrame, group: str, target: str, base: list[str], preference: list[str], seeds: list[int], fraction: float = 0.2, key: str = "id", bucket: str | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """[M19-M23] condition, seed, arm, id, lineage_id, label, probability, l2_lambda of the held-out groups of every condition and
    seed, under four sets of numeric columns: base alone, preference alone, both, and both with the preference columns dealt again
    within each side of the split (and bucket). Missing numbers take training medians; the penalty is 1 / n. Conditions, seeds and
    arms are fitted together. rows(condition, key, group, target, ...); a training side of one class is an error. With `conditions`
    (targets by name) all of them have the same rows, which are then given, split and dealt once."""
    named = [F.col("condition")] if conditions is None else [F.lit(c) for c in conditions]
    targets = [F.col(target)] if conditions is None else list(conditions.values())
    rows = rows.select((named[0] if conditions is None else F.lit("")).alias("condition"), F.col(key).alias("id"), F.col(group).alias("lineage_id"), F.array(*[y.cast("double") for y in targets]).alias("y"), *[F.col(c).cast("double").alias(f"b_{c}") for c in base], *[F.col(c).cast("double").alias(f"p_{c}") for c in preference], (F.lit(0) if bucket is None else F.col(bucket)).alias("bucket"))
    rows = rows.where("lineage_id is not null")
    groups = rows.select("condition", "lineage_id").distinct()
    many = groups.groupBy("condition").agg(F.count("*").alias("n"))
    held = F.least(F.greatest(F.bround(F.col("n") * F.lit(fraction)), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    groups = groups.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    side = hash_ranked(groups, X.stable_hash(F.col("seed"), F.col("lineage_id")), ["condition", "seed"], ["lineage_id"]).join(F.broadcast(many), "condition")
    side = side.groupBy("condition", "lineage_id").agg(F.collect_list(F.struct("seed", (F.col("nth") <= held).alias("held_out"))).alias("sides"))
    cell = ["condition", "seed", "held_out", "bucket"]
    place = lambda tag: F.sha2(F.concat(F.lit(f"{tag}:"), F.col("seed").cast("string"), F.lit(":"), F.col("id").cast("string")), 256)

    def placed(rows: DataFrame, tag: str) -> DataFrame:
        """hash_ranked(), but the hash is taken again behind the shuffle: it is most of what would be sent."""
        rows = before_head(rows, F.substring(place(tag), 1, 3), cell, F.lit(1))
        nth = F.row_number().over(Window.partitionBy(*cell, "_head").orderBy(place(tag), "id")) + F.col("_before")
        return rows.withColumn("nth", nth.cast("int")).drop("_head", "_before")

    # no broadcasts: rows in memory are many times their compressed files, by which the planner would choose
    rows = written(rows.join(side.hint("merge"), ["condition", "lineage_id"]), "arms")
    by_seed = rows.select("*", F.inline("sides")).drop("sides")
    dealt = placed(by_seed.select(*cell, "id", *[f"p_{c}" for c in preference]), "dealt")
    dealt = dealt.select(*cell, "nth", *[F.col(f"p_{c}").alias(f"n_{c}") for c in preference])
    own = placed(by_seed, "natural").join(dealt.hint("merge"), [*cell, "nth"])
    found = sorted(r["condition"] for r in many.select("condition").collect())
    splits = sorted((c, s) for c in (found if conditions is None or not found else conditions) for s in seeds)
    if not splits:
        kind = rows.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"condition string, seed int, arm string, id {kind}, lineage_id {rows.schema['lineage_id'].dataType.simpleString()}, label int, probability double, l2_lambda double")
    each = F.explode(F.array(*[F.struct(c.alias("condition"), F.col("y")[i].alias("y")) for i, c in enumerate(named)]))
    own = own.withColumn("_each", each).withColumns({"condition": F.col("_each.condition"), "y": F.col("_each.y")})
    number = F.create_map(*[F.lit(x) for i, (c, s) in enumerate(splits) for x in (f"{s}:{c}", i)])
    features = F.array(*[F.col(f"b_{c}") for c in base], *[F.col(f"p_{c}") for c in preference], *[F.col(f"n_{c}") for c in preference])
    role = F.when(F.col("held_out"), G.TEST).otherwise(G.TRAIN)
    data = G.design(own, features, F.col("y"), F.array(number[F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("condition").cast("string"))]), F.array(role), keep=["condition", "seed", "lineage_id"])
    drop(rows)
    nb, np_ = len(base), len(preference)
    sets = {"no_preference": range(nb), "preference_only": range(nb, nb + np_), "full": range(nb + np_), "shuffled": [*range(nb), *range(nb + np_, nb + 2 * np_)]}
    arms = [G.Arm(i, name, tuple(columns)) for i in range(len(splits)) for name, columns in sets.items()]
    scales, models = G.fit(data, arms, c=1.0)
    return G.scored(data, scales, models, keep=["condition", "seed", "lineage_id"]).select("condition", "seed", "arm", "id", "lineage_id", "label", "probability", "l2_lambda")


VALUE_STATE = "fold int, weights array<array<double>>"
#: Tasks that train the replicas of a fold, each with a copy of its rows.
SHARES = 2


def _view(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.concatenate([c, x, x * c, np.abs(x - c)], 1)


class ValueNetwork:
    """Two tanh layers over [context, candidate, candidate * context, |candidate - context|] and a linear value."""

    def __init__(self, flat: list[list[float]]):
        size = len(flat[0])
        self.mean, self.sd = np.array(flat[0]), np.array(flat[1])
        self.p = [np.array(flat[2]).reshape(size, -1), np.array(flat[3]), np.array(flat[4]).reshape(len(flat[3]), -1), np.array(flat[5]), np.array(flat[6])]

    def values(self, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and value of each candidate."""
        v = (_view(c, x) - self.mean) / self.sd
        z = np.tanh(np.tanh(v @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])
        return z, z @ self.p[4]


def value_networks(rows: DataFrame, folds: int, hidden: int = 32, bottleneck: int = 8, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-2, seed: int = 17) -> dict[int, list[list[float]]]:
    """[M37, M38] A ranker q(B) - q(A) for each fold, trained on all rows outside of its test bucket, with early stopping on its
    validation bucket. rows(id, fold_bucket, context, candidate_a, candidate_b, label from 0 to 1: 1 where B is selected, or a mix with
    a teacher's probability). A few kilobytes for each fold."""
    nets = transfer_networks(rows.withColumn("labels", F.array(F.col("label").cast("double"))), folds, hidden, bottleneck, epochs, rate, decay, seed)
    return {fold: weights for (_, fold), weights in nets.items()}


class _Spool:
    """Rows of doubles of one width in a file of the task that has no name: read by number, so that memory holds a batch alone."""

    def __init__(self):
        self.file, self.width = tempfile.TemporaryFile(), 0

    def add(self, rows: np.ndarray) -> None:
        self.width = rows.shape[1]
        self.file.write(np.ascontiguousarray(rows, np.float64))

    def read(self, at: np.ndarray) -> np.ndarray:
        size, file = 8 * self.width, self.file.fileno()
        return np.frombuffer(b"".join([os.pread(file, size, size * i) for i in at.tolist()]), np.float64).reshape(len(at), -1)


def transfer_networks(rows: DataFrame, folds: int, hidden: int = 32, bottleneck: int = 8, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-2, seed: int = 17) -> dict[tuple[int, int], list[list[float]]]:
    """[M37, M41] value_networks() for each place in rows' column labels (array<double>: authentic ones, and dealt again for controls) and
    fold. A fold's rows meet in one task, since steps follow one another, or in SHARES tasks with some of the replicas each; a task
    writes them to a file of its own, whatever their number, and trains a replica at a time from there."""
    every = rows.select("id", "fold_bucket", "context", "candidate_a", "candidate_b", F.col("labels").cast("array<double>").alias("labels"))
    every = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold_bucket <> fold").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    every = every.repartitionById(folds * SHARES, F.col("fold") * SHARES + F.col("share")).sortWithinPartitions("id")

    def fit(batches):
        spool, buckets, fold, share, replicas = _Spool(), [], 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                table = {n: batch.column(n) for n in batch.schema.names}
                parts = [table[n].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("context", "candidate_a", "candidate_b", "labels")]
                spool.add(np.concatenate(parts, 1))
                buckets.append(table["fold_bucket"].to_numpy().astype(np.int32))
                fold, share, replicas = table["fold"][0].as_py(), table["share"][0].as_py(), parts[3].shape[1]
        if spool.width:
            spool.file.flush()
            valid = np.concatenate(buckets) == (fold + 1) % folds
        for replica in range(share, replicas, SHARES):
            pick = (spool.width - replicas) // 3, replica
            flat = _fitted(spool.read, *pick, valid, hidden, bottleneck, epochs, rate, decay, seed + fold + 1000 * replica)
            yield pa.RecordBatch.from_arrays([pa.array([replica], pa.int32()), pa.array([fold], pa.int32()), pa.array([flat], pa.list_(pa.list_(pa.float64())))], ["replica", "fold", "weights"])

    return {(r["replica"], r["fold"]): r["weights"] for r in every.mapInArrow(fit, f"replica int, {VALUE_STATE}").collect()}


def trained(part: pd.DataFrame, fold: int, folds: int, hidden: int, bottleneck: int, epochs: int, rate: float, decay: float, seed: int) -> list[list[float]]:
    """Weights of one ranker on a part in memory."""
    rows = np.concatenate([*(np.stack(part[x].to_numpy()).astype(np.float64) for x in ("context", "candidate_a", "candidate_b")), part["label"].to_numpy(float)[:, None]], 1)
    return _fitted(lambda at: rows[at], rows.shape[1] // 3, 0, part["fold_bucket"].to_numpy() == (fold + 1) % folds, hidden, bottleneck, epochs, rate, decay, seed)


def _fitted(read: Callable[[np.ndarray], np.ndarray], dim: int, replica: int, valid: np.ndarray, hidden: int, bottleneck: int, epochs: int, rate: float, decay: float, seed: int) -> list[list[float]]:
    """Weights of one ranker on rows that are read by number: context, candidates and labels by replica, in one array."""
    train, held = np.flatnonzero(~valid), np.flatnonzero(valid)
    chunks = lambda at: (at[lo : lo + 1024] for lo in range(0, len(at), 1024))
    room = np.empty((2048, 4 * dim))  # new arrays of that size would cost more than the sums

    def views(at):
        """Both candidates' views, A above B, until the next call, and labels."""
        r, n = read(at), len(at)
        c = r[:, :dim]
        for k in range(2):
            x, out = r[:, (k + 1) * dim : (k + 2) * dim], room[k * n : (k + 1) * n]
            out[:, :dim], out[:, dim : 2 * dim] = c, x
            np.multiply(x, c, out=out[:, 2 * dim : 3 * dim])
            np.abs(np.subtract(x, c, out=out[:, 3 * dim :]), out=out[:, 3 * dim :])
        return room[: 2 * n], r[:, 3 * dim + replica]

    mean = sum(views(at)[0].sum(0) for at in chunks(train)) / (2 * len(train))
    sd = np.sqrt(sum(((views(at)[0] - mean) ** 2).sum(0) for at in chunks(train)) / (2 * len(train)))
    sd[sd <= 1e-6] = 1
    rng = np.random.default_rng(seed)
    first = [rng.standard_normal((4 * dim, hidden)) / (4 * dim) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, bottleneck)) / hidden**0.5, np.zeros(bottleneck), rng.standard_normal(bottleneck) / bottleneck**0.5]
    # all weights as one vector, and each array as a part of it
    flat = np.concatenate([x.ravel() for x in first])
    p = [x.reshape(y.shape) for x, y in zip(np.split(flat, np.cumsum([x.size for x in first])[:-1]), first, strict=True)]
    m, v = np.zeros_like(flat), np.zeros_like(flat)

    def forward(at):
        x, y = views(at)
        x -= mean
        x /= sd
        h = np.tanh(x @ p[0] + p[1])
        z = np.tanh(h @ p[2] + p[3])
        q = z @ p[4]
        return x, h, z, q[len(y) :] - q[: len(y)], y

    def loss(at):
        *_, q, y = forward(at)
        return (np.logaddexp(0, q) - q * y).sum()

    best, kept, wait, t = np.inf, flat.copy(), 0, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            x, h, z, q, y = forward(at)
            d = (1 / (1 + np.exp(-q)) - y) / len(at)
            s = np.concatenate([-d, d])
            dz = s[:, None] * p[4] * (1 - z**2)
            dh = dz @ p[2].T * (1 - h**2)
            g = np.concatenate([(x.T @ dh).ravel(), dh.sum(0), (h.T @ dz).ravel(), dz.sum(0), z.T @ s])
            t += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            flat -= rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * flat)
        now = sum(loss(at) for at in chunks(held)) / len(held) if len(held) else 0.0
        if now < best - 1e-6:
            best, kept, wait = now, flat.copy(), 0
        else:
            wait += 1
            if wait >= 5:
                break
    flat[:] = kept
    return [x.ravel().tolist() for x in (mean, sd, *p)]


def _batches(columns: list[str], run, kind: str, rows: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            if batch.num_rows:
                table = {n: batch.column(i) for i, n in enumerate(columns)}
                wide = {n: table[n].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) for n in ("context", "candidate_a", "candidate_b")}
                yield from run(table, wide)

    return rows.select(*columns).mapInArrow(each, kind)


def value_network(rows: DataFrame, folds: int, **settings) -> DataFrame:
    """[M37, M38] id, fold, label and probability of every row by the network of the fold that tests its bucket; rows pass as a
    stream of batches."""
    nets = value_networks(rows, folds, **settings)

    def run(table, wide):
        bucket = table["fold_bucket"].to_numpy()
        p = np.full(len(bucket), 0.5)
        for fold, weights in nets.items():
            at = np.flatnonzero(bucket == fold)
            net = ValueNetwork(weights)
            p[at] = 1 / (1 + np.exp(net.values(wide["context"][at], wide["candidate_a"][at])[1] - net.values(wide["context"][at], wide["candidate_b"][at])[1]))
        yield pa.RecordBatch.from_arrays([table["id"], table["fold_bucket"].cast(pa.int32()), table["label"].cast(pa.int32()), pa.array(p)], ["id", "fold", "label", "probability"])

    kind = rows.schema["id"].dataType.simpleString()
    return _batches(["id", "fold_bucket", "label", "context", "candidate_a", "candidate_b"], run, f"id {kind}, fold int, label int, probability double", rows)


def _states(net: ValueNetwork, c: np.ndarray, a: np.ndarray, b: np.ndarray, selected_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (ha, qa), (hb, qb) = (net.values(c, x) for x in (a, b))
    hs, hr = np.where(selected_b[:, None], hb, ha), np.where(selected_b[:, None], ha, hb)
    gap = np.where(selected_b, qb - qa, qa - qb)
    return np.concatenate([ha + hb, np.abs(ha - hb), np.abs(qa - qb)[:, None]], 1), np.concatenate([hs, hr, hs - hr, gap[:, None]], 1)


def transfer_states(rows: DataFrame, nets: dict[tuple[int, int], list[list[float]]]) -> DataFrame:
    """[M42, G50] id, fold_bucket, and for each replica (in order) its two states in `blind` and `choice_aware` (arrays of arrays) by
    the network whose fold tests the row's bucket, so that no row's state comes from a network that saw it.
    rows(id, fold_bucket, context, candidate_a, candidate_b, label = 1 where B is selected)."""
    replicas = sorted({r for r, _ in nets})

    def run(table, wide):
        bucket, b = table["fold_bucket"].to_numpy(), table["label"].to_numpy(zero_copy_only=False) == 1
        out: list[list] = [[None] * len(replicas) for _ in range(2)]
        for k, replica in enumerate(replicas):
            for fold in np.unique(bucket):
                at = np.flatnonzero(bucket == fold)
                found = _states(ValueNetwork(nets[replica, int(fold)]), *(wide[x][at] for x in ("context", "candidate_a", "candidate_b")), b[at])
                for side, x in zip(out, found, strict=True):
                    side[k] = np.zeros((len(bucket), x.shape[1])) if side[k] is None else side[k]
                    side[k][at] = x
        kind = pa.list_(pa.list_(pa.float64()))
        both = [pa.array([[x[i].tolist() for x in side] for i in range(len(bucket))], kind) for side in out]
        yield pa.RecordBatch.from_arrays([table["id"], table["fold_bucket"].cast(pa.int32()), *both], ["id", "fold_bucket", "blind", "choice_aware"])

    kind = rows.schema["id"].dataType.simpleString()
    return _batches(["id", "fold_bucket", "label", "context", "candidate_a", "candidate_b"], run, f"id {kind}, fold_bucket int, blind array<array<double>>, choice_aware array<array<double>>", rows)


def value_states(rows: DataFrame, weights: list[list[float]]) -> DataFrame:
    """[M40, M42] id and two states of each row by one network: `blind` (sum and absolute difference of the candidates' states, and of
    values) does not tell which candidate was selected; `choice_aware` has the selected one, the other, and their differences.
    rows(id, context, candidate_a, candidate_b, label = 1 where B is selected)."""

    def run(table, wide):
        blind, aware = _states(ValueNetwork(weights), wide["context"], wide["candidate_a"], wide["candidate_b"], table["label"].to_numpy(zero_copy_only=False) == 1)
        yield pa.RecordBatch.from_arrays([table["id"], pa.array(list(blind), pa.list_(pa.float64())), pa.array(list(aware), pa.list_(pa.float64()))], ["id", "blind", "choice_aware"])

    kind = rows.schema["id"].dataType.simpleString()
    return _batches(["id", "label", "context", "candidate_a", "candidate_b"], run, f"id {kind}, blind array<double>, choice_aware array<double>", rows)
