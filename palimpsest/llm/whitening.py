"""Whitening of embeddings: a randomised range finder with power passes over all centred rows, then Rayleigh-Ritz.

Entries become integers x = floor(SCALE * c) + OFFSET, so n and the sums S are exact, and a centred row (n x - S) / n is
exact but for its last rounding. A pass multiplies the covariance V of all rows by an orthonormal block Q of components +
OVERSAMPLE columns: tasks add y (y' Q) over their rows, and the d sums of each task are added in a shuffle by dimension. One
pass gives Q' V Q, the Ritz pairs of the block, their residuals V u - e u, and the next block. While the residuals fall fast
enough, passes go on, at most POWER of them; else the block grows to all d dimensions, where one pass gives every pair to
double precision. What goes to the driver is d rows of the block, whatever the number of vectors; V itself is never built
from more than that.

Cases: vectors that are null, empty, or hold null or non-finite entries are left out; rows that repeat a vec_id, also a null
one, are rows of their own and count each; vectors of another length are a fit list of their own, with its own n, sums
and components, in the same passes; directions without variance (eigenvalues up to RANK of the largest) cannot be whitened and
are no components, so a list of one vector, or of equal ones, gives no rows; entries beyond 2^62 count as 2^62, and a
deviation beyond 64 bits as the largest 64-bit number; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Shared, prepare, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Columns of the block beside the components, and passes before it grows to all dimensions.
OVERSAMPLE, POWER = 10, 8
#: Residuals, in terms of the largest eigenvalue, that count as exact; eigenvalues up to this share of the largest are none.
EXACT, RANK = 2.0**-47, 1e-12
MOST = 1 << 62


@dataclass
class Moments:
    """Exact count and sums of one fit list, split as S = n base + rest with 0 <= rest < n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.base = [s // self.n for s in self.sums]
        self.rest = [s - self.n * b for s, b in zip(self.sums, self.base, strict=True)]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits where they suffice."""
        wide = max(map(abs, self.base), default=0) + int(np.abs(x).max(initial=0))
        kind = np.int64 if wide < MOST and wide * self.n < MOST else object
        return (x.astype(kind) - np.array(self.base, kind)) * self.n - np.array(self.rest, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Sums of squared deviations, exact up to the largest 64-bit number."""
        d = self.deviations(x)
        most = int(np.abs(d).max(initial=0))
        if most * most * x.shape[1] < MOST:
            return (d.astype(np.int64) ** 2).sum(1)
        return np.array([min(sum(int(v) ** 2 for v in row), (1 << 63) - 1) for row in d], np.int64)


@dataclass
class Fit:
    """Moments and components of one fit list: unit columns, eigenvalues, and what they explain."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.vectors / np.sqrt(self.values)


def integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and integer entries of the usable vectors of a list column, by length."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        c = flat[start[at][:, None] + np.arange(dim)]
        fine = np.isfinite(c).all(1)
        if fine.any():
            scaled = np.clip(np.floor(SCALE * c[fine]), -float(MOST), float(MOST) - 1024)
            yield int(dim), at[fine], scaled.astype(np.int64) + OFFSET


def moments(vectors: DataFrame) -> dict[int, Moments]:
    """Exact count and sums of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for dim, at, x in integers(batch.column(0)):
                kind = np.int64 if int(np.abs(x).max()) * len(x) < MOST else object
                part = x.astype(kind).sum(0).tolist()
                n[dim] = n.get(dim, 0) + len(at)
                total[dim] = [a + b for a, b in zip(total.get(dim, [0] * dim), part, strict=True)]
        rows = [(d, i, str(s), n[d]) for d, sums in total.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["dim", "i", "s", "n"])

    parts = vectors.select("embedding").mapInArrow(run, "dim int, i int, s string, n long")
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = (int(r["s"]), r["n"])
    return {dim: Moments(at[0][1], [at[i][0] for i in range(dim)]) for dim, at in found.items()}


def _added(parts: DataFrame) -> dict[int, dict[int, np.ndarray]]:
    """Sums of the rows v of parts(dim, i, v) by dim and i, added in tasks by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[dim, i] = total[dim, i] + v if (dim, i) in total else np.array(v)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], ["dim", "i", "v"])

    kind = "dim int, i int, v array<double>"
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.repartition("dim", "i").mapInArrow(add, kind).collect():
        out.setdefault(r["dim"], {})[r["i"]] = np.array(r["v"])
    return out


def _pass(vectors: DataFrame, known: dict[int, Moments], blocks: dict[int, np.ndarray], square: bool = False) -> dict[int, dict[int, np.ndarray]]:
    """By length: the rows of sum of y (y' Q), and at -1 the sums of y' y. With square, of z z' for z = y' Q, and the sums of z."""
    shared = Shared(vectors.sparkSession, (known, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = shared.value
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in integers(batch.column(0)):
                if dim in blocks:
                    y = known[dim].centred(x)
                    z = y @ blocks[dim]
                    now = [z.T @ z, z.sum(0)] if square else [y.T @ z, np.array([(y * y).sum()])]
                    total[dim] = [a + b for a, b in zip(total[dim], now, strict=True)] if dim in total else now
        rows = [(d, i, v.tolist()) for d, (whole, one) in total.items() for i, v in [*enumerate(whole), (-1, one)]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["dim", "i", "v"])

    return _added(vectors.select("embedding").mapInArrow(run, "dim int, i int, v array<double>"))


def _basis(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = 13) -> dict[int, Fit]:
    """Components of the vectors of each length, see above."""
    known = moments(vectors)
    rng = np.random.default_rng(seed)
    blocks = {dim: _basis(rng.standard_normal((dim, min(dim, components + OVERSAMPLE)))) for dim in sorted(known)}
    done: dict[int, Fit] = {}
    last: dict[int, float] = {}
    for step in range(POWER + 1):
        if not blocks:
            break
        for dim, rows in _pass(vectors, known, blocks).items():
            q = blocks[dim]
            product = np.array([rows[i] for i in range(dim)]) / known[dim].n
            small = q.T @ product
            values, turn = np.linalg.eigh((small + small.T) / 2)
            top = np.argsort(-values, kind="stable")[:components]
            values, ritz = values[top], q @ turn[:, top]
            largest = max(float(values[0]), 0.0)
            off = float(np.sqrt(((product @ turn[:, top] - ritz * values) ** 2).sum(0)).max())
            whole = q.shape[1] == dim
            if whole or off <= EXACT * largest:
                real = values > RANK * largest
                done[dim] = Fit(known[dim], ritz[:, real], values[real], float(rows[-1][0]) / known[dim].n)
                del blocks[dim]
                continue
            # at the rate of the last pass, would the passes that are left be enough?
            rate = off / last[dim] if dim in last else 0.0
            last[dim] = off
            if step >= POWER - 1 or off * rate ** (POWER - 1 - step) > EXACT * largest:
                blocks[dim] = _basis(np.hstack([q, rng.standard_normal((dim, dim - q.shape[1]))]))
            else:
                blocks[dim] = _basis(product)
    done = {dim: f for dim, f in done.items() if len(f.values)}
    if done:
        known = {dim: f.moments for dim, f in done.items()}
        for dim, rows in _pass(vectors, known, {dim: f.vectors / np.sqrt(f.values) for dim, f in done.items()}, square=True).items():
            k, n = len(done[dim].values), known[dim].n
            mean = rows[-1] / n
            done[dim].identity_error = float(np.abs(np.array([rows[i] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)).max())
    return done


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row of vectors(vec_id, embedding)
    and each component of its fit list."""
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fits = fit(vectors, components)
    if not fits:
        return spark.createDataFrame([], schema)
    shared = Shared(spark, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in integers(batch.column(1)):
                if dim not in shared.value:
                    continue
                f = shared.value[dim]
                k, rows = len(f.values), len(at)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, f.moments.n)),
                    pa.array(np.repeat(f.moments.squares(x), k)), pa.array(f.whitened(x).ravel()), pa.array(np.tile(f.values / f.trace, rows)), pa.array(np.full(rows * k, f.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def op13_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
