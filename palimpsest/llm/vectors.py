"""Vector tables: exact top-k search over a pivot-distance index, and a subspace pigeonhole similarity join.

Both lay vectors out in tiles: rows sorted by (group, key) and packed, so that a tile is a run of at most so many rows
of one group with a known key range. Tiles join by group and range; a tile is a row, so no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import Shared, batch_rows, components, join_hot, prepare, table, written

#: Fitting looks at so many vectors (in order of a hash of vec_id); pivots grow with the square root of the table.
FIT, PIVOTS, MOST_PIVOTS = 4096, 32, 1024
#: Rows of an index tile, and queries that meet it at once.
INDEX_ROWS, QUERY_ROWS = 512, 256
#: Tiles that each query looks at before its bound decides about the rest.
NEAREST = 4
#: Blocks of dimensions and rows of a join tile.
BLOCKS, JOIN_ROWS = 4, 1024
#: Rows with tiles that go to Python at once.
TILE_BATCH = 16

TILE = "tile long, lo double, hi double, ids array<{id}>, rows binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim, and the other columns, of vectors that are not null and hold only finite numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("v", v).withColumn("dim", F.size("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def tiled(rows: DataFrame, group: list[str], key: str, most: int) -> DataFrame:
    """Tiles of rows(group..., key, vec_id, packed): group columns, tile number, key range, ids and joined packed rows."""
    kinds = dict(rows.dtypes)
    ordered = rows.select(*group, key, "vec_id", "packed").repartitionByRange(*group, key, "vec_id").sortWithinPartitions(*group, key, "vec_id")
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, ids, lo, hi, packed, count, out = None, [], 0.0, 0.0, [], 0, []

        def close():
            nonlocal count
            if ids:
                out.append((*held, (part << 32) + count, lo, hi, list(ids), b"".join(packed)))
                count += 1
                ids.clear()
                packed.clear()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        names = [*group, "tile", "lo", "hi", "ids", "rows"]
        for batch in batches:
            types = [*[batch.schema.field(i).type for i in range(width)], pa.int64(), pa.float64(), pa.float64(), pa.list_(batch.schema.field(width + 1).type), pa.binary()]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != held or len(ids) >= most:
                    close()
                    held, lo = row[:width], row[width]
                ids.append(row[width + 1])
                packed.append(row[width + 2])
                hi = row[width]
            if len(out) >= 64:
                yield flush()
        close()
        if out:
            yield flush()

    return ordered.mapInArrow(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", " + TILE.format(id=kinds["vec_id"]))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits become the nearest 64-bit number."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most >= 2.0**62:
        exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    if most >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def _slack(norm, longest):
    """What distances in doubles may be off by, in terms of scores, and more."""
    return (norm + longest) * 1e-6 + 1


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query (vec_id divisible by `every`).

    Components are floor(scale * x). With an extra coordinate sqrt(M - |x|^2), M the largest squared norm, a higher
    score is a smaller Euclidean distance, so vectors are keyed by nearest pivot and distance to it. A query first
    looks at a bounded sample and at its nearest annuli, then at every annulus that the triangle inequality does not
    exclude against the score it has by then.

    Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id;
    only vectors of the query's length are candidates; queries and candidates are rows, not ids: rows that repeat a vec_id are
    candidates each, also of each other, and queries each, with a list of its own under the same query_id; ties go to the
    smaller vec_id; a query with fewer candidates has fewer rows; components and scores beyond 64 bits count as the nearest
    64-bit number; other columns are not looked at.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors.select("vec_id", "embedding")).select("vec_id", "dim", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18)))).alias("v"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # from here on rows go by their number, which is written with them
    rows = written(rows.withColumnRenamed("vec_id", "name").withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
    named, kind = rows.schema["name"].dataType.simpleString(), "bigint"
    fitted = {}
    for dim, longest, many in rows.groupBy("dim").agg(F.max("norm"), F.count("*")).collect():
        pivots = int(min(MOST_PIVOTS, FIT // 4, max(PIVOTS, many**0.5 / 8)))
        found = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).collect()
        exact = np.array([r["v"] for r in found], np.int64)
        sample = exact.astype(np.float64)
        wide = np.concatenate([sample, np.sqrt(np.maximum(longest - (sample**2).sum(1), 0))[:, None]], 1)
        centre = wide[:pivots].copy()
        for _ in range(5):
            near = (((wide**2).sum(1)[:, None] - 2 * wide @ centre.T) + (centre**2).sum(1)).argmin(1)
            for p in range(len(centre)):
                if (near == p).any():
                    centre[p] = wide[near == p].mean(0)
        fitted[dim] = (float(longest), centre, np.array([r["vec_id"] for r in found], object), exact)
    if not fitted:
        return spark.createDataFrame([], f"query_id {named}, rank int, vec_id {named}, score long")
    shared = Shared(spark, fitted)

    def to_pivots(v: np.ndarray, dim: int, extra: bool) -> np.ndarray:
        longest, centre, _, _ = shared.value[dim]
        v = v.astype(np.float64)
        last = np.sqrt(np.maximum(longest - (v**2).sum(1), 0)) if extra else np.zeros(len(v))
        wide = np.concatenate([v, last[:, None]], 1)
        return np.sqrt(np.maximum((wide**2).sum(1)[:, None] - 2 * wide @ centre.T + (centre**2).sum(1), 0))

    def by_dim(batch: pa.RecordBatch):
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            yield int(dim), batch.column(0).take(at), matrix(batch.column(2).take(at)).astype(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, v in by_dim(batch):
                d = to_pivots(v, dim, True)
                near = d.argmin(1)
                packed = [x.tobytes() for x in v.astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), ids, pa.array(packed, pa.binary())], ["dim", "pivot", "distance", "vec_id", "packed"])

    index = written(tiled(rows.select("vec_id", "dim", "v").mapInArrow(keyed, f"dim int, pivot int, distance double, vec_id {kind}, packed binary"), ["dim", "pivot"], "distance", INDEX_ROWS), "index")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, v in by_dim(batch):
                _, _, known, sample = shared.value[dim]
                score = _inner(v, sample)
                own = np.array(ids.to_pylist(), object)[:, None] == known
                score = np.where(own, -(1 << 62), score)
                bound = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] >= k else np.full(len(v), -(1 << 62))
                d = to_pivots(v, dim, False)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), ids, pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary()), pa.array(bound), pa.array((v.astype(np.float64) ** 2).sum(1)), pa.array(list(d), pa.list_(pa.float64()))], ["dim", "query_id", "packed", "bound", "norm", "far"])

    queries = written(rows.where(F.col("name") % every == 0).select("vec_id", "dim", "v").mapInArrow(asked, f"dim int, query_id {kind}, packed binary, bound long, norm double, far array<double>"), "queries")
    longest = F.create_map(*[F.lit(x) for dim, f in fitted.items() for x in (int(dim), f[0])])
    places = queries.select("dim", "query_id", "norm", "bound", F.posexplode("far").alias("pivot", "away"))
    spans = index.select(F.col("dim").alias("d"), F.col("pivot").alias("p"), "tile", "lo", "hi")
    gap = F.greatest(F.col("lo") - F.col("away"), F.col("away") - F.col("hi"), F.lit(0.0))
    best = (F.col("norm") + longest[F.col("dim")] - gap * gap) / 2 + _slack(F.col("norm"), longest[F.col("dim")])
    reach = written(places.join(spans, (F.col("dim") == F.col("d")) & (F.col("pivot") == F.col("p")) & (best >= F.col("bound"))).select("query_id", "tile", best.alias("best"), "bound"), "reach")
    # the nearest tiles of each query, taken from each task's own first ones
    first_tiles = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("best")).alias("far"), "tile"))), 1, NEAREST)
    own = reach.withColumn("_part", F.pmod(F.xxhash64("tile"), F.lit(64))).groupBy("query_id", "_part").agg(first_tiles.alias("t"))
    nearest = own.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t"))), 1, NEAREST).alias("t"))
    nearest = written(nearest.select("query_id", F.explode(F.col("t")["tile"]).alias("tile")), "nearest")
    chunks = max(1, -(-queries.count() // QUERY_ROWS))

    def searched(pairs: DataFrame) -> DataFrame:
        """Candidates with at least the query's bound from (query_id, tile) pairs."""
        asked = pairs.join(queries.select("query_id", "packed", "bound"), "query_id")
        met = asked.groupBy("tile", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "packed", "bound")).alias("queries"))
        met = met.join(index.select("tile", "dim", "ids", "rows"), "tile").select("dim", "queries", "ids", "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, ask, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    v = np.frombuffer(raw, "<i8").reshape(-1, dim)
                    q = np.stack([np.frombuffer(x["packed"], "<i8") for x in ask])
                    own, names = np.array([x["query_id"] for x in ask], object), np.array(ids, object)
                    score = _inner(q, v)
                    ok = (score >= np.array([x["bound"] for x in ask])[:, None]) & (own[:, None] != names)
                    if score.shape[1] > k:
                        low = -np.partition(np.where(ok, -score, 1 << 62), k - 1, axis=1)[:, k - 1]
                        ok &= score >= low[:, None]
                    i, j = np.nonzero(ok)
                    kind = batch.schema.field(2).type.value_type
                    yield pa.RecordBatch.from_arrays([pa.array(own[i], kind), pa.array(names[j], kind), pa.array(score[i, j])], ["query_id", "vec_id", "score"])

        return met.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score long")

    # ties go by the candidates' names, of one name by their numbers
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "vec_id")
    names = rows.select(F.col("vec_id").alias("_row"), "name")

    def best_of(found: DataFrame) -> DataFrame:
        found = found.select("query_id", "vec_id", "score").join(names, F.col("vec_id") == F.col("_row")).drop("_row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    with batch_rows(spark, TILE_BATCH):
        first = written(best_of(searched(nearest)), "first")
    sure = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("of"), "least")
    rest = reach.join(sure, F.col("query_id") == F.col("of"), "left").where(F.col("least").isNull() | (F.col("best") >= F.col("least"))).select("query_id", "tile").join(nearest, ["query_id", "tile"], "left_anti")
    with batch_rows(spark, TILE_BATCH):
        more = written(searched(rest), "more")
    found = best_of(first.select("query_id", "vec_id", "score").union(more))
    asking = rows.where(F.col("name") % every == 0).select(F.col("vec_id").alias("_query"), F.col("name").alias("_name"))
    return found.join(asking, F.col("query_id") == F.col("_query")).select(F.col("_name").alias("query_id"), "rank", F.col("name").alias("vec_id"), "score")


def op7_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


#: Into how many tasks the pairs of tiles of one label and block are dealt.
SALTS = 16


def _units(v: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates; a row's result does not depend on the rows around it."""
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    out = np.zeros_like(unit)
    for i in range(unit.shape[1]):
        out += unit[:, i, None] * turn[i]
    return out


def _blocks(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def similar_pairs(a: np.ndarray, b: np.ndarray, same: bool, block: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two tiles with cosine >= least that `block` is the first block to find within its share of the
    squared distance; of one tile i < j."""
    dim = a.shape[1]
    turn = rotation(dim)
    x, y = _units(a, turn), _units(b, turn)
    cuts = _blocks(dim)
    budget = [(2 - 2 * least) * (c.stop - c.start) / dim + 1e-9 for c in cuts]
    c = cuts[block]
    rough = (x[:, c] ** 2).sum(1)[:, None] + (y[:, c] ** 2).sum(1) - 2 * x[:, c] @ y[:, c].T
    i, j = np.nonzero(rough <= budget[block] + 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    out_i, out_j = [], []
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for lo in range(0, len(i), 1 << 14):
        p, q = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        square = (x[p] - y[q]) ** 2
        ok = square[:, c].sum(1) <= budget[block]
        for earlier in range(block):
            ok &= square[:, cuts[earlier]].sum(1) > budget[earlier]
        p, q = p[ok], q[ok]
        ok = (a[p] * b[q]).sum(1) / (na[p] * nb[q]) >= least
        out_i.append(p[ok]), out_j.append(q[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def linked(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id of vectors(vec_id, embedding, label).

    Unit vectors with cosine >= least are within 2 - 2 * least of each other in square; in one of BLOCKS blocks of
    rotated dimensions they are within that block's share. Per label and block, vectors are sorted by the block's
    first coordinate into tiles; tiles whose ranges come within the radius meet, and what passes the block's share is
    verified with the whole vectors. A pair counts in the first block that finds it, so tasks return counts and a
    spanning set of links, never all pairs.

    Cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
    component, as are those with a null label; vectors of different lengths do not link; rows equal in vec_id, label
    and vector are one; rows that repeat a vec_id with other vectors or labels are one node, which has the links of all
    of them, other nodes counted once and itself never; a null vec_id has no links and a null component; other columns
    are not looked at; an empty table gives no rows.

    High-dimensional blocks leave little for ranges to cut: on 5,681 vectors of one label, bounding boxes of 64 rows along a
    curve keep 90 to 99 % of the pairs of tiles, the first coordinate keeps about 71 %, and 0.9 % of the pairs of rows are
    within a block's share. So tiles meet by the first coordinate, and the share is applied to rows by one product each.
    """
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    base = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    rows = usable(base).where(F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)).select("vec_id", "label", "dim", "v").distinct()
    rows = written(rows, "vectors")
    # links of an id with several vectors are told one by one, so that no other id counts twice
    several = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", "n", F.lit(1.0).alias("several")), "several")
    rows = join_hot(rows, several, "vec_id", max(1, rows.count())).withColumn("several", F.coalesce("several", F.lit(0.0)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(at)
                v = matrix(part.column(3))
                x = _units(v, rotation(int(dim)))
                whole = np.concatenate([v, part.column(4).to_numpy()[:, None]], 1)
                packed = pa.array([r.tobytes() for r in whole.astype("<f8")], pa.binary())
                for n, c in enumerate(_blocks(int(dim))):
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.full(len(v), n, np.int32)), pa.array(x[:, c.start]), part.column(0), packed], ["label", "dim", "block", "place", "vec_id", "packed"])

    tiles = written(tiled(rows.mapInArrow(keyed, f"label string, dim int, block int, place double, vec_id {kind}, packed binary"), ["label", "dim", "block"], "place", JOIN_ROWS), "tiles")
    spans = tiles.select("label", "dim", "block", "tile", "lo", "hi", F.pmod(F.xxhash64("tile"), F.lit(SALTS)).alias("salt"))
    other = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(*[F.col(c).alias(f"{c}_2") for c in spans.columns])
    # the widest share of any block, so that ranges are compared with one radius
    share = F.sqrt((2 - 2 * least) * F.ceil(F.col("dim") / F.least(F.col("dim"), F.lit(BLOCKS))) / F.col("dim")) + 1e-6
    meet = spans.join(other, (F.col("label") == F.col("label_2")) & (F.col("dim") == F.col("dim_2")) & (F.col("block") == F.col("block_2")) & (F.col("salt") == F.col("salt_2")) & (F.col("tile") <= F.col("tile_2")) & (F.col("lo") <= F.col("hi_2") + share) & (F.col("lo_2") <= F.col("hi") + share)).select("tile", "tile_2", "block", "dim")
    load = tiles.select("tile", "ids", "rows")
    met = meet.join(load, "tile").join(load.select(F.col("tile").alias("tile_2"), F.col("ids").alias("ids_2"), F.col("rows").alias("rows_2")), "tile_2").select("tile", "tile_2", "block", "dim", "ids", "rows", "ids_2", "rows_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, block, dim, ids, raw, ids_2, raw_2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(x, "<f8").reshape(-1, dim + 1) for x in (raw, raw_2))
                i, j = similar_pairs(np.ascontiguousarray(a[:, :dim]), np.ascontiguousarray(b[:, :dim]), t1 == t2, block, least)
                names = np.array(ids if t1 == t2 else ids + ids_2)
                alone = (a[i, dim] == 0) & (b[j, dim] == 0)
                j = j if t1 == t2 else j + len(ids)
                others = names[i] != names[j]
                told = others & ~alone
                kind = batch.schema.field(4).type.value_type
                n = np.bincount(i[alone], minlength=len(names)) + np.bincount(j[alone], minlength=len(names))
                one, two = names[i[told]], names[j[told]]
                i, j = i[others], j[others]
                label = names.copy()
                while len(i):
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    np.minimum.at(low, j, label[i])
                    if (low == label).all():
                        break
                    label = low
                some = (n > 0) | (label != names)
                rest = [pa.array(np.concatenate([one, two]), kind), pa.array(np.zeros(2 * len(one), np.int64)), pa.array(np.concatenate([one, two]), kind), pa.array(np.concatenate([two, one]), kind)]
                yield pa.RecordBatch.from_arrays([pa.array(names[some], kind), pa.array(n[some].astype(np.int64)), pa.array(label[some], kind), pa.nulls(int(some.sum()), kind)], ["vec_id", "n", "near", "other"])
                if len(one):
                    yield pa.RecordBatch.from_arrays(rest, ["vec_id", "n", "near", "other"])

    with batch_rows(spark, TILE_BATCH):
        found = written(met.mapInArrow(run, f"vec_id {kind}, n long, near {kind}, other {kind}"), "found")
    labels = components(found.where("vec_id <> near").select(F.col("vec_id").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("vec_id").agg((F.sum("n") + F.countDistinct("other")).alias("n_links")).select(F.col("vec_id").alias("of"), "n_links")
    out = base.select("vec_id").distinct().join(counts, F.col("vec_id") == F.col("of"), "left").join(labels, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_near_duplicates(spark, sf_dir):
    return linked(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
