"""What the corpus operators share: reading, written intermediate tables, fold rule, Arrow batch limits."""

from __future__ import annotations

import contextlib
import pickle
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import workers_can_import
from palimpsest.sources.staging import bucketed, drop, new_path, shared_dir, written  # noqa: F401

#: Rows and bytes of an Arrow batch; texts may be long, and a worker holds a few copies of a batch.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return workers_can_import(spark)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Within, jobs send at most n rows to Python at once: for rows that hold many bytes each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column = "doc_id") -> Column:
    """crc32 of the key's text modulo 5; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key) % 5


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key) == 0, F.lit(False))


def learnable(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key) != 0, F.lit(False))


_opened: dict[str, object] = {}


class Shared:
    """A driver-side model of bounded size for the Python workers: compressed on the way, opened once in each worker. Arrays travel
    beside the pickled rest, so that a worker holds each of them once."""

    def __init__(self, spark: SparkSession, model: object):
        self.name = uuid.uuid4().hex
        arrays: list[pickle.PickleBuffer] = []
        rest = pickle.dumps(model, 5, buffer_callback=arrays.append)
        self.packed = spark.sparkContext.broadcast((rest, [(x.raw().nbytes, zlib.compress(x.raw(), 1)) for x in arrays]))

    @property
    def value(self):
        if self.name not in _opened:
            while len(_opened) > 1:
                _opened.pop(next(iter(_opened)))
            rest, arrays = self.packed.value
            _opened[self.name] = pickle.loads(rest, buffers=[zlib.decompress(raw, bufsize=max(1, size)) for size, raw in arrays])
        return _opened[self.name]


#: A key that this share of the rows has is joined by broadcast: there are at most 1 / HOT such keys.
HOT = 0.001


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left join of right(key, n, ...), n being the rows of left with that key: frequent keys by broadcast of at most
    1 / HOT rows, the others by shuffle, so that no task gets more than HOT of the rows for one key."""
    names = [c for c in right.columns if c not in (key, "n")]
    own = [F.col(f"`{c}`") for c in left.columns]
    side = right.select(F.col(key).alias("_key"), "n", *[F.col(c).alias(f"_{c}") for c in names])

    def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.join(other, F.col(key) == F.col("_key"), "left").select(*own, *[F.col(f"_{c}").alias(c) for c in names])

    hot = side.where(F.col("n") > total * HOT)
    keys = [r[0] for r in hot.select("_key").collect()]
    if not keys:
        return joined(left, side)
    frequent = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return joined(left.where(frequent), F.broadcast(hot)).unionByName(joined(left.where(~frequent), side.where(F.col("n") <= total * HOT)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (smallest node reachable) for every node of edges(a, b): neighbours' minimum and pointer jumps, each
    round written to the shared folder, until no label changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        # only labels that are nodes with a smaller label are followed; many nodes may share a label
        step = step.join(jump, F.col("label") == F.col("to"), "left").select("node", "was", F.least("label", "next").alias("label"))
        new = written(step, "labels")
        drop(labels)
        labels = new.select("node", "label")
        labels._palimpsest_path = new._palimpsest_path
        if new.where(F.col("label") < F.col("was")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
