"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where spark.checkpoint.dir is unset; what was written and is not dropped yet.
_own: dict[str, str] = {}
_kept: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own with a local master (tests), as all tasks run on this
    machine; an error with any other."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, _own[sc.applicationId].removeprefix("file://"), True)
        found = _own[sc.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path of the shared folder, removed at the end of this process at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _kept[path] = (where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, by column from now on."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """What written() does, in buckets by key: joins by key move the other side alone. For rows of many bytes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    own = path.rsplit("/", 1)[1].replace("-", "_")
    out = df.write.format("parquet").option("path", path).option("compression", "zstd").option("parquet.block.size", str(16 << 20))
    out.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(own)
    out = spark.table(own)
    out._palimpsest_path = path
    return out


def drop_path(path: str) -> None:
    """Remove a path of the shared folder, also when its session has ended; nothing where it is gone already."""
    files, where = _kept.pop(path, (None, None))
    if files is not None:
        files.delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Remove what written() wrote for these once nothing reads it any more."""
    for df in frames:
        drop_path(df._palimpsest_path)


@atexit.register
def _drop_all() -> None:
    for path in list(_kept):
        with contextlib.suppress(Exception):  # the JVM may be gone
            drop_path(path)
