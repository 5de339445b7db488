"""Folders published on storage that all executors share: digests by executors, a rename with a marker that comes last, and chains of
contracts back to their first inputs. Paths are URIs of any store that Spark reads.

Cases: a folder without files has no digest; names that begin with _ or . are markers and checksums, which Spark does not list and
digests leave out; a folder without its marker is a leftover of a run that ended early, which publish() replaces with force alone, as
it may be someone else's; a file is hashed whole by one task, so it is at most 2 GB.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.artifacts import value_digest
from palimpsest.sources.staging import drop, written
from palimpsest.sources.tables import write_jsonl

#: Written last, with the digest of the folder's files; and the contract of a folder that has one.
MARKER, CONTRACT = "_COMPLETE", "contract.json"


def _at(spark: SparkSession, path: str):
    """File system and full name of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(where)


def shared_path(spark: SparkSession, path: str) -> str:
    """The full name of a path, or an error where executors on other machines would not see it: with a master that is not local, a
    local path must lie in spark.checkpoint.dir, which is shared by definition."""
    where = _at(spark, path)[1]
    sc = spark.sparkContext
    if where.toUri().getScheme() == "file" and not re.fullmatch(r"local(\[.*\])?", sc.master):
        known = sc.getConf().get("spark.checkpoint.dir")
        root = _at(spark, known)[1].toString().rstrip("/") if known else None
        if root is None or not f"{where.toString()}/".startswith(f"{root}/"):
            raise ValueError(f"executors of {sc.master} do not share {where.toString()}")
    return where.toString()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    files, where = _at(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    put_text(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def get_json(spark: SparkSession, path: str) -> dict:
    found = json.loads(get_text(spark, path) or "null")
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a JSON object")
    return found


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return None
    found = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name (from the folder on), length and sha256 of every file under a folder."""
    root = _at(spark, path)[1].toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", "length", F.sha2("content", 256).alias("sha256")).unionByName(spark.createDataFrame(_empty_files(spark, path), "path string, length long, sha256 string"))
    return rows.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "length", "sha256")


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """Visible files without a byte: a scan has no split of them."""
    files, where = _at(spark, path)
    listed, out, root = files.listFiles(where, True), [], len(where.toString().rstrip("/"))
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            name = status.getPath().toString()
            if not any(part.startswith((".", "_")) for part in name[root:].split("/")):
                out.append((name, 0, hashlib.sha256().hexdigest()))
    return out


def digest(spark: SparkSession, path: str) -> str:
    """What artifacts.folder_digest gives for the same visible files: the executors hash the files once, and the driver
    passes over their names in order, a partition at a time. A path that is a file has its own SHA-256."""
    files, where = _at(spark, path)
    status = files.getFileStatus(where)
    if status.isFile():
        if status.getLen() == 0:
            return hashlib.sha256().hexdigest()
        return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    rows = written(file_digests(spark, path), "digests")
    found, n = hashlib.sha256(), 0
    for r in rows.orderBy(F.split("name", "/")).toLocalIterator():
        name = r["name"].encode()
        found.update(len(name).to_bytes(8, "big") + name + bytes.fromhex(r["sha256"]))
        n += 1
    drop(rows)
    if not n:
        raise ValueError(f"no files in {path}")
    return found.hexdigest()


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether a folder has its marker."""
    return get_text(spark, f"{path}/{MARKER}") is not None


def check_published(spark: SparkSession, path: str) -> str:
    """The digest of a published folder, or an error: it has no marker, or its files are not those it was published with."""
    marker = get_text(spark, f"{path}/{MARKER}")
    if marker is None:
        raise ValueError(f"{path} is not complete")
    found = digest(spark, path)
    if found != json.loads(marker)["sha256"]:
        raise ValueError(f"{path} was changed")
    return found


def publish(spark: SparkSession, path: str, fill: Callable[[str], object], force: bool = False) -> object:
    """[K07, K09, K10] What fill(folder) returns, once the folder that it filled has taken the place of path and has its marker. The
    marker comes after the rename, so it also holds where a store renames file by file. What is at path stays, and is an error,
    unless force is given; then it is only removed when the new folder is whole."""
    target = shared_path(spark, path)
    files, where = _at(spark, target)
    if files.exists(where) and not force:
        raise FileExistsError(target if is_published(spark, target) else f"{target}, which has no marker")
    made, old = (_at(spark, f"{target}-{uuid.uuid4().hex}.{end}")[1] for end in ("partial", "old"))
    try:
        out = fill(made.toString())
        found = digest(spark, made.toString())
        if files.exists(where) and not files.rename(where, old):
            raise OSError(f"cannot move {target}")
        files.mkdirs(where.getParent())
        if not files.rename(made, where):
            raise OSError(f"cannot move {made.toString()} to {target}")
        put_text(spark, f"{target}/{MARKER}", json.dumps({"sha256": found}))
    except BaseException:
        if files.exists(old) and not files.exists(where):
            files.rename(old, where)
        raise
    finally:
        files.delete(made, True)
    files.delete(old, True)
    return out


def contract(spark: SparkSession, name: str, settings: dict, inputs: dict[str, str]) -> dict:
    """[M54, M55] Settings and digests of inputs, as artifacts.contract, with digests by executors."""
    own = {"contract": name, "settings": settings, "inputs": {k: {"path": p, "sha256": digest(spark, p)} for k, p in sorted(inputs.items())}}
    return own | {"contract_sha256": value_digest(own)}


def put_contract(spark: SparkSession, folder: str, found: dict) -> None:
    put_json(spark, f"{folder}/{CONTRACT}", found)


def check_chain(spark: SparkSession, found: dict) -> list[str]:
    """[M59] Names of all contracts that a contract rests on, ancestors first and itself last. An input that is a folder with a
    contract is a link of the chain; the first broken link is an error that names the way to it. Each contract is checked once,
    also where many rest on it."""
    order: list[str] = []
    done: set[str] = set()

    def walk(c: dict, way: tuple[str, ...]) -> None:
        own = {k: v for k, v in c.items() if k != "contract_sha256"}
        here = " < ".join((*way, c.get("contract", "?"))[::-1])
        if value_digest(own) != c.get("contract_sha256"):
            raise ValueError(f"{here}: contract was changed")
        if c["contract_sha256"] in done:
            return
        for k, x in own["inputs"].items():
            text = get_text(spark, f"{x['path']}/{CONTRACT}")
            if text is not None:
                walk(json.loads(text), (*way, c["contract"]))
            if not _at(spark, x["path"])[0].exists(_at(spark, x["path"])[1]):
                raise ValueError(f"{here}: input {k} is gone: {x['path']}")
            if digest(spark, x["path"]) != x["sha256"]:
                raise ValueError(f"{here}: input {k} was changed: {x['path']}")
        done.add(c["contract_sha256"])
        order.append(c["contract"])

    walk(found, ())
    return order


def write_split(path: str, assignment: DataFrame, members: DataFrame, summary: DataFrame, settings: dict) -> None:
    """[K04] Bucket of each lineage, members by fold and partition, the summary, and the settings."""
    assignment.write.mode("overwrite").parquet(f"{path}/buckets")
    members.write.mode("overwrite").partitionBy("fold", "partition").parquet(f"{path}/members")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    put_json(assignment.sparkSession, f"{path}/settings.json", settings)


def write_pairs(path: str, pairs: DataFrame, excluded: DataFrame, target: int | None, seed: int) -> dict:
    """[K06, U08] Temporal pairs as JSON lines, and an audit of them: counts, overlap with excluded lineages, and its gates."""
    write_jsonl(pairs, f"{path}/pairs")
    both = pairs.select("lineage_id").distinct().join(excluded.select("lineage_id").distinct(), "lineage_id", "left_semi").count()
    r = pairs.agg(F.count("*").alias("n"), F.countDistinct("temporal_pair_id").alias("ids"), F.countDistinct("lineage_id").alias("lineages")).first()
    audit = {"seed": seed, "target_pairs": target, "accepted_pairs": r.n, "temporal_lineages": r.lineages, "evaluation_lineage_overlap": both}
    audit["gates"] = {"target_pair_count_reached": target is None or r.n >= target, "temporal_lineages_disjoint_from_evaluation": both == 0, "temporal_pair_ids_unique": r.ids == r.n}
    put_json(pairs.sparkSession, f"{path}/audit.json", audit)
    return audit
