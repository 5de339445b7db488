"""Sources: alias-resolved version tables, SQLite tables, JSON lines, caches; and sinks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from palimpsest.operators.selection import numeric_prefix, rebuilt

# Physical names by logical one, in order of preference.
ARTICLE_ALIASES = {
    "source": ("source", "publisher", "outlet"),
    "article_id": ("a_id", "article_id", "articleid", "story_id"),
    "version_id": ("version_id", "v_id", "version", "revision_id"),
    "text": ("text", "article_text", "body", "content"),
    "created": ("created", "created_at", "timestamp", "published_at", "date"),
    "title": ("title", "headline"),
    "num_versions": ("num_versions", "version_count", "n_versions"),
}
SENTENCE_ALIASES = {
    "article_id": ("entry_id", "a_id", "article_id", "articleid", "story_id"),
    "version_id": ("version", "version_id", "v_id", "revision_id"),
    "sentence_id": ("sent_idx", "sentence_id", "sent_id", "sentence_index"),
    "sentence": ("sentence", "sent", "text"),
}
ARTICLE_REQUIRED, SENTENCE_REQUIRED = ("source", "article_id", "version_id", "text"), tuple(SENTENCE_ALIASES)
#: Columns that must not reach a model's inputs, as they tell the outcome.
OUTCOME_COLUMNS = ("v2_sentence", "future_revised", "v2_version_id")
EPISODE_COLUMNS = ("episode_id", "lineage_id", "candidate_a", "candidate_b", "selected_index", "context_before", "context_after")


def resolve(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """[S05, S24] The first alias that is a column, whatever the case."""
    known = {c.lower(): c for c in columns}
    return next((known[a] for a in aliases if a in known), None)


def resolved(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame | None:
    """[S06-S08] df under logical names, or None where a required one is missing."""
    found = {k: resolve(df.columns, v) for k, v in aliases.items()}
    if any(found[k] is None for k in required):
        return None
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items() if c is not None])


def discover(tables: dict[str, DataFrame], aliases: dict[str, tuple[str, ...]], required: tuple[str, ...], preferred: str | None = None) -> tuple[str, DataFrame]:
    """[S02, S06-S08, S28-S30] The preferred table, else the first in order of name, that has the required columns; the
    error says for each table what is missing."""
    names = sorted(tables, key=lambda n: (n != preferred, n))
    for name in names:
        out = resolved(tables[name], aliases, required)
        if out is not None:
            return name, out
    missing = {n: [k for k in required if resolve(tables[n].columns, aliases[k]) is None] for n in names}
    raise ValueError(f"no table has the required columns; missing by table: {missing}")


def article_versions(df: DataFrame, split) -> DataFrame:
    """[S10, R06] lineage_id, source, article_id, version_id, created, sentences of resolved article rows with text."""
    rows = df.where(F.length(F.trim("text")) > 0)
    created = F.col("created").cast("string") if "created" in df.columns else F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string").alias(c)
    return rows.select(F.concat_ws("::", "source", "article_id").alias("lineage_id"), text("source"), text("article_id"), text("version_id"), created.alias("created"), split("text").alias("sentences"))


def sentence_versions(df: DataFrame, source: str) -> DataFrame:
    """[S11, S32, S33, Q4, Q6] The same of resolved sentence rows, which are kept as they are."""
    rows = df.where(F.length(F.trim("sentence")) > 0).withColumn("place", F.struct(numeric_prefix("sentence_id").alias("n"), F.col("sentence_id").cast("string").alias("t")))
    out = rebuilt(rows, ["article_id", "version_id"], "place", "sentence")
    return out.select(F.concat_ws("::", F.lit(source), "article_id").alias("lineage_id"), F.lit(source).alias("source"), F.col("article_id").cast("string").alias("article_id"), F.col("version_id").cast("string").alias("version_id"),
                      numeric_prefix("version_id").alias("place"), "sentences")


def forbid(df: DataFrame, columns: tuple[str, ...] = OUTCOME_COLUMNS) -> DataFrame:
    """[S18] df, or an error if it has a column that must not be there."""
    found = [c for c in df.columns if c in columns]
    if found:
        raise ValueError(f"columns that tell the outcome: {found}")
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """[S16, S19, S21] df, or an error naming some repeated or missing keys."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"{key} is missing or repeated: {[r[0] for r in bad]}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """[S13-S15, P04] Lines of one JSON object each; a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    """[K01] Keys in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """[S22]"""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_cache(df: DataFrame, path: str) -> None:
    """[K03, K11] Parquet, or CSV (compressed where the name ends in .gz)."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


def write_corpora(records: DataFrame, path: str) -> None:
    """[K05, K08] One folder for each fold, corpus and partition."""
    records.write.mode("overwrite").partitionBy("fold", "corpus", "partition").parquet(path)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """[S01-S04] `spark.read.format("sqlite").option("path", ...).option("table", ...)`: read-only, in ranges of rowid.
    The file must be reachable from every executor."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> StructType:
        with self._connect() as c:
            rows = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda t: LongType() if "INT" in t.upper() else DoubleType() if any(x in t.upper() for x in ("REAL", "FLOA", "DOUB")) else BinaryType() if t.upper() == "BLOB" else StringType()
        return StructType([StructField(r[1], kind(r[2] or "")) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema: StructType):
        self.source, self.columns = source, schema
        self.arrow = pa.schema([(f.name, {LongType: pa.int64(), DoubleType: pa.float64(), BinaryType: pa.binary()}.get(type(f.dataType), pa.string())) for f in schema])

    def partitions(self) -> list[InputPartition]:
        with self.source._connect() as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.source.options['table'])}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        n = int(self.source.options.get("partitions", "8"))
        step = -(-(high - low + 1) // n)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_quoted(f.name) for f in self.columns)
        with self.source._connect() as c:
            cursor = c.execute(f"SELECT {names} FROM {_quoted(self.source.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
            while rows := cursor.fetchmany(2048):
                data = [[None if v is None else str(v) if pa.types.is_string(f.type) else v for v in column] for f, column in zip(self.arrow, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, self.arrow, strict=True)], schema=self.arrow)


def _quoted(name: str) -> str:
    """[Q10]"""
    return '"' + name.replace('"', '""') + '"'


def sqlite_tables(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """[S01, S02, Q8] All tables of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    return {n: spark.read.format("sqlite").option("path", path).option("table", n).option("partitions", str(partitions)).load() for n in names}
