"""Sources and sinks over small files."""

import sqlite3

import pytest

from palimpsest.functions import text as X
from palimpsest.operators import alignment as A
from palimpsest.sources import tables as T


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "news.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE article_versions (SOURCE TEXT, A_ID TEXT, VERSION_ID TEXT, TEXT TEXT, CREATED TEXT)")
        for name, middle in (("revised", ("may", "will")), ("stable", ("could", "will"))):
            for i, word in enumerate((*middle, "will" if name == "stable" else "must")):
                c.execute("INSERT INTO article_versions VALUES (?, ?, ?, ?, ?)", ("ex", name, str(i + 1), f"An opening line stays here. The deal {word} close on Monday now. The end is as it was.", f"2020-01-0{i + 1}"))
        c.execute("CREATE TABLE split_sentences (entry_id TEXT, version INTEGER, sent_idx INTEGER, sentence TEXT)")
        c.executemany("INSERT INTO split_sentences VALUES (?, ?, ?, ?)", [("e", v, i, f"Mr. number {i} of version {v}") for v in (1, 2) for i in (10, 9, 2)])
        c.execute("CREATE TABLE other (x INTEGER)")
    return path


def test_sqlite_to_episodes(spark, database):
    tables = T.sqlite_tables(spark, database, 3)
    name, rows = T.discover(tables, T.ARTICLE_ALIASES, T.ARTICLE_REQUIRED)
    assert name == "article_versions" and rows.count() == 6
    found = A.episodes(A.replacements(T.article_versions(rows, X.sentence_split), A.version_order("created", "version_id"))).collect()
    assert {r.article_id: r.future_revised for r in found} == {"revised": True, "stable": False}


def test_sentence_rows_are_kept_in_number_order(spark, database):
    name, rows = T.discover(T.sqlite_tables(spark, database), T.SENTENCE_ALIASES, T.SENTENCE_REQUIRED, "split_sentences")
    got = T.sentence_versions(rows, "ex").where("version_id = '1'").first()
    assert name == "split_sentences" and got.sentences == [f"Mr. number {i} of version 1" for i in (2, 9, 10)]


def test_discovery_says_what_is_missing(spark):
    with pytest.raises(ValueError, match="version_id"):
        T.discover({"t": spark.range(1).selectExpr("id as a_id", "'x' as text")}, T.ARTICLE_ALIASES, T.ARTICLE_REQUIRED)


def test_guards(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "episode_id string, v2_sentence string")
    with pytest.raises(ValueError):
        T.forbid(df)
    with pytest.raises(ValueError):
        T.require_unique(df, "episode_id")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y\nz', 1)], "id string, text string, n int")
    T.write_jsonl(df, str(tmp_path / "j"))
    assert T.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()
    for name in ("c.parquet", "c.csv", "c.csv.gz"):
        T.write_cache(df, str(tmp_path / name))
        assert T.read_cache(spark, str(tmp_path / name)).first().text == 'say "x", y\nz'


def test_malformed_json_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception):
        T.read_jsonl(spark, str(tmp_path / "bad.json"), "id string").collect()
