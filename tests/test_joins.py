"""What is joined at size: no broadcast of rows whose compressed files look small, no join of means with themselves."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import metrics as M
from palimpsest.operators import reports as B
from palimpsest.operators import selection as S
from palimpsest.sources.staging import written


def test_ranks_in_many_groups_do_not_broadcast(spark):
    rows = written(spark.range(20_000).select("id", (F.col("id") % 400).alias("cell")), "cells")
    out = S.hash_ranked(rows, F.sha2(F.col("id").cast("string"), 256), ["cell"], ["id"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()
    per = out.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("nth").alias("k"), F.max("nth").alias("most")).collect()
    assert len(per) == 400 and all(r["n"] == r["k"] == r["most"] == 50 for r in per)


@pytest.mark.parametrize("summary", [M.arm_summary, B.full_summary])
def test_the_baseline_never_beats_itself(spark, summary):
    """Values that come out anew each time they are computed stand for means whose last digits depend on the order of the rows."""
    value = F.udf(lambda _: 0.2 + 0.6 * random.random(), "double").asNondeterministic()
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, "generic").otherwise("treatment").alias("arm"), F.floor(F.col("id") % 80 / 2).cast("int").alias("fold"), (F.floor(F.col("id") / 80) % 2).cast("int").alias("label"), value("id").alias("probability"))
    out = {r["arm"]: r["folds_beating_baseline"] for r in summary(rows).collect()}
    assert out["generic"] == 0 and 0 < out["treatment"] < 40
