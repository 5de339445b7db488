"""Sessions of ordered votes: continuation targets, votes and their reports; a synthetic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

VOTES = ("a", "b", "tie", "both_bad")


def prepared(rows: DataFrame, session: str, order: list, vote: str) -> DataFrame:
    """[W05, P17, P18] session_id, round (from 0), vote, whether the session goes on, and the vote one-hot."""
    w = Window.partitionBy(session)
    rows = rows.withColumn("round", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count("*").over(w))
    out = rows.select(F.col(session).alias("session_id"), "round", "size", X.normalise_winner(vote).alias("vote"), (F.col("round") < F.col("size") - 1).cast("int").alias("continues"))
    return out.withColumns({f"pref_{v}": (F.col("vote") == v).cast("int") for v in VOTES})


def continuation(rows: DataFrame, by: list[str]) -> DataFrame:
    """[G58] Continuation rate by vote, by order, or by vote in the first round, with its lift over all."""
    total = rows.agg(F.avg("continues").alias("base"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("continues").alias("rate"))
    return out.crossJoin(F.broadcast(total)).select(*by, "n", "rate", (F.col("rate") - F.col("base")).alias("lift"))


def session_sizes(rows: DataFrame) -> DataFrame:
    """[G58, G59]"""
    per = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("sessions"), F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def synthetic(spark: SparkSession, sessions: int, rounds: int, seed: int = 17, effect: float = 0.5, shared: float = 0.8) -> DataFrame:
    """[S25, F37] Sessions with a latent mood that sways both votes and leaving; rounds end with the first stop."""
    u = lambda *parts: F.conv(F.substring(X.stable_hash(seed, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = spark.range(sessions).select(F.col("id").alias("session_id"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    rows = rows.withColumn("mood", u(F.lit("mood"), F.col("session_id")) * 2 - 1)
    rows = rows.withColumn("prefers_a", (u(F.lit("vote"), F.col("session_id"), F.col("round")) < X.sigmoid(shared * F.col("mood"))).cast("int"))
    stop = (u(F.lit("stop"), F.col("session_id"), F.col("round")) < X.sigmoid(-1.5 - shared * F.col("mood") - effect * (2 * F.col("prefers_a") - 1))).cast("int")
    rows = rows.withColumn("stop", stop)
    w = Window.partitionBy("session_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stopped", F.coalesce(F.sum("stop").over(w), F.lit(0)))
    return rows.where("stopped = 0").select("session_id", "round", F.when(F.col("prefers_a") == 1, "model_a").otherwise("model_b").alias("winner"), "mood", "stop")
