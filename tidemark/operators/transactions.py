"""Conditional transactions as set-based checks: every request's conditions against one state of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conditions(requests: DataFrame) -> DataFrame:
    """Rows (request, rank, kind, key, revision, session) of requests (request, key, revision, session): every third
    one needs its key missing, every third its key at a revision, every second a live session. All of a request's
    rows must hold; of those that don't, the one of the lowest rank is told."""
    of = lambda cond, rank, kind: F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
    n = F.col("request")
    kinds = F.filter(F.array(of(n % 3 == 0, 2, "missing"), of(n % 3 == 1, 3, "revision"), of(n % 2 == 0, 4, "session")), lambda x: x.isNotNull())
    return requests.withColumn("c", F.explode(kinds)).select("request", "c.rank", "c.kind", "key", "revision", "session")


def judged(requests: DataFrame, conditions_: DataFrame, state: DataFrame, done: DataFrame, live: DataFrame) -> DataFrame:
    """(request, outcome): commit, the first condition that fails, or `request seen` for a request done before.

    Every kind of condition is one equi-join with what it asks about: entities, requests done, live sessions."""
    now = state.select("key", F.col("revision").alias("now"))
    met = conditions_.join(now, "key", "left").join(live.withColumn("alive", F.lit(True)), "session", "left")
    failed = F.when(F.col("kind") == "missing", F.col("now").isNotNull()).when(F.col("kind") == "revision", ~F.col("now").eqNullSafe(F.col("revision"))).otherwise(F.col("alive").isNull())
    worst = met.filter(failed).groupBy("request").agg(F.min_by("kind", "rank").alias("kind"))
    both = requests.join(worst, "request", "left").join(done.withColumn("seen", F.lit(True)), "request", "left")
    return both.select("request", F.when(F.col("seen"), "request seen").otherwise(F.coalesce("kind", F.lit("commit"))).alias("outcome"))
