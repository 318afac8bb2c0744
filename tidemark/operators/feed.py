"""The ordered change log: reading on from a cursor, latest state, replays, session epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["revision", "event_index"]


def after(feed: DataFrame, cursor: int) -> DataFrame:
    return feed.filter(F.col("revision") > cursor)


def for_consumer(feed: DataFrame, cursor: int, mine: Column) -> DataFrame:
    """The consumer's own events after the cursor, with the cursor to go on from: that of the whole feed,
    also where the last events were for others."""
    rest = after(feed, cursor)
    upto = rest.agg(F.coalesce(F.max("revision"), F.lit(cursor)).alias("next_revision"))
    # one row, joined by a constant: the cursor is taken before the filter
    return rest.filter(mine).withColumn("_k", F.lit(1)).join(F.broadcast(upto.withColumn("_k", F.lit(1))), "_k").drop("_k")


def state(feed: DataFrame, key: str = "key") -> DataFrame:
    """Latest state: the last change of every key, without the deleted."""
    rest = [c for c in feed.columns if c != key]
    last = feed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_l")).select(key, "_l.*")
    return last.filter("kind <> 'delete'").drop("kind")


def replays(requests: DataFrame) -> DataFrame:
    """Requests (caller, request, digest, at) by outcome: first applied, replays of it, and those under
    the same name with another digest, which conflict."""
    first = requests.groupBy("caller", "request").agg(F.min_by("digest", "at").alias("first_digest"), F.min("at").alias("first_at"))
    both = requests.join(first, ["caller", "request"])
    outcome = F.when(F.col("at") == F.col("first_at"), "applied").when(F.col("digest") == F.col("first_digest"), "replayed").otherwise("conflict")
    return both.withColumn("outcome", outcome).drop("first_digest", "first_at")


def session_epochs(log: DataFrame, node: str, session: str, at: str) -> DataFrame:
    """Lease epochs: a node's epoch goes up by one when another session than the last registers."""
    w = Window.partitionBy(node).orderBy(at)
    fresh = F.when(F.lag(session).over(w).eqNullSafe(F.col(session)), 0).otherwise(1)
    return log.withColumn("_f", fresh).withColumn("epoch", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def registrations(log: DataFrame, ttl: int) -> DataFrame:
    """Registrations (node, session, at): accepted or, where the session's own lease has run out before, expired for
    good. The epoch of an accepted one goes up by one when another session than the node's last registers."""
    own = Window.partitionBy("node", "session").orderBy("at")
    late = F.coalesce(F.col("at") - F.lag("at").over(own) >= ttl, F.lit(False))
    seen = log.withColumn("_late", late).withColumn("_refused", F.max("_late").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    good = session_epochs(seen.filter(~F.col("_refused")), "node", "session", "at").select("node", "session", F.col("at").alias("seen_at"), F.lit("accepted").alias("outcome"), "epoch")
    return good.unionByName(seen.filter("_refused").select("node", "session", F.col("at").alias("seen_at"), F.lit("expired").alias("outcome"), F.lit(None).cast("long").alias("epoch")))


def gaps(log: DataFrame, revision: str = "revision") -> DataFrame:
    """Revisions that don't follow the one before, with that one: a log must be contiguous.

    Ends of runs are found by anti-joins on the neighbour; only they, a few rows a gap, are ordered."""
    revs = log.select(F.col(revision).alias("r")).distinct()
    starts = revs.join(revs.select((F.col("r") + 1).alias("r")), "r", "left_anti").withColumn("ends", F.lit(0))
    ends = revs.join(revs.select((F.col("r") - 1).alias("r")), "r", "left_anti").withColumn("ends", F.lit(1))
    order = Window.orderBy("r", "ends").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ends") == 1, F.col("r")), ignorenulls=True).over(order)
    found = starts.unionByName(ends).withColumn("before", before)
    return found.filter("ends = 0 AND before IS NOT NULL").select(F.col("r").alias(revision), "before")
