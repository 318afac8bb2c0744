"""Reads: listings, pages, first matches, soft limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(entries: DataFrame, parent: Column | str) -> DataFrame:
    """A directory's entries by name bytes."""
    return entries.filter(F.col("parent") == parent).orderBy(F.encode("name", "UTF-8"))


def page(entries: DataFrame, keys: list[str], order: list[str], cookie: int, limit: int) -> DataFrame:
    """For every directory the `limit` entries after `cookie`; an entry's cookie is its place, from 1."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("cookie", at).filter((F.col("cookie") > cookie) & (F.col("cookie") <= cookie + limit))


def soft_limit(feed: DataFrame, limit: int, revision: str = "revision") -> DataFrame:
    """At least `limit` rows by revision, never part of a revision; 0 is no limit.

    A revision has a row at least, so the first `limit` revisions are enough: the window runs over
    their counts, not over the feed."""
    if limit == 0:
        return feed
    sizes = feed.groupBy(revision).agg(F.count(F.lit(1)).alias("n")).orderBy(revision).limit(limit)
    before = F.coalesce(F.sum("n").over(Window.orderBy(revision).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return feed.join(sizes.withColumn("before", before).filter(F.col("before") < limit).select(revision), revision, "left_semi")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first occurrence."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def scan_revision(rows: DataFrame, revision: str, store_revision: int) -> DataFrame:
    """The revision a scan answers for: the largest of the store's and the rows'."""
    return rows.agg(F.greatest(F.lit(store_revision), F.coalesce(F.max(revision), F.lit(0))).alias("revision"))


def xattr(name: str) -> Column:
    """The value of one extended attribute of `xattrs`, null if there is none."""
    return F.get(F.transform(F.filter("xattrs", lambda x: x["name"] == name), lambda x: x["value"]), F.lit(0))


def xattr_names() -> Column:
    return F.array_sort(F.transform("xattrs", lambda x: x["name"]))


def repair_work(tasks: DataFrame, short: DataFrame, completed: str) -> DataFrame:
    """Unfinished tasks (chunk_id, state, attempt), and chunks that are short of copies and have none: a completed
    task of theirs is taken up again with its attempts, else a new one begins."""
    both = tasks.join(short.withColumn("_short", F.lit(True)), "chunk_id", "full_outer")
    unfinished = F.col("state") != completed
    origin = F.when(unfinished, "unfinished").when(F.col("state").isNotNull(), "reactivated").otherwise("new")
    return both.filter(F.coalesce(unfinished, F.lit(False)) | F.col("_short")).select("chunk_id", origin.alias("origin"), F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"))
