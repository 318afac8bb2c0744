"""Interval algebra: coalescing, subtraction, coverage, layout checks. Starts and ends are whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced(ranges: DataFrame, keys: list[str], *, inclusive: bool = False, clip: int | None = None, least: str | None = None) -> DataFrame:
    """Merged ranges per key. Half-open ranges merge when start <= end of what came before; inclusive
    ones also when they adjoin. Empty ranges go; clip cuts ranges off at a length. least is a column of which
    a merged range has the smallest value.

    Gaps and islands: a running maximum of ends over the earlier rows marks where an island begins."""
    df = ranges.select(*keys, "start", F.least("end", F.lit(clip)).alias("end") if clip is not None else "end", *([least] if least else []))
    df = df.filter(F.col("start") <= F.col("end") if inclusive else F.col("start") < F.col("end"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") - 1 > before if inclusive else F.col("start") > before
    df = df.withColumn("fresh", F.when(before.isNull() | apart, 1).otherwise(0))
    df = df.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *([F.min(least).alias(least)] if least else [])).drop("island")


def covered(asked: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Asked half-open ranges with whether one merged range holds them whole.

    Merged ranges are disjoint, so only the last that starts at or before the asked start can: one
    sorted pass over both, no pairs."""
    both = asked.select(*keys, "start", "end", F.lit(1).alias("ask")).unionByName(merged.select(*keys, "start", "end", F.lit(0).alias("ask")))
    order = Window.partitionBy(*keys).orderBy("start", "ask").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.last(F.when(F.col("ask") == 0, F.col("end")), ignorenulls=True).over(order)
    return both.withColumn("covered", F.coalesce(upto >= F.col("end"), F.lit(False))).filter("ask = 1").drop("ask")


def subtracted(ranges: DataFrame, cut_start: int, cut_end: int) -> DataFrame:
    """Inclusive ranges without [cut_start, cut_end]: none, one or two remainders each."""
    left = F.when(F.col("start") < cut_start, F.struct(F.col("start").alias("start"), F.least(F.col("end"), F.lit(cut_start - 1)).alias("end")))
    right = F.when(F.col("end") > cut_end, F.struct(F.greatest(F.col("start"), F.lit(cut_end + 1)).alias("start"), F.col("end").alias("end")))
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    return ranges.select(*rest, F.explode(F.filter(F.array(left, right), lambda x: x.isNotNull() & (x["start"] <= x["end"]))).alias("r")).select(*rest, "r.start", "r.end")


def layout_faults(extents: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Extents, in the order they are listed, that are empty, or begin before the one listed before them ends."""
    order = Window.partitionBy(*keys).orderBy(position)
    before = F.lag("end").over(order)
    fault = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") < before, "overlap or disorder")
    return extents.withColumn("fault", fault).filter("fault IS NOT NULL")


def inherited(new: DataFrame, old: DataFrame) -> DataFrame:
    """New extents (chunk_id, file_offset, chunk_offset, length) that lie in an old one of the same chunk, equally offset."""
    o = old.select(F.col("chunk_id").alias("o_chunk"), (F.col("file_offset") - F.col("chunk_offset")).alias("o_delta"), F.col("file_offset").alias("o_start"), (F.col("file_offset") + F.col("length")).alias("o_end"))
    inside = (F.col("o_start") <= F.col("file_offset")) & (F.col("file_offset") + F.col("length") <= F.col("o_end"))
    return new.join(o, (F.col("chunk_id") == F.col("o_chunk")) & (F.col("file_offset") - F.col("chunk_offset") == F.col("o_delta")) & inside, "left_semi")


def within(ranges: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """ranges, each inside its key's length (column `length` of lengths); one that ends beyond it fails the query."""
    both = ranges.join(lengths, keys)
    end = F.when(F.col("end") <= F.col("length"), F.col("end")).otherwise(F.raise_error(F.lit("range past the chunk's end")))
    return both.select(*keys, "start", end.alias("end"))


def grid(owners: DataFrame, extents: DataFrame, keys: list[str], length: int, block: int) -> DataFrame:
    """Every block of [0, length) of every owner, with the units that extents hold in it and those that read as zero."""
    cut = coalesced(extents, keys, clip=length).withColumn("start", F.greatest("start", F.lit(0))).filter("start < end")
    each = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    part = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    held = each.groupBy(*keys, "block").agg(F.sum(part).alias("held"))
    every = owners.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((length - 1) // block).cast("long"))).alias("block"))
    held = every.join(held, [*keys, "block"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return held.withColumn("zero", F.lit(block) - F.col("held"))


def sparse_read(extents: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Per key the bytes of [0, length) that extents hold, and those that read as zero."""
    held = coalesced(extents, keys, clip=length).groupBy(*keys).agg(F.sum(F.col("end") - F.greatest(F.col("start"), F.lit(0))).alias("held"))
    return held.withColumn("zero", F.lit(length) - F.col("held"))
