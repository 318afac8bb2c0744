"""Mixing sources to target weights by Sainte-Lague apportionment (native DataFrame code).

Blocks of equal word counts are the seats, (source, shard) units are the parties. A unit's votes are
its share of its source's target; seats go to the highest quotients votes / (2k + 1). Inside a unit,
documents lie in a seeded order, cut into blocks; whole cycles take every block, the rest of the
quota takes a run of blocks from a seeded start. The last seat's quotient is bracketed by a mergeable
quantile sketch; what lies above the bracket is counted, and only quotients inside it, few but for ties,
are ranked. A source is dealt over shards by its words and by its documents, so no shard is large.

Defined cases: a null or wordless text has size 0 and taken 0; a null source is a source of its own,
last in order; repeated rows are separate rows (equal ones share one place in the order, ties are
harmless as they are alike); an empty table gives no rows; input columns named like an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, small, stage, table, text_of

BLOCK_WORDS = 32
#: About how many words and documents a shard has at most.
SHARD_WORDS, SHARD_DOCS = 1_000_000, 2_000
#: Accuracy of the sketch that brackets the last seat's quotient: the bracket is four times this share of all quotients.
ACCURACY = 20_000
SEED = 17


def with_targets(sources: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """Rows (source, source_size) get weight and target.

    Water filling: target = min(most * size, level * weight). With sources by falling eagerness to
    fill up, the level is the largest of (words left) / (weight left) over all prefixes.
    One row per source passes the two windows, never a row per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("at", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))
    )


def apportion(units: DataFrame, block_words: int, most: int = 3, accuracy: int = ACCURACY) -> DataFrame:
    """Sainte-Lague quotas for units (source, shard, words, votes): adds blocks (the unit's own) and quota.

    Seats that every unit is sure to win are given at once; only quotients around each unit's ideal
    share compete, about six candidate rows a unit, and those beside the last seat's are ranked."""
    sums = units.agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes")).first()
    seats = max(1, round_half_up((sums.votes or 0) / block_words))
    near = units.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    near = near.withColumn("slack", (F.ceil(F.lit(sums.n) * F.col("votes") / F.lit(sums.votes or 1.0)) + 2).cast("long"))
    sure = F.greatest(F.lit(0), F.least(F.floor(F.col("votes") / block_words) - F.col("slack"), most * F.col("blocks")))
    near = near.withColumn("sure", sure.cast("long")).withColumn("top", F.least(F.col("sure") + 2 * F.col("slack") + 1, most * F.col("blocks")))
    near = stage(near, "near")
    rivals = near.filter("sure < top").select("source", "shard", "votes", F.explode(F.sequence(F.col("sure"), F.col("top") - 1)).alias("k"))
    rivals = rivals.withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    open_ = seats - (near.agg(F.sum("sure")).first()[0] or 0)
    high, low, above = bracket(rivals, open_, accuracy)
    order = Window.orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "shard", "k")
    ranked = rivals.filter((F.col("quotient") <= high) & (F.col("quotient") >= low)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= open_ - above)
    won = rivals.filter(F.col("quotient") > high).select("source", "shard").unionByName(ranked.select("source", "shard"))
    won = won.groupBy(F.col("source").alias("w_source"), F.col("shard").alias("w_shard")).agg(F.count(F.lit(1)).alias("won"))
    same = F.col("source").eqNullSafe(F.col("w_source")) & (F.col("shard") == F.col("w_shard"))
    return near.join(won, same, "left").select("source", "shard", "words", "blocks", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def round_half_up(x: float) -> int:
    return int(x + 0.5)


def bracket(rivals: DataFrame, seats: int, accuracy: int) -> tuple[float, float, int]:
    """(high, low, n): the quotient of place `seats` lies in [low, high], and n quotients above high.

    Places of the sketch are right to a part in `accuracy`; should they not hold, the bracket is everything."""
    total = rivals.count()
    if not 0 < seats < total:
        return float("inf"), float("-inf"), 0
    at = [min(1.0, max(0.0, 1 - seats / total + x / accuracy)) for x in (2, -2)]
    high, low = rivals.agg(F.percentile_approx("quotient", at, accuracy).alias("q")).first().q
    n = rivals.agg(F.count(F.when(F.col("quotient") > high, 1)).alias("above"), F.count(F.when(F.col("quotient") >= low, 1)).alias("upto")).first()
    return (high, low, n.above) if n.above < seats <= n.upto else (float("inf"), float("-inf"), 0)


def order_key(seed: int):
    """A seeded order of rows by id and text: hex digits, equal only for equal rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of())))


def mix(docs: DataFrame, *, weights=(5, 2, 1), most: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, place (its order key), size, source_size, target, taken.

    Two shuffles carry a few dozen bytes a row; texts are read once and never shuffled. A hot source
    is dealt over its shards, about one for every shard_words words and one for every shard_docs rows of the
    source, so that a small one is one unit at any size of the table. A unit's votes count its last block at its
    real size: as its seats take blocks, however short, a target of a whole number of cycles is met exactly.
    """
    sized = stage(docs.select("doc_id", "source", n_words(text_of()).alias("size"), order_key(seed).alias("place")), "sized")
    of = stage(sized.groupBy("source").agg(F.sum("size").alias("__words"), F.count(F.lit(1)).alias("__rows")).withColumnRenamed("source", "__of"), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("__words") / shard_words), F.ceil(F.col("__rows") / shard_docs))
    sized = sized.join(small(of, of.count()), F.col("source").eqNullSafe(F.col("__of")))
    sized = sized.withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % shards).drop("__of", "__words", "__rows")
    by_unit = sized.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    sources = with_targets(by_unit.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    units = by_unit.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    units = stage(units.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(F.lit(0.0))), "units")
    units = units.withColumn("votes", F.when(F.col("words") > 0, F.col("votes") * F.ceil(F.col("words") / block_words) * block_words / F.col("words")).otherwise(F.lit(0.0)))
    n = units.count()
    quotas = apportion(units.filter("votes > 0").select("source", "shard", "words", "votes"), block_words, most)
    seen = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "blocks", "quota")
    plan = units.join(seen, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    plan = plan.select(
        F.col("source").alias("u_source"), F.col("shard").alias("u_shard"), "source_size", "target",
        F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("quota", F.lit(0)).alias("quota"), (draw % F.coalesce("blocks", F.lit(1))).alias("first"),
    )
    laid = Window.partitionBy("source", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("a", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    joined = placed.join(small(plan, n), F.col("source").eqNullSafe(F.col("u_source")) & (F.col("shard") == F.col("u_shard")))
    return joined.select("doc_id", "place", "size", "source_size", F.round("target", 6).alias("target"), taken(block_words).alias("taken"))


def taken(block_words: int):
    """Words of [a, a + size) in the chosen blocks: whole cycles, and a run of blocks from `first` on, going round."""
    a, b = F.col("a"), F.col("a") + F.col("size")
    cycles, rest = F.floor(F.col("quota") / F.col("blocks")), F.col("quota") % F.col("blocks")
    lo, hi = F.col("first") * block_words, (F.col("first") + rest) * block_words
    round_by = F.col("blocks") * block_words

    def shared(x, y):
        return F.greatest(F.lit(0), F.least(b, y) - F.greatest(a, x))

    return (cycles * F.col("size") + shared(lo, hi) + shared(F.lit(0), hi - round_by)).cast("long")


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents, with the columns of docs: every row taken // size times, once more if at
    least half of it is left over. Only documents at the ends of a run of blocks are rounded so. A row
    without words has nothing to take and goes."""
    mixed = mix(docs, **params).select(F.col("place").alias("__place"), F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int").alias("__times"))
    mixed = mixed.groupBy("__place").agg(F.max("__times").alias("__times")).filter("__times > 0")  # equal rows: alike
    placed = docs.withColumn("__at", order_key(params.get("seed", SEED)))
    return placed.join(mixed, F.col("__at") == F.col("__place")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[f"`{c}`"] for c in docs.columns])


def query(spark, sf_dir):
    """op10: every document with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).drop("place")
