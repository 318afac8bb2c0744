"""Statistics of storage tests: three quantile rules, health, quorum, histograms, ratios, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, per_cent: list[int], *, floor: bool = False) -> DataFrame:
    """Nearest-rank quantiles sorted[ceil(n p / 100) - 1], or by floor sorted[n p // 100], as rows (keys, p, value).

    Values are counted first: the window runs over distinct values with their running counts, and no
    group is gathered in a list."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    p = run.withColumn("p", F.explode(F.array(*[F.lit(x) for x in per_cent])))
    place = F.least(F.floor(F.col("total") * F.col("p") / 100), F.col("total") - 1) if floor else F.greatest(F.ceil(F.col("total") * F.col("p") / 100), F.lit(1)) - 1
    return p.filter(F.col("upto") > place).groupBy(*keys, "p").agg(F.min(value).alias("value"))


def interpolated_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def live_copies(chunks: DataFrame, copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunks with live_nodes: distinct live nodes with a ready copy; none is 0."""
    live = copies.filter("ready").join(nodes.filter("live").select("node_id"), "node_id", "left_semi")
    counted = live.groupBy("chunk_id").agg(F.count_distinct("node_id").alias("live_nodes"))
    return chunks.join(counted, "chunk_id", "left").withColumn("live_nodes", F.coalesce("live_nodes", F.lit(0)))


def health(live: Column, desired: int) -> Column:
    return F.when(live == 0, "BlockedNoSource").when(live < desired, "UnderReplicated").otherwise("Satisfied")


def commit_health(copies: DataFrame, desired: int) -> DataFrame:
    """At commit it is copies that count, whether or not their nodes live."""
    return copies.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies")).withColumn("state", health(F.col("copies"), desired))


def quorum(receipts: DataFrame, keys: list[str], min_nodes: int, min_domains: int) -> DataFrame:
    """Whether receipts reach the minima of distinct nodes and failure domains, with no node twice."""
    g = receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("receipts"), F.count_distinct("node_id").alias("n_nodes"), F.count_distinct("domain").alias("n_domains"))
    return g.withColumn("met", (F.col("n_nodes") >= min_nodes) & (F.col("n_domains") >= min_domains) & (F.col("receipts") == F.col("n_nodes")))


def bucket(value: Column, bounds: list[float]) -> Column:
    """The first bound that is at least the value, else +Inf."""
    out = F.lit("+Inf")
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(str(b))).otherwise(out)
    return out


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per bound, in long form."""
    le = [F.count(F.when(F.col(value) <= b, 1)).alias(str(b)) for b in bounds] + [F.count(value).alias("+Inf")]
    wide = df.groupBy(*keys).agg(*le)
    names = [*map(str, bounds), "+Inf"]
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in names])).alias("b")).select(*keys, "b.le", "b.n")


def exemplars(df: DataFrame, keys: list[str], value: str, time: str, ident: str, bounds: list[float]) -> DataFrame:
    """The last exemplar of every series and bucket."""
    return df.groupBy(*keys, bucket(F.col(value), bounds).alias("le")).agg(F.max_by(F.struct(F.col(ident).alias("exemplar"), F.col(value).alias("value")), F.struct(time, ident)).alias("e")).select(*keys, "le", "e.*")


def paired_ratios(df: DataFrame, round_: str, side: str, value: str, a: str, b: str, least: float, warm_up: int = 0) -> DataFrame:
    """Median, least and largest ratio a / b over rounds that have both, and whether the median reaches `least`.
    Rounds below warm_up are left out."""
    both = df.filter(F.col(round_) >= warm_up).groupBy(round_).agg(F.sum(F.when(F.col(side) == a, F.col(value))).alias("x"), F.sum(F.when(F.col(side) == b, F.col(value))).alias("y"))
    r = both.filter("x IS NOT NULL AND y > 0").select((F.col("x") / F.col("y")).alias("r"))
    return r.agg(F.count("r").alias("rounds"), F.median("r").alias("median"), F.min("r").alias("least"), F.max("r").alias("largest")).withColumn("pass", F.col("median") >= least)


def conservation(results: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Discovered against passed, failed, skipped and others, which must add up."""
    one = lambda *s: F.count(F.when(F.col(status).isin(*s), 1))
    g = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("discovered"), one("pass").alias("passed"), one("fail").alias("failed"), one("skip").alias("skipped"), one("todo").alias("todo"))
    left = F.col("discovered") - F.col("passed") - F.col("failed") - F.col("skipped") - F.col("todo")
    return g.withColumn("incomplete", left).withColumn("verdict", F.when(left > 0, "incomplete").when(F.col("failed") > 0, "failed").otherwise("passed"))


def delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """after - before over the keys of both, a missing one counted as 0, without zeros."""
    b, a = before.select(key, F.col(value).alias("_b")), after.select(key, F.col(value).alias("_a"))
    return b.join(a, key, "full_outer").select(key, (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta")).filter("delta <> 0")


def tree_digest(df: DataFrame, keys: list[str], line: Column, fan: int = 2) -> DataFrame:
    """One digest per key of its lines: lines are dealt into buckets by the first `fan` hex digits of their own
    digests, a bucket is the digest of its lines in order, a key that of its buckets. So a key of very many lines
    is gathered in parts; equal sets of lines have equal digests."""
    lines = df.select(*keys, line.alias("_l")).withColumn("_b", F.substring(F.sha2("_l", 256), 1, fan))
    buckets = lines.groupBy(*keys, "_b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_l")), "\n"), 256).alias("_d"))
    return buckets.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))
