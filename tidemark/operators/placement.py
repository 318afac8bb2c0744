"""Placement: hash partitions, replica groups over failure domains, synchronous prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.posix import fnv1a
from tidemark.staging import staged


def partition_of(ident: Column, groups: int) -> Column:
    """FNV-1a-64 of the id modulo the number of groups."""
    return (fnv1a(ident) % groups).cast("long")


def preferred(devices: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first device of each key by (order)."""
    return devices.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_m")).select(*keys, "_m.*")


def chosen(turned: DataFrame, key: str, size: int) -> DataFrame:
    """(key, replicas) of candidates (key, node_id, domain, pos): first those of new domains by pos, then any by pos,
    up to size. `again` is true beforehand where a domain is taken already."""
    first = F.row_number().over(Window.partitionBy(key, "domain").orderBy("pos")) > 1
    placed = turned.withColumn("again", first | F.col("again")).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("again", "pos"))).filter(F.col("k") <= size)
    return placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node_id"))), lambda x: x["node_id"]).alias("replicas"), F.count_distinct("domain").alias("domains"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with their place r from 0 by id and their number n. Ids are dealt to parts by range and ordered inside
    a part; only the parts' counts, a row each, are summed up in one task."""
    dealt = staged(nodes.repartitionByRange("node_id").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.select("_part", F.sum("_rows").over(Window.orderBy("_part")).alias("_upto"), "_rows", F.sum("_rows").over(Window.partitionBy()).alias("n"))
    r = F.col("_upto") - F.col("_rows") + F.row_number().over(Window.partitionBy("_part").orderBy("node_id")) - 1
    return dealt.join(parts, "_part").withColumn("r", r).drop("_part", "_upto", "_rows")


def replica_groups(chunks: DataFrame, nodes: DataFrame, groups: int, size: int) -> DataFrame:
    """(chunk_id, partition, replicas): chunks by hash partition, each partition's replica group chosen once from the
    live nodes turned by the partition's number: a row for a node and partition, whatever the chunks."""
    live = numbered(nodes.filter("live").select("node_id", "domain")).withColumn("partition", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    turned = live.withColumn("pos", F.pmod(F.col("r") - F.col("partition"), F.col("n"))).withColumn("again", F.lit(False))
    return chunks.withColumn("partition", partition_of(F.col("chunk_id").cast("string"), groups)).join(chosen(turned, "partition", size).drop("domains"), "partition")


def ahead(targets: DataFrame, size: int) -> DataFrame:
    """Targets (r, node_id, domain; other columns stay) numbered from 0 as a ring, with `near`: of the nodes from the own place on
    those closer than `size` and the first ones of `size` domains, as (pos, node_id, domain) by pos.

    What is known of the next `width` nodes is put before what the node `width` places on knows, and width doubles:
    a row holds at most twice `size` nodes, and only rows that still lack domains go on, at worst once around."""
    reach = staged(targets.withColumn("near", F.array(F.struct(F.lit(0).cast("long").alias("pos"), "node_id", "domain"))))
    n, width = reach.count(), 1
    domains = lambda near: F.size(F.array_distinct(F.transform(near, lambda x: x["domain"])))
    wanted = lambda kept, x: (x["pos"] < size) | (~F.exists(kept, lambda y: y["domain"].eqNullSafe(x["domain"])) & (domains(kept) < size))
    lacking = domains(F.col("near")) < size
    while width < n and not reach.filter(lacking).isEmpty():
        more = reach.select(F.col("r").alias("_at"), F.transform("near", lambda x: x.withField("pos", x["pos"] + width)).alias("_more"))
        both = reach.filter(lacking).withColumn("_at", F.pmod(F.col("r") + width, F.lit(n))).join(more, "_at")
        both = both.withColumn("near", F.filter(F.concat("near", "_more"), lambda x: x["pos"] < n))
        both = both.withColumn("near", F.aggregate("near", F.slice("near", 1, 1), lambda kept, x: F.when((x["pos"] > 0) & wanted(kept, x), F.concat(kept, F.array(x))).otherwise(kept)))
        reach = staged(reach.filter(~lacking).unionByName(both.select(*reach.columns)))
        width *= 2
    return reach


def headed_groups(sessions: DataFrame, size: int, min_domains: int) -> DataFrame:
    """Of every live node the preferred device and the group that it heads, with the number of its domains: the head
    first, then the others from the next one on, new domains before known ones. Groups of too few domains go.

    Only the `size` nearest nodes and the nearest of `size` domains can be chosen; no pairs of nodes are made."""
    targets = sessions.select("node_id", "domain", F.array_min(F.transform("devices", lambda d: F.struct(d["device_id"].alias("device_id"), d["device_epoch"].alias("device_epoch")))).alias("d"))
    targets = numbered(targets.select("node_id", "domain", F.col("d.device_id").alias("device_id"))).drop("n")
    near = F.col("near")
    known = lambda x: F.exists(near, lambda y: (y["pos"] < x["pos"]) & y["domain"].eqNullSafe(x["domain"]))
    picked = F.slice(F.concat(F.filter(near, lambda x: ~known(x)), F.filter(near, known)), 1, size)
    found = ahead(targets, size).filter(F.size("near") > 1).withColumn("group", picked)
    replicas = F.array_join(F.transform("group", lambda x: x["node_id"].cast("string")), ",")
    domains = F.size(F.array_distinct(F.transform("group", lambda x: x["domain"]))).cast("long")
    return found.select("node_id", "device_id", replicas.alias("replicas"), domains.alias("domains")).filter(F.col("domains") >= min_domains)


def sync_prefix(plan: DataFrame, keys: list[str], position: str, min_nodes: int, min_domains: int) -> DataFrame:
    """The shortest prefix of each plan with enough distinct nodes and domains: its length, null if none."""
    w = Window.partitionBy(*keys).orderBy(position)
    first = lambda c: F.when(F.row_number().over(Window.partitionBy(*keys, c).orderBy(position)) == 1, 1).otherwise(0)
    df = plan.withColumn("_n", first("node_id")).withColumn("_d", first("domain"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_nodes", F.sum("_n").over(run)).withColumn("_domains", F.sum("_d").over(run)).withColumn("_at", F.row_number().over(w))
    return df.groupBy(*keys).agg(F.min(F.when((F.col("_nodes") >= min_nodes) & (F.col("_domains") >= min_domains), F.col("_at"))).alias("prefix"))


def by_plan(chunks: DataFrame) -> DataFrame:
    """Batches: chunks of equal replica lists."""
    return chunks.groupBy("replicas").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))
