"""Storage-cluster relations derived from the given star-schema tables.

The queries work on nodes, chunks, copies, namespace entries, extents, locks, sessions and an ordered
change log. These views give them such relations, each a plain projection or aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import load

LIVE_ABOVE, DESIRED = 7000.0, 3
#: Lines of a table that one task groups or joins by chunk.
LINES_A_TASK = 250_000


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, domain, live, lease_ms): storage nodes with failure domain and lease."""
    s = load(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("domain"), (F.col("s_acctbal") > LIVE_ABOVE).alias("live"), F.floor(F.col("s_acctbal") * 100).cast("long").alias("lease_ms"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, length)."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size") * 100).cast("long").alias("length"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, node_id, ready, epoch): one copy for each chunk and node."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id")).agg((F.max("l_returnflag") == "A").alias("ready"), F.max("l_linenumber").cast("long").alias("epoch"))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, start, end): half-open ranges of an owner, in days."""
    li = load(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return li.select(F.col("l_suppkey").alias("owner"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, name, inode): directory entries of a tree region > nation > customer."""
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.lit("root").alias("parent"), F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("inode"))
    mid = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("inode"))
    low = c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("inode"))
    return top.unionByName(mid).unionByName(low)


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inode, kind, mode, uid, gid): attributes; customers are files."""
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("inode"), F.lit("dir").alias("kind"), F.lit(0o755).alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).alias("gid"))
    mid = n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("dir"), F.lit(0o2775), F.lit(0).cast("long"), F.col("n_nationkey"))
    mode = (F.col("c_custkey") * 37 % 4096).cast("int")
    low = c.select(F.concat(F.lit("c"), "c_custkey"), F.lit("file"), mode, F.col("c_custkey") % 50, F.col("c_nationkey"))
    return top.union(mid).union(low)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(revision, event_index, key, kind, value, ts): an ordered change log; an `error` event deletes its key."""
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return e.select(F.floor(F.col("event_id") / 3).alias("revision"), (F.col("event_id") % 3).alias("event_index"), F.col("user_id").alias("key"), kind.alias("kind"), "value", "ts", "event_type")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, domain, lease_epoch, lease_ms, devices): node sessions, devices an array of (device_id, device_epoch, catalog_revision)."""
    s = load(spark, sf_dir, "supplier")
    device = lambda i, e, c: F.struct(i.cast("long").alias("device_id"), e.cast("long").alias("device_epoch"), c.cast("long").alias("catalog_revision"))
    devices = F.array(device(F.col("s_suppkey") % 4, F.col("s_nationkey") % 3 + 1, F.col("s_nationkey") % 7), device((F.col("s_suppkey") + 1) % 4, F.lit(1), F.lit(6)))
    return s.select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("domain"), (F.col("s_nationkey") % 5 + 1).alias("lease_epoch"), F.floor(F.col("s_acctbal") * 100).cast("long").alias("lease_ms"), devices.alias("devices"))


def digested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, length, digest)."""
    return chunks(spark, sf_dir).withColumn("digest", F.md5(F.col("chunk_id").cast("string")))


def by_chunk(spark: SparkSession, lines: DataFrame, chunk: str) -> DataFrame:
    """Lines dealt by their chunk to so many tasks that each has about LINES_A_TASK of them, whatever the size of the
    table: what is grouped or joined by chunk afterwards stays where it is."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_TASK))
    return lines.repartition(tasks, chunk)


def stored_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with where they lie and what was verified: (chunk_id, node_id, ready, node_epoch, device_id,
    device_epoch, catalog_revision, bytes, digest)."""
    li = by_chunk(spark, load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id"), "l_returnflag", "l_linenumber", "l_quantity"), "chunk_id")
    c = li.groupBy("chunk_id", "node_id").agg(
        (F.max("l_returnflag") == "A").alias("ready"), (F.max("l_linenumber") % 6).alias("node_epoch"), (F.min("l_linenumber") % 4).alias("device_id"), (F.count(F.lit(1)) % 3 + 1).alias("device_epoch"),
        (F.max("l_quantity").cast("long") % 7).alias("catalog_revision"), F.when(F.max("l_linenumber") == 7, 1).otherwise(0).alias("lost"), F.when(F.min("l_linenumber") == 5, "x").otherwise("").alias("altered"),
    )
    held = digested_chunks(spark, sf_dir)
    return c.join(held, "chunk_id").withColumn("bytes", F.col("length") - F.col("lost")).withColumn("digest", F.concat("digest", "altered")).drop("length", "lost", "altered")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inode, target, xattrs): links' targets and extended attributes as an array of (name, value)."""
    c = load(spark, sf_dir, "customer")
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    pair = F.array(one("user.segment", F.col("c_mktsegment")), one("user.nation", F.col("c_nationkey")))
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("inode"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("/"), "c_name")).alias("target"), F.when(F.col("c_custkey") % 2 == 0, pair).otherwise(F.slice(pair, 1, 1)).alias("xattrs"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, data): chunks with their bytes."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
