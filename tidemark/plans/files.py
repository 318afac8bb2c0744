"""Queries that write files of storage metadata to the shared folder and read them back, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import relations as R
from tidemark.session import load
from tidemark.sources import catalog
from tidemark.staging import shared_folder


def catalog_records(s, d):
    """Every node's chunks as catalog lines with checksums, a node a revision; of a chunk the last record is read."""
    c = R.copies(s, d).join(R.chunks(s, d), "chunk_id")
    record = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "length", F.md5(F.col("chunk_id").cast("string")).alias("digest"), F.when(F.col("ready"), "ready").otherwise("copying").alias("state"))
    lines = c.groupBy(F.col("node_id").alias("revision")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    where = shared_folder(s)
    catalog.write_catalog(lines, where)
    return catalog.read_catalog(s, where).select("chunk_id", "length", "state", "revision")


def snapshot_entities(s, d):
    """A snapshot of the nations as entities, written as one JSON object."""
    n = load(s, d, "nation").agg(F.array_sort(F.collect_list(F.struct(F.lit("inode").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("long").alias("revision")))).alias("entities"))
    where = shared_folder(s)
    n.select(F.lit(1).alias("schema_version"), F.lit(77).cast("long").alias("revision"), "entities").write.json(where)
    return catalog.read_snapshot(s, where)


def metric_lines(s, d):
    """Counters as metric text."""
    e = load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = e.select(F.lit("events_total").alias("name"), F.concat(F.lit('type="'), "event_type", F.lit('"')).alias("labels"), F.col("n").cast("double").alias("value"))
    where = shared_folder(s)
    catalog.write_metrics(rows, where)
    return catalog.read_metrics(s, where)


def file_states(s, d):
    """Files of a folder against what a catalog says: missing, truncated, orphan or whole."""
    n = load(s, d, "nation").select(F.col("n_nationkey").alias("n"))
    where = shared_folder(s)
    n.filter("n <= 20").select(F.col("n").alias("chunk"), F.repeat(F.lit("x"), F.col("n") * 10 + 1).alias("value")).write.partitionBy("chunk").text(where)
    said = n.filter("n <> 3").select(F.col("n").cast("string").alias("chunk_id"), (F.col("n") * 10 + F.when(F.col("n") % 5 == 0, 9).otherwise(2)).cast("long").alias("length"))
    return catalog.reconcile_files(said, catalog.list_files(s, where, "chunk=([^/]+)/"))


def log_frames(s, d):
    """Every user's events as a log of frames, read up to its first damaged one."""
    e = load(s, d, "events").select(F.concat(F.lit("log"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("revision"), F.encode("event_type", "UTF-8").alias("body"))
    damaged = F.col("revision") % 50 == 49
    found = catalog.frames_of(catalog.as_logs(e.withColumn("damaged", damaged)))
    return found.select("file", "revision", F.decode("body", "UTF-8").alias("body"))


ORACLES = {
    "catalog_records": """WITH c AS (SELECT l_partkey AS chunk_id, l_suppkey AS node_id, max(l_returnflag) = 'A' AS ready FROM lineitem GROUP BY ALL)
      SELECT chunk_id::VARCHAR AS chunk_id, (p_size * 100)::BIGINT AS length, CASE WHEN ready THEN 'ready' ELSE 'copying' END AS state, node_id AS revision
      FROM c JOIN part ON chunk_id = p_partkey QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY node_id DESC) = 1""",
    "snapshot_entities": "SELECT 77::BIGINT AS snapshot_revision, 'inode' AS kind, n_nationkey::VARCHAR AS id, n_regionkey::BIGINT AS revision FROM nation",
    "metric_lines": """SELECT 'events_total' AS name, 'type="' || event_type || '"' AS labels, count(*)::DOUBLE AS value FROM events GROUP BY event_type""",
    "file_states": """SELECT n_nationkey::VARCHAR AS chunk_id, CASE WHEN n_nationkey = 3 THEN 'orphan' WHEN n_nationkey > 20 THEN 'missing' WHEN n_nationkey % 5 = 0 THEN 'truncated' ELSE 'whole' END AS state FROM nation""",
    "log_frames": """WITH e AS (SELECT 'log' || user_id AS file, event_id AS revision, event_type AS body, max(CASE WHEN event_id % 50 = 49 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS cut FROM events) SELECT file, revision, body FROM e WHERE cut = 0""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
