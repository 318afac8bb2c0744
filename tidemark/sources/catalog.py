"""Sources and sinks of storage metadata: JSON Lines catalogs, snapshots, metric texts, chunk files, frames."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.feed import gaps

CATALOG = "revision long, records array<struct<chunk_id:string,length:bigint,digest:string,state:string>>, checksum string"
SNAPSHOT = "schema_version int, revision long, entities array<struct<kind:string,id:string,revision:bigint>>"
#: A frame of the log: magic, version, length of the body, and a checksum of version, length and body; 28 bytes.
MAGIC, FRAME, FRAME_SIZE = b"TDLG", "<4sQQ8s", 28


def checksum() -> Column:
    """Of a catalog line: its revision and its records' fields."""
    each = F.transform("records", lambda r: F.concat_ws(":", *[F.coalesce(r[c].cast("string"), F.lit("")) for c in ("chunk_id", "length", "digest", "state")]))
    return F.sha2(F.concat_ws("|", F.col("revision").cast("string"), F.array_join(each, ",")), 256)


def write_catalog(lines: DataFrame, path: str) -> None:
    """Lines (revision, records) with their checksums as JSON Lines."""
    lines.select("revision", "records", checksum().alias("checksum")).write.json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog's current records: of every chunk the last. A line that is no JSON of the schema, or whose checksum
    is another than its fields', fails the query; lines of before there were checksums have none."""
    lines = spark.read.schema(CATALOG).option("mode", "FAILFAST").json(path)
    good = F.col("checksum").isNull() | (F.col("checksum") == checksum())
    lines = lines.withColumn("records", F.when(good, F.col("records")).otherwise(F.raise_error(F.concat(F.lit("checksum of revision "), F.col("revision").cast("string")))))
    each = lines.select("revision", F.posexplode("records").alias("at", "r")).select("revision", "at", "r.*")
    last = each.groupBy("chunk_id").agg(F.max_by(F.struct("length", "digest", "state", "revision"), F.struct("revision", "at")).alias("l"))
    return last.select("chunk_id", "l.*")


def catalog_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Revisions that do not follow the one before."""
    return gaps(spark.read.schema(CATALOG).json(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a snapshot of schema version 1; another version is an error."""
    snap = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = snap.withColumn("entities", F.when(F.col("schema_version") == 1, F.col("entities")).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))))
    return checked.select(F.col("revision").alias("snapshot_revision"), F.explode("entities").alias("e")).select("snapshot_revision", "e.*")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of metric text: comments and blank lines are passed over, a value that is no number
    (exponents, NaN and signed Inf are) fails the query."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    shape = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})? +([^ ]+)"
    return lines.select(*[F.regexp_extract("value", shape, k).alias(n) for k, n in ((1, "name"), (2, "labels"))], F.regexp_extract("value", shape, 3).cast("double").alias("value"))


def write_metrics(df: DataFrame, path: str) -> None:
    """Rows (name, labels, value) as metric text."""
    label = F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), "labels", F.lit("}")))
    df.select(F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("value")).write.text(path)


def reconcile_files(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog (chunk_id, length) against files (chunk_id, size): missing, truncated, orphan or whole."""
    both = catalog.select("chunk_id", "length").join(files.select("chunk_id", "size"), "chunk_id", "full_outer")
    state = F.when(F.col("size").isNull(), "missing").when(F.col("length").isNull(), "orphan").when(F.col("size") < F.col("length"), "truncated").otherwise("whole")
    return both.select("chunk_id", state.alias("state"))


def list_files(spark: SparkSession, path: str, name: str = "([^/]+)$") -> DataFrame:
    """(chunk_id, size) of the files of a folder, the id by a pattern of the path; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", name, 1).alias("chunk_id"), F.col("length").alias("size"))


def frame_checksum(version: int, body: bytes) -> bytes:
    return hashlib.sha256(struct.pack("<QQ", version, len(body)) + body).digest()[:8]


def frame(version: int, body: bytes) -> bytes:
    return struct.pack(FRAME, MAGIC, version, len(body), frame_checksum(version, body)) + body


def little(n: Column) -> Column:
    """A whole number's eight bytes, least first, in hexadecimal."""
    big = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def framed(version: Column, body: Column) -> Column:
    """A frame as `frame` makes it, in hexadecimal; without a version or a body there is none, which fails the query."""
    said = F.concat(little(version), little(F.octet_length(body)))
    digest = F.sha2(F.concat(F.unhex(said), body), 256)
    return F.coalesce(F.concat(F.lit(MAGIC.hex()), said, F.substring(digest, 1, 16), F.hex(body)), F.raise_error(F.lit("a frame needs a version and a body")))


def as_logs(records: DataFrame) -> DataFrame:
    """Logs (path, content) of records (path, revision, body, damaged), by revision; a damaged one has a wrong byte."""
    log = F.array_sort(F.collect_list(F.struct("revision", "body", "damaged")))

    def one(r: Column) -> Column:
        frame_hex = framed(r["revision"], r["body"])  # stands once in each branch, as a lambda works out every mention
        return F.when(r["damaged"], F.regexp_replace(frame_hex, "..$", b"?".hex())).otherwise(frame_hex)

    return records.groupBy("path").agg(log.alias("log")).select("path", F.unhex(F.array_join(F.transform("log", one), "")).alias("content"))


def frames_in(data: memoryview):
    """(version, body) of a log's frames up to the first torn or damaged one."""
    at = 0
    while at + FRAME_SIZE <= len(data):
        magic, version, size, said = struct.unpack_from(FRAME, data, at)
        body = bytes(data[at + FRAME_SIZE : at + FRAME_SIZE + size])
        if magic != MAGIC or len(body) < size or frame_checksum(version, body) != said:
            return
        yield version, body
        at += FRAME_SIZE + size


def read_pieces(batches, most: int = 4096, most_bytes: int = 8 << 20):
    """Arrow batches (file, revision, body) of batches of logs (path, content), so many frames or bytes at a time."""
    rows, held = [], 0
    table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["file", "revision", "body"])
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            name, data = name.as_py(), content.as_buffer()
            for version, body in frames_in(memoryview(b"" if data is None else data)):
                rows.append((name, version, body))
                held += len(body)
                if len(rows) >= most or held >= most_bytes:
                    yield table()
                    rows, held = [], 0
    if rows:
        yield table()


def frames_of(logs: DataFrame) -> DataFrame:
    """(file, revision, body) of logs (path, content), up to the first torn or damaged frame of each. Frames are given
    on by the thousand: a worker holds a batch of logs, which Spark bounds by bytes, not what is read of them."""
    return logs.select("path", "content").mapInArrow(read_pieces, "file string, revision long, body binary")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of log files."""
    return frames_of(spark.read.format("binaryFile").load(path))
