"""What the operators of this subpackage share: words, the shared folder, staging, output columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and the five ASCII controls tab to carriage return.
WS = " \t\n\x0b\f\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for a text without any."""
    bare = F.trim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RE))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    fresh one; a cluster's executors could not read it, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}/{name}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a path of new_path removed when the driver ends; results may read it until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Mark df for broadcast only if its counted rows are few; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of Arrow batches of whole texts, alike for every operator, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, size)


def in_slices(batches, column: str = "text", most: int = 8 << 20):
    """pandas batches cut so that the texts of one have at most `most` characters together, or it is one row."""
    for batch in batches:
        upto, at = batch[column].str.len().fillna(0).cumsum().to_numpy(), 0
        while at < len(batch):
            stop = max(at + 1, int(upto.searchsorted((upto[at - 1] if at else 0) + most, "right")))
            yield batch.iloc[at:stop]
            at = stop
