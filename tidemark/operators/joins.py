"""Navigational joins as set operations: directories, sources of chunks, grants, ancestry, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import staged


def with_parent(df: DataFrame, parents: DataFrame, key: str, what: str) -> DataFrame:
    """df with its parents' columns; a row whose parent is missing is an error of the whole query."""
    found = df.join(parents.withColumn("_found", F.lit(True)), key, "left")
    columns = [c for c in found.columns if c not in (key, "_found")]
    checked = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{what} not found: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return found.select(checked.alias(key), *columns)


def read_dir(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries with their inodes. An entry whose inode is missing fails the query; `dangling` lists such entries."""
    return with_parent(entries, inodes, "inode", "inode")


def dangling(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    return entries.join(inodes, "inode", "left_anti")


def chunk_sources(chunks: DataFrame, copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per chunk the nodes it can be read from, in order; a chunk without any has an empty list."""
    serving = copies.filter("ready").join(nodes.filter("live").select("node_id"), "node_id", "left_semi")
    listed = serving.groupBy("chunk_id").agg(F.sort_array(F.collect_set("node_id")).alias("sources"))
    return chunks.join(listed, "chunk_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))


def closed(reach: DataFrame, step) -> DataFrame:
    """reach joined with itself until nothing is new: the rounds are the logarithm of the longest way, in any depth."""
    reach = staged(reach)
    size = reach.count()
    while True:
        reach = staged(step(reach))
        now = reach.count()
        if now == size:
            return reach
        size = now


def ancestors(entries: DataFrame) -> DataFrame:
    """(inode, ancestor, distance) of every inode, itself included at 0, by doubling."""

    def step(reach):
        a, b = reach.alias("a"), reach.alias("b")
        more = a.join(b, F.col("a.ancestor") == F.col("b.inode")).select("a.inode", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        return reach.unionByName(more).groupBy("inode", "ancestor").agg(F.min("distance").alias("distance"))

    reach = closed(entries.select("inode", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct(), step)
    own = entries.select("inode", F.col("inode").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    return own.unionByName(reach).groupBy("inode", "ancestor").agg(F.min("distance").alias("distance"))


def below_or_same(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pairs (ancestor, child) with `below`: whether child is ancestor or below it. A child whose parents run into a
    cycle counts as below everything, so that nothing is moved there."""
    reach = closed(entries.select("inode", F.col("parent").alias("ancestor")).distinct(), lambda r: r.unionByName(r.alias("a").join(r.alias("b"), F.col("a.ancestor") == F.col("b.inode")).select("a.inode", "b.ancestor")).distinct())
    looped = reach.filter("inode = ancestor").select(F.col("inode").alias("on"))
    into = reach.join(looped, F.col("ancestor") == F.col("on")).select(F.col("inode").alias("child"), F.lit(True).alias("_loop")).distinct()
    met = reach.select("ancestor", F.col("inode").alias("child"), F.lit(True).alias("_met"))
    found = pairs.join(met, ["ancestor", "child"], "left").join(into, "child", "left")
    return found.select(*pairs.columns, ((F.col("ancestor") == F.col("child")) | F.coalesce("_met", "_loop", F.lit(False))).alias("below"))


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs connected by a way along edges; a cycle reaches itself."""
    return closed(edges.select("src", "dst").distinct(), lambda r: r.unionByName(r.alias("a").join(r.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct())


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes (node) on a cycle or on a way from one to another: those that are left when nodes without a way in or
    out are taken off until there are none. It never makes pairs, so it tells whether there is a deadlock at all."""
    left = staged(edges.select("src", "dst").distinct())
    while True:
        kept = staged(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if kept.count() == left.count():
            return kept.select(F.col("src").alias("node")).distinct()
        left = kept


def counted(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df staged, and joined by broadcast if it has few rows; else it is joined like any other."""
    df = staged(df)
    return F.broadcast(df) if df.count() <= most else df


def two_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with the least `place` so far, `first`, and the least one of another owner than that, `second`, by order.

    Where the first one changes its owner, the one before it is less than all others: it is what is left to second."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("first", F.min("place").over(upto)).withColumn("_prior", F.lag("first").over(w))
    left = F.when(F.col("place.owner") != F.col("first.owner"), F.col("place")).when(F.col("_prior.owner") != F.col("first.owner"), F.col("_prior"))
    return df.withColumn("second", F.min(left).over(upto)).drop("_prior")


def conflicts(locks: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """For every asked range the first lock, by start, seq, of another owner that overlaps it, if one of the two writes.

    Ranges are inclusive. Of the locks that end at the asked start or later the first one decides: if it begins after
    the asked end, so do all others. So locks are cut to the first ones of two owners for every end, and those with the
    asked starts to one pass from the last end on: over buckets of `width` first, a few rows each, then in every bucket.
    Neither pairs nor the length of a range matter."""
    of = ["kind", "write", "end"]
    place = F.struct("start", "seq", "owner")
    held = locks.withColumn("write", F.coalesce(F.col("lock_type") == "write", F.lit(False))).dropna(subset=["kind", "owner", "start", "end"])
    first = counted(held.groupBy(*of).agg(F.min(place).alias("place")))
    second = held.join(first.withColumnRenamed("place", "_first"), of).filter(F.col("owner") != F.col("_first.owner")).groupBy(*of).agg(F.min(place).alias("place"))
    bucket = F.floor(F.col("at") / width).alias("bucket")
    # a write meets all locks, a read those that write
    ends = first.unionByName(second).withColumn("any", F.explode(F.when(F.col("write"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    ends = staged(ends.select("kind", "any", F.col("end").alias("at"), "place").withColumn("bucket", bucket))
    want = asked.dropna(subset=["kind", "owner", "start", "end"]).select("ask_id", "kind", F.coalesce(F.col("lock_type") == "write", F.lit(False)).alias("any"), F.col("start").alias("at"), F.col("end").alias("a_end"), F.col("owner").alias("a_owner"))
    starts = staged(want.select("kind", "any", "at").distinct().withColumn("bucket", bucket))
    none = F.lit(None).cast(ends.schema["place"].dataType)

    group = ["kind", "any", "bucket"]
    total = two_first(ends, group, ["at", "place"]).groupBy(*group).agg(F.min("first").alias("first"), F.max_by("second", F.struct("at", "place")).alias("second"))
    total = total.select(*group, F.explode(F.array("first", "second")).alias("place"), F.lit(1).alias("turn")).filter("place IS NOT NULL")
    later = two_first(total.unionByName(starts.select(*group, none.alias("place"), F.lit(0).alias("turn")).distinct()), ["kind", "any"], [F.col("bucket").desc(), "turn", "place"]).filter("turn = 0")
    later = later.select(*group, F.explode(F.array("first", "second")).alias("place")).filter("place IS NOT NULL")

    # in a bucket: what comes from later ones, then from the last end on, an end before the starts equal to it
    rows = later.select(*group, F.lit(None).cast("long").alias("at"), "place", F.lit(0).alias("turn")).unionByName(ends.withColumn("turn", F.lit(0))).unionByName(starts.withColumn("place", none).withColumn("turn", F.lit(1)))
    met = two_first(rows, group, [F.col("at").desc_nulls_first(), "turn", "place"]).filter("turn = 1").select("kind", "any", "at", "first", "second")
    met = want.join(counted(met), ["kind", "any", "at"]).withColumn("m", F.when(F.col("first.owner") != F.col("a_owner"), F.col("first")).otherwise(F.col("second")))
    met = met.filter(F.col("m.start") <= F.col("a_end"))
    return met.groupBy("ask_id").agg(F.min(F.struct("m.start", "m.seq")).alias("m")).select("ask_id", F.col("m.start").alias("start"), F.col("m.seq").alias("seq"))


def reconcile(target: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two result sets (key, status): what is missing on a side, what differs."""
    t, r = target.select(key, F.col("status").alias("t_status")), reference.select(key, F.col("status").alias("r_status"))
    verdict = F.when(F.col("t_status").isNull(), "missing in target").when(F.col("r_status").isNull(), "missing in reference").when(F.col("t_status") != F.col("r_status"), "differs").otherwise("same")
    return t.join(r, key, "full_outer").withColumn("verdict", verdict)


def current_grants(grants: DataFrame, sessions: DataFrame, pending: DataFrame) -> DataFrame:
    """Grants whose holder has a live session and that no pending command revokes."""
    return grants.join(sessions.filter("live"), "holder", "left_semi").join(pending, "root_id", "left_anti")


def located(roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """Roots with where they are: the home session's node, or unavailable where it is absent or over."""
    home = sessions.select(F.col("session_id").alias("home"), "node_id", "live")
    found = roots.join(home, "home", "left")
    return found.withColumn("state", F.when(F.coalesce("live", F.lit(False)), "available").otherwise("unavailable"))


def serving(copies: DataFrame, sessions: DataFrame, chunks: DataFrame, now: int) -> DataFrame:
    """Copies that may be read, with lease_epoch, the epoch they are served under: ready, equal to their chunk in
    length and digest, of a live session no older than they are, on a device of the same epoch that the session
    has had since, or whose catalog has reached theirs."""
    # copies stay where they are by chunk: equality of the digests as a key would have them shuffled with their digests
    same = (F.col("c.chunk_id") == F.col("k.chunk_id")) & (F.col("c.bytes") - F.col("k.length") == 0) & F.col("c.digest").between(F.col("k.digest"), F.col("k.digest"))
    whole = copies.filter("ready AND node_epoch <> 0").alias("c").join(chunks.alias("k"), same, "left_semi")
    met = whole.join(sessions.filter(F.col("lease_ms") > now), "node_id").filter("lease_epoch >= node_epoch")
    device = F.exists("devices", lambda d: (d["device_id"] == F.col("device_id")) & (d["device_epoch"] == F.col("device_epoch")) & ((F.col("lease_epoch") == F.col("node_epoch")) | (d["catalog_revision"] >= F.col("catalog_revision"))))
    return met.filter(device)


def layout_sources(layout: DataFrame, served: DataFrame) -> DataFrame:
    """layout (file, chunk_id) with the nodes that serve each chunk, in order; none is an empty list."""
    listed = served.groupBy("chunk_id").agg(F.sort_array(F.collect_set("node_id")).alias("sources"))
    return layout.join(listed, "chunk_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))


def grants_in_force(shown: DataFrame, held: DataFrame, sessions: DataFrame, pending: DataFrame) -> DataFrame:
    """Grants as shown that equal those held in root, holder, epoch, home, generation and token, whose holder and
    home sessions live, and whose root, epoch and generation no pending command revokes."""
    live = sessions.filter("live")
    same = shown.join(held, ["root_id", "holder", "root_epoch", "home", "generation", "token"], "left_semi")
    both = same.join(live.select(F.col("session").alias("holder")), "holder", "left_semi").join(live.select(F.col("session").alias("home")), "home", "left_semi")
    return both.join(pending, ["root_id", "root_epoch", "generation"], "left_anti")


def judged_batches(entries: DataFrame, copies: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Batches of entries (batch, chunk_id, node_id, expires): denied whole where one entry has no copy or there
    are more than `most`; else granted until the earliest expiry of the grants and the nodes' leases."""
    both = entries.join(copies.withColumn("ok", F.lit(1)), ["chunk_id", "node_id"], "left").join(nodes, "node_id")
    g = both.groupBy("batch").agg(F.count(F.lit(1)).alias("entries"), F.count("ok").alias("good"), F.min(F.least("expires", "lease_ms")).alias("until"))
    outcome = F.when(F.col("entries") > most, "too many").when(F.col("good") < F.col("entries"), "denied").otherwise("granted")
    return g.select("batch", "entries", outcome.alias("outcome"), F.when(outcome == "granted", F.col("until")).alias("expires"))


def suite_differences(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Full outer comparison of results (id, status, errno, reason). A skip on either side is compared by its reason
    first; then error numbers, and the status where none was skipped."""
    t, r = (df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("status", "errno", "reason")]) for df, p in ((target, "t"), (reference, "r")))
    skipped = (F.col("t_status") == "SKIP") | (F.col("r_status") == "SKIP")
    apart = lambda c: ~F.col(f"t_{c}").eqNullSafe(F.col(f"r_{c}"))
    verdict = F.when(F.col("t_status").isNull(), "missing in target").when(F.col("r_status").isNull(), "missing in reference")
    verdict = verdict.when(skipped & (apart("status") | apart("reason")), "skip").when(apart("errno") | (apart("status") & ~skipped), "errno").when(F.col("t_status") == "FAIL", "failed alike").otherwise("same")
    return t.join(r, "id", "full_outer").select("id", verdict.alias("verdict"))


def range_reads(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Byte ranges (ask, chunk_id, offset, length) of chunks (chunk_id, data). All ranges of a chunk meet it in one
    join; where one chunk is asked very often, adaptive execution splits it."""
    end = F.col("offset") + F.col("length")
    size = F.octet_length("data")
    outcome = F.when(F.col("data").isNull(), "missing").when(end > size, "beyond the end").otherwise("read")
    data = F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return asked.join(chunks, "chunk_id", "left").select("ask", "chunk_id", outcome.alias("outcome"), F.when(outcome == "read", F.lower(F.hex(data))).alias("bytes_hex"))


def verified(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records (chunk_id, digest, length) with whether the chunk's bytes agree; a missing chunk is not intact."""
    both = records.join(chunks, "chunk_id", "left")
    intact = (F.sha2("data", 256) == F.col("digest")) & (F.octet_length("data") == F.col("length"))
    return both.select("chunk_id", F.coalesce(intact, F.lit(False)).alias("intact"))


def per_key(df: DataFrame, key: str) -> DataFrame:
    """Rows that share an identity: hard links."""
    return df.withColumn("links", F.count(F.lit(1)).over(Window.partitionBy(key)))
