"""Named queries of the engine over the given tables, each an operator applied to a derived relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import relations as R
from tidemark.functions import posix as P
from tidemark.operators import feed, intervals, joins, lookup, placement, stats
from tidemark.plans import files, rules
from tidemark.session import load
from tidemark.staging import shared_folder
from tidemark.streaming import changes as streams

NOW_MS = 500_000
BOUNDS = [1.0, 5.0, 20.0, 50.0]


def chunk_health(s, d):
    live = stats.live_copies(R.chunks(s, d), R.copies(s, d), R.nodes(s, d))
    return live.select("chunk_id", F.col("live_nodes").alias("live_copies"), stats.health(F.col("live_nodes"), R.DESIRED).alias("health"))


def chunk_health_summary(s, d):
    return chunk_health(s, d).groupBy("health").agg(F.count(F.lit(1)).alias("chunks"), F.sum("live_copies").alias("live_copies"))


def commit_health(s, d):
    return stats.commit_health(R.copies(s, d), 30)


def point_lookup(s, d):
    return R.chunks(s, d).filter("chunk_id = 17")


def directory_scan(s, d):
    return lookup.listing(R.entries(s, d), "n3").select("parent", "name", "inode")


def live_sessions(s, d):
    n = R.nodes(s, d)
    return n.filter(P.live(F.col("lease_ms"), NOW_MS)).select("node_id", "lease_ms").orderBy("node_id")


def scan_revision(s, d):
    return lookup.scan_revision(R.changes(s, d).filter("kind = 'put'"), "revision", 100)


def recovery_scan(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    roots = c.filter("c_nationkey = 7").select(F.lit("root").alias("entity"), F.col("c_custkey").alias("id"))
    held = o.filter("o_orderstatus = 'P'").join(c.filter("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return roots.unionByName(held.select(F.lit("reservation").alias("entity"), F.col("o_orderkey").alias("id")))


def servable_copies(s, d):
    c, n = R.copies(s, d), R.nodes(s, d)
    ok = F.col("ready") & (F.col("epoch") > 0) & P.live(F.col("lease_ms"), NOW_MS) & (F.col("domain") >= F.col("epoch"))
    return c.join(n, "node_id").filter(ok).groupBy("node_id").agg(F.count(F.lit(1)).alias("servable"), F.max("epoch").alias("epoch"))


def claimable_tasks(s, d):
    o = load(s, d, "orders")
    due = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    state = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "P", due >= 0).otherwise(False)
    t = o.withColumn("claimable", state)
    return t.groupBy("o_orderstatus", "claimable").agg(F.count(F.lit(1)).alias("tasks"))


def first_claimable(s, d):
    o = load(s, d, "orders").filter("o_orderstatus = 'P'")
    return lookup.first_of(o.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")])


def read_dir(s, d):
    return joins.read_dir(R.entries(s, d), R.inodes(s, d)).select("parent", "name", "inode", "kind", "mode")


def dangling_entries(s, d):
    files = R.inodes(s, d).filter("uid % 7 <> 3")
    return joins.dangling(R.entries(s, d), files).select("parent", "name", "inode")


def empty_directories(s, d):
    o = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(s, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def name_lookup(s, d):
    e = R.entries(s, d).filter("parent = 'n3'")
    i = R.inodes(s, d)
    return e.join(i, "inode", "left").select("name", "inode", "kind", "uid")


def access_check(s, d):
    i = R.inodes(s, d).filter("kind = 'file'")
    ask = lambda want: P.granted(F.col("mode"), F.col("uid"), F.col("gid"), F.lit(7), F.lit(3), want)
    return i.select("inode", ask(P.READ).alias("may_read"), ask(P.WRITE).alias("may_write"), ask(P.EXECUTE).alias("may_run"))


def mode_rules(s, d):
    i = R.inodes(s, d)
    return i.select("inode", P.without_privilege(F.col("mode")).alias("plain_mode"), P.child_gid(F.col("mode"), F.col("gid"), F.lit(99)).alias("child_gid"), P.deletable(F.lit(0o1777), F.lit(0), F.col("uid"), F.lit(7).cast("long")).alias("deletable"))


def name_rules(s, d):
    return rules_of(load(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("name")))


def rules_of(names):
    return names.select("doc_id", P.valid_name(F.col("name")).alias("valid_name"), P.valid_target(F.col("name")).alias("valid_target"), P.low_hex(F.encode(F.substring("name", 1, 8), "UTF-8")).alias("prefix_hex"))


def error_codes(s, d):
    o = load(s, d, "orders").select((F.lit(0xC0000000) + F.col("o_orderkey") * 65537).alias("code"))
    return o.select("code", P.error_parts(F.col("code")).alias("p")).select("code", "p.*")


def backoff(s, d):
    li = load(s, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct()
    return li.select("attempt", P.backoff_ms(F.col("attempt")).alias("delay_ms"))


def chunk_sources(s, d):
    found = joins.chunk_sources(R.chunks(s, d), R.copies(s, d), R.nodes(s, d))
    return found.select("chunk_id", "length", F.size("sources").alias("n_sources"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def missing_requested(s, d):
    asked = load(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("chunk_id")).distinct()
    held = R.copies(s, d).filter("ready").select("chunk_id")
    return asked.join(held, "chunk_id", "left_anti")


def grant_batches(s, d):
    asked = load(s, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id"))
    ready = R.copies(s, d).filter("ready").select("chunk_id", "node_id", F.lit(1).alias("ok"))
    return asked.join(ready, ["chunk_id", "node_id"], "left").groupBy("batch").agg(F.count(F.lit(1)).alias("grants"), (F.count("ok") == F.count(F.lit(1))).alias("valid"))


def root_locations(s, d):
    o, c = load(s, d, "orders"), load(s, d, "customer")
    roots = o.select(F.col("o_orderkey").alias("root_id"), F.col("o_custkey").alias("home"))
    sessions = c.filter("c_nationkey <> 5").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("node_id"), (F.col("c_acctbal") > 0).alias("live"))
    return joins.located(roots, sessions).groupBy("state").agg(F.count(F.lit(1)).alias("roots"), F.count("node_id").alias("with_node"))


def current_grants(s, d):
    o, c, li = load(s, d, "orders"), load(s, d, "customer"), load(s, d, "lineitem")
    grants = o.select(F.col("o_orderkey").alias("root_id"), F.col("o_custkey").alias("holder"))
    sessions = c.select(F.col("c_custkey").alias("holder"), (F.col("c_acctbal") > 2000).alias("live"))
    pending = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("root_id"))
    return joins.current_grants(grants, sessions, pending).select("root_id", "holder")


def ancestry(s, d):
    return joins.ancestors(R.entries(s, d)).select("inode", "ancestor", "distance")


def waits_for(s, d, o):
    """Wait-for edges between nations of orders o, for the reach of a waiter and cycles."""
    c, li, sp = load(s, d, "customer"), load(s, d, "lineitem"), load(s, d, "supplier")
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(sp, F.col("l_suppkey") == F.col("s_suppkey"))
    return e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def deadlock(s, d):
    return reach_of(waits_for(s, d, load(s, d, "orders")))


def reach_of(edges):
    reach = joins.reachable(edges)
    return reach.groupBy("src").agg(F.count(F.lit(1)).alias("reach"), F.max(F.col("src") == F.col("dst")).alias("deadlocked"))


def lock_conflicts(s, d):
    return conflicts_of(s, d, load(s, d, "orders"))


def conflicts_of(s, d, orders):
    e = load(s, d, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    locks = e.filter("l_returnflag <> 'R'").groupBy(F.col("l_linestatus").alias("kind"), F.col("l_suppkey").alias("owner"), day.alias("start")).agg((F.max(day) + F.max("l_quantity").cast("long")).alias("end"), F.min("l_orderkey").alias("seq"), F.when(F.max("l_linenumber") > 3, "write").otherwise("read").alias("lock_type"))
    asked = orders.select(F.col("o_orderkey").alias("ask_id"), F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("F").alias("kind"), (F.col("o_custkey") % 10).alias("owner"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("start"), F.when(F.col("o_orderpriority").like("1%"), "write").otherwise("read").alias("lock_type"))
    return joins.conflicts(locks, asked.withColumn("end", F.col("start") + 3), 4)


def reconcile_results(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    target = c.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "pass").otherwise("fail").alias("status"))
    reference = o.groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.sum("o_totalprice") > 1_000_000, "pass").otherwise("fail").alias("status"))
    return joins.reconcile(target, reference, "id").select("id", "verdict")


def hard_links(s, d):
    e = load(s, d, "lineitem").select(F.col("l_partkey").alias("inode"), F.col("l_orderkey").alias("dir")).distinct()
    return joins.per_key(e, "inode").filter("links > 40").select("inode", "dir", "links")


def merged_extents(s, d):
    return intervals.coalesced(R.extents(s, d), ["owner"], clip=2000).withColumnRenamed("end", "stop")


def merged_locks(s, d):
    return intervals.coalesced(R.extents(s, d), ["owner"], inclusive=True).withColumnRenamed("end", "stop")


def range_coverage(s, d):
    e = R.extents(s, d)
    asked = e.select("owner", (F.col("start") - 5).alias("start"), (F.col("start") + 40).alias("end")).distinct()
    got = intervals.covered(asked, intervals.coalesced(e, ["owner"]), ["owner"])
    return got.groupBy("owner", "covered").agg(F.count(F.lit(1)).alias("ranges"))


def lock_remainders(s, d):
    return intervals.subtracted(intervals.coalesced(R.extents(s, d), ["owner"], inclusive=True), 900, 1200).withColumnRenamed("end", "stop")


def layout_faults(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("position"), F.floor("value").cast("long").alias("start"))
    return intervals.layout_faults(e.withColumn("end", F.col("start") + F.col("position") % 4), ["owner"], "position").select("owner", "position", "fault")


def inherited_extents(s, d):
    e = load(s, d, "lineitem").select(F.col("l_partkey").alias("chunk_id"), (F.col("l_suppkey") * 10).alias("file_offset"), (F.col("l_suppkey") % 3).alias("chunk_offset"), F.col("l_quantity").cast("long").alias("length"), "l_returnflag").distinct()
    cut = ["chunk_id", "file_offset", "chunk_offset", "length"]
    return intervals.inherited(e.filter("l_returnflag = 'A'").select(*cut), e.filter("l_returnflag = 'R'").select(*cut))


def sparse_files(s, d):
    return intervals.sparse_read(R.extents(s, d), ["owner"], 2600)


def receipts_quorum(s, d):
    return quorum_of(s, d, load(s, d, "lineitem"))


def quorum_of(s, d, lines):
    r = lines.select(F.col("l_orderkey").alias("write_id"), F.col("l_suppkey").alias("node_id")).join(R.nodes(s, d).select("node_id", "domain"), "node_id")
    return stats.quorum(r, ["write_id"], 3, 2)


def counters(s, d):
    return load(s, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def value_histogram(s, d):
    return stats.histogram(load(s, d, "events"), ["event_type"], "value", BOUNDS)


def last_exemplars(s, d):
    return stats.exemplars(load(s, d, "events"), ["event_type"], "value", "ts", "event_id", BOUNDS)


def nearest_rank(s, d):
    return stats.ranked_quantiles(load(s, d, "events"), ["event_type"], "value", [50, 95, 99])


def floor_index(s, d):
    return stats.ranked_quantiles(load(s, d, "events"), ["event_type"], "value", [50, 95, 99], floor=True)


def plain_median(s, d):
    m = stats.interpolated_median(load(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return m.select("l_returnflag", F.round("median", 4).alias("median"))


def stage_summary(s, d):
    li = load(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.array("l_quantity", "l_extendedprice").alias("samples"))
    flat = li.select("l_returnflag", "l_linestatus", F.explode("samples").alias("v"))
    return flat.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("samples"), F.min("v").alias("least"), F.max("v").alias("largest"), F.round(F.sum(F.col("v").cast("decimal(20,4)")), 2).cast("double").alias("total"))


def paired_speed(s, d):
    e = load(s, d, "events").filter("event_type IN ('view', 'click')").groupBy(F.col("user_id").alias("round"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    r = stats.paired_ratios(e, "round", "event_type", "value", "view", "click", 0.9, warm_up=3)
    return r.select("rounds", *[F.round(c, 6).alias(c) for c in ("median", "least", "largest")], "pass")


def improvement(s, d):
    e = load(s, d, "events")
    dec = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value").cast("decimal(18,4)"))).cast("double")
    one = e.agg(dec("view").alias("a"), dec("click").alias("b"))
    return one.select(F.round((F.col("a") - F.col("b")) / F.col("a"), 6).alias("improvement"), (F.col("b") / F.col("a")).between(0.9, 1.1).alias("in_band"))


def session_ratio(s, d):
    q = stats.ranked_quantiles(load(s, d, "events"), ["event_type"], "value", [50])
    one = q.agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("b"))
    return one.select(F.round(F.col("a") / F.col("b"), 6).alias("ratio"), (F.col("a") / F.col("b") <= 0.8).alias("pass"))


def suite_conservation(s, d):
    status = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "skip").when(F.col("event_type") == "signup", "todo").otherwise("running")
    return stats.conservation(load(s, d, "events").withColumn("status", status), ["user_id"], "status")


def scrape_delta(s, d):
    e = load(s, d, "events")
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.delta(count(e.filter("event_id % 3 = 0")), count(e.filter("event_id % 3 = 1")), "user_id", "n")


def tree_digest(s, d):
    e = R.entries(s, d)
    return stats.tree_digest(e, ["parent"], F.concat_ws(":", "name", "inode"))


def cookie_pages(s, d):
    return lookup.page(R.entries(s, d), ["parent"], ["name"], 10, 5).select("parent", "name", "cookie")


def soft_limited_feed(s, d):
    return lookup.soft_limit(R.changes(s, d), 100).select("revision", "event_index", "key", "kind")


def repair_candidates(s, d):
    under = chunk_health(s, d).filter("health = 'UnderReplicated'").select("chunk_id")
    tasks = load(s, d, "lineitem").filter("l_linestatus = 'O' AND l_quantity > 48").select(F.col("l_partkey").alias("chunk_id")).distinct()
    new = under.join(tasks, "chunk_id", "left_anti").select("chunk_id", F.lit("new").alias("origin"))
    return tasks.select("chunk_id", F.lit("task").alias("origin")).unionByName(new)


def first_per_key(s, d):
    return lookup.first_of(load(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")])


def set_difference(s, d):
    return sides_of(s, d)


def sides_of(s, d):
    c, o = load(s, d, "customer").select(F.col("c_custkey").alias("id")), load(s, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return c.exceptAll(o).select("id", F.lit("only listed").alias("side")).unionByName(c.intersect(o).select("id", F.lit("both").alias("side")))


def first_seen_order(s, d):
    return lookup.distinct_in_order(load(s, d, "events"), "user_id", "event_id")


def feed_after(s, d):
    n = R.changes(s, d)
    return feed.for_consumer(n, 50, F.col("key") % 5 == 1).select("revision", "event_index", "key", "kind", "next_revision")


def feed_state(s, d):
    return feed.state(R.changes(s, d).select("key", "revision", "event_index", "kind", "value"))


def request_replays(s, d):
    r = load(s, d, "events").select(F.col("user_id").alias("caller"), F.floor(F.col("event_id") / 200).alias("request"), F.col("event_type").alias("digest"), F.col("event_id").alias("at"))
    return feed.replays(r).groupBy("caller", "outcome").agg(F.count(F.lit(1)).alias("requests"))


def session_epochs(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("session"), F.col("event_id").alias("at"))
    return feed.session_epochs(e, "node", "session", "at").withColumnRenamed("at", "seen_at")


def feed_gaps(s, d):
    return feed.gaps(R.changes(s, d).filter("event_type <> 'view' AND event_type <> 'click'")).select("revision", "before")


def put_delete_counts(s, d):
    return R.changes(s, d).groupBy("kind", "event_index").agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last_revision"))


def preferred_device(s, d):
    li = load(s, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_partkey").alias("device"), F.col("l_linenumber").alias("epoch"))
    return placement.preferred(li, ["node_id"], ["device", "epoch"])


def hash_partitions(s, d):
    return R.chunks(s, d).select("chunk_id", placement.partition_of(F.col("chunk_id").cast("string"), 64).alias("partition"))


def sync_prefixes(s, d):
    plan = R.copies(s, d).join(R.nodes(s, d).select("node_id", "domain"), "node_id")
    return placement.sync_prefix(plan.withColumn("position", F.col("node_id")), ["chunk_id"], "position", 3, 3)


def vectored_read(s, d):
    """Byte ranges of a text, read and put together in order: one request per document."""
    t = load(s, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    cut = [(1, 16), (101, 8), (9, 4)]
    return t.select("doc_id", P.low_hex(F.concat(*[F.substring("data", a, n) for a, n in cut])).alias("bytes_hex"), F.octet_length("data").cast("long").alias("length"))


def chunk_digests(s, d):
    """Content addresses, and which contents are stored more than once."""
    t = load(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("chunk_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return t.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("refs"), F.max("length").alias("length"))


def first_readable(s, d):
    """The first candidate that can be read, of each chunk."""
    c = R.copies(s, d).join(R.nodes(s, d), "node_id").filter("ready AND live")
    return c.groupBy("chunk_id").agg(F.min_by("node_id", F.struct("domain", "node_id")).alias("node_id"))


def capacity(s, d):
    c = R.chunks(s, d).agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("files"))
    return c.select("used", "files", (F.lit(10**9) - F.col("used")).alias("free"))


def stream_dedup(s, d):
    """The events through a stream that keeps each id once."""
    out = streams.deduplicated(streams.source(s, d, "events.parquet"))
    return streams.written(out, shared_folder(s)).select("event_id", "user_id", "event_type", "value")


def stream_session_epochs(s, d):
    """Session epochs kept as a stream's state; the batch form is session_epochs."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return streams.written(streams.session_epochs(streams.source(s, d, "events.parquet")), shared_folder(s))


def stream_hourly_counts(s, d):
    """Counts per hour and type of the windows that the watermark has closed."""
    out = streams.written(streams.windowed(streams.source(s, d, "events.parquet")), shared_folder(s))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


HELPERS = ("waits_for", "rules_of", "reach_of", "conflicts_of", "quorum_of", "sides_of")
QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and k not in HELPERS} | rules.QUERIES | files.QUERIES
