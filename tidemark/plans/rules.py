"""Queries of the serving, grant, lease, repair and placement rules over derived relations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import relations as R
from tidemark.functions import posix as P
from tidemark.operators import feed, intervals, joins, lookup, placement, stats, transactions
from tidemark.session import load

NOW_MS, TTL = 500_000, 400

SESSIONS = """sessions AS (SELECT s_suppkey AS node_id, s_nationkey % 5 + 1 AS lease_epoch, floor(s_acctbal * 100)::BIGINT AS lease_ms, s_nationkey AS domain FROM supplier),
  devices AS (SELECT s_suppkey AS node_id, s_suppkey % 4 AS device_id, s_nationkey % 3 + 1 AS device_epoch, s_nationkey % 7 AS catalog_revision FROM supplier
    UNION ALL SELECT s_suppkey, (s_suppkey + 1) % 4, 1, 6 FROM supplier)"""
STORED = """stored AS (SELECT l_partkey AS chunk_id, l_suppkey AS node_id, max(l_returnflag) = 'A' AS ready, max(l_linenumber) % 6 AS node_epoch, min(l_linenumber) % 4 AS device_id, count(*) % 3 + 1 AS device_epoch, max(l_quantity)::BIGINT % 7 AS catalog_revision,
    CASE WHEN max(l_linenumber) = 7 THEN 1 ELSE 0 END AS lost, CASE WHEN min(l_linenumber) = 5 THEN 'x' ELSE '' END AS altered FROM lineitem GROUP BY ALL),
  parts AS (SELECT p_partkey AS chunk_id, (p_size * 100)::BIGINT AS length, md5(p_partkey::VARCHAR) AS digest FROM part)"""
SERVING = f"""{SESSIONS}, {STORED}, serving AS (SELECT chunk_id, node_id, lease_epoch FROM stored c JOIN sessions s USING (node_id) JOIN parts p USING (chunk_id)
  WHERE ready AND node_epoch <> 0 AND lease_epoch >= node_epoch AND lease_ms > {NOW_MS} AND lost = 0 AND altered = ''
    AND EXISTS (SELECT 1 FROM devices d WHERE d.node_id = c.node_id AND d.device_id = c.device_id AND d.device_epoch = c.device_epoch AND (s.lease_epoch = c.node_epoch OR d.catalog_revision >= c.catalog_revision)))"""


def serving_copies(s, d):
    """Copies that may be read, with the epoch they are served under."""
    return joins.serving(R.stored_copies(s, d), R.sessions(s, d), R.digested_chunks(s, d), NOW_MS).select("chunk_id", "node_id", "lease_epoch")


def file_sources(s, d):
    """Per extent of a file's layout the nodes that serve its chunk; none is an empty list."""
    layout = R.by_chunk(s, load(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("chunk_id")), "chunk_id").distinct()
    found = joins.layout_sources(layout, joins.serving(R.stored_copies(s, d), R.sessions(s, d), R.digested_chunks(s, d), NOW_MS))
    return found.select("file", "chunk_id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def file_versions(s, d):
    """Versions with their layouts; a version without its layout would fail the query."""
    versions = load(s, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("layout_id"), F.col("o_totalprice").cast("long").alias("length"))
    layouts = load(s, d, "customer").select(F.col("c_custkey").alias("layout_id"), F.col("c_nationkey").alias("inode_id"))
    return joins.with_parent(versions, layouts, "layout_id", "layout")


def all_placements(s, d):
    return R.digested_chunks(s, d).select("chunk_id", "length").orderBy("chunk_id")


def all_tasks(s, d):
    return load(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("state")).orderBy("task_id")


def attribute_updates(s, d):
    """Whether user 7 of group 3 may create in, chown, chgrp to 3, chmod, touch and set an attribute of each inode."""
    i, me, mine = R.inodes(s, d), F.lit(7), F.array(F.lit(3))
    own = (F.col("mode"), F.col("uid"), F.col("gid"))
    return i.select(
        "inode", P.may_create(*own, me, mine).alias("may_create"), P.may_chown(F.col("uid"), me, F.col("uid")).alias("may_chown"), P.may_chgrp(F.col("uid"), F.col("gid"), me, mine, F.lit(3)).alias("may_chgrp"),
        P.may_chmod(F.col("uid"), me).alias("may_chmod"), P.may_touch(*own, me, mine, F.lit(True)).alias("may_touch_now"), P.may_touch(*own, me, mine, F.lit(False)).alias("may_touch_at"), P.may_set_xattr(F.col("kind"), *own, me, mine).alias("may_set_xattr"),
    )


def extended_attributes(s, d):
    """Links' targets, one attribute by name, and all names in order."""
    x = R.attributes(s, d)
    return x.select("inode", "target", lookup.xattr("user.segment").alias("segment"), F.array_join(lookup.xattr_names(), ",").alias("names"))


def xattr_rules(s, d):
    names = load(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user."), "event_type")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.repeat(F.lit("user."), 60)).alias("name"))
    return names.select("event_id", P.valid_xattr(F.col("name")).alias("valid"))


def lock_table(s, d):
    """Locks merged by kind, owner and type, with the smallest sequence number of those merged."""
    li = load(s, d, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    locks = li.select(F.col("l_linestatus").alias("kind"), F.col("l_suppkey").alias("owner"), F.when(F.col("l_linenumber") > 3, "write").otherwise("read").alias("lock_type"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.col("l_orderkey").alias("seq"))
    return intervals.coalesced(locks, ["kind", "owner", "lock_type"], inclusive=True, least="seq").withColumnRenamed("end", "stop")


def grant_checks(s, d):
    """Grants that are current: the same root epoch, home, generation and token as presented, both sessions live, no revocation pending."""
    o, c, li = load(s, d, "orders"), load(s, d, "customer"), load(s, d, "lineitem")
    held = o.select(F.col("o_orderkey").alias("root_id"), F.col("o_custkey").alias("holder"), (F.col("o_custkey") % 7).alias("root_epoch"), (F.col("o_orderkey") % 50).alias("home"), (F.col("o_orderkey") % 3).alias("generation"), F.col("o_orderpriority").alias("token"))
    shown = held.withColumn("root_epoch", F.when(F.col("root_id") % 11 == 0, F.col("root_epoch") + 1).otherwise(F.col("root_epoch"))).withColumn("token", F.when(F.col("root_id") % 13 == 0, F.lit("other")).otherwise(F.col("token")))
    sessions = c.select(F.col("c_custkey").alias("session"), (F.col("c_acctbal") > 2000).alias("live"))
    pending = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("root_id"), (F.col("l_linenumber") % 7).cast("long").alias("root_epoch"), (F.col("l_orderkey") % 3).alias("generation")).distinct()
    return joins.grants_in_force(shown, held, sessions, pending).select("root_id", "holder")


def read_batches(s, d):
    """Batches of reads: 1 to 128 entries, all or nothing, with the earliest expiry of those concerned."""
    e = load(s, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("batch"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("node_id"), (F.col("l_extendedprice") * 100).cast("long").alias("expires"))
    copies = R.copies(s, d).filter("ready").select("chunk_id", "node_id")
    return joins.judged_batches(e, copies, R.nodes(s, d).select("node_id", "lease_ms"), 128)


def suite_differences(s, d):
    """Results of a target against a reference, with what differs: status, errno, or what was skipped and why."""
    e = load(s, d, "events")
    status = F.when(F.col("event_type") == "view", "PASS").when(F.col("event_type") == "click", "SKIP").otherwise("FAIL")
    side = lambda r: e.filter(F.col("event_id") % 3 == r).groupBy(F.floor(F.col("event_id") / 6).alias("id")).agg(F.min(status).alias("status"), F.min(F.col("user_id") % 2).alias("errno"), F.min("event_type").alias("reason"))
    return joins.suite_differences(side(0), side(1))


def zero_filled(s, d):
    """Every block of 100 days of every node, with the days an extent holds; the rest reads as zero."""
    return intervals.grid(R.nodes(s, d).select(F.col("node_id").alias("owner")), R.extents(s, d), ["owner"], 3600, 100)


def registrations(s, d):
    """Registrations of sessions: a session that has run out can't renew, and only another session raises the epoch."""
    e = load(s, d, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("session"), F.col("event_id").alias("at"))
    return feed.registrations(e, TTL)


def repair_tasks(s, d):
    """Repair work: unfinished tasks, and placements short of copies without one, a completed task of theirs taken up again."""
    o = load(s, d, "orders").groupBy((F.col("o_custkey") % 3000).alias("chunk_id")).agg(F.min("o_orderstatus").alias("state"), F.count(F.lit(1)).alias("attempt"))
    live = stats.live_copies(R.chunks(s, d), R.copies(s, d), R.nodes(s, d))
    return lookup.repair_work(o, live.filter(F.col("live_nodes") < R.DESIRED).select("chunk_id"), "F")


def replica_groups(s, d):
    g = placement.replica_groups(R.chunks(s, d), R.nodes(s, d), 64, 3)
    return g.select("chunk_id", "partition", F.array_join(F.transform("replicas", lambda x: x.cast("string")), ",").alias("replicas"))


def replica_batches(s, d):
    return placement.by_plan(replica_groups(s, d))


def placement_snapshot(s, d):
    """Live nodes with their preferred device, and the groups that each would head."""
    return placement.headed_groups(R.sessions(s, d).filter(P.live(F.col("lease_ms"), NOW_MS)), 3, 2)


def range_reads(s, d):
    """Ranges of chunks, as bytes; a range beyond its chunk's end is told apart."""
    asked = load(s, d, "events").select(F.col("event_id").alias("ask"), F.col("user_id").alias("chunk_id"), (F.col("event_id") % 4000).alias("offset"), (F.col("event_id") % 16 + 1).alias("length"))
    return joins.range_reads(R.contents(s, d), asked)


def verified_chunks(s, d):
    """Chunks whose bytes have the digest that their record says."""
    c = R.contents(s, d)
    said = c.select("chunk_id", F.when(F.col("chunk_id") % 10 == 3, F.lit("0" * 64)).otherwise(F.sha2("data", 256)).alias("digest"), F.octet_length("data").cast("long").alias("length"))
    return joins.verified(said, c)


def field_hashes(s, d):
    return R.nodes(s, d).select("node_id", P.field_hash(P.hash_string(F.col("node_id").cast("string")), P.hash_long(F.col("domain").cast("long"))).cast("string").alias("hash"))


def saturated(s, d):
    """Unsigned 64-bit sums that stay at the top, and whether a checked sum would fail."""
    top = load(s, d, "events").select("event_id", (F.lit("18446744073709546615").cast("decimal(20,0)") + F.col("event_id")).alias("x"))
    return top.select("event_id", P.saturating_add(F.col("x"), F.lit(10).cast("decimal(38,0)")).cast("string").alias("sum"), P.overflows(F.col("x"), F.lit(10).cast("decimal(38,0)")).alias("overflows"))


def conditional_transactions(s, d):
    """Requests with the conditions they are under, all of which must hold in the state of the log before them."""
    state = feed.state(R.changes(s, d)).select(F.col("key"), "revision", F.col("value").cast("string").alias("value"))
    e = load(s, d, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 160).alias("key"), (F.col("o_orderkey") % 3400).alias("revision"), (F.col("o_custkey") % 1500).alias("session"))
    want = transactions.conditions(e)
    done = load(s, d, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("request"))
    live = load(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session"))
    return transactions.judged(e.select("request"), want, state, done, live)


GROUPS = """live AS (SELECT s_suppkey AS node_id, s_nationkey AS domain, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 7000),
  turned AS (SELECT p, node_id, domain, (r - p % n + n) % n AS pos FROM live, (SELECT unnest(range(64)) AS p)),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY p, domain ORDER BY pos) > 1 AS again FROM turned),
  placed AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY again, pos) AS k FROM firsts),
  chosen AS (SELECT p AS partition, string_agg(node_id::VARCHAR, ',' ORDER BY k) AS replicas FROM placed WHERE k <= 3 GROUP BY p),
  h AS (SELECT p_partkey AS chunk_id, p_partkey::VARCHAR AS s, 1 AS i, 14695981039346656037::UHUGEINT AS h FROM part
    UNION ALL SELECT chunk_id, s, i + 1, (xor(h, ascii(substr(s, i, 1))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM h WHERE i <= length(s)),
  groups AS (SELECT chunk_id, partition, replicas FROM (SELECT chunk_id, (h % 64)::BIGINT AS partition FROM h WHERE i = length(s) + 1) JOIN chosen USING (partition))"""
INODES = """inodes AS (SELECT 'r' || r_regionkey AS inode, 'dir' AS kind, 493 AS mode, 0::BIGINT AS uid, 0 AS gid FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'dir', 1533, 0, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'file', (c_custkey * 37 % 4096)::INT, c_custkey % 50, c_nationkey FROM customer)"""

ORACLES = {
    "serving_copies": f"WITH {SERVING} SELECT chunk_id, node_id, lease_epoch FROM serving",
    "file_sources": f"""WITH {SERVING}, layout AS (SELECT DISTINCT l_orderkey AS file, l_partkey AS chunk_id FROM lineitem), l AS (SELECT chunk_id, array_to_string(list_sort(list(node_id)), ',') AS s FROM serving GROUP BY chunk_id)
      SELECT file, chunk_id, coalesce(s, '') AS sources FROM layout LEFT JOIN l USING (chunk_id)""",
    "file_versions": "SELECT o_orderkey AS version_id, o_custkey AS layout_id, trunc(o_totalprice)::BIGINT AS length, c_nationkey AS inode_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "all_placements": "SELECT p_partkey AS chunk_id, (p_size * 100)::BIGINT AS length FROM part",
    "all_tasks": "SELECT o_orderkey AS task_id, o_orderstatus AS state FROM orders",
    "attribute_updates": f"""WITH {INODES}, b AS (SELECT *, CASE WHEN uid = 7 THEN mode >> 6 WHEN gid = 3 THEN mode >> 3 ELSE mode END AS bits FROM inodes)
      SELECT inode, (bits & 3) = 3 AS may_create, uid = 7 AS may_chown, uid = 7 AS may_chgrp, uid = 7 AS may_chmod, uid = 7 OR (bits & 2) = 2 AS may_touch_now, uid = 7 AS may_touch_at,
        kind IN ('file', 'dir') AND NOT (kind = 'dir' AND (mode & 512) <> 0 AND uid <> 7) AND (bits & 2) = 2 AS may_set_xattr FROM b""",
    "extended_attributes": """SELECT 'c' || c_custkey AS inode, CASE WHEN c_custkey % 10 = 0 THEN '/' || c_name END AS target, c_mktsegment AS segment,
      CASE WHEN c_custkey % 2 = 0 THEN 'user.nation,user.segment' ELSE 'user.segment' END AS names FROM customer""",
    "xattr_rules": "SELECT event_id, event_id % 3 = 0 AS valid FROM events",
    "lock_table": """WITH l AS (SELECT l_linestatus AS kind, l_suppkey AS owner, CASE WHEN l_linenumber > 3 THEN 'write' ELSE 'read' END AS lock_type, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS b, l_orderkey AS seq FROM lineitem),
      m AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY kind, owner, lock_type ORDER BY a, b, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a - 1 THEN 0 ELSE 1 END AS fresh FROM l),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, owner, lock_type ORDER BY a, b, seq ROWS UNBOUNDED PRECEDING) AS island FROM m)
      SELECT kind, owner, lock_type, min(a) AS start, max(b) AS stop, min(seq) AS seq FROM i GROUP BY kind, owner, lock_type, island""",
    "grant_checks": """SELECT o_orderkey AS root_id, o_custkey AS holder FROM orders o JOIN customer h ON o_custkey = h.c_custkey JOIN customer r ON o_orderkey % 50 = r.c_custkey
      WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND h.c_acctbal > 2000 AND r.c_acctbal > 2000
        AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey AND l_linenumber % 7 = o_custkey % 7)""",
    "read_batches": """WITH e AS (SELECT l_orderkey % 2000 AS batch, l_partkey AS chunk_id, l_suppkey AS node_id, trunc(l_extendedprice * 100)::BIGINT AS expires FROM lineitem),
      c AS (SELECT l_partkey AS chunk_id, l_suppkey AS node_id FROM lineitem GROUP BY ALL HAVING max(l_returnflag) = 'A')
      SELECT batch, count(*) AS entries, CASE WHEN count(*) > 128 THEN 'too many' WHEN count(c.chunk_id) < count(*) THEN 'denied' ELSE 'granted' END AS outcome,
        CASE WHEN count(*) <= 128 AND count(c.chunk_id) = count(*) THEN min(least(expires, floor(s_acctbal * 100)::BIGINT)) END AS expires
      FROM e LEFT JOIN c ON e.chunk_id = c.chunk_id AND e.node_id = c.node_id JOIN supplier ON e.node_id = s_suppkey GROUP BY batch""",
    "suite_differences": """WITH e AS (SELECT event_id, event_id // 6 AS id, CASE event_type WHEN 'view' THEN 'PASS' WHEN 'click' THEN 'SKIP' ELSE 'FAIL' END AS status, user_id % 2 AS errno, event_type AS reason FROM events),
      t AS (SELECT id, min(status) AS status, min(errno) AS errno, min(reason) AS reason FROM e WHERE event_id % 3 = 0 GROUP BY id), r AS (SELECT id, min(status) AS status, min(errno) AS errno, min(reason) AS reason FROM e WHERE event_id % 3 = 1 GROUP BY id)
      SELECT id, CASE WHEN t.status IS NULL THEN 'missing in target' WHEN r.status IS NULL THEN 'missing in reference'
        WHEN (t.status = 'SKIP' OR r.status = 'SKIP') AND (t.status <> r.status OR t.reason <> r.reason) THEN 'skip' WHEN t.errno <> r.errno OR (t.status <> r.status AND t.status <> 'SKIP' AND r.status <> 'SKIP') THEN 'errno'
        WHEN t.status = 'FAIL' THEN 'failed alike' ELSE 'same' END AS verdict FROM t FULL JOIN r USING (id)""",
    "zero_filled": """WITH days AS (SELECT DISTINCT l_suppkey AS owner, unnest(range(greatest(0, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)), least(3600, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT))) AS day FROM lineitem),
      held AS (SELECT owner, day // 100 AS block, count(*) AS n FROM days GROUP BY ALL), g AS (SELECT s_suppkey AS owner, unnest(range(36)) AS block FROM supplier)
      SELECT owner, block, coalesce(n, 0)::BIGINT AS held, (100 - coalesce(n, 0))::BIGINT AS zero FROM g LEFT JOIN held USING (owner, block)""",
    "registrations": f"""WITH l AS (SELECT user_id AS node, event_type AS session, event_id AS at_, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) >= {TTL} AS late FROM events),
      a AS (SELECT *, coalesce(bool_or(late) OVER (PARTITION BY node, session ORDER BY at_), false) AS refused FROM l),
      f AS (SELECT *, CASE WHEN lag(session) OVER (PARTITION BY node ORDER BY at_) IS NOT DISTINCT FROM session THEN 0 ELSE 1 END AS fresh FROM a WHERE NOT refused)
      SELECT node, session, at_ AS seen_at, 'accepted' AS outcome, (sum(fresh) OVER (PARTITION BY node ORDER BY at_))::BIGINT AS epoch FROM f UNION ALL SELECT node, session, at_, 'expired', NULL FROM a WHERE refused""",
    "repair_tasks": """WITH t AS (SELECT o_custkey % 3000 AS chunk_id, min(o_orderstatus) AS state, count(*) AS attempt FROM orders GROUP BY 1),
      c AS (SELECT l_partkey AS chunk_id, l_suppkey AS node_id FROM lineitem GROUP BY ALL HAVING max(l_returnflag) = 'A'), n AS (SELECT chunk_id, count(*) AS n FROM c JOIN supplier ON node_id = s_suppkey WHERE s_acctbal > 7000 GROUP BY 1),
      short AS (SELECT p_partkey AS chunk_id FROM part LEFT JOIN n ON p_partkey = chunk_id WHERE coalesce(n, 0) < 3)
      SELECT chunk_id, CASE WHEN t.state <> 'F' THEN 'unfinished' WHEN t.state = 'F' THEN 'reactivated' ELSE 'new' END AS origin, coalesce(attempt, 0)::BIGINT AS attempt
      FROM t FULL JOIN short s USING (chunk_id) WHERE t.state <> 'F' OR s.chunk_id IS NOT NULL""",
    "replica_groups": f"WITH RECURSIVE {GROUPS} SELECT * FROM groups",
    "replica_batches": f"WITH RECURSIVE {GROUPS} SELECT replicas, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM groups GROUP BY replicas",
    "placement_snapshot": f"""WITH {SESSIONS}, t AS (SELECT node_id, device_id, domain FROM (SELECT s.node_id, d.device_id, s.domain, row_number() OVER (PARTITION BY s.node_id ORDER BY d.device_id, d.device_epoch) AS k FROM sessions s JOIN devices d USING (node_id) WHERE lease_ms > {NOW_MS}) WHERE k = 1),
      r AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS r, count(*) OVER () AS n FROM t),
      near AS (SELECT h.node_id AS head, h.device_id, h.domain AS hd, c.node_id, c.domain, (c.r - h.r + h.n) % h.n AS pos FROM r h JOIN r c ON h.node_id <> c.node_id),
      f AS (SELECT *, domain = hd OR row_number() OVER (PARTITION BY head, domain ORDER BY pos) > 1 AS again FROM near), k AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY again, pos) AS k FROM f),
      g AS (SELECT head, device_id, head::VARCHAR || ',' || string_agg(node_id::VARCHAR, ',' ORDER BY k) AS replicas, 1 + count(DISTINCT domain) FILTER (domain <> hd) AS domains FROM k WHERE k < 3 GROUP BY head, device_id, hd)
      SELECT head AS node_id, device_id, replicas, domains FROM g WHERE domains >= 2""",
    "range_reads": """WITH a AS (SELECT event_id AS ask, user_id AS chunk_id, event_id % 4000 AS o, event_id % 16 + 1 AS n FROM events), c AS (SELECT doc_id AS chunk_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
      SELECT ask, chunk_id, CASE WHEN h IS NULL THEN 'missing' WHEN o + n > length(h) // 2 THEN 'beyond the end' ELSE 'read' END AS outcome, CASE WHEN o + n <= length(h) // 2 THEN lower(substr(h, 2 * o + 1, 2 * n)) END AS bytes_hex FROM a LEFT JOIN c USING (chunk_id)""",
    "verified_chunks": "SELECT doc_id AS chunk_id, doc_id % 10 <> 3 AS intact FROM documents",
    "field_hashes": """WITH RECURSIVE n AS (SELECT s_suppkey AS node_id, hex(s_suppkey::VARCHAR) || 'FF' || lpad(hex(s_nationkey), 2, '0') || '00000000000000' AS b FROM supplier),
      h AS (SELECT node_id, b, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM n
        UNION ALL SELECT node_id, b, i + 1, (xor(h, ('0x' || substr(b, 2 * i + 1, 2))::INT::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM h WHERE 2 * i < length(b))
      SELECT node_id, CASE WHEN h = 0 THEN '1' ELSE h::VARCHAR END AS hash FROM h WHERE 2 * i = length(b)""",
    "saturated": """WITH x AS (SELECT event_id, 18446744073709546615::HUGEINT + event_id AS x FROM events) SELECT event_id, least(x + 10, 18446744073709551615::HUGEINT)::VARCHAR AS sum, x + 10 > 18446744073709551615::HUGEINT AS overflows FROM x""",
    "conditional_transactions": """WITH changes AS (SELECT event_id // 3 AS revision, event_id % 3 AS event_index, user_id AS key, event_type, value FROM events),
      state AS (SELECT key, revision FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC, event_index DESC) AS k FROM changes) WHERE k = 1 AND event_type <> 'error'),
      r AS (SELECT o_orderkey AS request, o_custkey % 160 AS key, o_orderkey % 3400 AS revision, o_custkey % 1500 AS session FROM orders)
      SELECT r.request, CASE WHEN d.request IS NOT NULL THEN 'request seen' WHEN r.request % 3 = 0 AND s.key IS NOT NULL THEN 'missing' WHEN r.request % 3 = 1 AND s.revision IS DISTINCT FROM r.revision THEN 'revision' WHEN r.request % 2 = 0 AND c.c_custkey IS NULL THEN 'session' ELSE 'commit' END AS outcome
      FROM r LEFT JOIN state s ON r.key = s.key LEFT JOIN (SELECT event_id AS request FROM events WHERE event_type = 'signup') d ON r.request = d.request LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON r.session = c.c_custkey""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
