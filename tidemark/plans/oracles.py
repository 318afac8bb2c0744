"""DuckDB SQL of the queries, over the same tables."""

from tidemark.plans import files, rules

NODES = "nodes AS (SELECT s_suppkey AS node_id, s_nationkey AS domain, s_acctbal > 7000 AS live, floor(s_acctbal * 100)::BIGINT AS lease_ms FROM supplier)"
CHUNKS = "chunks AS (SELECT p_partkey AS chunk_id, (p_size * 100)::BIGINT AS length FROM part)"
COPIES = "copies AS (SELECT l_partkey AS chunk_id, l_suppkey AS node_id, max(l_returnflag) = 'A' AS ready, max(l_linenumber)::BIGINT AS epoch FROM lineitem GROUP BY ALL)"
EXTENTS = "extents AS (SELECT l_suppkey AS owner, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS b FROM lineitem)"
ENTRIES = """entries AS (SELECT 'root' AS parent, r_name AS name, 'r' || r_regionkey AS inode FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_name, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey FROM customer)"""
INODES = """inodes AS (SELECT 'r' || r_regionkey AS inode, 'dir' AS kind, 493 AS mode, 0::BIGINT AS uid, 0 AS gid FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'dir', 1533, 0, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'file', (c_custkey * 37 % 4096)::INT, c_custkey % 50, c_nationkey FROM customer)"""
CHANGES = "changes AS (SELECT event_id // 3 AS revision, event_id % 3 AS event_index, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, value, ts, event_type FROM events)"
LIVE = f"""{NODES}, {CHUNKS}, {COPIES}, counted AS (SELECT chunk_id, count(DISTINCT node_id) AS n FROM copies JOIN nodes USING (node_id) WHERE ready AND live GROUP BY ALL),
  health AS (SELECT chunk_id, coalesce(n, 0) AS live_copies, CASE WHEN coalesce(n, 0) = 0 THEN 'BlockedNoSource' WHEN n < 3 THEN 'UnderReplicated' ELSE 'Satisfied' END AS health FROM chunks LEFT JOIN counted USING (chunk_id))"""


def merged(relation: str, keys: str, inclusive: bool, clip: str = "") -> str:
    """CTE `merged` (keys, a, b) of the ranges (a, b) of a relation."""
    b = f"least(b, {clip})" if clip else "b"
    apart, empty = ("a - 1 > before", "a <= b") if inclusive else ("a > before", "a < b")
    return f"""cut AS (SELECT {keys}, a, {b} AS b FROM {relation}),
  marked AS (SELECT *, CASE WHEN before IS NULL OR {apart} THEN 1 ELSE 0 END AS fresh FROM (
    SELECT *, max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut WHERE {empty})),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked),
  merged AS (SELECT {keys}, min(a) AS a, max(b) AS b FROM islands GROUP BY {keys}, island)"""


def closure(edges: str) -> str:
    """Recursive CTE `reach` (src, dst) of edges (src, dst)."""
    return f"reach AS ({edges} UNION SELECT r.src, e.dst FROM reach r JOIN ({edges}) e ON r.dst = e.src)"


WAITS = """SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
  JOIN supplier ON l_suppkey = s_suppkey"""


def rank(expression: str) -> str:
    return f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
  p AS (SELECT unnest([50, 95, 99]) AS p) SELECT event_type, p, value FROM r, p WHERE i = {expression}"""


def le(bound: float | None) -> str:
    return f"SELECT event_type, '{bound if bound else '+Inf'}' AS le, count(*) FILTER (value <= {bound or 1e300}) AS n FROM events GROUP BY event_type"


ORACLES = {
    "chunk_health": f"WITH {LIVE} SELECT chunk_id, live_copies, health FROM health",
    "chunk_health_summary": f"WITH {LIVE} SELECT health, count(*) AS chunks, sum(live_copies)::BIGINT AS live_copies FROM health GROUP BY health",
    "commit_health": f"WITH {COPIES} SELECT chunk_id, count(*) AS copies, CASE WHEN count(*) = 0 THEN 'BlockedNoSource' WHEN count(*) < 30 THEN 'UnderReplicated' ELSE 'Satisfied' END AS state FROM copies GROUP BY chunk_id",
    "point_lookup": f"WITH {CHUNKS} SELECT * FROM chunks WHERE chunk_id = 17",
    "directory_scan": f"WITH {ENTRIES} SELECT parent, name, inode FROM entries WHERE parent = 'n3'",
    "live_sessions": f"WITH {NODES} SELECT node_id, lease_ms FROM nodes WHERE lease_ms > 500000",
    "scan_revision": f"WITH {CHANGES} SELECT greatest(100, coalesce(max(revision), 0)) AS revision FROM changes WHERE kind = 'put'",
    "recovery_scan": """SELECT 'root' AS entity, c_custkey AS id FROM customer WHERE c_nationkey = 7
      UNION ALL SELECT 'reservation', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""",
    "servable_copies": f"WITH {NODES}, {COPIES} SELECT node_id, count(*) AS servable, max(epoch) AS epoch FROM copies JOIN nodes USING (node_id) WHERE ready AND epoch > 0 AND lease_ms > 500000 AND domain >= epoch GROUP BY node_id",
    "claimable_tasks": """SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'P' THEN o_orderdate::DATE <= DATE '1998-01-01' ELSE false END AS claimable, count(*) AS tasks
      FROM orders GROUP BY ALL""",
    "first_claimable": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "read_dir": f"WITH {ENTRIES}, {INODES} SELECT parent, name, inode, kind, mode FROM entries JOIN inodes USING (inode)",
    "dangling_entries": f"WITH {ENTRIES}, {INODES} SELECT * FROM entries WHERE inode NOT IN (SELECT inode FROM inodes WHERE uid % 7 <> 3)",
    "empty_directories": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "name_lookup": f"WITH {ENTRIES}, {INODES} SELECT name, inode, kind, uid FROM entries LEFT JOIN inodes USING (inode) WHERE parent = 'n3'",
    "access_check": f"""WITH {INODES}, b AS (SELECT inode, CASE WHEN uid = 7 THEN mode >> 6 WHEN gid = 3 THEN mode >> 3 ELSE mode END AS bits FROM inodes WHERE kind = 'file')
      SELECT inode, (bits & 4) = 4 AS may_read, (bits & 2) = 2 AS may_write, (bits & 1) = 1 AS may_run FROM b""",
    "mode_rules": f"""WITH {INODES} SELECT inode, CASE WHEN (mode & 8) <> 0 THEN mode & ~2048 & ~1024 ELSE mode & ~2048 END AS plain_mode,
      CASE WHEN (mode & 1024) <> 0 THEN gid ELSE 99 END AS child_gid, uid = 7 AS deletable FROM inodes""",
    "name_rules": """WITH n AS (SELECT doc_id, coalesce(text, '') AS name FROM documents)
      SELECT doc_id, strlen(name) BETWEEN 1 AND 255 AND name NOT IN ('.', '..') AND NOT contains(name, '/') AS valid_name, strlen(name) BETWEEN 1 AND 4096 AS valid_target,
             lower(hex(substr(name, 1, 8)::BLOB)) AS prefix_hex FROM n""".replace("hex(substr(name, 1, 8)::BLOB)", "hex(encode(substr(name, 1, 8)))"),
    "error_codes": """WITH c AS (SELECT 3221225472 + o_orderkey * 65537 AS code FROM orders)
      SELECT code, (code >> 24) & 255 AS class, (code >> 16) & 255 AS subsystem, code & 65535 AS reason FROM c""",
    "backoff": "SELECT DISTINCT l_linenumber AS attempt, (1000 * 2 ** least(l_linenumber, 6))::BIGINT AS delay_ms FROM lineitem",
    "chunk_sources": f"""WITH {NODES}, {CHUNKS}, {COPIES}, l AS (SELECT chunk_id, list_sort(list(DISTINCT node_id)) AS s FROM copies JOIN nodes USING (node_id) WHERE ready AND live GROUP BY chunk_id)
      SELECT chunk_id, length, coalesce(len(s), 0)::INT AS n_sources, coalesce(array_to_string(s, ','), '') AS sources FROM chunks LEFT JOIN l USING (chunk_id)""",
    "missing_requested": f"WITH {COPIES} SELECT DISTINCT l_partkey AS chunk_id FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT chunk_id FROM copies WHERE ready)",
    "grant_batches": f"""WITH {COPIES} SELECT l_orderkey AS batch, count(*) AS grants, bool_and(ready) AS valid FROM lineitem JOIN copies ON chunk_id = l_partkey AND node_id = l_suppkey GROUP BY l_orderkey""",
    "root_locations": """SELECT CASE WHEN c_acctbal > 0 THEN 'available' ELSE 'unavailable' END AS state, count(*) AS roots, count(c_nationkey) AS with_node
      FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 5) ON o_custkey = c_custkey GROUP BY ALL""",
    "current_grants": """SELECT o_orderkey AS root_id, o_custkey AS holder FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 2000
      AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "ancestry": f"""WITH RECURSIVE {ENTRIES}, up AS (SELECT inode, inode AS ancestor, 0 AS distance FROM entries
      UNION ALL SELECT up.inode, e.parent, up.distance + 1 FROM up JOIN entries e ON up.ancestor = e.inode)
      SELECT inode, ancestor, min(distance) AS distance FROM up GROUP BY ALL""",
    "deadlock": f"WITH RECURSIVE {closure(WAITS)} SELECT src, count(*) AS reach, bool_or(src = dst) AS deadlocked FROM reach GROUP BY src",
    "lock_conflicts": """WITH locks AS (SELECT l_linestatus AS kind, l_suppkey AS owner, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', max(l_shipdate)::DATE) + max(l_quantity)::BIGINT AS b,
        min(l_orderkey) AS seq, CASE WHEN max(l_linenumber) > 3 THEN 'write' ELSE 'read' END AS t FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_linestatus, l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)),
      asked AS (SELECT o_orderkey AS ask_id, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS kind, o_custkey % 10 AS owner, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, CASE WHEN o_orderpriority LIKE '1%' THEN 'write' ELSE 'read' END AS t FROM orders),
      met AS (SELECT ask_id, l.a AS start, seq FROM asked q JOIN locks l ON q.kind = l.kind AND q.owner <> l.owner AND l.a <= q.a + 3 AND l.b >= q.a AND (l.t = 'write' OR q.t = 'write'))
      SELECT ask_id, start, seq FROM met QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY start, seq) = 1""",
    "reconcile_results": """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'fail' END AS status FROM customer WHERE c_custkey % 10 <> 3),
      r AS (SELECT o_custkey AS id, CASE WHEN sum(o_totalprice) > 1000000 THEN 'pass' ELSE 'fail' END AS status FROM orders GROUP BY ALL)
      SELECT id, CASE WHEN t.status IS NULL THEN 'missing in target' WHEN r.status IS NULL THEN 'missing in reference' WHEN t.status <> r.status THEN 'differs' ELSE 'same' END AS verdict FROM t FULL JOIN r USING (id)""",
    "hard_links": """WITH e AS (SELECT DISTINCT l_partkey AS inode, l_orderkey AS dir FROM lineitem) SELECT inode, dir, count(*) OVER (PARTITION BY inode) AS links FROM e QUALIFY links > 40""",
    "merged_extents": f"WITH {EXTENTS}, {merged('extents', 'owner', False, '2000')} SELECT owner, a AS start, b AS stop FROM merged",
    "merged_locks": f"WITH {EXTENTS}, {merged('extents', 'owner', True)} SELECT owner, a AS start, b AS stop FROM merged",
    "range_coverage": f"""WITH {EXTENTS}, {merged('extents', 'owner', False)}, asked AS (SELECT DISTINCT owner, a - 5 AS x, a + 40 AS y FROM extents)
      SELECT owner, EXISTS (SELECT 1 FROM merged m WHERE m.owner = q.owner AND m.a <= q.x AND m.b >= q.y) AS covered, count(*) AS ranges FROM asked q GROUP BY ALL""",
    "lock_remainders": f"""WITH {EXTENTS}, {merged('extents', 'owner', True)}, c AS (SELECT owner, a, least(b, 899) AS b FROM merged WHERE a < 900 UNION ALL SELECT owner, greatest(a, 1201), b FROM merged WHERE b > 1200)
      SELECT owner, a AS start, b AS stop FROM c WHERE a <= b""",
    "layout_faults": """WITH e AS (SELECT user_id AS owner, event_id AS position, floor(value)::BIGINT AS a, floor(value)::BIGINT + event_id % 4 AS b FROM events),
      l AS (SELECT *, lag(b) OVER (PARTITION BY owner ORDER BY position) AS before FROM e)
      SELECT owner, position, CASE WHEN b <= a THEN 'empty' ELSE 'overlap or disorder' END AS fault FROM l WHERE b <= a OR a < before""",
    "inherited_extents": """WITH e AS (SELECT DISTINCT l_partkey AS chunk_id, l_suppkey * 10 AS file_offset, l_suppkey % 3 AS chunk_offset, l_quantity::BIGINT AS length, l_returnflag FROM lineitem)
      SELECT chunk_id, file_offset, chunk_offset, length FROM e n WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM e o WHERE o.l_returnflag = 'R' AND o.chunk_id = n.chunk_id
        AND o.file_offset - o.chunk_offset = n.file_offset - n.chunk_offset AND o.file_offset <= n.file_offset AND n.file_offset + n.length <= o.file_offset + o.length)""",
    "sparse_files": f"WITH {EXTENTS}, {merged('extents', 'owner', False, '2600')} SELECT owner, sum(b - greatest(a, 0))::BIGINT AS held, (2600 - sum(b - greatest(a, 0)))::BIGINT AS zero FROM merged GROUP BY owner",
    "receipts_quorum": """SELECT l_orderkey AS write_id, count(*) AS receipts, count(DISTINCT s_suppkey) AS n_nodes, count(DISTINCT s_nationkey) AS n_domains,
      count(DISTINCT s_suppkey) >= 3 AND count(DISTINCT s_nationkey) >= 2 AND count(*) = count(DISTINCT s_suppkey) AS met FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey""",
    "counters": "SELECT event_type, user_id % 2 AS shard, count(*) AS n FROM events GROUP BY ALL",
    "value_histogram": " UNION ALL ".join(map(le, [1.0, 5.0, 20.0, 50.0, None])),
    "last_exemplars": """WITH b AS (SELECT *, CASE WHEN value <= 1 THEN '1.0' WHEN value <= 5 THEN '5.0' WHEN value <= 20 THEN '20.0' WHEN value <= 50 THEN '50.0' ELSE '+Inf' END AS le FROM events)
      SELECT event_type, le, event_id AS exemplar, value FROM b QUALIFY row_number() OVER (PARTITION BY event_type, le ORDER BY ts DESC, event_id DESC) = 1""",
    "nearest_rank": rank("greatest(ceil(n * p / 100), 1) - 1"),
    "floor_index": rank("least(n * p // 100, n - 1)"),
    "plain_median": "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag",
    "stage_summary": """WITH f AS (SELECT l_returnflag, l_linestatus, unnest([l_quantity, l_extendedprice]) AS v FROM lineitem)
      SELECT l_returnflag, l_linestatus, count(*) AS samples, min(v) AS least, max(v) AS largest, round(sum(v::DECIMAL(20, 4)), 2)::DOUBLE AS total FROM f GROUP BY ALL""",
    "paired_speed": """WITH s AS (SELECT user_id, sum(value::DECIMAL(18, 4)) FILTER (event_type = 'view') AS x, sum(value::DECIMAL(18, 4)) FILTER (event_type = 'click') AS y FROM events GROUP BY ALL),
      r AS (SELECT x::DOUBLE / y::DOUBLE AS r FROM s WHERE x IS NOT NULL AND y > 0 AND user_id >= 3)
      SELECT count(*) AS rounds, round(median(r), 6) AS median, round(min(r), 6) AS least, round(max(r), 6) AS largest, median(r) >= 0.9 AS pass FROM r""",
    "improvement": """WITH s AS (SELECT (sum(value::DECIMAL(18, 4)) FILTER (event_type = 'view'))::DOUBLE AS a, (sum(value::DECIMAL(18, 4)) FILTER (event_type = 'click'))::DOUBLE AS b FROM events)
      SELECT round((a - b) / a, 6) AS improvement, b / a BETWEEN 0.9 AND 1.1 AS in_band FROM s""",
    "session_ratio": f"WITH q AS ({rank('greatest(ceil(n * p / 100), 1) - 1')}), s AS (SELECT max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'purchase') AS b FROM q WHERE p = 50) SELECT round(a / b, 6) AS ratio, a / b <= 0.8 AS pass FROM s",
    "suite_conservation": """WITH c AS (SELECT user_id, count(*) AS discovered, count(*) FILTER (event_type = 'view') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS skipped,
        count(*) FILTER (event_type = 'signup') AS todo, count(*) FILTER (event_type = 'purchase') AS incomplete FROM events GROUP BY user_id)
      SELECT *, CASE WHEN incomplete > 0 THEN 'incomplete' WHEN failed > 0 THEN 'failed' ELSE 'passed' END AS verdict FROM c""",
    "scrape_delta": """WITH c AS (SELECT user_id, count(*) FILTER (event_id % 3 = 1) - count(*) FILTER (event_id % 3 = 0) AS delta FROM events GROUP BY user_id) SELECT * FROM c WHERE delta <> 0""",
    "tree_digest": f"WITH {ENTRIES}, l AS (SELECT parent, name || ':' || inode AS line FROM entries), b AS (SELECT parent, substr(sha256(line), 1, 2) AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY ALL) SELECT parent, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY parent",
    "cookie_pages": f"WITH {ENTRIES}, r AS (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY name) AS cookie FROM entries) SELECT * FROM r WHERE cookie BETWEEN 11 AND 15",
    "soft_limited_feed": f"WITH {CHANGES}, r AS (SELECT *, rank() OVER (ORDER BY revision) AS k FROM changes) SELECT revision, event_index, key, kind FROM r WHERE k <= 100",
    "repair_candidates": f"""WITH {LIVE}, tasks AS (SELECT DISTINCT l_partkey AS chunk_id FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48)
      SELECT chunk_id, 'task' AS origin FROM tasks UNION ALL SELECT chunk_id, 'new' FROM health WHERE health = 'UnderReplicated' AND chunk_id NOT IN (SELECT chunk_id FROM tasks)""",
    "first_per_key": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
    "set_difference": """SELECT c_custkey AS id, 'only listed' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT c_custkey, 'both' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "first_seen_order": "SELECT user_id, min(event_id) AS first_at FROM events GROUP BY user_id",
    "feed_after": f"WITH {CHANGES} SELECT revision, event_index, key, kind, (SELECT max(revision) FROM changes) AS next_revision FROM changes WHERE revision > 50 AND key % 5 = 1",
    "feed_state": f"WITH {CHANGES}, l AS (SELECT key, revision, event_index, kind, value FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, event_index DESC) = 1) SELECT key, revision, event_index, value FROM l WHERE kind <> 'delete'",
    "request_replays": """WITH r AS (SELECT user_id AS caller, event_id // 200 AS request, event_type AS digest, event_id AS at_ FROM events),
      f AS (SELECT *, first_value(digest) OVER w AS fd, first_value(at_) OVER w AS fa FROM r WINDOW w AS (PARTITION BY caller, request ORDER BY at_)),
      o AS (SELECT caller, CASE WHEN at_ = fa THEN 'applied' WHEN digest = fd THEN 'replayed' ELSE 'conflict' END AS outcome FROM f) SELECT caller, outcome, count(*) AS requests FROM o GROUP BY ALL""",
    "session_epochs": """WITH l AS (SELECT user_id AS node, event_type AS session, event_id AS seen_at, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events)
      SELECT node, session, seen_at, (sum(f) OVER (PARTITION BY node ORDER BY seen_at))::BIGINT AS epoch FROM l""",
    "stream_dedup": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_session_epochs": """WITH l AS (SELECT user_id AS node, event_id, event_type AS session, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events)
      SELECT node, event_id, session, (sum(f) OVER (PARTITION BY node ORDER BY event_id))::BIGINT AS epoch FROM l""",
    "feed_gaps": f"""WITH {CHANGES}, r AS (SELECT DISTINCT revision FROM changes WHERE event_type NOT IN ('view', 'click')), l AS (SELECT revision, lag(revision) OVER (ORDER BY revision) AS before FROM r) SELECT * FROM l WHERE revision <> before + 1""",
    "put_delete_counts": f"WITH {CHANGES} SELECT kind, event_index, count(*) AS n, max(revision) AS last_revision FROM changes GROUP BY ALL",
    "preferred_device": "SELECT l_suppkey AS node_id, l_partkey AS device, l_linenumber AS epoch FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_linenumber) = 1",
    "hash_partitions": f"""WITH RECURSIVE {CHUNKS}, h AS (SELECT chunk_id, chunk_id::VARCHAR AS s, 1 AS i, 14695981039346656037::UHUGEINT AS h FROM chunks
      UNION ALL SELECT chunk_id, s, i + 1, (xor(h, ascii(substr(s, i, 1))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM h WHERE i <= length(s))
      SELECT chunk_id, (h % 64)::BIGINT AS partition FROM h WHERE i = length(s) + 1""",
    "sync_prefixes": f"""WITH {NODES}, {COPIES}, p AS (SELECT chunk_id, node_id, domain, row_number() OVER (PARTITION BY chunk_id ORDER BY node_id) AS k,
        CASE WHEN row_number() OVER (PARTITION BY chunk_id, domain ORDER BY node_id) = 1 THEN 1 ELSE 0 END AS d FROM copies JOIN nodes USING (node_id)),
      r AS (SELECT chunk_id, k, sum(d) OVER (PARTITION BY chunk_id ORDER BY k) AS domains FROM p) SELECT chunk_id, min(k) FILTER (k >= 3 AND domains >= 3) AS prefix FROM r GROUP BY chunk_id""",
    "vectored_read": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
      SELECT doc_id, lower(substr(h, 1, 32) || substr(h, 201, 16) || substr(h, 17, 8)) AS bytes_hex, length(h) // 2 AS length FROM d""",
    "chunk_digests": "SELECT sha256(coalesce(text, '')) AS chunk_id, count(*) AS refs, max(strlen(coalesce(text, ''))) AS length FROM documents GROUP BY 1",
    "first_readable": f"WITH {NODES}, {COPIES} SELECT chunk_id, node_id FROM copies JOIN nodes USING (node_id) WHERE ready AND live QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY domain, node_id) = 1",
    "capacity": f"WITH {CHUNKS} SELECT sum(length)::BIGINT AS used, count(*) AS files, (1000000000 - sum(length))::BIGINT AS free FROM chunks",
    "stream_hourly_counts": """WITH c AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL)
      SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM c WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
} | rules.ORACLES | files.ORACLES
