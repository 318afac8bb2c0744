"""Operators on small cases: ranges, quantiles, feeds, placement, ancestry with cycles, hashes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import posix as P
from tidemark.operators import feed, intervals, joins, lookup, placement, stats


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("inclusive", [False, True])
def test_coalesced(spark, inclusive):
    rng = random.Random(inclusive)
    data = [(k, a, a + rng.randint(-1, 6)) for k in range(4) for a in [rng.randint(0, 60) for _ in range(25)]]
    want = []
    for k in range(4):
        cells = {x for kk, a, b in data if kk == k for x in range(2 * a, 2 * b + 1 + inclusive) if a < b or (inclusive and a == b)}
        run = []
        for x in sorted(cells):
            if run and x == run[-1][1] + 1:
                run[-1][1] = x
            else:
                run.append([x, x])
        want += [(k, a // 2, (b - inclusive) // 2) for a, b in run]
    got = intervals.coalesced(spark.createDataFrame(data, "k int, start long, end long"), ["k"], inclusive=inclusive)
    assert rows(got) == sorted(want, key=repr)


def test_subtract_cover_layout(spark):
    r = spark.createDataFrame([("a", 0, 10), ("b", 5, 6), ("c", 8, 20)], "k string, start long, end long")
    assert rows(intervals.subtracted(r, 4, 8)) == [("a", 0, 3), ("a", 9, 10), ("c", 9, 20)]
    asked = spark.createDataFrame([("a", 0, 10), ("a", 0, 11), ("z", 1, 2)], "k string, start long, end long")
    assert rows(intervals.covered(asked, r, ["k"])) == [("a", 0, 10, True), ("a", 0, 11, False), ("z", 1, 2, False)]
    e = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 4, 6), (1, 2, 6, 6), (1, 3, 6, 9)], "k int, at int, start long, end long")
    assert [(r_.at, r_.fault) for r_ in intervals.layout_faults(e, ["k"], "at").collect()] == [(1, "overlap or disorder"), (2, "empty")]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 20])
def test_three_quantiles(spark, n):
    df = spark.createDataFrame([("k", float(x)) for x in range(1, n + 1)], "k string, v double")
    near = {r.p: r.value for r in stats.ranked_quantiles(df, ["k"], "v", [50, 95, 100]).collect()}
    floor = {r.p: r.value for r in stats.ranked_quantiles(df, ["k"], "v", [50, 95], floor=True).collect()}
    s = list(range(1, n + 1))
    assert near == {p: s[-(-n * p // 100) - 1] for p in (50, 95, 100)}
    assert floor == {p: s[min(n * p // 100, n - 1)] for p in (50, 95)}
    assert stats.interpolated_median(df, ["k"], "v").first().median == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_feed(spark):
    log = [(1, 0, "a", "put", 1.0), (1, 1, "b", "put", 2.0), (2, 0, "a", "delete", 0.0), (3, 0, "b", "put", 3.0), (5, 0, "c", "put", 4.0)]
    f = spark.createDataFrame(log, "revision long, event_index long, key string, kind string, value double")
    assert rows(feed.state(f).select("key", "value")) == [("b", 3.0), ("c", 4.0)]
    assert rows(lookup.soft_limit(f, 1).select("revision")) == [(1,), (1,)]
    assert lookup.soft_limit(f, 3).count() == 3 and lookup.soft_limit(f, 0).count() == 5 and lookup.soft_limit(f, 9).count() == 5
    got = feed.for_consumer(f, 1, F.col("key") == "a")
    assert [(r.revision, r.next_revision) for r in got.collect()] == [(2, 5)]
    assert rows(feed.gaps(f)) == [(5, 3)]
    r = spark.createDataFrame([("c", "r", "x", 1), ("c", "r", "x", 2), ("c", "r", "y", 3), ("d", "r", "y", 4)], "caller string, request string, digest string, at long")
    assert [x.outcome for x in feed.replays(r).orderBy("at").collect()] == ["applied", "replayed", "conflict", "applied"]


def test_ancestors_with_a_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "inode string, parent string")
    got = {(r.inode, r.ancestor): r.distance for r in joins.ancestors(e).collect()}
    assert got[("c", "a")] == 2 and got[("c", "c")] == 0 and got[("x", "y")] == 1 and ("a", "c") not in got
    loop = joins.reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int"))
    assert {r.src for r in loop.filter("src = dst").collect()} == {1, 2, 3} and loop.count() == 12


def test_hash_and_rules(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    texts = ["", "a", "foobar", "0", "chunk-12345", "é漢", "x" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [int(r[0]) for r in df.select(P.fnv1a(F.col("t"))).collect()] == [fnv(t) for t in texts]
    names = spark.createDataFrame([("",), (".",), ("..",), ("a/b",), ("ok",), ("x" * 255,), ("x" * 256,), ("é" * 128,)], "n string")
    assert [r[0] for r in names.select(P.valid_name(F.col("n"))).collect()] == [False, False, False, False, True, True, False, False]
    assert spark.range(1).select(P.live(F.lit(5), 5)).first()[0] is False


def greedy(nodes, turn, size):
    """The rule as a loop: turned candidates, first those of new domains, then any until the group is full."""
    nodes = nodes[turn % len(nodes) :] + nodes[: turn % len(nodes)]
    chosen, domains = [], set()
    for fresh in (True, False):
        for node, domain in nodes:
            if len(chosen) < size and node not in chosen and not (fresh and domain in domains):
                chosen.append(node), domains.add(domain)
    return chosen


def test_greedy_groups(spark):
    rng = random.Random(6)
    nodes = [(k, rng.randint(0, 4), rng.random() < 0.8) for k in range(17)]
    chunks = spark.createDataFrame([(k,) for k in range(300)], "chunk_id long")
    got = placement.replica_groups(chunks, spark.createDataFrame(nodes, "node_id long, domain long, live boolean"), 64, 7).collect()
    assert len(got) == 300 and len({r.partition for r in got}) > 40
    live = [(n, d) for n, d, up in nodes if up]
    assert all(r.replicas == greedy(live, r.partition, 7) for r in got)
    assert placement.replica_groups(chunks, spark.createDataFrame(nodes, "node_id long, domain long, live boolean").limit(0), 64, 3).count() == 0


def test_conflicts_against_all_pairs(spark):
    rng = random.Random(2)
    one = lambda i: (i, rng.choice("pf"), rng.randint(0, 3), rng.choice(["read", "write"]), *(lambda a: (a, a + rng.randint(0, 40)))(rng.randint(0, 150)))
    locks, asked = [one(i) for i in range(60)], [one(i) for i in range(60)]
    got = joins.conflicts(spark.createDataFrame(locks, "seq int, kind string, owner int, lock_type string, start long, end long"), spark.createDataFrame(asked, "ask_id int, kind string, owner int, lock_type string, start long, end long"), 16)
    want = []
    for i, k, o, t, a, b in asked:
        hit = [(x[4], x[0]) for x in locks if x[1] == k and x[2] != o and x[4] <= b and x[5] >= a and "write" in (t, x[3])]
        if hit:
            want.append((i, *min(hit)))
    assert rows(got) == sorted(want, key=repr)


def test_conflicts_of_long_ranges_and_close_ends(spark):
    """Ranges of any length, narrow and wide buckets, one owner ahead of all, owners and types that are missing."""
    rng = random.Random(12)

    def one(i, far):
        a = rng.randint(-far, far)
        return i, rng.choice("pf"), rng.choice([0, 0, 0, 1, 2, None]), rng.choice(["read", "read", "write", None]), a, a + rng.choice([-1, 0, 1, 5, far, 10**9 * far])

    for far, width in ((12, 1), (12, 4), (1000, 4), (1000, 5000)):
        locks, asked = [one(i, far) for i in range(80)], [one(i // 2, far) for i in range(160)]
        got = joins.conflicts(spark.createDataFrame(locks, "seq int, kind string, owner int, lock_type string, start long, end long"), spark.createDataFrame(asked, "ask_id int, kind string, owner int, lock_type string, start long, end long"), width)
        want = {}
        for i, k, o, t, a, b in asked:
            hit = [(x[4], x[0]) for x in locks if None not in (o, x[2]) and x[1] == k and x[2] != o and x[4] <= b and x[5] >= a and "write" in (t, x[3])]
            if hit:
                want[i] = min(*hit, *([want[i]] if i in want else [hit[0]]))
        assert {r.ask_id: (r.start, r.seq) for r in got.collect()} == want and len(want) > 20


# depth, cycles, missing parents


def test_deep_chain_and_ring(spark):
    chain = spark.createDataFrame([(f"i{k}", f"i{k + 1}") for k in range(1000)], "inode string, parent string")
    got = joins.ancestors(chain).filter("inode = 'i0'")
    assert got.count() == 1001 and got.filter("distance = 1000 AND ancestor = 'i1000'").count() == 1
    ring = spark.createDataFrame([(k, (k + 1) % 500) for k in range(500)] + [(1000, 0), (499, 2000)], "src long, dst long")
    reach = joins.reachable(ring)
    assert reach.filter("src = dst").count() == 500 and reach.filter("src = 1000").count() == 501
    assert {r.node for r in joins.on_cycles(ring).collect()} == set(range(500))
    assert joins.on_cycles(spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")).count() == 0


def test_a_cycle_counts_as_below(spark):
    entries = spark.createDataFrame([("a", "root"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "inode string, parent string")
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("b", "b"), ("a", "z"), ("root", "c"), ("q", "c")], "ancestor string, child string")
    assert {(r.ancestor, r.child): r.below for r in joins.below_or_same(pairs, entries).collect()} == {("a", "c"): True, ("c", "a"): False, ("b", "b"): True, ("a", "z"): True, ("root", "c"): True, ("q", "c"): False}


def test_missing_parents_fail(spark):
    entries = spark.createDataFrame([("root", "n", "i1"), ("root", "m", "i2")], "parent string, name string, inode string")
    inodes = spark.createDataFrame([("i1", "file")], "inode string, kind string")
    assert joins.read_dir(entries.filter("inode = 'i1'"), inodes).first().kind == "file"
    with pytest.raises(Exception, match="inode not found: i2"):
        joins.read_dir(entries, inodes).collect()
    ranges = spark.createDataFrame([(1, 0, 5), (1, 3, 11)], "chunk long, start long, end long")
    sized = spark.createDataFrame([(1, 10)], "chunk long, length long")
    assert intervals.within(ranges.limit(1), ["chunk"], sized).count() == 1
    with pytest.raises(Exception, match="past the chunk's end"):
        intervals.within(ranges, ["chunk"], sized).collect()


def test_sums_and_hashes(spark):
    d = spark.createDataFrame([(str(2**64 - 1),), ("5",)], "x string").select(F.col("x").cast("decimal(38,0)").alias("x"))
    one = F.lit(1).cast("decimal(38,0)")
    assert [int(r[0]) for r in d.select(P.saturating_add(F.col("x"), one)).collect()] == [2**64 - 1, 6]
    with pytest.raises(Exception, match="overflows"):
        d.select(P.checked_add(F.col("x"), one)).collect()
    h = 0xCBF29CE484222325
    for b in b"ab\xff" + (7).to_bytes(8, "little"):
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert int(spark.range(1).select(P.field_hash(P.hash_string(F.lit("ab")), P.hash_long(F.lit(7)))).first()[0]) == h


def test_groups_with_heads(spark):
    rows = [(k, k // 2, [(3, 1), (1, k)]) for k in range(6)]
    s = spark.createDataFrame(rows, "node_id long, domain long, devices array<struct<device_id:long,device_epoch:long>>")
    got = {r.node_id: (r.device_id, r.replicas, r.domains) for r in placement.headed_groups(s, 3, 2).collect()}
    assert got[0] == (1, "0,2,4", 3) and got[5] == (1, "5,0,2", 3) and got[1] == (1, "1,2,4", 3)
    assert placement.headed_groups(s.filter("domain = 0"), 3, 2).count() == 0


def test_groups_of_many_heads_without_pairs(spark):
    """Long runs of one domain, against the rule as a loop; what is made stays far below the pairs of nodes."""
    rng = random.Random(8)
    domains = [0] * 150 + [1] * 40 + [rng.randint(0, 3) for _ in range(60)] + [0] * 250
    rows = [(7 * k, d, [(2, 1), (1, 3)]) for k, d in enumerate(domains)]
    s = spark.createDataFrame(rows, "node_id long, domain long, devices array<struct<device_id:long,device_epoch:long>>")
    nodes = [(7 * k, d) for k, d in enumerate(domains)]
    for size in (2, 3, 6):  # six: more than there are domains, so that the nearest of known ones follow
        groups = placement.headed_groups(s, size, 1)
        got = {r.node_id: r.replicas for r in groups.collect()}
        assert got == {node: ",".join(map(str, greedy(nodes, k, size))) for k, (node, _) in enumerate(nodes)}
        held = placement.ahead(placement.numbered(s.select("node_id", "domain")), size)
        assert held.count() == len(nodes) and held.select(F.max(F.size("near"))).first()[0] <= 2 * size
    assert "Generate" not in groups._jdf.queryExecution().executedPlan().toString()
    one = placement.headed_groups(s.filter("node_id < 700"), 3, 1)
    assert one.count() == 100 and {r.domains for r in one.collect()} == {1} and placement.headed_groups(s.filter("node_id = 0"), 3, 1).count() == 0
