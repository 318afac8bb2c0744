"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are cut into five blocks. Two that differ in at most three bits agree in two of the
blocks at least, so they are laid into ten tries, one for each pair of blocks: its bits come first, then the
rest. In one of the tries they share the node at depth TOP; node pairs that differ above it are pruned, the
other tries have them. At this depth 30 million nodes share the fingerprints, so nearly none is crowded; one
that is is split along the trie into subtries of bounded size, and only pairs of subtries whose prefixes are
within the error budget are joined. Each task then traverses the node pairs
of its subtries together, bit by bit, adds up differing bits, and drops pairs beyond the budget.
A task emits a spanning forest of the links it finds, not the links; star contraction over the
forests gives the components.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other;
documents of equal fingerprint are one trie leaf; repeated rows and repeated ids share fingerprints
and so components; a null doc_id never names a component unless all of its members' ids are null;
an empty table gives no rows; extra columns are ignored by `components` and kept by `keep_first`.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, stage, table

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Blocks of bits, as (bits below, width), and the pairs of blocks that lead a trie; the depth at which all tries begin.
BLOCKS = ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
TRIES, TOP = tuple(itertools.combinations(range(len(BLOCKS)), 2)), 25
#: Most fingerprints of one subtrie: bounds a task's unit of work, loses nothing.
CROWD = 2048
#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAVES = 32


# fingerprints


def simhash(texts: pd.Series) -> pd.Series:
    """Signed 64-bit SimHash of each text: bit set if set in over half of the shingles' XXH64."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for at, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) < SHINGLE:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:], strict=False)]
        out[at] = majority(np.array(hashes, np.uint64))
    return pd.Series(out.view(np.int64))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of hashes, counted in slices so that long texts need no more memory."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp): fp the SimHash of the whole text as a signed long."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(simhash, "long")("text").alias("fp"))


# the trie self-join


def moves(trie: int) -> list[tuple[int, int, int]]:
    """How a trie orders the bits: (bits below in the fingerprint, bits below in the key, width) of each block."""
    out, upto = [], BITS
    for k in (*TRIES[trie], *(k for k in range(len(BLOCKS)) if k not in TRIES[trie])):
        below, width = BLOCKS[k]
        upto -= width
        out.append((below, upto, width))
    return out


def laid_out(fp: Column, trie: int) -> Column:
    """The fingerprint with its bits in the order of a trie."""
    parts = [F.shiftleft(F.shiftrightunsigned(fp, below).bitwiseAND((1 << width) - 1), to) for below, to, width in moves(trie)]
    return functools.reduce(Column.bitwiseOR, parts)


def put_back(keys: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Signed fingerprints of keys of tries."""
    out = np.zeros(len(keys), np.uint64)
    for trie in np.unique(tries):
        of = tries == trie
        for below, to, width in moves(int(trie)):
            out[of] |= (keys[of] >> np.uint64(to) & np.uint64((1 << width) - 1)) << np.uint64(below)
    return out.view(np.int64)


def subtries(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Rows (trie, depth, node, key): every fingerprint of every trie with the subtrie it lies in.

    Starts at depth TOP; while a node holds more than `crowd` fingerprints, it is split eight bits
    deeper. Counting is a partial aggregation, so a crowded node never meets in one task."""
    laid = fps.select(F.posexplode(F.array(*[laid_out(F.col("fp"), t) for t in range(len(TRIES))])).alias("trie", "key"))
    rest, done = stage(laid, "tries"), []
    for depth in (*range(TOP, BITS, 8), BITS):
        at = rest.withColumn("node", F.shiftrightunsigned("key", BITS - depth) if depth < BITS else F.col("key")).withColumn("depth", F.lit(depth))
        if depth == BITS:
            done.append(at.select("trie", "depth", "node", "key"))
            break
        crowded = stage(at.groupBy("trie", "node").count().filter(F.col("count") > crowd).select(F.col("trie").alias("c_trie"), F.col("node").alias("c_node")), "crowded")
        same = (F.col("trie") == F.col("c_trie")) & (F.col("node") == F.col("c_node"))
        if crowded.isEmpty():
            done.append(at.select("trie", "depth", "node", "key"))
            break
        done.append(at.join(crowded, same, "left_anti").select("trie", "depth", "node", "key"))
        rest = stage(at.join(crowded, same, "left_semi").select("trie", "key"), "crowd")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def units(placed: DataFrame) -> DataFrame:
    """Rows (unit, trie, side, key): the work to do. A subtrie joins itself, and each other subtrie
    under the same node of depth TOP whose prefix differs in at most BUDGET bits.

    Only crowded nodes have more than one subtrie; the pairs are made from the list of those, one row
    a subtrie, never from fingerprints."""
    alone = placed.filter(F.col("depth") == TOP).select(F.xxhash64("trie", "depth", "node").alias("unit"), "trie", F.lit(0).alias("side"), "key")
    deep = placed.filter(F.col("depth") > TOP).withColumn("top", F.expr(f"shiftrightunsigned(node, depth - {TOP})"))
    nodes = deep.select("trie", "top", "depth", "node").distinct()
    a, b = nodes.alias("a"), nodes.alias("b")
    apart = F.bit_count(F.expr("shiftrightunsigned(a.node, a.depth - least(a.depth, b.depth)) ^ shiftrightunsigned(b.node, b.depth - least(a.depth, b.depth))"))
    before = (F.col("a.depth") < F.col("b.depth")) | ((F.col("a.depth") == F.col("b.depth")) & (F.col("a.node") <= F.col("b.node")))
    pairs = a.join(b, (F.col("a.trie") == F.col("b.trie")) & (F.col("a.top") == F.col("b.top")) & before & (apart <= BUDGET))
    pairs = pairs.select(F.col("a.trie").alias("trie"), F.xxhash64("a.trie", "a.depth", "a.node", "b.depth", "b.node").alias("unit"),
                         F.array_distinct(F.array(F.struct(F.col("a.depth").alias("d"), F.col("a.node").alias("n"), F.lit(0).alias("side")),
                                                  F.struct(F.col("b.depth").alias("d"), F.col("b.node").alias("n"), F.when((F.col("a.depth") == F.col("b.depth")) & (F.col("a.node") == F.col("b.node")), 0).otherwise(1).alias("side")))).alias("of"))
    work = pairs.select(F.col("trie").alias("w_trie"), "unit", F.explode("of").alias("o")).select("w_trie", "unit", F.col("o.d").alias("w_depth"), F.col("o.n").alias("w_node"), F.col("o.side").alias("side"))
    same = (F.col("trie") == F.col("w_trie")) & (F.col("depth") == F.col("w_depth")) & (F.col("node") == F.col("w_node"))
    return alone.unionByName(deep.join(work, same).select("unit", "trie", "side", "key"))


def traverse(keys: np.ndarray, lo_a, hi_a, lo_b, hi_b):
    """Yields index arrays (i, j) of keys within BUDGET bits, for node pairs (a, b) of sorted ranges.

    All node pairs of a task descend one bit at a time together; equal ranges are a node with itself."""
    diff, shift = np.zeros(len(lo_a), np.int64), BITS - 1
    while len(lo_a):
        n_a, n_b = hi_a - lo_a, hi_b - lo_b
        same = lo_a == lo_b
        ready = (n_a * n_b <= LEAVES) | (shift < 0)
        if ready.any():
            yield from leaves(keys, lo_a[ready], n_a[ready], lo_b[ready], n_b[ready])
            keep = ~ready
            lo_a, hi_a, lo_b, hi_b, diff, same = lo_a[keep], hi_a[keep], lo_b[keep], hi_b[keep], diff[keep], same[keep]
        if not len(lo_a):
            return
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(shift)) & np.uint64(1), dtype=np.int64)])
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        cross = ~same
        parts = [(lo_a, mid_a, lo_b, mid_b, diff), (mid_a, hi_a, mid_b, hi_b, diff), (lo_a, mid_a, mid_b, hi_b, diff + 1), tuple(x[cross] for x in (mid_a, hi_a, lo_b, mid_b, diff + 1))]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (diff <= BUDGET) & (lo_a < hi_a) & (lo_b < hi_b) & ~((lo_a == lo_b) & (hi_a - lo_a < 2))
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[live], hi_a[live], lo_b[live], hi_b[live], diff[live]
        shift -= 1


def leaves(keys, lo_a, n_a, lo_b, n_b):
    """Compare all leaves of small node pairs, in slices."""
    total = n_a * n_b
    for part in np.array_split(np.arange(len(total)), max(1, int(total.sum()) // 2_000_000)):
        if not len(part):
            continue
        t = total[part]
        at = np.repeat(np.arange(len(part)), t)
        k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        i, j = lo_a[part][at] + k // n_b[part][at], lo_b[part][at] + k % n_b[part][at]
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= BUDGET) & (i != j)
        yield i[near], j[near]


def forest(n: int, pairs) -> np.ndarray:
    """For nodes 0..n-1, the smallest node of each one's component under the linked pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            i, j = root[i], root[j]
            i, j = i[i != j], j[i != j]
            if len(i):
                np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
                while (root[root] != root).any():
                    root = root[root]
    return root


def join_units(batches):
    """mapInPandas: rows sorted by unit, side and key in; links (a, b) of a spanning forest a unit out.

    Units are bounded, so what is held is one batch and the unit that runs over its end."""
    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        unit = batch["unit"].to_numpy()
        cut = len(unit) - int((unit == unit[-1]).sum()) if len(unit) else 0
        held = batch.iloc[cut:]
        if cut:
            yield links(batch.iloc[:cut])
    if held is not None and len(held):
        yield links(held)


def links(rows: pd.DataFrame) -> pd.DataFrame:
    """Traverse all units of rows at once."""
    unit, trie, side, keys = rows["unit"].to_numpy(), rows["trie"].to_numpy(), rows["side"].to_numpy(), rows["key"].to_numpy().view(np.uint64)
    order = np.lexsort((keys, side, trie, unit))
    unit, trie, side, keys = unit[order], trie[order], side[order], keys[order]
    start = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (trie[1:] != trie[:-1])]))
    end = np.append(start[1:], len(unit))
    zeros = np.concatenate([[0], np.cumsum(side == 0)])
    mid = start + zeros[end] - zeros[start]
    two = mid < end
    lo_b, hi_b = np.where(two, mid, start), np.where(two, end, mid)
    live = (mid - start > 1) | two
    root = forest(len(keys), traverse(keys, start[live], mid[live], lo_b[live], hi_b[live]))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": put_back(keys[root[linked]], trie[linked]), "b": put_back(keys[linked], trie[linked])})


def linked(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    work = units(stage(subtries(fps, crowd), "subtries"))
    return work.repartition("unit").sortWithinPartitions("unit", "side", "key").mapInPandas(join_units, "a long, b long")


# components


def contract(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (node, root) of the connected components of edges (a, b); root is the smallest node.

    Large-star and small-star rounds: each is an aggregation with map-side combine and an equi-join
    that Spark can split where a node is hot. Every round is staged, so lineage stays short."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stage(small_.filter("u <> v").distinct(), "stars")
        sign = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, after)]
        edges = after
        if sign[0] == sign[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Rows (fp, first_id, root): distinct fingerprints of prints (doc_id, fp), their smallest id and component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = contract(linked(distinct.select("fp"), crowd))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stage(fingerprints(docs), "fingerprints")
    found = labelled(prints, crowd)
    named = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = found.join(named, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return prints.join(names, prints["fp"] == names["n_fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def keep_first(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest (doc_id, text hash), nulls last.

    Ids need not be there nor differ. Rows that agree in both are one document, of which one row stays. Every
    row is numbered where it lies in a staged copy, so that which one stays is settled once, by number; texts
    meet the numbers in a join that Spark broadcasts while they are few, and shuffles otherwise."""
    bound_batches(docs.sparkSession)
    row = stage(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("at"), F.col("doc_id").alias("id"), text_hash().alias("th"), F.pandas_udf(simhash, "long")("text").alias("fp")), "rows")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("d"), F.col("th").alias("t"), "at")
    firsts = row.groupBy("fp").agg(F.min(order).alias("first"))
    of = labelled(row.select(F.col("id").alias("doc_id"), "fp"), crowd).select(F.col("fp").alias("l_fp"), "root")
    keep = firsts.join(of, firsts["fp"] == of["l_fp"]).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return row.join(keep, "at", "left_semi").select("__row.*")


def query(spark, sf_dir):
    """op2: every document with its fingerprint and component."""
    return components(table(spark, sf_dir, "documents"))
