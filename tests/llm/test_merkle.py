"""Merkle fingerprints against a plain version, and odd rows."""

import hashlib
import os
import re

import pytest

from tidemark.llm import merkle as M

DIR = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def slow_tree(text):
    runs = [[[sha(r) for r in re.findall(r"\s*(?:\S+\s*){1,8}|\s+", p)] for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n\n)(?!\n)", text)]
    secs = [sha("".join(sha("".join(p)) for p in s)) for s in runs]
    return sha("".join(secs)), {r for s in runs for p in s for r in p}


def slow_like(a, b):
    (ra, a), (rb, b) = slow_tree(a), slow_tree(b)
    return 1.0 if ra == rb else 2 * len(a & b) / max(1, len(a) + len(b))


def check(rows, got):
    rows = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(e))
        assert (r.fingerprint, r.edited_fingerprint) == (slow_tree(t)[0], slow_tree(e)[0])
        assert r.near_edited == pytest.approx(slow_like(t, e)) and r.near_next == pytest.approx(slow_like(t, nxt))


class Fake:
    def __init__(self, df):
        self.read, self.df = self, df

    def parquet(self, _):
        return self.df


@pytest.mark.parametrize("rows", [[(1, "alone here\nand there")], [(i * 37, f"text {i} " * (i % 5) + "\n\nend\n") for i in range(40)], [(-5, "a"), (None, "null id"), (10**15, None), (3, ""), (4, "x " * 40_000), (64, "b\n\n\n c"), (70, " \n")], []])
def test_rows(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, b int")
    check(rows, M.query(Fake(df), "").collect())


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(1, "other")], "doc_id long, text string")
    got = M.query(Fake(df), "").collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2


@pytest.mark.parametrize("ids", ["hashed", "clusters", "one", "nulls", "extremes"])
def test_orders_of_ids(spark, ids):
    """Sparse, clustered, hot and null ids: the order holds, and no window holds many rows of the table."""
    n = 2000
    of = {
        "hashed": lambda i: int(sha(str(i))[:15], 16) - 2**58,
        "clusters": lambda i: i if i % 2 else 10**15 + 7 * i,
        "one": lambda i: 5 if i % 3 == 0 else 1000 + i,
        "nulls": lambda i: None if i % 3 == 0 else i,
        "extremes": lambda i: (-(2**63), 2**63 - 1, i)[i % 3] if i > 1990 else i,
    }[ids]
    rows = [(of(i), f"text number {i} is here") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.followed(df).collect()
    by = lambda d, t: (d is not None, d if d is not None else 0)
    hashes = {r.text: r.h for r in df.select("text", M.F.xxhash64("text").alias("h")).collect()}
    order = [t for d, t in sorted(rows, key=lambda r: (*by(*r), hashes[r[1]]))]
    follows = {r.text: r.next_text for r in got}
    assert len(got) == n and all(follows[a] == b for a, b in zip(order, order[1:] + order[:1], strict=True))
    with_th = df.withColumn("th", M.F.xxhash64("text"))
    at, b = M.bucket(df)
    sizes = [r["count"] for r in with_th.withColumn("__at", at).groupBy(b.alias("b")).count().collect()]
    assert max(sizes) <= 200 and len(sizes) < n / 2


def test_edit_is_located(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nB\nc")], "doc_id long, text string")
    trees = {r.doc_id: r.tree for r in M.fingerprints(df).collect()}
    assert trees[1].root != trees[2].root and [x == y for x, y in zip(trees[1].paragraphs, trees[2].paragraphs)] == [True, False, True]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    check(rows, M.query(spark, DIR).collect())
