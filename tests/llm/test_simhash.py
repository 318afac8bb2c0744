"""SimHash: fingerprints and components against brute force, crowded nodes, edge cases."""

import itertools
import os
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from tidemark.llm import simhash as S

DIR = "/root/testdata/sf0.01"


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " ", "One", "one TWO", "ÀB c d", None] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [x % 2**64 for x in S.simhash(pd.Series(texts))] == [slow_print(x) for x in texts]


@pytest.mark.parametrize("crowd", [2048, 4])
def test_links_are_whole(spark, crowd):
    rng = random.Random(crowd)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for x in list(prints)[:12]:  # chains and dense clusters
        for _ in range(10):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    fps = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in S.contract(S.linked(fps, crowd)).collect()}
    got = [roots.get(x, x) for x in prints]
    want = [prints[k] for k in slow_components([x % 2**64 for x in prints])]
    assert got == want


def test_components_of_odd_rows(spark):
    rows = [(3, "a b c d"), (1, "A b  c D"), (7, None), (5, ""), (6, " \t"), (None, "lone words here now"), (9, "x" * 50_000), (3, "a b c d")]
    got = S.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert (by[3], by[1], by[7], by[5], by[6], by[9], by[None]) == (1, 1, 5, 5, 5, 9, None)
    assert S.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first(spark):
    rows = [(3, "a b c d", 1), (1, "A b  c D", 2), (1, "A b  c D", 3), (8, "other words are here", 4), (None, "lone words here now", 5)]
    got = S.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp long"))
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 8]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_whole_table(spark):
    """The query against all pairs of the table."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    prints = [slow_print(t) for _, t in rows]
    label = slow_components(prints)
    want = {d: (f"{p:016x}", rows[k][0]) for (d, _), p, k in zip(rows, prints, label, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, DIR).collect()} == want


def test_tries_turn_back():
    keys = np.random.default_rng(3).integers(0, 2**64, 50, dtype=np.uint64)
    for trie in range(len(S.TRIES)):
        laid = np.zeros(len(keys), np.uint64)
        for below, to, width in S.moves(trie):
            laid |= (keys >> np.uint64(below) & np.uint64((1 << width) - 1)) << np.uint64(to)
        assert (S.put_back(laid, np.full(len(keys), trie)).view(np.uint64) == keys).all() and len(set(laid)) == len(keys)
    for bits in itertools.combinations(range(64), 3):  # in some trie no differing bit is among the first TOP
        assert any(all(k < 64 - S.TOP for k in [to + b - below for b in bits for below, to, width in S.moves(t) if below <= b < below + width]) for t in range(len(S.TRIES)))
