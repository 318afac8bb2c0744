"""Language ID: held-out accuracy on the given table, and odd rows."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid as L

DIR = "/root/testdata/sf0.01"


def test_kernel_is_blended_spectrum():
    m = L.fit([("a", "abab"), ("b", "xyzz")], landmarks=1).grams
    sets = {t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in ("abab", "xyzz", "abxq")}
    known = sets["abab"] | sets["xyzz"]
    want = [[len(sets[t] & sets[l]) / math.sqrt(len(sets[t] & known) * len(sets[l])) for l in ("abab", "xyzz")] for t in sets]
    assert np.allclose(L.kernel(m.incident(list(sets)), m.incident(["abab", "xyzz"])), want, atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = L.query(spark, DIR).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    tried = [r for r in got if r.held_out and len(r.text) >= 20]
    assert len(tried) > 100 and sum(r.lang == r.lang_pred for r in tried) / len(tried) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 1.0) for i in range(40)]
    rows += [(100, None, "en", 0.0), (101, "", "en", 0.0), (102, "12 34!", None, 0.0), (None, "der hund", None, 0.0), (103, "the dog " * 30_000, None, 0.0)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert len(got) == 45 and {got[k].lang_pred for k in (100, 101, 102)} == {"und"} and got[102].score == 0
    assert got[None].lang_pred == "de" and got[103].lang_pred == "en" and not got[None].held_out
    nothing = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert L.identify(nothing).first().lang_pred == "und"
    assert L.identify(nothing.limit(0)).count() == 0


def slow_scores(rows, landmarks, texts):
    """The same from the definition: sets of grams, a dense kernel, Nystrom by pseudo-inverse square root, ridge."""
    grams = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    langs = sorted({x for x, _ in rows})
    marks = [t for x in langs for t in [t for y, t in rows if y == x][:landmarks]]
    known = set().union(*map(grams, marks))
    k = lambda a, b: np.array([[len(grams(x) & grams(y)) / math.sqrt(max(1, len(grams(x) & known)) * max(1, len(grams(y) & known))) for y in b] for x in a])
    u, v = np.linalg.eigh(k(marks, marks))
    root = (v[:, u > 1e-6 * u.max()] / np.sqrt(u[u > 1e-6 * u.max()])) @ v[:, u > 1e-6 * u.max()].T
    z, y = k([t for _, t in rows], marks) @ root, np.array([[1.0 if x == lang else -1.0 for lang in langs] for x, _ in rows])
    rank = int((u > 1e-6 * u.max()).sum())
    w = np.linalg.solve(z.T @ z + L.RIDGE * len(rows) / rank * np.eye(len(marks)), z.T @ (y - y.mean(axis=0)))
    return k(texts, marks) @ root @ w + y.mean(axis=0)


@pytest.mark.parametrize("cells", [8_000_000, 300])
def test_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    rng = random.Random(2)
    word = {"a": "abcde", "b": "cdefg", "c": "xyzab"}
    text = lambda x: " ".join("".join(rng.choice(word[x]) for _ in range(rng.randint(1, 6))) for _ in range(12))
    rows = [(x, text(x)) for x in "abc" for _ in range(9)]
    texts = [text(x) for x in "aabbcc"] + ["zzz", "a", "1 2 3"]
    assert np.allclose(L.fit(rows, landmarks=4).scores(texts), slow_scores(rows, 4, texts), atol=2e-3)


def test_what_cannot_reach_a_prediction(spark):
    """Held-out rows, and the lang, source and id of a row, change no prediction of another or of itself."""
    rows = [(i, ("the cat and the dog %d" if i % 2 else "der hund und die katze %d") % i, "en" if i % 2 else "de", "s") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    held = {r.doc_id for r in docs.filter(L.held_out()).collect()}
    assert held == {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    changed = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(changed).collect()} == want
    model = L.fit(L.sample(docs))
    alone = L.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text"), model)
    assert {-r.doc_id: (r.lang_pred, r.score) for r in alone.collect()} == want


def test_sample_is_bounded_and_keeps_every_language(spark):
    rows = [(i, f"short text {i}", "en") for i in range(1000)] + [(7, "one row many times", "en")] * 3000 + [(i, f"sehr langer text {i} " * 900, "de") for i in range(40)] + [(None, "nul", "fr")] * 500
    got = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50)
    by = {x: [t for y, t in got if y == x] for x in ("en", "de", "fr")}
    assert len(by["en"]) == 50 and len(set(by["en"])) == 50 and len(by["fr"]) == 1
    assert 20 <= len(by["de"]) <= 40 and all(len(t) == L.FIT_CHARS for t in by["de"]) and any(not t.startswith("sehr langer text") for t in by["de"])
    assert got == L.sample(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string"), per_lang=50)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 3, ("the cat", "der hund")[i % 2], ("en", "de")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    got = L.identify(docs).collect()
    assert len(got) == 60 and len({(r.lang_pred, r.score) for r in got}) == 2
