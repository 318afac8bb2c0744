"""Quality rules, line dedup and mixing: their SQL on the smallest tables, and odd rows."""

import os
import re

import pytest

from tidemark.llm import linededup, mixing, quality
from tidemark.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


# quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots, seen = set(), {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            spots |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h i j k", "x y z " * 300, "l one\nl one\n\n \nl two\nl one", "a b c d e a b c d e f", "é𝒳 ##<>|\x0b b", "same " * 9000, "a b c d e f a b c d e f a b"]


def test_counts(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.keep_good(df).columns == df.columns
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_sketches_merge(spark):
    df = spark.createDataFrame([("en", f"s{i % 3}", i % 40 + 1, 5 * (i % 40 + 1) + i % 7, 0, 0, 0, 9) for i in range(600)], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    parts = [quality.sketches(df.filter(f"word_chars % 2 = {k}")) for k in (0, 1)]
    merge = lambda s: {tuple(r)[:4]: r.n for r in s.groupBy("lang", "source", "metric", "bucket").agg({"n": "sum"}).toDF("lang", "source", "metric", "bucket", "n").collect()}
    assert merge(parts[0].unionByName(parts[1])) == merge(quality.sketches(df))
    values = sorted(1000 * r.word_chars // r.n_words for r in df.collect())
    q = quality.quantiles(quality.sketches(df), []).filter("metric = 0").first()
    for found, exact in ((q.low, values[len(values) // 10]), (q.mid, values[len(values) // 2]), (q.high, values[9 * len(values) // 10])):
        assert abs(found - exact) <= exact / 64


def test_adaptive_verdict(spark):
    plain = lambda i: " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(40))
    rows = [(i, plain(i), "en", "a") for i in range(200)] + [(900, " ".join(f"w{k}###" for k in range(40)), "en", "a"), (901, " ".join("supercalifragilistic%d" % k for k in range(40)), "en", "rare")]
    rows += [(902, " ".join(f"w{k}" for k in range(40)), "en", "a"), (903, plain(3) + " $", "en", "a")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(200)) | {903}


def test_limits_follow_the_data(spark):
    """In two groups of unlike habits every metric has its own limit, and what one group rejects the other keeps."""
    rows = []
    for k, (source, size, noise) in enumerate((("terse", 4, 1), ("wordy", 9, 8))):
        for i in range(200):
            n = i % 10 + 1
            words = ["x" * (size + (i + j) % 3) + str(j * 1000 + i) for j in range(60)]
            words[10 : 10 + noise * n] = [w + "%" for w in words[10 : 10 + noise * n]][: noise * n]
            text = " ".join(words) + "".join("\nsome line" if i < 20 * noise and j < noise * n else f"\nl{i} {j}" for j in range(40))
            text += " a b c d e f" * (2 if i < 6 * noise else 0)
            rows.append((1000 * k + i, text, "en", source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r.t_source: r for r in quality.thresholds(quality.sketches(quality.features(df, ["lang", "source"]))).collect()}
    for name in quality.METRICS:
        terse, wordy = limits["terse"][f"t_{name}"], limits["wordy"][f"t_{name}"]
        assert terse.high < wordy.high, name
    louder = [(5000 + k, rows[200 * k + 163][1].replace(" ", "% ", 24), "en", rows[200 * k][3]) for k in (0, 1)]
    more = df.unionByName(spark.createDataFrame(louder, df.schema))
    kept = {r.doc_id for r in quality.judge(more).filter("kept").collect()}
    assert 5001 in kept and 5000 not in kept


def test_copies_do_not_set_the_limits(spark):
    """A group that is mostly copies has no spread of its own and takes its language's."""
    plain = lambda i: " ".join("w" * (3 + (i * k) % 5) + str(k) for k in range(40))
    rows = [(i, plain(7), "en", "copies") for i in range(190)] + [(1000 + i, plain(i), "en", "copies") for i in range(10)] + [(2000 + i, plain(i), "en", "other") for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert got.filter("NOT kept").count() == 0


# line dedup


def test_lines(spark):
    line = "this very line  stands in MANY documents"
    rows = [(5, f"{line}\nown words of five here", 1), (3, f"top of three has words\nThis very line stands in many  documents\nshort one", 1), (9, line, 1), (None, line, 1), (4, None, 1), (6, "", 1), (7, "short one\nshort one", 1), (3, f"top of three has words\nThis very line stands in many  documents\nshort one", 1), (8, f"é {line} x\n" * 3, 1), (10, f"before it all. {line}, more words; short one\n \t\n", 1), (11, f"another start. {line}, \tmore words; and an end ", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = linededup.dedup(df, run_words=7).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].n_removed == 0 and by[3].text == rows[1][1]
    assert by[5].text == "own words of five here" and [tuple(s) for s in by[5].removed] == [(0, len(line))]
    assert by[9].text == by[None].text == by[4].text == by[6].text == "" and by[9].n_units == 1
    assert by[7].text == "short one\nshort one" and by[7].n_units == 2 and by[7].n_removed == 0
    first = f"é {line} x"
    assert by[8].text == first + "\n" and [tuple(s) for s in by[8].removed] == [(len(first) + 1, 2 * len(first) + 1), (2 * len(first) + 2, 3 * len(first) + 2)]
    assert by[10].text == rows[9][1] and by[10].n_units == 4
    assert by[11].text == "another start. and an end " and by[11].n_removed == 2 and [tuple(s) for s in by[11].removed] == [(14, 15 + len(line) + 1), (15 + len(line) + 1, 15 + len(line) + 1 + len(" \tmore words;"))]
    assert linededup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [10_000, 2])
def test_runs_against_brute_force(spark, monkeypatch, hot):
    import random

    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(11)
    bank = [" ".join(rng.choice(["ab", "Cd", "éf", "g"]) for _ in range(rng.randint(1, 4))) + rng.choice([".", ",", "", '?"', "a.b"]) for _ in range(12)]
    rows = [(k, "".join(rng.choice(bank) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    rows.append((61, "x" * 100_000 + " y. " * 30_000))
    pieces, seen = {}, {}
    for d, t in rows:  # words with the unit ends behind them, a word at a time
        units, words = [], []
        for line in t.split("\n"):
            for w in re.findall(r"[^\x20\x09-\x0D]+", line):
                words.append(w.lower())
                if re.search(r"""[.!?,;:]["')\]]*$""", w):
                    units.append(tuple(words))
                    words = []
            if words:
                units.append(tuple(words))
                words = []
        pieces[d] = units
        for k, u in enumerate(units):
            seen.setdefault(u, (d, k))
    for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), run_words=9).collect():
        gone, run = 0, []
        for k, u in enumerate([*pieces[r.doc_id], None]):
            if u is not None and seen[u] != (r.doc_id, k):
                run.append(len(u))
            else:
                gone, run = gone + (len(run) if sum(run) >= 9 else 0), []
        assert (r.n_units, r.n_removed) == (len(pieces[r.doc_id]), gone)
        t = dict(rows)[r.doc_id]
        cut = [t[a:b] for a, b in r.removed]
        assert len(" ".join(cut).split()) + len(r.text.split()) == len(t.split())


# mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 3, "b": 40, "c": 90}, {None: 60, "z": 10, "é": 70, "b": 5}, {"only": 30}, {"a": 1, "b": 1, "c": 500, "d": 2}])
def test_mix(spark, sizes):
    rows = [(100 * k + i, "w " * (1 + i % 90), s, 7) for k, (s, n) in enumerate(sizes.items()) for i in range(n)] + [(None, None, next(iter(sizes)), 7), (1, "", next(iter(sizes)), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    for bounds in ({}, {"shard_words": 600}, {"shard_docs": 20}):
        got = mixing.mix(df, block_words=4, **bounds).collect()
        assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df, block_words=4, **bounds).collect()))
        words = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sizes}
        target, taken = slow_targets(words), {}
        source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
        for r in got:
            s = source[r.doc_id, r.size]
            assert r.source_size == words[s] and r.target == pytest.approx(target[s], abs=1e-5) and r.taken <= 3 * r.size
            taken[s] = taken.get(s, 0) + r.taken
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 60
    assert mixing.mix(df.limit(0)).count() == 0


def test_seats_are_sainte_lague(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.5)]
    df = spark.createDataFrame([(s, 0, 1000, v) for s, v in votes], "source string, shard long, words long, votes double")
    got = {r.source: r.quota for r in mixing.apportion(df, 1).collect()}
    seats = {s: 0 for s, _ in votes}
    for _ in range(int(sum(v for _, v in votes) + 0.5)):
        best = max(votes, key=lambda x: x[1] / (2 * seats[x[0]] + 1))
        seats[best[0]] += 1
    assert got == seats


@pytest.mark.parametrize("accuracy", [100, 20_000])
def test_bracketed_seats_are_sainte_lague(spark, accuracy):
    import heapq
    import random

    rng = random.Random(4)
    units = [(f"s{i % 7}", i, 1000 * rng.randint(1, 40)) for i in range(400)]
    votes = [(s, k, w, w * (1.7 if s < "s3" else 0.6)) for s, k, w in units]
    df = spark.createDataFrame(votes, "source string, shard long, words long, votes double")
    got = {(r.source, r.shard): r.quota for r in mixing.apportion(df, 32, accuracy=accuracy).collect()}
    quota, queue = dict.fromkeys(got, 0), [(-v, s, k, v) for s, k, _, v in votes]
    heapq.heapify(queue)
    for _ in range(int(sum(v for *_, v in votes) / 32 + 0.5)):
        _, s, k, v = heapq.heappop(queue)
        quota[s, k] += 1
        heapq.heappush(queue, (-v / (2 * quota[s, k] + 1), s, k, v))
    assert got == quota


def test_long_text_in_a_mix(spark):
    rows = [(i, "w " * 30, "a") for i in range(50)] + [(99, "v " * 300_000, "b"), (99, "v " * 300_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.size for r in got if r.doc_id == 99] == [300_000] * 2 and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.doc_id != 99) == 3 * 1500
