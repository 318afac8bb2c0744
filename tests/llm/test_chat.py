"""Chat windows: budget, history, masks, escapes, and what is read back, against plain Python."""

import hashlib
import os
import random

import pytest

from tidemark.llm import chat as C

DIR = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def want(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nx", "\\", "\\\\<", "a\\<|end|>", "[<\\n]\n\n", "<", "é𝒳<|"])
def test_escapes(text):
    assert C.unescape(C.escape(text)) == text
    for role in ("assistant", "a\nb<|end|>", "\\n", ""):
        marked, a, b = C.render(role, text)
        assert C.unescape(marked[a:b]) == text and C.parse(marked * 2) == [(role, text)] * 2
        assert marked.count("<") == 2 and "[" not in marked


def test_windows_keep_to_the_budget():
    rng = random.Random(3)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant"]), "w " * rng.randint(0, 30)) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.5:
            turns.insert(0, ("system", "s " * 5))
        count = lambda x: len(x.split())
        size = lambda r, t: count(C.render(r, t)[0])
        got = list(C.windows([(r, t, size(r, t)) for r, t in turns], 60, 20))
        system = turns[0][0] == "system"
        own = []
        for n, first, n_system, n_history, n_own, tokens, text, loss in got:
            parts = C.parse(text)
            assert len(parts) == n_system + n_history + n_own and n_system == system
            assert count(text) == tokens and (tokens <= 60 or n_own == 1)
            assert sum(size(r, t) for r, t in parts[n_system : n_system + n_history]) <= 20
            assert parts[n_system : n_system + n_history] == own[len(own) - n_history :] and first == len(own)
            own += parts[n_system + n_history :]
            assert [C.unescape(text[s["start"] : s["end"]]) for s in loss] == [t for r, t in parts[n_system + n_history :] if r == "assistant"]
        assert own == turns[system:]


def test_odd_rows(spark):
    rows = [(1, 0, "system", None, "x"), (1, 1, "user", "hi", "x"), (1, 1, "user", "hi", "x"), (1, 2, "assistant", "<|end|>\\", "x"), (2, 5, None, "no role", "x"), (3, 0, "system", "only", "x"), (None, 0, "assistant", "lost", "x")]
    rows += [(4, i, ("user", "assistant")[i % 2], "long " * (3000 if i == 3 else 200), "x") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    formed = C.form(df).cache()
    assert formed.filter("conv_id = 4").count() > 5
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(formed).collect()}
    by = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: want(ts) for c, ts in by.items()}
    assert C.read_back(C.form(df.limit(0))).count() == 0


def test_written_windows_keep_to_the_budget(spark):
    """By the tokens of the text itself, with the real vocabulary."""
    rows = [(1, i, ("user", "assistant")[i % 2], "ok" if i % 3 else "[<\\\n" * (i % 7)) for i in range(3000)]
    rows += [(2, i, "user", "word " * 900 + "x" * (i % 5)) for i in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if os.path.isdir("/root/testdata/sf0.01"):
        turns = turns.unionByName(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(turns.columns))
    count = C.counter(pytest.importorskip("public_tokenizers").path(C.TOKENS))
    several = 0
    for w in C.form(turns).collect():
        n = count(w.text)
        assert n <= w.tokens and (n <= C.BUDGET or w.n_own == 1)
        several += w.n_own > 1
    assert several > 50


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
def test_table(spark):
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{DIR}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {r.conv_id: tuple(r)[1:5] for r in C.query(spark, DIR).collect()} == {c: want(ts) for c, ts in by.items()}
