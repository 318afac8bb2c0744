"""Line dedup by passages: runs that repeat inside lines, against brute force."""

import random

import pytest

from tidemark.llm import linededup as L
from tidemark.llm.queries import QUERIES


def normal(text):
    return " ".join((text or "").lower().split())


@pytest.mark.parametrize("hot", [10_000, 3])
def test_passage_inside_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgéñ𝒳") for _ in range(rng.randint(2, 9)))
    words = lambda n: [word() for _ in range(n)]
    shared = words(70)
    rows = [(k, " ".join(words(rng.randint(3, 90))) + " " + (" " if k % 2 else "\n").join(shared).upper() + "  " + " ".join(words(rng.randint(3, 90)))) for k in range(6)]
    rows += [(20, " ".join(words(200))), (21, None), (22, ""), (None, "tail \n" + " ".join(shared)), (23, "ab cd " * 900), (24, "İ" + " ".join(shared)), (25, "漢" * 30 + "\nx"), (26, "y\n" + "漢" * 30)]
    got = L.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by, whole = {r.doc_id: r for r in got}, dict(rows)
    reach = L.REACH
    seen = {}
    for d, t in rows:
        n = normal(t)
        for i in range(len(n) - reach + 1):
            seen.setdefault(n[i : i + reach], set()).add(d)
    left = {d: normal(r.text) for d, r in by.items()}
    for run, of in seen.items():  # no two texts keep what they share; the first text keeps all of it
        if len(of) > 1:
            assert sum(run in left[d] for d in of) <= 1 and (run in left[0]) == (0 in of)
    assert by[0].text == whole[0] and by[20].text == whole[20] and by[21].text == by[22].text == ""
    for d, r in by.items():
        t = whole[d] or ""
        for a, b in r.removed:
            assert 0 <= a < b <= len(t)
        if not r.removed:
            assert r.text == t
    for k in range(1, 6):
        [span] = by[k].removed
        cut = whole[k][span[0] : span[1]]
        assert len(normal(" ".join(shared))) - 2 * L.WINDOW < len(normal(cut)) <= len(normal(" ".join(shared))) + 1
        assert by[k].text == whole[k][: span[0]] + whole[k][span[1] :]
    assert 0 < len(by[23].text) < 2 * reach
    assert by[26].text == "y" and by[25].text == rows[-2][1]
    assert L.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered():
    assert "op6_passage_dedup" in QUERIES


def test_picks_do_not_depend_on_slices(monkeypatch):
    import numpy as np

    points = np.random.default_rng(5).integers(97, 123, 5000).astype(np.uint32)
    want = L.picks(points).tolist()
    monkeypatch.setattr(L, "SLICE", 700)
    assert L.picks(points).tolist() == want
    for i in range(len(points) - L.REACH + 1):
        assert any(i <= p <= i + L.WINDOW - 1 for p in want[max(0, i // L.WINDOW - 1) :])
