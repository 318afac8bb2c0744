"""N-best segmentation against all segmentations, decoding, odd rows."""

import os
import random
from array import array

import pytest

from tidemark.llm import nbest as B

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(B.MODEL)


@pytest.fixture(scope="module")
def pieces():
    return B.Pieces(PATH)


def all_ways(p, s):
    """Scores of all segmentations of a text with its mark."""
    if not s:
        return [0.0]
    out = []
    for k in range(1, len(s) + 1):
        if s[:k] in p.of and "\0" not in s[:k]:
            out += [p.of[s[:k]][1] + x for x in all_ways(p, s[k:])]
    if s[0] not in p.of:
        out += [p.unknown + x for x in all_ways(p, s[1:])]
    return out


@pytest.mark.parametrize("text", ["a", "the", " the", "a  b", "line\nend", "ñ▁o", "漢字 x", "hello you", "\n\n", "tothe in"])
def test_all_ways(pieces, text):
    s = (" " + text).replace(B.MARK, "\0").replace(" ", B.MARK)
    want = sorted(all_ways(pieces, s), reverse=True)
    for n in (1, 2, 6):
        got = pieces.encode(text, n)
        assert [x for x, _ in got] == pytest.approx(want[:n])
        assert len({i for _, i in got}) == len(got)
        for score, ids in got:
            assert pieces.decode(ids) == text


def test_scores_are_of_the_ids(pieces):
    for text in ("Anblewh sttible athawh thonre was is anly", "Ñcillra la de.\nOs los", "🙂 ok"):
        for score, ids in pieces.encode(text, 5):
            plain = [i for i in array("I", ids) if i not in pieces.byte_of]
            scores = {i: s for i, s in pieces.of.values()}
            unknown = len([c for c in text if c.replace(" ", B.MARK) not in pieces.of])
            assert score == pytest.approx(sum(scores[i] for i in plain) + unknown * pieces.unknown)


def test_cheapest():
    costs = [[0, 1, 4], [0, 2], [0, 2.5, 2.6]]
    want = sorted(a + b + c for a in costs[0] for b in costs[1] for c in costs[2])
    assert [x for x, _ in B.cheapest(costs, 100)] == want


def test_long_run(pieces):
    text = "th" * 20_000
    got = pieces.encode(text, 3)
    assert got[0][0] >= got[1][0] >= got[2][0] and all(pieces.decode(i) == text for _, i in got)


def test_odd_rows(spark):
    rows = [(1, "some words", 1), (1, "some words", 1), (None, None, 1), (2, "", 1), (3, "a▁b\t\0 ́", 1)]
    got = B.segment(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].n_pieces == by[2].n_pieces == 0 and by[2].score == 0
    assert B.segment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_table(spark):
    got = B.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.round_trip and len(r.nbest) == B.N and r.nbest[0].score == r.score for r in got)


def test_small_memory_gives_the_same(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None]
    want = list(B.Pieces(PATH).encode_batch(texts))
    monkeypatch.setattr(B, "REMEMBER", 30)
    p, got = B.Pieces(PATH), []
    for i in range(0, len(texts), 5):
        got += p.encode_batch(texts[i : i + 5])
    assert got == want


def test_long_pieces(monkeypatch):
    """A vocabulary with pieces of 40 characters: places and lengths don't run into each other."""
    p = B.Pieces(PATH)
    score = max(s for _, s in p.of.values())
    p.of = dict(p.of) | {B.MARK + "ab" * 20: (31_999, score), "ab" * 17: (31_998, score)}
    p.starts = {x[:k]: None for x in p.of for k in range(1, len(x) + 1)} | p.of
    p.index_prefixes()
    monkeypatch.setattr(B, "LONG", 200)
    for text in ("ab" * 20, "ab" * 17 + "c", "ab" * 60):
        got = next(p.encode_batch([text], 2))
        s, best = p.marked(" " + text), p.forward(p.marked(" " + text))[0]
        assert got[0][0] == pytest.approx(best[-1]) and len(s) > 32
