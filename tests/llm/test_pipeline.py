"""The pipeline on a small fixture: what each stage keeps, and that its decisions take effect."""

import os
import random
import re

import pytest

import corpus_pipeline as C

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "to", "re", "lin", "mo"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(60), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[5][1], "en", "s0"), (101, rows[6][1] + " end", "en", "s1")]  # an exact and a near copy
    rows += [(102, "too short", "en", "s0"), (103, "same words here again now " * 20, "en", "s1"), (104, None, None, None), (105, "", "en", None)]
    rows += [(106, text(50) + " mail joe.1@mail.example.com " + text(10), "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark):
    docs = spark.createDataFrame(fixture(), COLUMNS)
    seen = []
    for _, step in C.STAGES[:-1]:
        docs = C.stage(step(spark, docs, ""), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    ids = [{r.doc_id for r in x} for x in seen]
    assert ids[0] == set(range(60)) | {100, 101, 106}
    assert ids[1] >= set(range(60)) | {106} and 100 not in ids[1] and len(seen[1]) == len(ids[1])
    mails = {r.doc_id: r.text for r in seen[2]}
    assert "<EMAIL>" in mails[106] and "@" not in mails[106] and len(seen[2]) == len(seen[1])
    words = {}
    for r in seen[3]:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    total = sum(len(r.text.split()) for r in seen[2])
    for source, share in (("s0", 5 / 8), ("s1", 2 / 8), ("s2", 1 / 8)):
        assert abs(words[source] - share * total) < 0.06 * total
    last = C.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == len(seen[3]) and all(r.round_trip for r in last)


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, step in C.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0


def test_ids_and_columns_that_clash(spark):
    """Null and repeated ids, and columns named like those of the stages: no row of a text of its own is lost."""
    rows = [(None if i % 3 == 0 else i % 4, f"{r[1]} number {i}", "en", "s", 1, "a", 2) for i, r in enumerate(fixture()[:60])]
    docs = spark.createDataFrame(rows, COLUMNS + ", place string, kept int")
    for name, step in C.STAGES[:3]:
        docs = C.stage(step(spark, docs, ""), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "kept"] and docs.count() == 60, name
    mixed = C.STAGES[3][1](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == 60
    assert C.STAGES[4][1](spark, mixed, "").filter("round_trip").count() == 60


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_run(spark):
    """The stages on the table, each against a plain version over what the one before kept."""
    from test_pii import slow
    from test_simhash import slow_components, slow_print

    from tidemark.llm import mixing, quality

    docs = C.table(spark, "/root/testdata/sf0.001", "documents")
    good = C.stage(C.keep_quality(spark, docs, ""), "t")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    label = slow_components([slow_print(t) for _, t in rows])
    single = C.stage(C.drop_near_duplicates(spark, good, ""), "t")
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k][0] for k in label})
    masked = C.stage(C.mask_personal_data(spark, single, ""), "t")
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        assert not slow(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    mixed = C.stage(C.mix_sources(spark, masked, ""), "t")
    times = {r.doc_id: (2 * r.taken + r["size"]) // (2 * r["size"]) for r in mixing.mix(masked).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in times.items() if n}
    got = C.run(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == mixed.count() and all(r.round_trip for r in got)
