"""A small source of short documents meets its target beside a source of many shards."""

import pytest

from tidemark.llm import mixing


@pytest.mark.parametrize("size", [5, 10, 20])
def test_target_of_a_small_source(spark, size):
    big = [(i, "w " * 50, "b") for i in range(400)]
    rows = big + [(1000 + i, "v " * size, "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(df, shard_words=200).collect() if r.size == size]
    assert len(got) == 30
    assert abs(sum(r.taken for r in got) - 3 * 30 * size) <= 96
    if size == 5:
        tiny = spark.createDataFrame([*big, (1, "v " * size, "a")], "doc_id long, text string, source string")
        assert [r.taken for r in mixing.mix(tiny, shard_words=200).collect() if r.size == size] == [15]
        assert len([r for r in mixing.repeated(tiny).collect() if r.source == "a"]) == 3


@pytest.mark.parametrize("size", [5, 10, 20])
def test_shards_follow_the_source(spark, size):
    rows = [(i, "w " * 50, "b") for i in range(400)] + [(1000 + i, "v " * size, "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.taken for r in mixing.mix(df, shard_words=1000).collect() if r.size == size]
    assert abs(sum(got) - 3 * 30 * size) <= 112
