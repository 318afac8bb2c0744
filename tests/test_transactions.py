"""Conditional transactions as checks, and the sets they ask about."""

from tidemark.operators import transactions as T


def test_conditions(spark):
    requests = spark.createDataFrame([(1, 10, 5, 7), (3, 10, 5, 7), (4, 11, 5, 7), (6, 99, 5, 8), (5, 1, 1, 1), (12, 10, 0, 8), (8, 1, 1, 7)], "request long, key long, revision long, session long")
    state = spark.createDataFrame([(10, 5), (11, 6)], "key long, revision long")
    done, live = spark.createDataFrame([(8,)], "request long"), spark.createDataFrame([(7,)], "session long")
    got = dict(map(tuple, T.judged(requests.select("request"), T.conditions(requests), state, done, live).collect()))
    assert got == {1: "commit", 3: "missing", 4: "revision", 6: "session", 5: "commit", 12: "missing", 8: "request seen"}
    assert T.judged(requests.limit(0).select("request"), T.conditions(requests.limit(0)), state, done, live).count() == 0
