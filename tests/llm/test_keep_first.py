"""One row of every near-duplicate component stays, whatever the ids."""

from tidemark.llm import simhash as S


def test_ids_that_do_not_tell_rows_apart(spark):
    rows = [(None, f"lone text {i} of words {i * 7} here {i * 31} now") for i in range(6)]
    rows += [(4, "the same id with these words"), (4, "quite other words under one number"), (None, "The same id  with these words")]
    got = S.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame(rows[:8], "doc_id long, text string").collect()]))
