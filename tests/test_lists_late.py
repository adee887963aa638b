"""References of paired owners travel as lists."""

from tessera.operators import voting


def test_positional_pairs_open_only_lists_that_count(spark):
    s = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 11, None), (2, 1, 12, "a"), (3, 1, 13, "a"), (3, 2, 14, "b"), (4, 1, 15, "c")], "owner long, ord int, ref long, kind string")
    t = spark.createDataFrame([(5, 1, 20, "a"), (5, 2, 21, None), (6, 1, 22, "a"), (7, 1, 23, "a"), (8, 1, 24, "c"), (9, 2, 25, "c")], "owner long, ord int, ref long, kind string")
    pairs = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8), (4, 9), (4, 77)], "source_id long, target_id long")
    out = voting.positional_pairs(pairs, s, t)
    assert {tuple(r) for r in out.collect()} == {(12, 22), (15, 24)}
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
