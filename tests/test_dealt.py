from pyspark.sql import functions as F

from tessera.operators import graph, voting


def test_joins_on_the_keys_move_the_other_side_only(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    other = spark.range(0, 2000, 2).withColumn("y", F.col("id") * 3)
    held = graph.dealt(rows, "id")
    try:
        both = held.hint("merge").join(other, "id")
        assert sorted(both.collect()) == sorted(rows.join(other, "id").collect())
        final = both._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
        assert final.count("ENSURE_REQUIREMENTS") == 1, final
    finally:
        held.unpersist()
    assert not held.is_cached


def test_a_sole_caller_may_call_twice_and_a_matched_one_does_not_count(spark):
    calls = spark.createDataFrame([("s", 1, 10), ("s", 1, 10), ("s", 20, 10), ("t", 2, 11), ("t", 2, 11), ("s", 3, 12), ("s", 5, 12), ("t", 4, 13)], "side string, caller long, callee long")
    matches = spark.createDataFrame([(10, 11, 0.9), (12, 13, 0.9), (20, 21, 0.9)], "source_id long, target_id long, confidence double")
    assert [tuple(r) for r in voting.sole_caller_votes(matches, calls).collect()] == [(1, 2, 0.45)]
