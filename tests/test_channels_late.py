"""Candidates are ranked by all scores in one pass, in tasks of bounded size."""

from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import evidence


def test_alternatives_by_several_scores(spark):
    rows = spark.createDataFrame([(1, 1, 9, 1), (1, 2, 9, 5), (1, 3, 2, 5), (1, 4, 1, 4), (2, 1, None, 3), (2, 1, None, 3)], "unit long, candidate long, percent int, weight int")
    out = evidence.chosen_alternatives(rows, "unit", ["percent", "weight"], 1)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 9, 1), (1, 2, 9, 5), (2, 1, None, 3)}
    assert out.count() == 3
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_two_channels_follow_the_lines(spark, tmp_path):
    line = {"l_orderkey": F.col("id") % 400_000, "l_partkey": F.col("id"), "l_quantity": F.lit(1.0), "l_extendedprice": F.lit(2.0)}
    spark.range(1_100_000).select(*(c.alias(n) for n, c in line.items())).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert queries.two_channel_choice(spark, str(tmp_path)).rdd.getNumPartitions() == 3
