"""Groups searched to their own fixpoint, against rounds over whole tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import anchors, voting
from tessera.plans import fixpoint


def test_closed_groups_reach_the_same_fixpoint_without_jobs_by_rounds(spark, tmp_path):
    rng, begin = random.Random(3), datetime(2024, 1, 1)
    data = [
        (k, rng.choice([1, 2, 3, 4, 5, None]), begin + timedelta(seconds=rng.randint(0, 40)), rng.choice(["click", "view", "login"]), rng.choice([None, 3.0, 4.5, 11.0, 26.0, 44.0, 90.0]))
        for k in range(240)
    ]
    spark.createDataFrame(data, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    tracker, group = spark.sparkContext.statusTracker(), "closed groups"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = sorted(tuple(r) for r in queries.propagate_fixpoint(spark, str(tmp_path)).collect())
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    rows = queries.event_entities(spark, str(tmp_path)).cache()
    source, target = (queries.version(rows, "id", v) for v in (0, 1))
    sites = [queries.event_calls(side) for side in (source, target)]
    callers = sites[0].withColumn("side", F.lit("s")).unionByName(sites[1].withColumn("side", F.lit("t"))).select("side", F.col("owner").alias("caller"), "callee")
    places = [side.select("user_id", "id", "pos") for side in (source, target)]
    voters = [
        lambda m: voting.call_site_votes(m, *sites),
        lambda m: voting.sole_caller_votes(m, callers),
        lambda m: voting.layout_votes(m.select("source_id", "target_id"), *places, ["user_id"]),
    ]
    prints = [side.select("id", F.col("name").alias("hash"), F.col("event_type").alias("shape"), "size", F.lit(1).alias("calls"), F.lit(1).alias("data")) for side in (source, target)]
    want = fixpoint.propagate(anchors.one_to_one(source, target, "name", "name", 1.0), voters, *prints)
    assert got == sorted(tuple(r) for r in want.collect())
    assert max(r[5] for r in got) >= 2
    assert jobs <= 6, jobs
