"""Members without a match must not meet in one task."""

from tessera.operators import evidence


def test_places_are_joined_to_matches_before_members(spark):
    source = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 3, 5)], "id long, unit long, pos long")
    target = spark.createDataFrame([(11, 1), (12, 2), (14, 9)], "id long, pos long")
    matches = spark.createDataFrame([(1, 11), (2, 12), (3, 14), (4, 99)], "source_id long, target_id long")
    out = evidence.complete_sequences(matches, source, target)
    assert {tuple(r) for r in out.collect()} == {(1, 2, True), (2, 2, False), (3, 1, False)}
    outer = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(outer) == 2 and "target_id" not in outer[0] and "target_id" in outer[1]
