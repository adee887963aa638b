"""Fingerprints are joined to the best pairs only, with the same outcome as on all pairs."""

import random

from tessera.operators import voting


def test_described_after_ranking_equals_described_before(spark):
    rng = random.Random(3)
    votes = spark.createDataFrame([(rng.randrange(12), rng.randrange(12), rng.choice([0.5, 1.0])) for _ in range(60)], "source_id long, target_id long, weight double")
    prints = [
        spark.createDataFrame([(k, f"h{k % 3}", "ab"[k % 2], rng.randrange(1, 40), 1 + k % 4, k % 5) for k in range(12)], "id long, hash string, shape string, size long, calls long, data long")
        for _ in range(2)
    ]
    tallied = voting.tally(votes)
    before = voting.accepted(voting.described(tallied, *prints), 0.0)
    best = voting.mutual_best(voting.plausible_only(tallied, *prints))
    after = voting.confident(voting.described(best, *prints), 0.0).select(*before.columns)
    assert before.count() > 0
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before.collect()))
