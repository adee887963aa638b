"""Chains with their runner-up, gaps between placed neighbours, and joins of long ranges."""

import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import boundary, intervals, sequence


def every_chain(edges):
    for k in range(1, len(edges) + 1):
        for c in combinations(range(len(edges)), k):
            if all(edges[a][0] < edges[b][0] and edges[a][1] < edges[b][1] for a, b in zip(c, c[1:], strict=False)):
                yield c


def test_best_and_second_chain_equal_all_chains():
    rng = random.Random(4)
    for _ in range(400):
        edges = sorted((rng.randrange(6), rng.randrange(6), float(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9)))
        picked, score, second = sequence.best_chain(edges)
        ranked = sorted(((len(c), sum(edges[e][2] for e in c), c) for c in every_chain(edges)), reverse=True)
        assert (len(picked), score) == ranked[0][:2]
        others = [w for n, w, c in ranked if n == len(picked) and c != tuple(picked)]
        assert second == max(others, default=0.0)


def test_a_runner_up_leaves_out_each_chosen_edge_at_a_time():
    edges = [(0, 0, 2.0), (1, 1, 3.0), (1, 2, 2.5), (2, 3, 4.0)]
    picked, score, second = sequence.best_chain(edges)
    without = [sequence.best_chain([x for k, x in enumerate(edges) if k != e]) for e in picked]
    assert (picked, score) == ([0, 1, 3], 9.0)
    assert second == max(w for p, w, _ in without if len(p) == 3) == 8.5
    assert sequence.best_chain([]) == ([], 0.0, 0.0)


def test_a_hundred_thousand_edges_take_no_quadratic_time():
    rng = random.Random(2)
    edges = sorted((rng.randrange(50_000), rng.randrange(50_000), rng.random()) for _ in range(100_000))
    began = time.process_time()
    picked, score, second = sequence.best_chain(edges)
    assert time.process_time() - began < 40
    assert len(picked) > 500 and score >= second > 0
    assert all(edges[a][0] < edges[b][0] and edges[a][1] < edges[b][1] for a, b in zip(picked, picked[1:], strict=False))


RANGE = "section string, unit string, start long, end long, auto boolean"
MATCH = "source_id long, target_id long, confidence double, tier string, runner_up long, share double"


def tables(spark, matches, target_ranges, sizes=(200, 200, 200, 200)):
    source = [(k, "m", k) for k in range(len(sizes) + 1)]
    at, target = 100, []
    for k, s in enumerate(sizes):
        target.append((k, "t", k, at, at + s))
        at += s
    ranges = [("t", "a", 0, 100, False), ("t", "m", 100, 900, False), ("t", "z", 900, 1000, False)]
    anchors = [("m", "t", s, e, e - s) for _, _, _, s, e in target[:2]]
    return (
        spark.createDataFrame(ranges, RANGE), spark.createDataFrame(target_ranges, RANGE), spark.createDataFrame(source, "id long, unit string, pos long"),
        spark.createDataFrame(target, "id long, section string, pos long, start long, end long"), spark.createDataFrame(matches, MATCH),
        spark.createDataFrame(anchors, "unit string, section string, start long, end long, size long"),
    )


PLACED = [("t", "a", 0, 100, False), ("t", "z", 900, 1000, False)]
ALL = [(k, k, 0.9, "exact", None, None) for k in range(4)]


def one(spark, *args, **more):
    found = boundary.boundary_sequences(*tables(spark, *args), **more).collect()
    assert len(found) <= 1
    return found[0] if found else None


def test_a_filled_gap_is_accepted(spark):
    r = one(spark, ALL, PLACED)
    assert r.eligible and r.method == "matched-sequence" and r.reasons == []
    assert (r.start, r.end, r.aligned, r.aligned_bytes, r.direct_anchors, r.margin) == (100, 900, 4, 800, 2, 1.0)


def test_an_empty_an_ambiguous_and_a_foreign_gap_are_not(spark):
    empty = one(spark, [(0, 99, 0.9, "exact", None, None)], PLACED)
    assert not empty.eligible and empty.aligned == 0 and {"few_functions", "few_matched", "out_of_order", "close_alternative"} <= set(empty.reasons)
    close = one(spark, [*ALL[:3], (3, 3, 0.9, "exact", 4, 0.95)], PLACED)
    assert close.reasons == ["close_alternative"] and close.margin == round(1 - (3 + 0.95) / 4, 3)
    better = one(spark, [*ALL[:3], (3, 3, 0.9, "exact", 4, 1.2)], PLACED)
    assert better.reasons == ["out_of_order", "close_alternative", "needs_alternative"]
    owned = one(spark, ALL, [*PLACED, ("t", "b", 300, 308, False)])
    assert owned.method == "matched-sequence" and not owned.eligible and owned.reasons == ["other_owner"]


def test_gaps_need_two_explicit_neighbours_placed_once(spark):
    assert one(spark, ALL, [("t", "a", 0, 100, True), PLACED[1]]) is None
    assert one(spark, ALL, [*PLACED, ("t", "a", 2000, 2100, False)]) is None
    assert one(spark, ALL, [("t", "a", 900, 1000, False), ("t", "z", 0, 100, False)]) is None
    assert one(spark, ALL, [*PLACED, ("t", "b", 300, 308, True)]).eligible


def test_layout_support_accepts_what_matches_do_not(spark):
    anchors = [("t", "m", "g", 10 * k, 100 + 200 * k, 300 + 200 * k, 300, 5, 4, 1200, 20) for k in range(4)]
    schema = "section string, unit string, layout_group string, source_start long, start long, end long, size long, changed long, group_functions long, group_bytes long, group_changed long"
    few = ALL[:1]
    r = one(spark, few, PLACED, layouts=spark.createDataFrame(anchors, schema))
    assert r.eligible and (r.method, r.layout_group) == ("layout-corroborated-boundary", "g")
    swapped = [(*a[:3], -a[3], *a[4:]) for a in anchors]
    assert not one(spark, few, PLACED, layouts=spark.createDataFrame(swapped, schema)).eligible
    missing = [(*a[:8], 5, *a[9:]) for a in anchors]
    assert not one(spark, few, PLACED, layouts=spark.createDataFrame(missing, schema)).eligible


def test_joins_of_very_long_ranges_cost_a_few_rows(spark):
    rng = random.Random(5)
    left = [(1, s, s + rng.choice((1, 7, 300, 1 << 20, 1 << 40))) for s in (rng.randrange(1 << 41) for _ in range(60))] + [(1, -5, 1 << 45), (1, 3, 3)]
    right = [(1, s, s + rng.choice((1, 5000, 1 << 30))) for s in (rng.randrange(1 << 41) for _ in range(60))] + [(1, -(1 << 50), 1 << 50)]
    a = spark.createDataFrame(left, "k int, start long, end long")
    b = spark.createDataFrame(right, "k int, start2 long, end2 long")
    got = sorted((r.start, r.end, r.start2, r.end2) for r in intervals.overlapping(a, b, ["k"]).collect())
    assert got == sorted((s, e, x, y) for _, s, e in left if s < e for _, x, y in right if s < y and x < e)
    points = [(1, i, rng.randrange(1 << 41)) for i in range(50)]
    held = [(1, f"u{i}", s, e) for i, (_, s, e) in enumerate(left[:-2])]
    out = intervals.owners_at(spark.createDataFrame(points, "k int, id int, at long"), spark.createDataFrame(held, "k int, unit string, start long, end long"), ["k"])
    for r in out.collect():
        owners = [u for _, u, s, e in held if s <= r["at"] < e]
        assert r.owner == (owners[0] if len(owners) == 1 else None)
    level = intervals._bins(a.where("start < end"), F.col("start"), F.col("end") - 1, 256, F.lit(0), "own")
    assert level.groupBy("start", "end").count().agg(F.max("count")).first()[0] <= 18
