"""Literal cases of the operators, and invariance to how rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import anchors, fuzzy, graph, intervals, islands, resolve, score, sequence, transactions, voting
from tessera.plans import fixpoint, stages


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def spans(spark, *data):
    return spark.createDataFrame([(1, *d) for d in data] or [(0, 1, 1, "-")], "k int, start long, end long, unit string").where("start < end or unit <> '-'")


def cover(data):
    return {x for a, b, *_ in data for x in range(a, b)}


def test_touching_ranges_merge_and_overlap_does_not_include_touching(spark):
    r = spans(spark, (0, 5, "a"), (5, 8, "b"), (10, 12, "a"))
    assert rows(intervals.merged(r, ["k"]), "start", "end") == [(0, 8), (10, 12)]
    other = r.select("k", F.col("unit").alias("unit2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    one = r.where("start = 0").select("k", "start", "end")
    assert rows(intervals.overlapping(one, other, ["k"], width=2), "start2") == [(0,)]
    assert rows(intervals.overlapping(one, other, ["k"], width=2, touching=True), "start2") == [(0,), (5,)]


def test_range_algebra_against_sets_of_positions(spark):
    rng = random.Random(1)
    a, b = ([(s, s + rng.randrange(0, 9), "u") for s in rng.sample(range(80), 12)] for _ in range(2))
    x, y = spans(spark, *a), spans(spark, *b)
    for f, want in ((intervals.intersect, cover(a) & cover(b)), (intervals.difference, cover(a) - cover(b))):
        assert cover(rows(f(x.repartition(3), y, ["k"]), "start", "end")) == want
    assert cover(rows(intervals.merged(x, ["k"]), "start", "end")) == cover(a)


def test_owner_is_null_for_several(spark):
    r = spans(spark, (0, 600, "a"), (500, 700, "b"))
    points = spark.createDataFrame([(1, i, at) for i, at in enumerate((0, 499, 500, 650, 700))], "k int, id long, at long")
    assert [x[1] for x in rows(intervals.owners_at(points, r, ["k"]), "id", "owner")] == ["a", "a", None, "b", None]


def test_transfer_of_a_boundary_move(spark):
    before = spans(spark, (0x1000, 0x1100, "P"), (0x1100, 0x1500, "B"))
    after = spans(spark, (0x1000, 0x1100, "P"), (0x1100, 0x1300, "A"), (0x1300, 0x1500, "B"))
    assert rows(intervals.transfers(before, after, ["k"]), "start", "end", "from_unit", "to_unit") == [(0x1100, 0x1300, "B", "A")]


def test_runs_bridge_only_where_the_unit_resumes(spark):
    def of(units, candidates=None, claimed=()):
        data = [(1, i, i, u, 100, (candidates or {}).get(i), i in claimed) for i, u in enumerate(units)]
        r = spark.createDataFrame(data, "k int, o int, at long, unit string, size long, candidate string, claimed boolean")
        return rows(islands.bridged_runs(r.repartition(4), ["k"], ["o"]), "unit", "members", "bridged")

    long = ["a", None, "a", None, "b", None, None, None, None, None, None, "b", "c"]
    assert of(long) == [("a", 3, 100), ("b", 1, 0), ("b", 1, 0), ("c", 1, 0)]
    # a candidate of the same unit starts the budget anew, one of another blocks, as a claim does where nothing names the unit
    assert of(long, {8: "b"}) == [("a", 3, 100), ("b", 8, 600), ("c", 1, 0)]
    assert of(long, {8: "b", 9: "c"}) == of(long)
    assert of(long, {8: "b"}, {6}) == of(long)
    assert of(long, {8: "b"}, {8}) == of(long, {8: "b"})


def test_anchors_need_keys_unique_on_both_sides(spark):
    s = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "id long, name string")
    t = spark.createDataFrame([(11, "x"), (12, "y"), (13, None)], "id long, name string")
    assert rows(anchors.one_to_one(s, t, "name", "name", 1.0), "source_id", "target_id") == [(1, 11)]


def test_disagreeing_literals_give_nothing(spark):
    s = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "id long, literal string")
    t = spark.createDataFrame([(11, "p"), (12, "q"), (13, "r")], "id long, literal string")
    assert rows(anchors.by_literals(s, t), "source_id", "target_id") == [(2, 13)]


def test_ties_are_deferred(spark):
    v = spark.createDataFrame([(1, 11, 1.0), (1, 12, 1.0), (2, 13, 0.5), (2, 13, 0.25), (3, 13, 0.5)], "source_id long, target_id long, weight double")
    got = rows(voting.mutual_best(voting.tally(v.repartition(3))), "source_id", "target_id", "weight", "votes", "margin")
    assert got == [(2, 13, 0.75, 2, round(1 - 0.5 / 0.75, 6))]


def test_equal_gaps_pair_positions(spark):
    side = lambda base, n: spark.createDataFrame([("s", base + i, i) for i in range(1, n + 1)], "k string, id long, pos long")
    m = spark.createDataFrame([(101, 201), (104, 204), (106, 207)], "source_id long, target_id long")
    got = rows(voting.layout_votes(m, side(100, 8), side(200, 8), ["k"]), "source_id", "target_id")
    assert got == [(102, 202), (103, 203)]


def test_positional_pairs_are_all_or_nothing(spark):
    s = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 11, "b"), (2, 1, 12, "a"), (2, 2, 13, "a")], "owner long, ord int, ref long, kind string")
    t = spark.createDataFrame([(5, 1, 20, "a"), (5, 2, 21, "b"), (6, 1, 22, "a"), (6, 2, 23, "b")], "owner long, ord int, ref long, kind string")
    pairs = spark.createDataFrame([(1, 5), (2, 6)], "source_id long, target_id long")
    assert rows(voting.positional_pairs(pairs, s, t), "source_ref", "target_ref") == [(10, 20), (11, 21)]


def test_propagation_reaches_a_fixpoint(spark):
    start = spark.createDataFrame([(1, 11, "name", 1.0)], "source_id long, target_id long, method string, confidence double")
    edges = spark.createDataFrame([(i, i + 1, i + 10, i + 11) for i in range(1, 5)], "s long, s2 long, t long, t2 long")
    found = spark.createDataFrame([(i, f"h{i % 10}", "x", 9 if i != 20 else 90, 1, 1) for i in range(1, 21)], "id long, hash string, shape string, size long, calls long, data long")

    def follow(matches):
        hit = matches.join(edges, (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")))
        return hit.select(F.col("s2").alias("source_id"), F.col("t2").alias("target_id"), F.lit(1.0).alias("weight"))

    got = rows(fixpoint.propagate(start, [follow], found, found), "source_id", "target_id", "round")
    assert got == [(i, i + 10, i - 1) for i in range(1, 6)]
    with pytest.warns(UserWarning):
        assert fixpoint.propagate(start, [follow], found, found, rounds=2).count() == 3


def test_confidence_and_plausibility_of_votes(spark):
    v = spark.createDataFrame([(1, 11, 1.0, 1), (2, 12, 2.0, 2), (3, 13, 3.0, 6), (4, 14, 1.0, 1), (4, 13, 1.5, 3)], "source_id long, target_id long, weight double, votes long")
    make = lambda *r: spark.createDataFrame(list(r), "id long, hash string, shape string, size long, calls long, data long")
    source = make((1, "a", "x", 4, 1, 1), (2, "b", "x", 10, 2, 2), (3, "c", "y", 10, 2, 4), (4, "d", "z", 100, 1, 1))
    target = make((11, "a", "x", 4, 1, 1), (12, "bb", "x", 10, 2, 2), (13, "cc", "yy", 5, 1, 1), (14, "dd", "z", 20, 1, 1))
    got = {r.source_id: r for r in voting.accepted(voting.described(v, source, target)).collect()}
    assert got[1].confidence == 0.98 and got[1].distinct
    assert got[2].similarity == 1.0 and got[2].confidence == round(min(0.95, 0.45 + 0.2 + 0.2 * 2 / 3 + 0.15), 6)
    alike = 0.2 * 0.5 + 0.15 * 0.5 + 0.15 * 0.25
    assert got[3].similarity == round(alike, 6) and got[3].confidence == round(0.45 + 0.2 * round(alike, 6) + 0.2 + 0.15, 6)
    assert 4 not in got  # 100 and 20 or 5 are too far apart, so pair (4, 13) is no rival of (3, 13) either


def test_call_sites_align_between_fixed_points(spark):
    calls = lambda owner, *c: [(owner, i, x) for i, x in enumerate(c)]
    s = spark.createDataFrame(calls(1, 3, 4, 5, 6, 7, 8) + calls(2, 3, 9), "owner long, ord int, callee long")
    t = spark.createDataFrame(calls(11, 13, 14, 15, 99, 16, 17) + calls(12, 13), "owner long, ord int, callee long")
    m = spark.createDataFrame([(1, 11, 0.9), (2, 12, 0.8), (5, 15, 1.0), (7, 16, 1.0)], "source_id long, target_id long, confidence double")
    got = rows(voting.call_site_votes(m, s, t), "source_id", "target_id", "weight")
    # before 5 and 15 both have two calls, then one each, then one each; owner 2 has two against one
    assert got == [(3, 13, 0.9), (4, 14, 0.9), (6, 99, 0.9), (8, 17, 0.9)]


def test_margin_rule(spark):
    data = [("sole", 99.5, 1.0, 1), ("two", 99.5, 1.0, 2), ("strong", 85.0, 31.0, 0), ("some", 70.0, 15.0, 0), ("weak", 69.0, 40.0, 0)]
    b = spark.createDataFrame(data, "k string, percent double, margin double, exact long")
    assert dict(rows(fuzzy.decided(b), "k", "verdict")) == {"sole": "sole-exact", "two": "undecided", "strong": "confident", "some": "probable", "weak": "undecided"}


def test_size_bins_lose_no_pair(spark):
    rng = random.Random(5)
    a, b = ([("g", i, rng.randrange(1, 4000)) for i in range(60)] for _ in range(2))
    make = lambda x: spark.createDataFrame(x, "group string, id long, size long")
    want = sorted((i, j) for _, i, x in a for _, j, y in b if max(x, y) <= 2.5 * min(x, y))
    assert sorted((r.a_id, r.b_id) for r in fuzzy.size_compatible(make(a), make(b)).collect()) == want


def test_resolution_reasons(spark):
    p = [("o1", "n1", "u", 2), ("o1", "n2", "v", 2), ("o2", "n3", "u", 2), ("o2", "n4", "u", 1), ("o3", "n5", "u", 2), ("o4", "o5", "u", 2), ("o5", "n6", "u", 2), ("o6", "n7", "u", 2), ("o7", "n7", "u", 2)]
    proposals = spark.createDataFrame(p, "old string, new string, unit string, strength int")
    p += [("o8", "n8", "u", 2), ("o9", "n6", "u", 2), ("o10", "o11", "u", 2)]
    proposals = spark.createDataFrame(p, "old string, new string, unit string, strength int")
    names = spark.createDataFrame([(f"o{i}", i) for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)] + [("o11", 10)], "name string, place int")
    defined = spark.createDataFrame([("n6", "other"), ("n3", "u"), ("n8", "u")], "name string, unit string")
    owners = spark.createDataFrame([(5, "u"), (8, "u")], "place int, unit string")
    assert dict(rows(resolve.resolved(proposals, names, defined, owners), "old", "status")) == {
        "o8": "resolved", "o9": "resolved", "o10": "resolved",  # o9's place has no owner; o11 is another name of o10's place
        "o1": "units disagree", "o2": "resolved", "o3": "not in symbols file", "o4": "name already taken",
        "o5": "name defined by another unit's source", "o6": "name claimed by several symbols", "o7": "name claimed by several symbols",
    }


def test_components_of_chains_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 61), (61, 60)], "a long, b long")
    nodes = spark.range(70).withColumnRenamed("id", "node")
    got = dict(rows(graph.components(links, nodes), "node", "component"))
    assert {got[i] for i in range(41)} == {0} and got[61] == 60 and got[65] == 65
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e")], "before string, after string")
    back = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(5, 2), (9, 0), (7, 9)], "before long, after long")
    assert dict(rows(graph.strongly_connected(back), "unit", "component")) == {**{i: 0 for i in range(8)}, 8: 8, 9: 0}
    assert graph.cyclic(back.limit(0)).count() == 0
    assert rows(graph.cyclic(edges), "unit", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")]


def test_order_edges_leave_out_what_the_linker_orders(spark):
    r = [(".text", 0, "a"), (".text", 5, "b"), (".text", 9, "b"), (".bss", 0, "b"), (".bss", 5, "a"), (".ctors", 0, "x"), (".ctors", 4, "y"), (".ctors", 8, "z")]
    ranges = spark.createDataFrame([(s, at, at + 4, u) for s, at, u in r], "section string, start long, end long, unit string")
    assert rows(graph.order_edges(ranges), "before", "after") == [("a", "b"), ("y", "z")]


def test_dominant_ranges_keep_aligned_data(spark):
    r = [(".text", 0, 9, False, 0), (".text", 20, 29, False, 1), (".text", 40, 60, True, 2), (".data", 0, 4, False, 3), (".data", 8, 9, False, 4), (".data", 12, 13, True, 5), (".init", 0, 4, True, 6)]
    ranges = spark.createDataFrame([("u", *x) for x in r], "unit string, section string, start long, end long, misaligned boolean, ord int")
    assert rows(islands.dominant(ranges, ["unit"]), "section", "start") == [(".data", 0), (".data", 8), (".text", 20)]


def test_a_rename_is_skipped_for_its_old_name(spark):
    target = spark.createDataFrame([("Kept",), ("Twice",), ("Twice",), ("Done",)], "name string")
    renames = [("Place_80001000", "Fresh"), ("Kept", "Next_80001000"), ("Twice", "Once"), ("Before", "Done"), ("Nowhere", "Other"), ("One", "Same"), ("Two", "Same")]
    got = dict(rows(resolve.rename_plan(spark.createDataFrame(renames, "old string, new string"), target), "old", "status"))
    assert got == {
        "Place_80001000": "address-derived", "Kept": "apply", "Twice": "ambiguous in target", "Before": "already applied",
        "Nowhere": "not in target", "One": "duplicate new name", "Two": "duplicate new name",
    }


def test_footprints_that_touch_conflict(spark):
    f = spark.createDataFrame([("s", 1, "a", 0, 5), ("s", 2, "b", 5, 6), ("s", 3, "c", 8, 9), ("t", 4, "c", 0, 1)], "k string, id long, unit string, start long, end long")
    got = dict(rows(graph.components(graph.footprint_links(f, ["k"]), f.select(F.col("id").alias("node"))), "node", "component"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_transaction_round_trip_and_refusals(spark):
    world = spark.createDataFrame([("a", "s", 0, 5), ("b", "s", 5, 9)], "unit string, section string, start long, end long")
    change = lambda *c: spark.createDataFrame(list(c), "txn long, unit string, phase string, section string, start long, end long")
    good = change((1, "a", "before", "s", 0, 5), (1, "a", "after", "s", 0, 4), (1, "b", "read", "s", 5, 9))
    assert transactions.refused(world, good).count() == 0
    moved = transactions.applied(world, good)
    assert rows(moved, "unit", "end") == [("a", 4), ("b", 9)]
    assert rows(transactions.undone(moved, good), "unit", "start", "end") == rows(world, "unit", "start", "end")
    assert rows(transactions.refused(moved, good), "reason") == [("world differs",)]
    bad = change((2, "a", "before", "s", 0, 5), (2, "a", "after", "s", 3, 3), (3, "a", "before", "s", 0, 5), (3, "a", "after", "s", 0, 3), (3, "a", "after", "s", 2, 4))
    assert rows(transactions.refused(world, bad), "txn", "reason") == [(2, "empty range"), (3, "overlap")]
    assert transactions.retry_key(good).first().key == transactions.retry_key(good.repartition(3)).first().key


def brute_divide(pieces, end, units, worth):
    """Every way to cut the pieces, ranked."""
    starts, ways = [*(p.start for p in pieces), end], []

    def go(u, p, rank, way):
        if u == len(units) and p == len(pieces):
            ways.append((tuple(rank), way))
            return
        add = lambda *d: [a + b for a, b in zip(rank, d, strict=True)]
        if p < len(pieces) and pieces[p].owner is None:
            go(u, p + 1, add(0, -1, 0, 0, 0, 0, 0), way)
        if u < len(units):
            if all(x.owner != units[u] for x in pieces[p:]):
                go(u + 1, p, add(0, 0, -1, 0, 0, 0, 0), [*way, (units[u], None, None)])
            for q in range(p + 1, len(pieces) + 1):
                owners = {x.owner for x in pieces[p:q]}
                w = worth(units[u], starts[p], starts[q]) if units[u] in owners and owners <= {None, units[u]} else None
                if w:
                    go(u + 1, q, add(1, 0, 0, int(w.complete), w.independent, w.explained, -w.padding), [*way, (units[u], starts[p], starts[q])])

    go(0, 0, [0] * 7, [])
    ways.sort(key=lambda x: x[0], reverse=True)
    if not ways or ways[0][0][1] or ways[0][0][2]:
        return "incomplete", None
    return ("decisive", ways[0][1]) if len(ways) == 1 or ways[1][0] < ways[0][0] else ("ambiguous", None)


def test_division_equals_brute_force():
    rng, seen = random.Random(3), set()
    for _ in range(400):
        at, pieces = 0, []
        for i in range(rng.randrange(1, 8)):
            at += rng.randrange(0, 3)
            pieces.append(sequence.Piece(at, at + 2, rng.choice([None, f"u{min(i // 2, 2)}", f"u{min(i // 2, 2)}"])))
            at += 2
        units, n = [f"u{i}" for i in range(rng.randrange(2, 4))], rng.randrange(2, 9)
        worth = lambda u, a, b: sequence.Worth(1, b - a > 4, (b - a) % 3, (b - a) % 2) if b - a <= 3 * n else None  # noqa: B023, E731
        got, want = sequence.divide(pieces, at, units, worth), brute_divide(pieces, at, units, worth)
        assert got.status == want[0]
        assert want[1] is None or list(got.best) == want[1]
        seen.add(got.status)
    assert seen == {"decisive", "ambiguous", "incomplete"}


def test_division_of_long_lists_and_spent_budgets():
    pieces = [sequence.Piece(i, i + 1, "a" if i == 0 else "b" if i == 2999 else None) for i in range(3000)]
    worth = lambda u, a, b: sequence.Worth(1, True, b - a, 0) if (a == 0) == (u == "a") else None
    assert sequence.divide(pieces, 3000, ["a", "b"], worth, budget=10**6).status == "ambiguous"
    assert sequence.divide(pieces, 3000, ["a", "b"], worth, budget=1000).status == "exhausted"
    assert sequence.divide(pieces, 3000, ["a"], worth).status == "incomplete"


def test_sequences():
    assert sequence.common_subsequence("abcde", "xbdcey") in ([(1, 1), (3, 2), (4, 4)], [(1, 1), (2, 3), (4, 4)])
    assert list(sequence.filled([(1, 1), (4, 4)], 6, 7)) == [(0, 0), (2, 2), (3, 3)]
    assert sequence.increasing([5, 1, 2, 9, 3]) == [1, 2, 4]
    assert sequence.best_chain([(0, 0, 1.0), (1, 1, 1.0), (1, 2, 5.0), (2, 1, 9.0)]) == ([0, 3], 10.0, 6.0)
    assert sequence.rescued([(2, [9, 3]), (3, [4])], [(1, 1), (5, 6)]) == [(2, 3), (3, 4)]


def test_longest_chains_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(11)
    data = sorted({(g, rng.randrange(6), rng.randrange(6)): rng.randrange(1, 9) for g in range(12) for _ in range(rng.randrange(1, 8))}.items())
    edges = spark.createDataFrame([(*k, float(w)) for k, w in data], "g long, i long, j long, w double")
    got = {r.g: (r.edges, r.weight, r.chain) for r in sequence.chains(edges, "g").collect()}
    for g in range(12):
        own = [(i, j, w) for (h, i, j), w in data if h == g]
        best = (0, 0)
        for n in range(1, len(own) + 1):
            for c in combinations(own, n):
                if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:])):  # noqa: B905
                    best = max(best, (n, sum(w for _, _, w in c)))
        assert got[g][:2] == (len(own), best[1])
        weight = {f"{i}:{j}": w for i, j, w in own}
        picked = got[g][2].split(",")
        assert (len(picked), sum(weight[x] for x in picked)) == best


def test_ledger_of_one_user(spark):
    truth, before, after = spans(spark, (0, 10, "t")), spans(spark, (0, 4, "t")), spans(spark, (2, 12, "t"))
    book = score.ledger(truth, before, after, spans(spark, (10, 20, "f")), spans(spark, (0, 11, "c")), ["k"]).withColumn("o", score.outcome()).first()
    assert (book.retained, book.attributed, book.gained, book.lost, book.missed) == (4, 8, 6, 2, 2)
    assert (book.wrong_before, book.wrong_after, book.newly_wrong, book.unknown, book.o) == (0, 2, 2, 1, "incorrect")


def test_gate_bisects_and_falls_back_to_alternatives():
    bad = {("c", 0), ("e", 0), ("e", 1)}
    gate = lambda cs: not any((c.name, c.choice) in bad for c in cs)
    out = stages.integrate([stages.Candidate(n, (1, 2)) for n in "abcdef"], gate)
    assert sorted((c.name, c.choice) for c in out.accepted) == [("a", 0), ("b", 0), ("c", 1), ("d", 0), ("f", 0)]
    assert out.refused == ["e"]
    worlds = {0: ["A"], 1: ["B"], 2: ["A2"]}
    found = stages.run_stage(lambda done: [stages.Candidate(n) for n in worlds.get(len(done), [])], lambda cs: True)
    assert [c.name for c in found.accepted] == ["A", "B", "A2"]
    assert stages.batches([3, 3, 9, 1, 1], 5) == [[0], [1], [2], [3, 4]]


def test_edges_and_helpers(spark):
    from tessera.operators import evidence

    data = [(1, 0, 10, "a", True), (1, 10, 14, None, False), (1, 14, 20, "a", True), (1, 20, 25, "b", True), (1, 25, 27, None, False)]
    r = spark.createDataFrame(data, "k int, start long, end long, unit string, independent boolean")
    got = rows(evidence.judged_edges(r, ["k"]), "unit", "side", "address", "supported")
    assert ("a", "left", 0, True) in got and ("a", "right", 20, True) in got and ("b", "right", 25, False) in got and ("a", "right", 10, False) in got
    def placed(*changes):
        data_ = [dict(zip(("k", "start", "end", "unit", "independent"), x, strict=True)) | {"ambiguous": False, "source": i, "first": i in (0, 3), "last": i in (2, 3)} for i, x in enumerate(data)]
        for i, change in changes:
            data_[i] |= change
        schema = "k int, start long, end long, unit string, independent boolean, ambiguous boolean, source int, first boolean, last boolean"
        return rows(evidence.placed_helpers(spark.createDataFrame([tuple(d.values()) for d in data_], schema), ["k"]), "start", "placement", "owner")

    assert placed() == [(10, "interior", "a"), (25, "tail", "b")]
    assert placed((0, {"source": 9})) == [(25, "tail", "b")]  # members out of source order
    assert placed((2, {"ambiguous": True}), (3, {"last": False})) == []
    assert placed((2, {"unit": "c", "first": True}), (0, {"last": True})) == [(10, "head", "c"), (10, "tail", "a"), (25, "tail", "b")]
    assert placed((2, {"unit": "c", "first": False}), (0, {"last": True})) == [(25, "tail", "b")]  # c bounds a only where it begins


def test_shift_needs_agreeing_anchors(spark):
    from tessera.operators import evidence

    anchors_ = spark.createDataFrame([(1, 0, 5), (1, 10, 15), (1, 20, 27)], "k int, source long, target long")
    ranges = spark.createDataFrame([(1, 2, 8), (1, 12, 18), (1, 22, 23), (1, 0, 10)], "k int, start long, end long")
    assert rows(evidence.shifted(ranges, anchors_, ["k"]), "start", "target_start", "target_end") == [(0, 5, 15), (2, 7, 13)]


def test_queries_have_their_columns_in_sql():
    import duckdb

    from tessera.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 50
    for sql in ORACLE_SQL.values():
        assert duckdb.extract_statements(sql)


def test_entry_survives_without_the_llm_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parents[1]
    shutil.copytree(home / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_lcs_alignment_takes_every_order_with_the_next(spark, tmp_path):
    orders = [(o, 1, f"2020-01-0{o}") for o in (1, 2, 3, 4)] + [(9, 2, "2020-01-01")]
    lines = [(o, o % 2 + 5, 1, n, "A") for o in (1, 2, 3, 4, 9) for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(queries.lcs_alignment(spark, str(tmp_path)), "pair", "i", "j", "how")
    assert got == [(p, i, i, "fill") for p in (1, 2, 3) for i in (0, 1)]
