"""Judged edges, competing ones and composed claims on literal drafts, and edges against brute force."""

import random

from tessera.operators import compose


def frames(spark, drafts, owners, members=None, ranges=(), size=100):
    """drafts: (draft, family, start, end) of unit u; owners of functions of 100 bytes, - for none."""
    d = spark.createDataFrame([("u", "t", *x) for x in drafts], "unit string, section string, draft int, family string, start long, end long")
    f = spark.createDataFrame([("t", size * k, size * k + size, None if o == "-" else o) for k, o in enumerate(owners)], "section string, start long, end long, owner string")
    if members is None:
        members = [(n, size * k, size * k + size, 10 * k) for n, _, a, b in drafts for k, o in enumerate(owners) if o == "u" and a <= size * k and size * k + size <= b]
    m = spark.createDataFrame([("u", "t", *x) for x in members], "unit string, section string, draft int, target_start long, target_end long, source_start long")
    r = spark.createDataFrame([(u, "t", a, b) for u, a, b in ranges], "unit string, section string, start long, end long")
    return d, m, f, r


def composed(spark, *args, **more):
    return [tuple(r)[2:] for r in compose.compositions(*frames(spark, *args, **more)).collect()]


HEAD, TAIL = (1, "head", 100, 300), (2, "tail", 200, 500)


def test_two_drafts_with_one_good_edge_each_make_a_claim(spark):
    assert composed(spark, [HEAD, TAIL], "auuuub") == [(100, 500, "head", "tail", 4)]
    assert composed(spark, [HEAD, TAIL], "uuuuu", members=[]) == []  # nothing is supported


def test_none_or_several_supported_edges_settle_nothing(spark):
    assert composed(spark, [HEAD, TAIL], "a-uuub") == []  # no left edge: what lies inside it is unknown
    assert composed(spark, [HEAD, TAIL], "-uuuub") == []  # nor with an unknown function outside
    assert composed(spark, [HEAD, TAIL, (3, "wide", 300, 500)], "auauub") == []  # two left edges
    assert composed(spark, [HEAD, TAIL, (3, "full", 100, 500)], "auuuub") == []  # one draft says it all
    assert composed(spark, [(1, "head", 100, 300), (2, "tail", 200, 400)], "auuub") == [(100, 400, "head", "tail", 3)]


def test_claims_are_filled_and_reach_no_other_unit(spark):
    assert composed(spark, [HEAD, TAIL], "auuuub", ranges=[("z", 450, 600)]) == []
    assert composed(spark, [HEAD, TAIL], "auuuub", ranges=[("z", 500, 600), ("u", 0, 900)]) == [(100, 500, "head", "tail", 4)]


def test_members_of_both_drafts_agree_and_keep_source_order(spark):
    head = [(1, 100, 200, 10), (1, 200, 300, 20)]
    assert composed(spark, [HEAD, TAIL], "auuuub", [*head, (2, 200, 300, 20), (2, 300, 400, 30)]) == [(100, 500, "head", "tail", 3)]
    assert composed(spark, [HEAD, TAIL], "auuuub", [*head, (2, 200, 300, 21)]) == []
    assert composed(spark, [HEAD, TAIL], "auuuub", [*head, (2, 300, 400, 15)]) == []
    assert composed(spark, [HEAD, TAIL], "auuuub", [*head, (2, 450, 550, 60)]) == []
    assert composed(spark, [HEAD, TAIL], "auuuub", []) == []


def test_families_of_an_edge_are_named_once(spark):
    more = [HEAD, TAIL, (3, "head", 100, 200), (4, "other", 100, 400), (5, "tail", 400, 500)]
    assert composed(spark, more, "auuuub")[0][2:4] == ("head+other", "tail")


def test_judged_edges_equal_brute_force_and_name_their_rivals(spark):
    rng = random.Random(9)
    at, functions = 0, []
    for _ in range(60):
        at += rng.choice((0, 0, 8))
        size = rng.randrange(1, 9) * 4
        functions.append(("t", at, at + size, rng.choice(("a", "b", None))))
        at += size
    edges = sorted({(u, "t", side, x) for u in "ab" for side in ("left", "right") for x in rng.sample(range(-4, at + 8, 4), 60)})
    f = spark.createDataFrame(functions, "section string, start long, end long, owner string").repartition(4)
    judged = compose.judged(spark.createDataFrame(edges, "unit string, section string, side string, address long"), f)
    good = set()
    for u, s, side, x in edges:
        before = [g for g in functions if g[1] < x][-1:]
        after = [g for g in functions if g[1] >= x][:1]
        inside, outside = (after, before) if side == "left" else (before, after)
        if not (before and before[0][2] > x) and inside and inside[0][3] == u and (not outside or outside[0][3] not in (u, None)):
            good.add((u, s, side, x))
    rows = compose.competing(judged).collect()
    assert {tuple(r)[:4] for r in rows} == set(edges)
    assert {(r.unit, r.section, r.side, r.address) for r in rows if r.supported} == good and 5 < len(good) < len(edges)
    for r in rows:
        assert r.competing == sorted(x for u, _, side, x in good if (u, side) == (r.unit, r.side) and x != r.address)
