"""Joint runs: which units need one, how windows are cut, and what their division gives."""

import random

from tessera.operators import joint

ORDER = "section string, pos int, unit string, single boolean, explicit boolean, needed boolean"


def test_windows_are_chunks_of_needed_units_and_one_alone_takes_a_neighbour(spark):
    needed = [1] * 8 + [0, 0, 1, 0, 1]
    order = spark.createDataFrame([("t", p, f"u{p}", True, True, bool(n)) for p, n in enumerate(needed)] + [("s", 0, "only", True, True, True)], ORDER)
    got = sorted({(r.section, r.first, r.last) for r in joint.windows(order).collect()})
    assert got == [("t", 0, 5), ("t", 6, 7), ("t", 10, 11), ("t", 11, 12)]
    rng = random.Random(3)
    for _ in range(5):
        needed = [rng.random() < 0.6 for _ in range(25)]
        order = spark.createDataFrame([("t", p, f"u{p}", True, True, n) for p, n in enumerate(needed)], ORDER)
        want, p = set(), 0
        while p < len(needed):
            if not needed[p]:
                p += 1
                continue
            q = p
            while q < len(needed) and needed[q]:
                q += 1
            for a in range(p, q, 6):
                b = min(a + 6, q)
                want |= {(a, b - 1)} if b - a > 1 else {(a, b)} if b < len(needed) else {(a - 1, a)}
            p = q
        assert {(r.first, r.last) for r in joint.windows(order).collect()} == want


def run(spark, owners, ranges=(), hints=None, units="abc", sizes=None, auto=()):
    """Target functions of 100 bytes, one after the other, with these owners (- for none)."""
    hints = hints or {}
    sizes = sizes or [100] * len(owners)
    rows, at = [], 0
    for k, o in enumerate(owners):
        rows.append(("t", k, at, at + sizes[k], None if o == "-" else o, hints.get(k, [])))
        at += sizes[k]
    source = spark.createDataFrame([("t", u, 10 * k, u in auto) for k, u in enumerate(units)], "section string, unit string, start long, auto boolean")
    functions = spark.createDataFrame(rows, "section string, index int, start long, end long, owner string, hints array<string>")
    ranges = spark.createDataFrame([("t", *r) for r in ranges], "section string, unit string, start long, end long")
    out = joint.contested(joint.joint_runs(source, functions, ranges))
    return {r.units: (r.status, r.placements, r.conflict) for r in out.collect()}


def test_one_division_moves_all_units_of_a_window(spark):
    assert run(spark, "aabbcc") == {"a|b|c": ("decisive", "a:0-200|b:200-400|c:400-600", False)}
    assert run(spark, "a-abcc") == {"a|b|c": ("decisive", "a:0-300|b:300-400|c:400-600", False)}


def test_open_functions_belong_to_neighbours_of_one_unit_or_to_a_match(spark):
    assert run(spark, "aa-bcc") == {"a|b|c": ("incomplete", "", False)}
    assert run(spark, "aa-bcc", hints={2: ["b"]}) == {"a|b|c": ("decisive", "a:0-200|b:200-400|c:400-600", False)}
    assert run(spark, "aa-bcc", hints={2: ["a", "b"]})["a|b|c"][0] == "ambiguous"


def test_units_out_of_order_or_not_explicit_have_no_window(spark):
    assert run(spark, "abacc") == {}
    assert run(spark, "aabbcc", auto="b") == {}
    assert run(spark, "aabbcc", units="abca") == {}  # a unit that is taken up again has no one place
    assert run(spark, "aaccbb") == {}


def test_settled_units_are_left_alone(spark):
    placed = [("a", 0, 200), ("b", 200, 400), ("c", 400, 600)]
    assert run(spark, "aabbcc", placed) == {}
    astray = run(spark, "aabbcc", [("a", 0, 200), ("b", 200, 300), ("c", 400, 600)])
    assert astray == {"b|c": ("decisive", "b:200-400|c:400-600", False)}
    taken = run(spark, "aabbcc", [("a", 0, 300), ("b", 200, 400), ("c", 400, 600)])
    assert taken == {}  # a reaches into b, but every member begins in its own unit's range


def test_windows_end_at_an_owned_function_of_another_unit(spark):
    placed = [("a", 0, 100), ("d", 700, 800)]
    assert run(spark, "a--bc--d", placed, units="abcd") == {"b|c": ("incomplete", "", False)}
    assert run(spark, "a--bc--d", placed, hints={1: ["b"], 2: ["b"], 5: ["c"], 6: ["c"]}, units="abcd") == {"b|c": ("decisive", "b:100-400|c:400-700", False)}
    assert run(spark, "a-----bcd", [("a", 0, 100), ("d", 800, 900)], units="abcd") == {}  # nothing bounds it within reach


def test_large_windows_are_reported_and_not_searched(spark):
    assert run(spark, "a" * 25 + "b" * 25, units="ab") == {"a|b": ("function-limit-reached", "", False)}


def test_padding_between_functions_is_bounded(spark):
    sizes = [100, 100, 100, 100]
    assert run(spark, "aabb", units="ab", sizes=sizes) == {"a|b": ("decisive", "a:0-200|b:200-400", False)}


def test_windows_that_give_a_unit_different_places_conflict(spark):
    rows = [("t", "a|b", 2, "decisive", "a:0-1|b:1-3"), ("t", "b|c", 2, "decisive", "b:1-2|c:2-3"), ("t", "x|y", 2, "decisive", "x:7-8|y:8-9"), ("t", "c|d", 2, "ambiguous", "")]
    df = spark.createDataFrame(rows, "section string, units string, functions long, status string, placements string")
    assert {r.units: r.conflict for r in joint.contested(df).collect()} == {"a|b": True, "b|c": True, "x|y": False, "c|d": False}
