"""Placement of copies against all permutations of small families."""

import random
from itertools import permutations

from tessera.operators import placement

SITE = "section string, address long, n int, offset int, kind string, addend int, to_section string, to_address long"


def build(rng, families):
    """Objects u0.. with copies of each family's body; each copy calls some endpoints of its own object."""
    functions, sites, targets, t_sites, definitions = [], [], [], [], []
    place = 1000
    for k in range(families):
        size = rng.choice((2, 2, 3, 4))
        for c in range(size):
            unit, at = f"o{k}.{c}", 10
            body = f"body{k}"
            functions.append((unit, ".text", at, body))
            definitions.append((unit, ".text", at, body, True))
            targets.append((".text", place, body))
            for n in range(rng.choice((1, 2))):
                end = 100 + n
                shared = rng.random() < 0.4
                e_body = f"common{k}.{n}" if shared else f"own{k}.{c}.{n}"
                functions.append((unit, ".text", end, e_body))
                targets.append((".text", place + end, e_body))
                addend = rng.choice((0, 0, 0, 4))
                sites.append((unit, ".text", at, n, 4 * n, "call", addend, ".text", end))
                t_sites.append((".text", place, n, 4 * n, "call", addend if rng.random() < 0.9 else 8, ".text", place + end))
            place += 1000
    return functions, sites, targets, t_sites, definitions


def brute(functions, sites, targets, t_sites, definitions):
    compiled = {(u, s, a): b for u, s, a, b in functions}
    body = {(s, a): b for s, a, b in targets}
    lone = {b for b in compiled.values() if list(compiled.values()).count(b) == 1 and list(body.values()).count(b) == 1}
    out = set()
    for b in {d[3] for d in definitions}:
        copies = [d[:3] for d in definitions if d[3] == b]
        seen = [p for p, x in body.items() if x == b]

        def agrees(copy, there):
            mine = [x[3:] for x in sorted(sites) if x[:3] == copy]
            other = [x[2:] for x in sorted(t_sites) if x[:2] == there]
            if len(mine) != len(other) or any(m[:4] != o[:4] for m, o in zip(mine, other, strict=True)):
                return False
            ends = [(compiled[copy[0], m[4], m[5]], body[o[4], o[5]]) for m, o in zip(mine, other, strict=True)]
            return all(x == y for x, y in ends) and any(x in lone for x, _ in ends)

        ways = [p for p in permutations(seen) if all(agrees(c, t) for c, t in zip(copies, p, strict=True))]
        degree = [sum(agrees(c, t) for t in seen) for c in copies]
        if len(ways) == 1 and set(degree) == {1}:
            out |= {(c[0], t[1]) for c, t in zip(copies, ways[0], strict=True)}
        else:
            assert len(ways) != 1 or max(degree) > 1
    return out


def run(spark, functions, sites, targets, t_sites, definitions, known=None, identified=()):
    make = spark.createDataFrame
    known = [(s, a) for s, a, _ in targets] if known is None else known
    return placement.placements(
        make(definitions, "unit string, section string, address long, body string, clean boolean"), make(functions, "unit string, section string, address long, body string"),
        make(sites, f"unit string, {SITE}"), make(targets, "section string, address long, body string"), make(t_sites, SITE),
        make(known, "section string, address long"), make(list(identified), "unit string, section string, address long, body string"),
    ).collect()


def test_families_are_placed_where_one_permutation_agrees(spark):
    data = build(random.Random(6), 40)
    got = {(r.unit, r.target_address) for r in run(spark, *data)}
    want = brute(*data)
    assert got == want and 10 < len(want) < len(data[4])


def small(**more):
    functions = [("a", ".text", 1, "x"), ("b", ".text", 1, "x"), ("a", ".text", 5, "ea"), ("b", ".text", 5, "eb")]
    sites = [(u, ".text", 1, 0, 0, "call", 0, ".text", 5) for u in "ab"]
    targets = [(".text", 10, "x"), (".text", 20, "x"), (".text", 15, "eb"), (".text", 25, "ea")]
    t_sites = [(".text", p, 0, 0, "call", 0, ".text", p + 5) for p in (10, 20)]
    data = {"functions": functions, "sites": sites, "targets": targets, "t_sites": t_sites, "definitions": [("a", ".text", 1, "x", True), ("b", ".text", 1, "x", True)]}
    return data | more


def test_endpoints_place_copies_and_name_their_competitors(spark):
    got = {r.unit: (r.target_address, r.offset, r.endpoint, r.competitors) for r in run(spark, **small())}
    assert got == {"a": (20, 0, "ea", "b:10"), "b": (10, 0, "eb", "a:20")}


def test_what_leaves_a_family_open(spark):
    data = small()
    assert run(spark, **small(definitions=[data["definitions"][0], ("b", ".text", 1, "x", False)])) == []  # one object is stale
    assert run(spark, **small(functions=[*data["functions"], ("c", ".text", 9, "x")])) == []  # a copy without a name
    assert run(spark, **small(targets=[*data["targets"], (".text", 30, "x")])) == []  # one occurrence too many
    assert run(spark, **small(targets=[*data["targets"], (".text", 30, "ea"), (".text", 31, "eb")])) == []  # no endpoint is found but once
    twice = [*data["functions"][:3], ("b", ".text", 5, "ea")]
    assert run(spark, **small(functions=twice)) == []  # both copies agree with one occurrence


def test_endpoints_must_have_been_read_or_be_identified(spark):
    known = [(".text", 10), (".text", 20)]
    assert run(spark, **small(), known=known) == []
    sure = [("a", ".text", 25, "ea"), ("b", ".text", 15, "eb")]
    assert len(run(spark, **small(), known=known, identified=sure)) == 2
    assert run(spark, **small(), known=known, identified=sure[:1]) == []  # all or none
