"""Layouts and divisions are computed once, however often they are read."""

from tessera import boundary_queries, compose_queries
from tessera.operators import joint, layout

SMOKE = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layouts_are_read_and_not_computed_again(spark):
    rows = boundary_queries.laid(spark, SMOKE)
    for name in ("source", "target", "anchors"):
        assert "Window" not in _plan(rows[name]) and "Join" not in _plan(rows[name])
    assert "Join" not in _plan(rows["layouts"])
    got = {r.id: (r.pos, r.start, r.end) for r in rows["target"].where("section = 1").collect()}
    at = 0
    for pos, (_, start, end) in enumerate(sorted((v for v in got.values())), 1):
        assert start == at and (pos, start, end) in got.values()
        at = end
    drafts, _, functions, _ = compose_queries.drafted(spark, SMOKE)
    assert "Join" not in _plan(functions) and "Join" not in _plan(drafts)


def test_divisions_are_searched_once(spark):
    source = spark.createDataFrame([("t", u, k * 100, False) for k, u in enumerate("ab")], "section string, unit string, start long, auto boolean")
    functions = spark.createDataFrame([("t", k, k * 100, k * 100 + 100, u, []) for k, u in enumerate("aabb")], "section string, index int, start long, end long, owner string, hints array<string>")
    ranges = spark.createDataFrame([], "section string, unit string, start long, end long")
    out = joint.joint_runs(source, functions, ranges)
    assert "Python" not in _plan(out)
    assert [(r.units, r.functions, r.status, r.placements, r.conflict) for r in joint.contested(out).collect()] == [("a|b", 4, "decisive", "a:0-200|b:200-400", False)]


def test_digests_travel_as_bytes(spark):
    steps = spark.createDataFrame([(1, 1, "a", 8), (1, 2, "b", None), (2, 1, "a", 16), (2, 2, "b", None)], "id long, n int, code string, offset long")
    one, two = layout.bodies(steps).orderBy("id").collect()
    assert len(one.masked) == len(one.exact) == 32
    assert one.masked == two.masked and one.exact != two.exact
