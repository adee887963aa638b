"""Interval, symbol, rename and report text."""

import json

from pyspark.sql import functions as F

from tessera.sources import text

INTERVALS = """Sections:
\t.text       type:code align:4

b.cpp:
\t.text       start:0x00001100 end:0x00001500 align:8 common
#\t.data       start:0x00002000 end:0x00002010  # candidate: edge

a.cpp:
\t.text       start:0x00001000 end:0x00001100
"""


def test_interval_text(spark, tmp_path):
    (tmp_path / "splits.txt").write_text(INTERVALS)
    lines = text.lines(spark, str(tmp_path / "splits.txt"))
    got = text.intervals(lines).orderBy("entry_ord").collect()
    assert [(r.unit, r.section, r.start, r.end, list(r.attributes), r.candidate) for r in got] == [
        ("b.cpp", ".text", 0x1100, 0x1500, ["align:8", "common"], False),
        ("b.cpp", ".data", 0x2000, 0x2010, [], True),
        ("a.cpp", ".text", 0x1000, 0x1100, [], False),
    ]
    sure = text.intervals(lines, confident=True)
    assert sure.count() == 2
    blocks = {r.unit: r.text for r in text.render_intervals(sure).collect()}
    assert blocks["b.cpp"] == "b.cpp:\n\t.text       start:0x00001100 end:0x00001500 align:8 common\n"
    assert blocks["a.cpp"] == "a.cpp:\n\t.text       start:0x00001000 end:0x00001100\n"
    again = text.intervals(text.number_lines(spark.createDataFrame([("p", "".join(blocks.values()))], "path string, t string"), "path", "t"))
    assert sorted((r.unit, r.start) for r in again.collect()) == [("a.cpp", 0x1000), ("b.cpp", 0x1100)]


def test_files_are_rendered_byte_for_byte(spark):
    files = [("p", INTERVALS), ("q", "Sections:\n\t.text align:4\n\n"), ("r", "x:\n\n" + INTERVALS.split("\n\n", 1)[1])]
    rows = text.number_lines(spark.createDataFrame(files, "path string, t string"), "path", "t")
    raw = text.bodies(rows, raw=True)
    got = {r.path: r.text for r in text.rendered(text.headers(rows), raw).collect()}
    assert got == {"p": INTERVALS, "q": "Sections:\n\t.text align:4\n", "r": files[2][1]}
    clean = [r.line for r in text.bodies(rows).where("path = 'p'").orderBy("entry_ord").collect()]
    assert clean[1] == "\t.data       start:0x00002000 end:0x00002010"
    assert text.listed_twice(raw).count() == 0
    again = text.number_lines(spark.createDataFrame([("p", INTERVALS + "\nb.cpp:\n\t.bss start:0x1 end:0x2\n")], "path string, t string"), "path", "t")
    assert [tuple(r) for r in text.listed_twice(text.bodies(again)).collect()] == [("p", "b.cpp")]


def test_new_units_are_placed_by_their_code(spark):
    old = [("p", "b", 0, 50, False), ("p", "runtime", 1, 10, False), ("p", "data", 2, None, False), ("p", "z", 3, 90, False)]
    new = [("p", "n20", 9, 20, True), ("p", "n60", 9, 60, True), ("p", "m60", 9, 60, True), ("p", "n99", 9, 99, True), ("p", "only", 9, None, True)]
    units = spark.createDataFrame(old + new, "path string, unit string, unit_ord long, start long, new boolean")
    got = [r.unit for r in text.placed_units(units).orderBy("place").collect()]
    assert got == ["n20", "b", "runtime", "data", "m60", "n60", "z", "n99", "only"]


def test_misaligned_entries_go(spark):
    lines = ["\t.text start:0x0 end:0x4", "#\t.data start:0x8 end:0xC  # candidate: alignment", "\t.data start:0x10 end:0x14"]
    rows = spark.createDataFrame([("p", "u", 0, i, x) for i, x in enumerate(lines)], "path string, unit string, unit_ord int, entry_ord int, line string")
    assert [r.line for r in text.without_misaligned(rows).collect()] == lines[::2]


def test_symbols_and_renames(spark, tmp_path):
    (tmp_path / "symbols.txt").write_text(
        "start_80400000 = .text:0x80400000; // type:function size:0x10 scope:local\nKept = .data:0x80400100; // type:object\nOther = .bss:0x1; // x\njunk\n"
    )
    table = text.symbols(text.lines(spark, str(tmp_path / "symbols.txt")))
    assert sorted((r.name, r.address, r.kind, r.size, r.local) for r in table.collect()) == [
        ("Kept", 0x80400100, "object", None, False), ("Other", 1, None, None, False), ("start_80400000", 0x80400000, "function", 16, True),
    ]
    rows = [("p", i, line) for i, line in enumerate(["# note", "Kept = Swap", "Other = Kept", "start_80400000 = Named local", ""])]
    plan = text.renames(spark.createDataFrame(rows, "path string, n int, line string"))
    assert sorted(r.name for r in text.apply_renames(table, plan).collect()) == ["Kept", "Named", "Swap"]
    clash = plan.where("old = 'Other'")
    assert sorted(r.name for r in text.apply_renames(table, clash).collect()) == ["Kept", "Other", "start_80400000"]


def test_report(spark, tmp_path):
    units = [{"name": "a", "sections": [{"name": ".text", "size": "16", "fuzzy_match_percent": "99.5"}]}, {"name": "b"}]
    (tmp_path / "report.json").write_text(json.dumps({"units": units}, indent=1))
    got = text.report(spark, str(tmp_path / "report.json")).orderBy("unit").collect()
    assert [tuple(r) for r in got] == [("a", ".text", 99.5, 16), ("b", None, None, None)]


def test_add_missing_keeps_what_exists(spark):
    old = spark.createDataFrame([("a", 1)], "unit string, start long")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "unit string, start long")
    assert sorted(map(tuple, text.add_missing(old, new).collect())) == [("a", 1), ("b", 3)]
    assert old.where(F.lit(False)).count() == 0
