from tessera.operators import placement
from tessera.pairing_queries import relocation_placements


def test_lines_are_ranked_once_for_both_sides(spark):
    out = relocation_placements(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in out.inputFiles())


def test_tokens_carry_only_what_is_opened_later(spark):
    rows = spark.createDataFrame([("f", 2, 8, "R", 0, "b", ""), ("f", 1, 4, "A", 1, "a", "4,R,0"), ("g", 1, 4, "A", 1, None, "")], "id string, n int, offset int, kind string, addend int, e_body string, e_signature string")
    (row,) = placement._tokens(rows, ["id"]).collect()
    assert row.id == "f" and len(row.token) == 32
    assert [tuple(s) for s in row.sites] == [(1, 4, "a"), (2, 8, "b")]
