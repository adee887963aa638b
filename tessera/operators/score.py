"""Byte ledgers, verdicts, and counters over populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import sweep


def ledger(truth: DataFrame, before: DataFrame, after: DataFrame, foreign: DataFrame, claimed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes of each group by what was true, claimed before and claimed after, from one sweep."""
    parts = sweep({"t": truth, "b": before, "a": after, "f": foreign, "c": claimed}, keys)
    size = F.col("end") - F.col("start")
    t, b, a, f, c = (F.col(x) > 0 for x in "tbafc")

    def measure(name: str, condition: Column) -> Column:
        return F.sum(F.when(condition, size).otherwise(0)).alias(name)

    return parts.groupBy(*keys).agg(
        measure("retained", t & b),
        measure("attributed", t & a),
        measure("gained", t & a & ~b),
        measure("lost", t & b & ~a),
        measure("missed", t & ~a),
        measure("wrong_before", f & b),
        measure("wrong_after", f & a),
        measure("newly_wrong", f & a & ~b),
        measure("unknown", a & ~c),
        measure("changed", a != b),
        measure("inexact", a != t),
        measure("inexact_before", b != t),
    )


def outcome() -> Column:
    """The verdict of a ledger row."""
    return (
        F.when(F.col("changed") == 0, "abstained")
        .when(F.col("newly_wrong") > 0, "incorrect")
        .when(F.col("inexact") == 0, "exact")
        .when(F.col("attributed") > 0, "partial")
        .otherwise("unowned")
    )


def held_out(name: Column) -> Column:
    """Whether a name falls into the half that no rule was tuned on: first byte of its SHA-256 below 128."""
    return F.substring(F.sha2(name, 256), 1, 1) < "8"


def precision_recall(rows: DataFrame, key: str) -> DataFrame:
    """rows: (key, checked, correct, missed) booleans; 0 where nothing was checked."""
    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), one("checked"), one("correct"), one("missed"))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    checked, correct, missed = (F.col(c) for c in ("checked", "correct", "missed"))
    return out.withColumn("precision", safe(correct, checked)).withColumn("recall", safe(correct, checked + missed))


def selection_quality() -> Column:
    """The verdict of a body that was selected, on a ledger whose before side is empty."""
    return (
        F.when(F.col("attributed") + F.col("wrong_after") + F.col("changed") == 0, "no-change")
        .when(F.col("inexact") == 0, "exact")
        .when(F.col("newly_wrong") > 0, "incorrect")
        .when(F.col("attributed") > 0, "partial")
        .otherwise("unknown")
    )


#: Counters of a population that sum a ledger's bytes.
_BYTES = ("gained", "lost", "newly_wrong", "wrong_after", "missed", "unknown")
#: Counters by verdict.
_VERDICTS = {"exact": "exact", "partial": "partial", "wrong": "incorrect", "unowned": "unowned", "unchanged": "abstained"}


def populations(rows: DataFrame, groups: dict[str, tuple[Column, str]]) -> DataFrame:
    """One row of 17 counters for each population; populations may overlap.

    groups: name -> (condition, scope); rows have structs named by scope with outcome, proposed,
    selected and the ledger's bytes, and regressed and lost_exactness."""
    member = [F.when(c, F.struct(F.lit(name).alias("population"), F.col(scope).alias("x"))) for name, (c, scope) in groups.items()]
    each = rows.select("regressed", "lost_exactness", F.explode(F.array_compact(F.array(*member))).alias("m"))
    each = each.select("m.population", "m.x.*", "regressed", "lost_exactness")
    count = lambda c: F.count_if(c)
    return each.groupBy("population").agg(
        F.count(F.lit(1)).alias("units"),
        *(count(F.col("outcome") == o).alias(name) for name, o in _VERDICTS.items()),
        count(F.col("proposed")).alias("proposal_recall"), count(F.col("selected")).alias("selected_exact"),
        count(F.col("proposed") & ~F.col("selected")).alias("ranking_failures"),
        count(F.col("regressed")).alias("regressed"), count(F.col("lost_exactness")).alias("lost_exactness"),
        *(F.sum(c).alias(f"{c}_bytes") for c in _BYTES),
    )


def faults(**kinds: Column) -> Column:
    """The kinds of fault that hold, in the order given, comma-joined; null if none does."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k.replace("_", "-"))) for k, c in kinds.items())))
    return F.when(F.size(found) > 0, F.array_join(found, ","))
