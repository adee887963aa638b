"""Competing proposals, renames between revisions, and audits of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prints
from ..schema import THRESHOLDS as T

#: Strength of each method; all others count 2.
STRENGTH = {"function-position": 1}


def resolved(proposals: DataFrame, existing: DataFrame, defined: DataFrame, owners: DataFrame) -> DataFrame:
    """A status for each old name.

    proposals: (old, new, unit, strength); existing: (name, place) in the file; defined: (name,
    unit) of names that a unit's source defines; owners: (place, unit) of places that a unit owns.
    Only the strongest proposals of an old name count; then, in this order: units disagree, old
    name not in the file, new name taken at another place, defined by units that do not own the
    old name's place (where that has an owner), wanted by several old names."""
    top = F.max("strength").over(Window.partitionBy("old"))
    strong = proposals.withColumn("__top", top).where("strength = __top")
    one = strong.groupBy("old").agg(F.min("new").alias("new"), F.max("new").alias("hi"))
    places = existing.groupBy("name").agg(F.min("place").alias("place"))
    row = one.join(places.select(F.col("name").alias("old"), "place"), "old", "left")
    row = row.join(places.select(F.col("name").alias("new"), F.col("place").alias("other")), "new", "left")
    row = row.join(owners.groupBy("place").agg(F.min("unit").alias("here")), "place", "left")
    claims = defined.select(F.col("name").alias("new"), "unit").groupBy("new").agg(F.collect_set("unit").alias("claimants"))
    row = row.join(claims, "new", "left")
    elsewhere = F.col("here").isNotNull() & F.col("claimants").isNotNull() & ~F.array_contains("claimants", F.col("here"))
    status = (
        F.when(F.col("new") != F.col("hi"), "units disagree")
        .when(F.col("place").isNull(), "not in symbols file")
        .when(F.col("other") != F.col("place"), "name already taken")
        .when(elsewhere, "name defined by another unit's source")
    )
    row = row.withColumn("first", status)
    wanted = F.sum(F.when(F.col("first").isNull(), 1).otherwise(0)).over(Window.partitionBy("new"))
    several = F.when(F.col("first").isNull() & (wanted > 1), "name claimed by several symbols")
    return row.select("old", F.when(F.col("new") == F.col("hi"), F.col("new")).alias("new"), F.coalesce("first", several.otherwise("resolved")).alias("status"))


def renames_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(place, old, new): places that hold one name in each revision, and different ones."""

    def single(rows: DataFrame, name: str) -> DataFrame:
        one = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias(name)).where("n = 1")
        return one.drop("n")

    return single(old, "old").join(single(new, "new"), "place").where("old <> new")


def rename_plan(renames: DataFrame, target: DataFrame) -> DataFrame:
    """renames (old, new) with the first reason to skip each, or ``apply``.

    target: (name), as often as the name stands in the file."""
    held = target.groupBy("name").agg(F.count(F.lit(1)).alias("held"))
    row = renames.join(held.select(F.col("name").alias("old"), F.col("held").alias("n_old")), "old", "left")
    row = row.join(held.select(F.col("name").alias("new"), F.col("held").alias("n_new")), "new", "left")
    wanted = F.count(F.lit(1)).over(Window.partitionBy("new"))
    absent = F.col("n_old").isNull()
    status = (
        F.when(prints.address_derived(F.col("old")), "address-derived")
        .when(wanted > 1, "duplicate new name")
        .when(absent & F.col("n_new").isNotNull(), "already applied")
        .when(absent, "not in target")
        .when(F.col("n_old") > 1, "ambiguous in target")
        .otherwise("apply")
    )
    return row.select("old", "new", status.alias("status"))


def stunted(source: DataFrame, target: DataFrame, ratio: float = T.stunted) -> DataFrame:
    """(unit, source_bytes, target_bytes) of units that are much smaller in the target."""
    s = source.groupBy("unit").agg(F.sum("bytes").alias("source_bytes"))
    t = target.groupBy("unit").agg(F.sum("bytes").alias("target_bytes"))
    return s.join(t, "unit").where(F.col("target_bytes") < ratio * F.col("source_bytes"))


def relocated(source: DataFrame, target: DataFrame) -> DataFrame:
    """(unit, source_module, target_module) of units that moved; a unit of several modules counts by the first."""
    s = source.groupBy("unit").agg(F.min("module").alias("source_module"))
    t = target.groupBy("unit").agg(F.min("module").alias("target_module"))
    return s.join(t, "unit").where("source_module <> target_module")
