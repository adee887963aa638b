"""Runs of one unit in an order, their edges, and what lies between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T


def number_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with ``run``: maximal stretches of equal ``unit`` in the order of a group, from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col("unit").eqNullSafe(F.lag("unit").over(window)) | (F.row_number().over(window) == 1)
    rows = rows.withColumn("__new", changed.cast("int"))
    return rows.withColumn("run", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def unit_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, run, unit, members, start, end): one row a run; start and end by column ``at``."""
    runs = number_runs(rows, keys, order).groupBy(*keys, "run", "unit")
    return runs.agg(F.count(F.lit(1)).alias("members"), F.min("at").alias("start"), F.max("at").alias("end"))


def bridged_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int = T.bridge) -> DataFrame:
    """Runs in which rows without a unit are bridged.

    rows also have ``candidate`` (a unit that weak evidence names) and ``claimed`` (another
    owner holds the row already).  A stretch of rows without a unit is bridged if the same unit
    resumes behind it, no row names another candidate, no row without a candidate is claimed, and
    the sizes of the rows between two candidates sum to at most the budget each time."""
    numbered = number_runs(rows, keys, order)
    line = Window.partitionBy(*keys, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blind = F.col("candidate").isNull()
    parts = numbered.withColumn("part", F.count("candidate").over(line)).groupBy(*keys, "run", "unit", "part").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.sum(F.when(blind, F.col("size")).otherwise(0)).alias("blind"),
        F.min("candidate").alias("candidate"), F.bool_or(blind & F.col("claimed")).alias("claimed"), F.min("at").alias("start"), F.max("at").alias("end"),
    )
    runs = parts.groupBy(*keys, "run", "unit").agg(
        F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.max("blind").alias("blind"), F.min("candidate").alias("lo"),
        F.max("candidate").alias("hi"), F.bool_or("claimed").alias("claimed"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    line = Window.partitionBy(*keys).orderBy("run")
    before, after = F.lag("unit").over(line), F.lead("unit").over(line)
    own = F.col("lo").isNull() | ((F.col("lo") == before) & (F.col("hi") == before))
    bridged = F.col("unit").isNull() & F.coalesce(before == after, F.lit(False)) & own & ~F.col("claimed") & (F.col("blind") <= budget)
    runs = runs.withColumn("owner", F.when(bridged, before).otherwise(F.col("unit")))
    runs = runs.withColumn("bridged", F.when(bridged, F.col("bytes")).otherwise(F.lit(0)))
    again = number_runs(runs.withColumn("unit", F.col("owner")).withColumnRenamed("run", "piece"), keys, ["piece"])
    return again.where("unit is not null").groupBy(*keys, "run", "unit").agg(
        F.sum("members").alias("members"), F.sum("bridged").alias("bridged"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def edges(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with their neighbours' units and a verdict for each edge.

    An edge is pinned where another unit's run or the group's end follows it."""
    line = Window.partitionBy(*keys).orderBy("run")
    out = runs.withColumn("left_unit", F.lag("unit").over(line)).withColumn("right_unit", F.lead("unit").over(line))
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys, "unit"))
    return out.withColumn("fragments", times).withColumn(
        "tier",
        F.when((F.col("fragments") == 1) & (F.col("members") >= 2), "confident")
        .when(F.col("fragments") == 1, "probable")
        .otherwise("candidate"),
    )


def orphan_clusters(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stretches of two or more rows without a unit between two different units."""
    runs = unit_runs(rows, keys, order)
    line = Window.partitionBy(*keys).orderBy("run")
    runs = runs.withColumn("left_unit", F.lag("unit").over(line)).withColumn("right_unit", F.lead("unit").over(line))
    return runs.where("unit is null and members >= 2 and left_unit <> right_unit").drop("unit", "run")


def competing_slots(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose two neighbours share a foreign unit and whose size equals a neighbour's."""
    line = Window.partitionBy(*keys).orderBy(*order)
    for side, move in (("left", F.lag), ("right", F.lead)):
        rows = rows.withColumn(f"{side}_unit", move("unit").over(line)).withColumn(f"{side}_size", move("size").over(line))
    return rows.where("left_unit = right_unit and unit <> left_unit and (size = left_size or size = right_size)")


def adjacency(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct (before, after) of consecutive different units, with how often."""
    line = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.select(F.col("unit").alias("before"), F.lead("unit").over(line).alias("after")).where("before <> after")
    return pairs.groupBy("before", "after").agg(F.count(F.lit(1)).alias("times"))


def all_masks(runs: DataFrame) -> DataFrame:
    """Numbered runs once for each scenario, with ``hidden``: nothing, everything, every other run, or three of five."""
    hidden = {
        "nothing": F.lit(False),
        "everything": F.lit(True),
        "isolated": F.pmod("run", F.lit(2)) == 0,
        "consecutive": F.pmod("run", F.lit(5)).isin(2, 3, 4),
    }
    one = F.explode(F.array(*(F.struct(F.lit(name).alias("scenario"), h.alias("hidden")) for name, h in hidden.items())))
    return runs.withColumn("__mask", one).select(*runs.columns, "__mask.scenario", "__mask.hidden")


def dominant(ranges: DataFrame, keys: Sequence[str], code: Sequence[str] = T.code_sections) -> DataFrame:
    """Of each group's aligned ranges, the largest of each code section and all of the others.

    ranges: (keys, section, start, end, misaligned, ord); of several largest the last by ``ord`` stays."""
    line = Window.partitionBy(*keys, "section").orderBy((F.col("end") - F.col("start")).desc(), F.col("ord").desc())
    rows = ranges.where(~F.col("misaligned")).withColumn("__k", F.row_number().over(line))
    return rows.where((F.col("__k") == 1) | ~F.col("section").isin(*code)).drop("__k")


def tiling(ranges: DataFrame, keys: Sequence[str], padding: int = T.padding) -> DataFrame:
    """Per group: whether ranges follow each other without overlap and with gaps of padding only."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(line)
    ok = ranges.withColumn("__ok", F.coalesce(gap.between(0, padding), F.lit(True)))
    return ok.groupBy(*keys).agg(F.bool_and("__ok").alias("tiled"), F.min("start").alias("start"), F.max("end").alias("end"))
