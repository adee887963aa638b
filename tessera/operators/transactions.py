"""Interval transactions: all-or-nothing replacement of units' ranges, and its inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["unit", "section", "start", "end"]


def refused(world: DataFrame, changes: DataFrame) -> DataFrame:
    """(txn, reason) of transactions that must not be applied.

    changes: (txn, unit, phase 'before'|'after'|'read', section, start, end).  The world must
    hold exactly the ``before`` rows of each member and each row read, no range may be
    empty, and after-ranges of one transaction may not overlap."""
    empty = changes.where("start >= end").select("txn", F.lit("empty range").alias("reason"))
    need = changes.where("phase in ('before', 'read')").join(world.select(*COLUMNS), COLUMNS, "left_anti")
    moved = need.select("txn", F.lit("world differs").alias("reason"))
    members = changes.where("phase <> 'read'").select("txn", "unit").distinct()
    known = changes.where("phase = 'before'").select("txn", *COLUMNS)
    extra = members.join(world, "unit").join(known, ["txn", *COLUMNS], "left_anti").select("txn", F.lit("world differs").alias("reason"))
    after = changes.where("phase = 'after'")
    line = Window.partitionBy("txn", "section").orderBy("start", "end")
    clash = after.withColumn("prev", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))).where("prev > start")
    overlap = clash.select("txn", F.lit("overlap").alias("reason"))
    return empty.unionByName(moved).unionByName(extra).unionByName(overlap).distinct()


def applied(world: DataFrame, changes: DataFrame) -> DataFrame:
    """The world with each member's ranges replaced by its ``after`` rows."""
    members = changes.where("phase <> 'read'").select("unit").distinct()
    stay = world.join(members, "unit", "left_anti").select(*COLUMNS)
    return stay.unionByName(changes.where("phase = 'after'").select(*COLUMNS))


def undone(world: DataFrame, changes: DataFrame) -> DataFrame:
    """The inverse of ``applied``."""
    swap = F.when(F.col("phase") == "after", "before").when(F.col("phase") == "before", "after").otherwise(F.col("phase"))
    return applied(world, changes.withColumn("phase", swap))


def retry_key(changes: DataFrame) -> DataFrame:
    """(txn, key): a digest of what a transaction changes and reads, for not trying it twice."""
    row = F.concat_ws(":", "phase", "unit", "section", "start", "end")
    return changes.groupBy("txn").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(row))), 256).alias("key"))
