"""Arrays of fixed size as single values: tables of cells, and filters that pick a few rows of a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut

#: Bits of a filter (a power of two).  When it is full it lets every row pass; the join behind it decides.
FILTER_BITS = 1 << 23


def dense(spark: SparkSession, known: DataFrame, size: int) -> DataFrame:
    """One row, one array (values): ``value`` of each id from 0 to size - 1, by default 0."""
    every = spark.range(size).join(known, "id", "left").select("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "value")))
    return cut(every.agg(ordered.alias("r")).select(F.col("r.value").alias("values")))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose hash ``key`` is among those of ``wanted``, and few others; no shuffle of ``rows``."""
    asked = wanted.select(wanted_key.bitwiseAND(bits - 1).alias("b"))
    lanes = asked.groupBy(F.shiftright("b", 6).alias("id")).agg(F.bit_or(_bit(F.col("b"))).alias("value"))
    held = dense(rows.sparkSession, lanes, bits >> 6)
    found = rows.withColumn("__b", key.bitwiseAND(bits - 1)).withColumn("__held", held.scalar())
    lane = F.get("__held", F.shiftright("__b", 6).cast("int"))
    return found.where(lane.bitwiseAND(_bit(F.col("__b"))) != 0).select(*rows.columns)
