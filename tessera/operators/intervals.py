"""Algebra of half-open ranges [start, end) within groups.

Set operations sweep over cut points: one shuffle by the group, and no join.
Lookups join by bins of the position, so a large group spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of each group's ranges: overlapping and touching ones become one."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    islands = ranges.where("start < end").withColumn("__opens", opens.cast("int"))
    islands = islands.withColumn("__island", F.sum("__opens").over(upto))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def sweep(sets: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Elementary segments (keys, start, end) with each set's depth over them."""
    names = list(sets)

    def edges(name: str, ranges: DataFrame) -> DataFrame:
        step = lambda s: [F.lit(s if n == name else 0).alias(n) for n in names]
        good = ranges.where("start < end")
        opens = good.select(*keys, F.col("start").alias("at"), *step(1))
        return opens.unionByName(good.select(*keys, F.col("end").alias("at"), *step(-1)))

    points = reduce(DataFrame.unionByName, (edges(n, r) for n, r in sets.items()))
    points = points.groupBy(*keys, "at").agg(*(F.sum(n).alias(n) for n in names))
    order = Window.partitionBy(*keys).orderBy("at")
    depth = [F.sum(n).over(order).alias(n) for n in names]
    out = points.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), *depth)
    return out.where("end is not null")


def where_depth(sets: dict[str, DataFrame], keys: Sequence[str], condition: Column) -> DataFrame:
    return merged(sweep(sets, keys).where(condition), keys)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return where_depth({"a": a, "b": b}, keys, (F.col("a") > 0) & (F.col("b") > 0))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return where_depth({"a": a, "b": b}, keys, (F.col("a") > 0) & (F.col("b") == 0))


def same_ground(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: whether both sets cover the same positions."""
    parts = sweep({"a": a, "b": b}, keys).withColumn("same", (F.col("a") > 0) == (F.col("b") > 0))
    return parts.groupBy(*keys).agg(F.bool_and("same").alias("same"))


def disjoint_only(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges that overlap no other of their group: ground that two claim is left open."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "unit")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("start").over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = F.coalesce(last <= F.col("start"), F.lit(True)) & F.coalesce(first >= F.col("end"), F.lit(True))
    return ranges.withColumn("__clear", clear).where("__clear").drop("__clear")


#: Bins of a level are this many times as wide as those of the level below.
_STEP = 16


def _level(low: Column, high: Column, width: int) -> Column:
    """The least level at which [low, high] lies in at most 17 bins; level k has bins of width * 16**k."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(_STEP), (high - low + 1).cast("double") / (width * _STEP)))).cast("int")


def _bins(df: DataFrame, low: Column, high: Column, width: int, top: Column, own: str) -> DataFrame:
    """``df`` with a row for each bin that [low, high] meets, at its own level and at all up to ``top``.

    Two ranges meet at the larger of their levels; a range has 17 bins there at most, and two above."""
    df = df.withColumns({own: _level(low, high, width), "__top": top})
    df = df.withColumn("__k", F.explode(F.sequence(F.col(own), F.greatest("__top", own)))).drop("__top")
    return df.withColumn("__bin", F.explode(F.sequence(_bin(low, width), _bin(high, width))))


def _bin(at: Column, width: int) -> Column:
    """The number of the bin of level __k that holds a position."""
    return F.floor(at / (width * F.pow(F.lit(float(_STEP)), F.col("__k")))).cast("long")


def _top(ranges: DataFrame, low: Column, high: Column, width: int) -> Column:
    """The highest level of any range, as a subquery."""
    return F.coalesce(ranges.agg(F.max(_level(low, high, width))).scalar(), F.lit(0))


def owners_at(points: DataFrame, ranges: DataFrame, keys: Sequence[str], width: int = 256) -> DataFrame:
    """points (keys, id, at) with the one unit that covers each; null for none or several."""
    held = ranges.where("start < end").select(*keys, "unit", "start", "end")
    low, high = F.col("start"), F.col("end") - 1
    asked = _bins(points, F.col("at"), F.col("at"), width, _top(held, low, high, width), "__of_point")
    held = _bins(held, low, high, width, F.lit(0), "__of_range").where("__k = __of_range")
    hit = asked.join(held, [*keys, "__k", "__bin"]).where("start <= at and at < end")
    one = hit.groupBy(*keys, "id").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    owner = one.select(*keys, "id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("owner"))
    return points.join(owner, [*keys, "id"], "left")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = 256, touching: bool = False) -> DataFrame:
    """Pairs of ranges that overlap (or touch); the right side's columns must have other names: start2, end2.

    A range costs at most 17 rows and two for each level that longer ranges need, however long it is."""
    extra = 0 if touching else -1
    sides = ((left, "start", "end", "__left"), (right, "start2", "end2", "__right"))
    tops = [_top(df, F.col(a), F.col(b) + extra, width) for df, a, b, _ in sides]
    a, b = (_bins(df.where(F.col(s) <= F.col(e) + extra), F.col(s), F.col(e) + extra, width, top, own) for (df, s, e, own), top in zip(sides, reversed(tops), strict=True))
    meet = (F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end"))
    if not touching:
        meet = (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end"))
    home = (F.col("__bin") == _bin(F.greatest("start", "start2"), width)) & (F.col("__k") == F.greatest("__left", "__right"))
    return a.join(b, [*keys, "__k", "__bin"]).where(meet & home).drop("__k", "__bin", "__left", "__right")


def transfers(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments whose owner changes: (keys, start, end, from_unit, to_unit), equal neighbours joined.

    Neither side's ranges may overlap among themselves.  Unowned ground is null."""
    none = F.lit(None).cast("struct<unit:string,end:long>")

    def edges(ranges: DataFrame, side: str) -> DataFrame:
        held = F.struct(F.col("unit").cast("string").alias("unit"), F.col("end").cast("long").alias("end"))
        both = ("b", "a")
        opens = ranges.select(*keys, F.col("start").alias("at"), *((held if s == side else none).alias(s) for s in both))
        return opens.unionByName(ranges.select(*keys, F.col("end").alias("at"), *(none.alias(s) for s in both)))

    points = edges(before, "b").unionByName(edges(after, "a"))
    points = points.groupBy(*keys, "at").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    def owner(side: str) -> Column:
        held = F.last(side, ignorenulls=True).over(upto)
        return F.when(held["end"] > F.col("at"), held["unit"])

    parts = points.select(
        *keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), owner("b").alias("from_unit"), owner("a").alias("to_unit")
    ).where("end is not null and not (from_unit <=> to_unit)")
    return merged(parts, [*keys, "from_unit", "to_unit"])


def neighbours(members: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges of non-members that overlap or abut a member's: what a change must read."""
    others = ranges.join(members.select(*keys, "unit").distinct(), [*keys, "unit"], "left_anti")
    others = others.select(*keys, F.col("unit").alias("unit2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    pairs = overlapping(members.select(*keys, "start", "end"), others, keys, touching=True)
    return pairs.select(*keys, F.col("unit2").alias("unit"), F.col("start2").alias("start"), F.col("end2").alias("end")).distinct()
