"""Claims composed of edges that different drafts support.

An edge is supported if the function inside it is an independent member of the unit and
what lies outside is an independent member of another unit, or nothing.  If the drafts of a
unit have exactly one supported left and one supported right edge in a section, and no draft
has both, the range between them is a claim of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T
from .graph import written
from .intervals import overlapping

_UNIT = ["unit", "section"]


def judged(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """``edges`` (unit, section, side, address) with ``supported``.

    functions: (section, start, end, owner), owner being the unit that independent evidence gives,
    null for none; they do not overlap.  An edge within a function is never supported.  One sweep
    over each section finds the functions on both sides of every address."""
    held = F.struct("start", "end", "owner")
    marks = functions.select("section", F.col("start").alias("at"), F.lit(1).alias("kind"), held.alias("f"), F.lit(None).cast("struct<unit:string,side:string>").alias("e"))
    named = edges.select("unit", "section", "side", "address").distinct()
    asked = F.struct(F.col("unit").cast("string").alias("unit"), "side")
    points = named.select("section", F.col("address").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(marks.schema["f"].dataType).alias("f"), asked.alias("e"))
    line = Window.partitionBy("section").orderBy("at", "kind")
    rows = marks.unionByName(points).withColumns({
        "before": F.last("f", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first("f", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)),
    })
    rows = rows.where("e is not null and not coalesce(before.end > at, false)")
    inside = F.when(F.col("e.side") == "left", F.col("after")).otherwise(F.col("before"))
    outside = F.when(F.col("e.side") == "left", F.col("before")).otherwise(F.col("after"))
    own = inside["owner"].cast("string") == F.col("e.unit")
    foreign = outside.isNull() | (outside["owner"].cast("string") != F.col("e.unit"))
    good = rows.where(F.coalesce(own & foreign, F.lit(False))).select(F.col("e.unit").alias("u"), "section", F.col("e.side").alias("side"), F.col("at").alias("address"))
    keyed = named.withColumn("u", F.col("unit").cast("string"))
    found = keyed.join(good.withColumn("supported", F.lit(True)), ["u", "section", "side", "address"], "left")
    return found.select("unit", "section", "side", "address", F.coalesce("supported", F.lit(False)).alias("supported"))


def edges_of(drafts: DataFrame) -> DataFrame:
    """(unit, section, side, address) of both edges of every draft (unit, section, draft, family, start, end)."""
    side = lambda name, at: drafts.select(*_UNIT, F.lit(name).alias("side"), F.col(at).alias("address"))
    return side("left", "start").unionByName(side("right", "end")).distinct()


def competing(edges: DataFrame) -> DataFrame:
    """Judged edges with the other supported addresses of their unit on the same side, in order.

    Lists follow the drafts of one unit and section."""
    keys = [*_UNIT, "side"]
    rivals = edges.where("supported").groupBy(*keys).agg(F.sort_array(F.collect_set("address")).alias("all"))
    rows = edges.join(rivals, keys, "left")
    others = F.coalesce(F.filter("all", lambda x: x != F.col("address")), F.array().cast("array<bigint>"))
    return rows.withColumn("competing", others).drop("all")


def tiled(ranges: DataFrame, functions: DataFrame, padding: int = T.padding) -> DataFrame:
    """The (unit, section, start, end) that functions fill without crossing an edge or leaving more than padding."""
    wide = ranges.select(*_UNIT, F.col("start").alias("start2"), F.col("end").alias("end2"))
    rows = overlapping(functions.select("section", "start", "end"), wide, ["section"])
    line = Window.partitionBy(*_UNIT, "start2", "end2").orderBy("start")
    gap = F.col("start") - F.coalesce(F.lag("end").over(line), F.col("start2"))
    rows = rows.withColumn("gap", gap).groupBy(*_UNIT, "start2", "end2").agg(
        F.bool_and((F.col("start") >= F.col("start2")) & (F.col("end") <= F.col("end2")) & (F.col("gap") <= padding)).alias("good"), F.max("end").alias("last")
    )
    return rows.where((F.col("good")) & (F.col("end2") - F.col("last") <= padding)).select(*_UNIT, F.col("start2").alias("start"), F.col("end2").alias("end"))


def compatible(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys whose members (target_start, target_end, source_start) lie in [start, end), each target has one source,
    and sources rise with targets; with the number of targets."""
    each = members.groupBy(*keys, "start", "end", "target_start").agg(F.min("source_start").alias("source"), F.max("source_start").alias("other"), F.max("target_end").alias("target_end"))
    line = Window.partitionBy(*keys).orderBy("target_start")
    inside = (F.col("target_start") >= F.col("start")) & (F.col("target_end") <= F.col("end"))
    good = inside & (F.col("source") == F.col("other")) & F.coalesce(F.lag("source").over(line) < F.col("source"), F.lit(True))
    out = each.withColumn("good", good).groupBy(*keys).agg(F.bool_and("good").alias("good"), F.count(F.lit(1)).alias("members"))
    return out.where("good").drop("good")


def compositions(drafts: DataFrame, members: DataFrame, functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(unit, section, start, end, left_families, right_families, members): the claim between two edges of different drafts.

    drafts: (unit, section, draft, family, start, end), draft numbering them; members: (unit, section,
    draft, target_start, target_end, source_start); ranges: (unit, section, start, end), what units hold.
    The range may not reach another unit's, functions fill it, and the first draft of each edge
    agree about their members."""
    good = judged(edges_of(drafts), functions).where("supported")
    at = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("address")))
    one = good.groupBy(*_UNIT).agg(at("left").alias("l"), at("right").alias("r")).where("size(l) = 1 and size(r) = 1")
    found = one.select(*_UNIT, F.col("l")[0].alias("start"), F.col("r")[0].alias("end")).where("start < end")
    found = written(found.join(drafts.select(*_UNIT, "start", "end"), [*_UNIT, "start", "end"], "left_anti"))
    wide = found.select(*_UNIT, F.col("start").alias("start2"), F.col("end").alias("end2"))
    held = ranges.where("start < end").select("section", F.col("unit").alias("holder"), "start", "end")
    reached = overlapping(held, wide, ["section"]).where("holder <> unit").select(*_UNIT).distinct()
    found = written(found.join(reached, _UNIT, "left_anti"))
    found = found.join(tiled(found, functions), [*_UNIT, "start", "end"], "left_semi")
    placed = drafts.select(*_UNIT, "draft", "family", F.col("start").alias("d_start"), F.col("end").alias("d_end")).join(found, _UNIT)
    number = F.struct("draft", "family")
    sides = placed.groupBy(*_UNIT, "start", "end").agg(*(F.sort_array(F.collect_list(F.when(F.col(f"d_{e}") == F.col(e), number))).alias(e[0]) for e in ("start", "end")))
    families = lambda c: F.array_join(F.array_distinct(F.transform(c, lambda x: x["family"])), "+")
    sides = sides.select(*_UNIT, "start", "end", F.col("s")[0]["draft"].alias("first"), F.col("e")[0]["draft"].alias("second"), families("s").alias("left_families"), families("e").alias("right_families"))
    both = sides.select(*_UNIT, "start", "end", F.explode(F.array("first", "second")).alias("draft")).distinct()
    agreed = compatible(both.join(members, [*_UNIT, "draft"]), _UNIT)
    return sides.join(agreed, _UNIT).drop("first", "second")
