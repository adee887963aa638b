"""Runs of neighbouring units divided among their target functions together.

Units whose placed ranges are missing or at odds with their independent members are taken
with their neighbours in source order, a few at a time.  The target functions from the first
to the last member form the window; functions without an owner are taken in at its ends up
to the next owned one.  One division of the window that leaves nothing open, and that no
other equals, moves all its units at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T
from .graph import stored
from .intervals import overlapping
from .sequence import Piece, Worth, divide

_PIECE = ("start", "end", "owner", "hints")


def source_order(source: DataFrame) -> DataFrame:
    """(section, pos, unit, single, explicit): units as they follow each other in the source; single if never taken up again.

    source: (section, unit, start, auto)."""
    line = Window.partitionBy("section").orderBy("start", "unit")
    rows = source.withColumn("new", ~F.col("unit").eqNullSafe(F.lag("unit").over(line))).where("new")
    rows = rows.withColumn("pos", F.row_number().over(line) - 1)
    again = Window.partitionBy("section", "unit")
    return rows.select("section", "pos", "unit", (F.count(F.lit(1)).over(again) == 1).alias("single"), (~F.max("auto").over(again)).alias("explicit"))


def _housed(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``functions`` with ``inside`` and ``begun``: whether a range of their owner holds all of them, or their start."""
    own = ranges.select("section", F.col("unit").alias("owner"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = functions.where("owner is not null").join(own, ["section", "owner"]).where("r_start <= start and start < r_end")
    hit = hit.groupBy("section", "index").agg(F.bool_or(F.col("end") <= F.col("r_end")).alias("inside"), F.lit(True).alias("begun"))
    return functions.join(hit, ["section", "index"], "left").fillna(False, ["inside", "begun"])


def needing(order: DataFrame, functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``order`` with ``needed``: no range, a member outside its ranges, or another unit's member begins in one."""
    held = ranges.select("section", "unit").distinct().withColumn("held", F.lit(True))
    astray = functions.where("owner is not null and not inside").select("section", F.col("owner").alias("unit")).distinct().withColumn("astray", F.lit(True))
    points = functions.where("owner is not null").select("section", "owner", "start", (F.col("start") + 1).alias("end"))
    wide = ranges.where("start < end").select("section", "unit", F.col("start").alias("start2"), F.col("end").alias("end2"))
    taken = overlapping(points, wide, ["section"]).where("owner <> unit").select("section", "unit").distinct().withColumn("taken", F.lit(True))
    keys = ["section", "unit"]
    rows = order.join(held, keys, "left").join(astray, keys, "left").join(taken, keys, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("needed", ~flag("held") | flag("astray") | flag("taken")).drop("held", "astray", "taken")


def windows(order: DataFrame, most: int = T.joint_units) -> DataFrame:
    """(section, first, last, pos): members of each window, chunks of needed units; one alone takes a neighbour."""
    line = Window.partitionBy("section").orderBy("pos")
    island = F.sum((~F.col("needed")).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = order.withColumns({"island": island, "end_of": F.max("pos").over(Window.partitionBy("section"))}).where("needed")
    at = F.row_number().over(Window.partitionBy("section", "island").orderBy("pos")) - 1
    chunks = rows.withColumn("chunk", F.floor(at / most)).groupBy("section", "island", "chunk").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("end_of").alias("end_of")
    )
    alone = F.col("first") == F.col("last")
    up = alone & (F.col("last") < F.col("end_of"))
    down = alone & ~up & (F.col("first") > 0)
    chunks = chunks.select("section", (F.col("first") - down.cast("int")).alias("first"), (F.col("last") + up.cast("int")).alias("last")).where("first < last")
    return chunks.distinct().withColumn("pos", F.explode(F.sequence("first", "last")))


def bounded(members: DataFrame, order: DataFrame, functions: DataFrame) -> DataFrame:
    """(section, first, units, left, right): windows of single, explicit units whose members follow in their order,
    with the target functions (left up to right) that an owned function or the section's end bounds."""
    own = functions.where("owner is not null").groupBy("section", F.col("owner").alias("unit")).agg(F.min("index").alias("low"), F.max("index").alias("high"))
    rows = members.join(order.select("section", "pos", "unit", "single", "explicit"), ["section", "pos"]).join(own, ["section", "unit"], "left")
    rows = rows.withColumn("after", F.lag("high").over(Window.partitionBy("section", "first", "last").orderBy("pos")))
    good = F.col("single") & F.col("explicit") & F.col("low").isNotNull() & F.coalesce(F.col("after") < F.col("low"), F.lit(True))
    found = rows.groupBy("section", "first", "last").agg(
        F.bool_and(good).alias("good"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("units"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ).where("good")
    line = Window.partitionBy("section").orderBy("index")
    held = F.when(F.col("owner").isNotNull(), F.col("index"))
    near = functions.select(
        "section", "index", F.max(held).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min(held).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("behind"), F.max("index").over(Window.partitionBy("section")).alias("top"),
    )
    found = found.join(near.select("section", F.col("index").alias("low"), "before"), ["section", "low"]).join(near.select("section", F.col("index").alias("high"), "behind", "top"), ["section", "high"])
    left = F.greatest(F.col("low") - T.joint_reach, F.coalesce("before", F.lit(-1)) + 1, F.lit(0))
    right = F.least(F.col("high") + T.joint_reach, F.coalesce("behind", F.col("top") + 1) - 1, F.col("top")) + 1
    found = found.withColumns({"left": left, "right": right})
    closed = ((F.col("left") == 0) | F.coalesce(F.col("before") == F.col("left") - 1, F.lit(False))) & ((F.col("right") > F.col("top")) | F.coalesce(F.col("behind") == F.col("right"), F.lit(False)))
    return found.where(closed).select("section", "first", "units", "left", "right", "top")


def _worth(pieces: list[Piece], hints: dict[int, set[str]], padding: int):
    """What a segment is worth: its unit's own functions, and others that lie between two of them or may be its own by a match."""

    def worth(unit: str, start: int, end: int) -> Worth | None:
        part = [p for p in pieces if start <= p.start < end]
        gaps = [b.start - a.end for a, b in zip(part, part[1:], strict=False)] + [end - part[-1].end] if part else [padding + 1]
        if any(g < 0 or g > padding for g in gaps):
            return None
        own = [p.start for p in part if p.owner == unit]
        open_ = [p for p in part if p.owner is None]
        if not own or any(not own[0] < p.start < own[-1] and unit not in hints[p.start] for p in open_):
            return None
        return Worth(len(own), not open_, len(open_), sum(gaps))

    return worth


def _divided(padding: int):
    def run(units: pd.Series, pieces: pd.Series, end: pd.Series) -> pd.DataFrame:
        out = []
        for names, found, last in zip(units, pieces, end, strict=True):
            each = [Piece(p["start"], p["end"], p["owner"]) for p in found]
            hints = {p["start"]: set(p["hints"]) for p in found}
            d = divide(each, last, list(names), _worth(each, hints, padding))
            best = [f"{u}:{a}-{b}" for u, a, b in d.best] if d.status == "decisive" else []
            out.append((d.status, best))
        return pd.DataFrame(out, columns=["status", "placements"])

    return F.pandas_udf(run, "status string, placements array<string>")


def joint_runs(source: DataFrame, functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(section, units, functions, status, placements): every bounded window and its division.

    functions: (section, index, start, end, owner, hints), the target's functions by address, with
    the unit that independent evidence gives them and the units that other matches name; ranges:
    (section, unit, start, end), what is placed now.  Status: decisive, ambiguous, incomplete,
    exhausted, or function-limit-reached for windows of more than 40 functions, which are not
    searched.  Windows that stray from their bounds or have nothing to change give no row.  The
    functions, the order, the windows and the divisions are written to the shared folder before this
    returns, so that the search runs once however often its result is read."""
    functions = stored(_housed(functions, ranges))
    order = stored(needing(source_order(source), functions, ranges))
    found = stored(bounded(windows(order), order, functions))
    wide = F.col("right") - F.col("left") > T.joint_functions
    over = found.where(wide).select("section", "units", (F.col("right") - F.col("left")).cast("long").alias("functions"), F.lit("function-limit-reached").alias("status"), F.array().cast("array<string>").alias("placements"))
    rows = found.where(~wide).withColumn("index", F.explode(F.sequence(F.col("left") - 1, F.col("right"))))
    rows = rows.join(functions, ["section", "index"])
    inside = (F.col("index") >= F.col("left")) & (F.col("index") < F.col("right"))
    stranger = inside & F.col("owner").isNotNull() & ~F.array_contains("units", F.col("owner"))
    rows = rows.groupBy("section", "first", "units", "left", "right").agg(
        F.sort_array(F.collect_list(F.when(inside, F.struct(*_PIECE)))).alias("pieces"), F.bool_or(stranger).alias("strange"),
        F.max(F.when(F.col("index") == F.col("left") - 1, F.col("end"))).alias("opened"), F.max(F.when(F.col("index") == F.col("right"), F.col("start"))).alias("closed"),
        F.bool_and(F.when(inside, F.col("begun"))).alias("settled"),
    ).where("not strange and not settled")
    head, tail = F.col("pieces")[0]["start"], F.element_at("pieces", -1)["end"]
    end = F.coalesce("closed", tail)
    rows = rows.where((head - F.coalesce("opened", head) <= T.padding) & (end - tail <= T.padding))
    rows = rows.withColumn("divided", _divided(T.padding)("units", "pieces", end))
    rows = rows.select("section", "units", F.size("pieces").cast("long").alias("functions"), "divided.status", "divided.placements")
    return stored(_joined(rows.unionByName(over)))


def _joined(rows: DataFrame) -> DataFrame:
    text: Column = F.array_join(F.transform("units", lambda x: x.cast("string")), "|")
    return rows.select("section", text.alias("units"), "functions", "status", F.array_join("placements", "|").alias("placements"))


def contested(rows: DataFrame) -> DataFrame:
    """``rows`` of joint_runs with ``conflict``: whether another decisive window gives one of its units another place."""
    each = rows.where("status = 'decisive'").select("section", "units", F.explode(F.split("placements", "[|]")).alias("p"))
    each = each.withColumn("unit", F.substring_index("p", ":", 1))
    clash = each.groupBy("section", "unit").agg(F.count_distinct("p").alias("n")).where("n > 1")
    hit = each.join(clash, ["section", "unit"]).select("section", "units").distinct().withColumn("conflict", F.lit(True))
    return rows.join(hit, ["section", "units"], "left").fillna(False, ["conflict"])
